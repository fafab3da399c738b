"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapwise.llm.bpe import bpe_digests
from gapwise.llm.chains import shared_passages
from gapwise.llm.collocations import collocations
from gapwise.llm.content_sort import exact_duplicates
from gapwise.llm.fm_index import contamination_digests
from gapwise.llm.jaccard_join import jaccard_groups
from gapwise.llm.page_text import page_texts
from gapwise.llm.prefix_counts import prefix_table, token_counts
from gapwise.llm.repeats import without_repeats
from gapwise.llm.shared import keep
from gapwise.llm.token_files import read_tokens, write_tokens
from gapwise.llm.toxicity import toxicity_scores
from gapwise.llm.turn_repair import conversation_repairs, damaged
from gapwise.llm.warc import read_warc, write_warc

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(_table(spark, sf_dir, "pages")))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_table(spark, sf_dir, "pages"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return read_tokens(manifest, as_ids=False)


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"), digests=True)


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(_table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(_table(spark, sf_dir, "documents"),
                                 _table(spark, sf_dir, "benchmark"))


def bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def turn_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversation_repairs(damaged(turns), turns)


def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prefix_table(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))
    return token_counts(keep(table, "prefixes"), limit=4096)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": warc,
    "op2_page_text": main_text,
    "op3_toxicity": toxicity,
    "op4_ngram_jaccard": ngram_jaccard,
    "op5_token_files": token_files,
    "op6_repeats": repeats,
    "op7_decontamination": decontamination,
    "op8_chains": chains,
    "op9_bpe": bpe_codes,
    "op10_content_sort": content_sort,
    "op11_turn_repair": turn_repairs,
    "op12_prefix_counts": prefix_counts,
    "op13_collocations": phrases,
}

ORACLES = {
    "op10_content_sort": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
                   FROM documents),
        r AS (SELECT doc_id, norm,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size
              FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM r""",
    "op13_collocations": r"""
        WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS text
                   FROM documents),
        pieces AS (SELECT doc, lang, generate_subscripts(p, 1) AS piece, unnest(p) AS text
                   FROM (SELECT doc, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS p FROM t)),
        words AS (SELECT doc, lang, piece, generate_subscripts(w, 1) AS pos, unnest(w) AS w1
                  FROM (SELECT doc, lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces)),
        runs AS (SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3
                 FROM words WINDOW s AS (PARTITION BY doc, piece ORDER BY pos)),
        one AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
        two AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
        three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL
                  GROUP BY ALL HAVING count(*) >= 10),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
        inside AS (SELECT lang, w1, w2, max(f) AS most
                   FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three)
                   GROUP BY ALL),
        found AS (
            SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1 AS k
            FROM two p JOIN one x ON x.lang = p.lang AND x.w1 = p.w1
            JOIN one y ON y.lang = p.lang AND y.w1 = p.w2
            LEFT JOIN inside i ON i.lang = p.lang AND i.w1 = p.w1 AND i.w2 = p.w2
            WHERE p.f >= 10 AND (i.most IS NULL OR 100 * i.most < 50 * p.f)
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
            FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1
            JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
            FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
            JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
        scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM found),
        cut AS (SELECT * FROM scored
                QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (
                       PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM cut)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
        WHERE rank <= 2000""",
}
