"""Exact token counts of every prefix of a text.

A piece model merges neighbours by score, so what the tokens of a prefix are follows from its
last token: of all pieces that end the prefix, just one also stands behind the last token of
the shorter prefix without merging with it. One pass over a text therefore gives the count of
every prefix, and a stored table of counts answers how many tokens the first n characters
have, or how many characters fit a budget, without encoding anything again.

Where two characters stand side by side in no piece, such as a letter and the space behind it,
nothing is ever merged; texts are cut there, and a task works each distinct segment out once.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.shared import frugal, texts
from gapwise.llm.units import gather
from gapwise.llm.words import CHUNK_BYTES, chunks

SPACE = "▁"
# A text with every kind of white space and characters that other normalisers would change.
_PROBE = "  ﬁ x²  \tÅ Ａ  é "
# Distinct segments and bytes of their counts, twice, and pairs of pieces that a worker keeps.
KEPT_SEGMENTS, KEPT_BYTES, KEPT_PAIRS = 250_000, 16_000_000, 300_000

# Segments of up to so many characters are worked out side by side, so many at a time.
SHORT, SIDE_BY_SIDE = 48, 20_000
# Texts are cut into segments by so many bytes, and into prefixes by CHUNK_BYTES.
TOGETHER_BYTES = 8 << 20
_PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)

_SCHEMA = "doc_id long, n_bytes long, n_chars long, n_tokens long, deltas binary"


class PieceModel:
    """Merging by scores, and the counts of all prefixes of a segment.

    Takes sentencepiece models of kind BPE with byte fallback that leave texts as they are,
    put one space in front, and whose runs of spaces merge after all else; any other model
    raises ValueError. Strings of special pieces in a text are
    ordinary text.
    """

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i)
                                        or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        runs = {p: s for p, s in self.score.items() if len(p) > 1 and not p.strip(SPACE)}
        rest = {p: s for p, s in self.score.items() if p not in runs}
        self.period = max(map(len, runs), default=1)
        lead = model.encode(_PROBE, out_type=str)[0]
        if (sum(model.is_byte(i) for i in ids) != 256 or lead[0] != SPACE
                or model.decode(model.encode(_PROBE)) != _PROBE
                or any(SPACE in p[1:] for p in rest)
                or runs and min(s for p, s in rest.items() if len(p) > 1) <= max(runs.values())):
            raise ValueError("prefix counts need a BPE piece model with byte fallback, "
                             "no normalisation and plain runs of spaces")
        self.runs = [len(self.merged(SPACE * n)) for n in range(4 * self.period)]
        if any(b != a + 1 for a, b in zip(self.runs, self.runs[self.period:])):
            raise ValueError("the tokens of long runs of spaces do not repeat")
        self.score = rest
        # Sizes of the pieces that end in the same two characters, longest first.
        self.sizes: dict[str, list[int]] = {}
        for piece in sorted(rest, key=len, reverse=True):
            sizes = self.sizes.setdefault(piece[-2:], [])
            if len(piece) > 1 and len(piece) not in sizes:
                sizes.append(len(piece))
        # Pieces by number and, for every size, the hashes of those of that size in order.
        self.pieces = list(rest)
        self.unknown = len(self.pieces)
        self.space = self.pieces.index(SPACE)
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(p) for p in self.pieces])
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            codes = _codes("".join(self.pieces[i] for i in own)).reshape(-1, size)
            value = np.zeros(len(own), np.uint64)
            for column in codes.T:
                value = value * _BASE + column
            order = np.argsort(value)
            self.hashes[size] = value[order], own[order].astype(np.int32)
        self.number_pairs: dict[int, bool] = {}
        # Pairs of ASCII characters that stand side by side in no piece.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for piece in self.pieces:
            for a, b in zip(piece.encode(), piece.encode()[1:]):
                self.apart[a, b] = False
        self.apart[32] = False
        self.apart[:, 32] = [b != 32 for b in range(256)]
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text, self.last, self.count, self.bare = "", [""], [0], [False]

    def merged(self, text: str) -> list[str]:
        """Neighbours merged by score, leftmost first among equals, until none fits."""
        return self._merges(text)[0]

    def _merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, score, final = list(text), self.score, None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, final
            final = parts[at], parts[at + 1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What a piece is merged from in the end; None for a single character."""
        if piece not in self.parts:
            parts, final = self._merges(piece)
            self.parts[piece] = final if len(parts) == 1 else ("", piece)
        return self.parts[piece]

    def _stands(self, piece: str) -> bool:
        """Whether a piece, merged on its own, becomes this one piece."""
        halves = self._halves(piece)
        return halves is None or halves[0] != ""

    def _follows(self, left: str, right: str) -> bool:
        """Whether two pieces side by side stay as they are: going back in time through
        their merges, none of the pairs that meet between them would have merged first."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        known = self._stands(left) and self._stands(right)
        a, b, score, limit, strict = left, right, self.score, -math.inf, False
        while known:
            met = score.get(a + b)
            if met is not None and (met > limit or not strict and met == limit):
                known = False
                break
            a_parts, b_parts = self._halves(a), self._halves(b)
            if a_parts is None and b_parts is None:
                break
            # The later merge is undone first: the one of lower score, of equals the right one.
            if b_parts is None or a_parts is not None and score[a] < score[b]:
                a, limit, strict = a_parts[1], score[a], True
            else:
                b, limit, strict = b_parts[0], score[b], False
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def run(self, n: int) -> int:
        """Tokens of ``n`` spaces."""
        return n // self.period + self.runs[n % self.period]

    def _extend(self, text: str) -> None:
        """The tables of ``text``; what it shares with the text before it is there already."""
        last, count, bare, score, pairs = self.last, self.count, self.bare, self.score, self.pairs
        old = self.text
        same = 0
        for x, y in zip(old, text):
            if x != y:
                break
            same += 1
        del last[same + 1:], count[same + 1:], bare[same + 1:]
        self.text = text
        for end in range(same + 1, len(text) + 1):
            for size in self.sizes.get(text[max(end - 2, 0):end], ()):
                start = end - size
                if start < 0:
                    continue
                piece = text[start:end]
                if piece not in score:
                    continue
                if start:
                    fits = pairs.get((last[start], piece))
                    if fits or fits is None and self._follows(last[start], piece):
                        break
                elif self._stands(piece):
                    break
            else:
                start, piece = end - 1, text[end - 1]
            last.append(piece)
            count.append(count[start] + (1 if piece in score else len(piece.encode())))
            bare.append(bare[start] if start else piece == SPACE)

    def counts(self, segment: str) -> list[int]:
        """Token counts of all prefixes of a segment, spaces first. Segments in sorted order
        share the work on what they begin with."""
        word = segment.lstrip(" ")
        k = len(segment) - len(word)
        self._extend(SPACE + word if k else word)
        if k < 2:
            return self.count[1:]
        # Where the last space belongs to the word's first piece, one space less is left over.
        spaces = [self.run(n) for n in range(k + 1)]
        left = {True: spaces[k] - 1, False: spaces[k - 1]}
        return spaces[1:] + [c + left[b] for c, b in zip(self.count[2:], self.bare[2:])]


    def _all_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_follows`` for pairs of numbers; a left number of -1 asks whether the right one
        stands alone. An unknown character is no part of any piece."""
        keys, back = np.unique((left.astype(np.int64) + 1) << 20 | right, return_inverse=True)
        known, pieces, found = self.number_pairs, self.pieces, []
        if len(known) > KEPT_PAIRS:
            known.clear()
        for key in keys.tolist():
            fits = known.get(key)
            if fits is None:
                a, b = (key >> 20) - 1, key & 0xFFFFF
                if b == self.unknown:
                    fits = True
                elif a in (-1, self.unknown):
                    fits = self._stands(pieces[b])
                else:
                    fits = self._follows(pieces[a], pieces[b])
                known[key] = fits
            found.append(fits)
        return np.array(found, bool)[back]

    def all_counts(self, segments: list[str]) -> list[bytes]:
        """``counts`` of many segments, as bytes of 32-bit numbers: column by column for all
        short ones, a segment of more than SHORT characters by itself."""
        out = [b""] * len(segments)
        spaces = np.array([len(s) - len(s.lstrip(" ")) for s in segments])
        sizes = np.array([len(s) for s in segments]) - spaces + (spaces > 0)
        short = np.flatnonzero(sizes <= SHORT)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = array("i", self.counts(segments[i])).tobytes()
        # Longest first, so that those which reach a column are the first rows.
        short = short[np.argsort(-sizes[short], kind="stable")]
        for at in range(0, len(short), SIDE_BY_SIDE):
            some = short[at:at + SIDE_BY_SIDE]
            self._side_by_side(segments, some, sizes[some], spaces[some], out)
        return out

    def _side_by_side(self, segments: list[str], short: np.ndarray, sizes: np.ndarray,
                      spaces: np.ndarray, out: list[bytes]) -> None:
        """Fill in ``out`` for the segments ``short``, longest first."""
        texts_ = [(SPACE if k else "") + segments[i].lstrip(" ") for i, k in zip(short.tolist(), spaces.tolist())]
        n, most = len(short), int(sizes[0])
        rows = np.repeat(np.arange(n), sizes)
        columns = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = np.zeros((most, n), np.uint64)
        code[columns, rows] = _codes("".join(texts_))
        hashed = np.zeros((most + 1, n), np.uint64)
        for j in range(most):
            hashed[j + 1] = hashed[j] * _BASE + code[j]
        last = np.full((most + 1, n), -1, np.int32)
        count = np.zeros((most + 1, n), np.int32)
        bare = np.zeros((most + 1, n), bool)
        powers = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(max(self.hashes) + 1)]
        for end in range(1, most + 1):
            todo = np.arange(int(np.searchsorted(-sizes, -end, "right")))
            for size in sorted(self.hashes, reverse=True):
                start = end - size
                if start < 0 or not len(todo):
                    continue
                table, numbers = self.hashes[size]
                value = hashed[end, todo] - hashed[start, todo] * powers[size]
                at = np.minimum(np.searchsorted(table, value), len(table) - 1)
                piece = np.where(table[at] == value, numbers[at], self.unknown).astype(np.int32)
                fits = piece < self.unknown
                if size > 1:
                    own = np.flatnonzero(fits)
                    fits[own] = self._all_follow(last[start, todo[own]], piece[own])
                else:
                    fits[:] = True
                done, piece = todo[fits], piece[fits]
                cost = np.ones(len(done), np.int32)
                if size == 1:
                    c = code[start, done]
                    wide = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                    cost = np.where(piece == self.unknown, wide, 1).astype(np.int32)
                last[end, done] = piece
                count[end, done] = count[start, done] + cost
                bare[end, done] = bare[start, done] if start else piece == self.space
                todo = todo[~fits]
        runs = {}
        for j, (i, size, k) in enumerate(zip(short.tolist(), sizes.tolist(), spaces.tolist())):
            own = count[1:size + 1, j]
            if k > 1:
                if k not in runs:
                    runs[k] = np.array([self.run(m) for m in range(1, k + 1)], np.int32)
                left = np.where(bare[2:size + 1, j], self.run(k) - 1, self.run(k - 1))
                own = np.concatenate([runs[k], own[1:] + left.astype(np.int32)])
            out[i] = own.tobytes()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


class _Segments:
    """Counts of the distinct segments a worker has met, as bytes of 32-bit numbers. When
    they are too many, those that were not needed again are forgotten."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.size = 0

    def of(self, segments: list[bytes]) -> list[bytes]:
        if len(self.known) > KEPT_SEGMENTS or self.size > KEPT_BYTES:
            self.before, self.known, self.size = self.known, {}, 0
        known, before = self.known, self.before
        fresh = []
        for s in segments:
            if s not in known:
                counts = before.get(s)
                if counts is None:
                    fresh.append(s)
                else:
                    known[s] = counts
                    self.size += len(counts)
        for s, counts in zip(fresh, self.model.all_counts([s.decode() for s in fresh])):
            known[s] = counts
            self.size += len(counts)
        return [known[s] for s in segments]


def _cuts(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> np.ndarray:
    at = np.zeros(len(data) + 1, bool)
    # Piece by piece, as look-ups take eight bytes for every byte.
    for i in range(0, len(data) - 1, _PIECE):
        before, after = data[i:min(i + _PIECE, len(data) - 1)], data[i + 1:i + 1 + _PIECE]
        at[i + 1:i + 1 + len(before)] = apart[before, after]
    at[offsets] = True
    return np.flatnonzero(at)


def _table(batches: Iterator[pa.RecordBatch], proto: bytes, prefixes: bool
           ) -> Iterator[pa.RecordBatch]:
    """Texts with one space in front in, counts out."""
    segments = _Segments(PieceModel(proto))
    for batch in batches:
        rows = pa.RecordBatch.from_pydict({"doc_id": np.arange(batch.num_rows), "text": batch["text"]})
        for which, data, offsets in chunks(iter([rows]), TOGETHER_BYTES):
            at = _cuts(data, offsets, segments.model.apart)
            column = pa.Array.from_buffers(
                pa.large_binary(), len(at) - 1,
                [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])
            coded = pc.dictionary_encode(column)
            counts = segments.of(coded.dictionary.to_pylist())
            code, first = coded.indices.to_numpy(), np.searchsorted(at, offsets)
            del column, coded, at
            a = 0
            while a < len(which):
                b = int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1
                b = min(max(b, a + 1), len(which))
                own = batch.slice(int(which[a]), b - a)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": own["doc_id"], "n_bytes": own["n_bytes"],
                    **_counts(counts, code[first[a]:first[b]], first[a:b + 1] - first[a], prefixes)})
                a = b


def _counts(known: list[bytes], code: np.ndarray, first: np.ndarray, prefixes: bool) -> dict:
    """Columns of some texts from their segments: the number of each, and where a text's
    segments begin."""
    used, code = np.unique(code, return_inverse=True)
    own = [known[i] for i in used.tolist()]
    flat = np.frombuffer(b"".join(own), np.int32)
    sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
    total = flat[np.cumsum(sizes) - 1][code]
    ends = np.concatenate([[0], np.cumsum(total)])
    chars = np.concatenate([[0], np.cumsum(sizes[code])])[first]
    columns = {
        "n_chars": np.maximum(np.diff(chars) - 1, 0), "n_tokens": np.diff(ends[first])}
    if prefixes:
        counts, _ = gather(flat, np.cumsum(sizes) - sizes, sizes, code)
        counts = counts + np.repeat(ends[:-1], sizes[code])
        deltas = np.diff(counts, prepend=0)
        # The space in front of a text is no prefix of it: its first character has the rest.
        filled = np.flatnonzero(np.diff(chars) > 0)
        keep = np.ones(len(counts), bool)
        keep[chars[filled]] = False
        after = chars[filled] + 1
        deltas[after] = counts[after] - ends[first[filled]]
        sizes_out = np.concatenate([[0], np.cumsum(columns["n_chars"])]).astype(np.int64)
        body = np.ascontiguousarray(deltas[keep].astype(np.int8))
        columns["deltas"] = pa.Array.from_buffers(
            pa.large_binary(), len(first) - 1,
            [None, pa.py_buffer(sizes_out), pa.py_buffer(body)]).cast(pa.binary())
    else:
        columns["deltas"] = pa.nulls(len(first) - 1, pa.binary())
    return columns


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                 text_col: str = "text", prefixes: bool = True) -> DataFrame:
    """Token counts of every prefix of every text.

    Columns: doc_id, n_bytes (UTF-8), n_chars (code points), n_tokens of the whole text, and
    ``deltas``: a signed byte for every code point, by which it changes the count of the
    prefix that ends with it (null where ``prefixes`` is false). A null text is empty: no
    tokens, no deltas. Rows without an id are left out; repeated rows and ids are counted
    one by one. Other columns are not read. An empty table gives an empty result.
    """
    with open(model_path, "rb") as file:
        proto = file.read()
    rows = texts(docs, id_col, text_col)
    # The model takes its own sign for a space as a space.
    plain = F.translate("text", SPACE, " ")
    led = F.when(plain != "", F.concat(F.lit(" "), plain)).otherwise("")
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), led.alias("text"))
    table = counted.mapInArrow(frugal(partial(_table, proto=proto, prefixes=prefixes)), _SCHEMA)
    return table


def _ask(batches: Iterator[pa.RecordBatch], budget: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        deltas = [np.frombuffer(d or b"", np.int8) for d in batch.column("deltas").to_pylist()]
        counts = [np.concatenate([[0], np.cumsum(d, dtype=np.int64)]) for d in deltas]
        if budget is None:
            wanted = batch.column("prefix_chars").to_pylist()
            answer = [None if w is None else int(c[min(max(w, 0), len(c) - 1)])
                      for c, w in zip(counts, wanted)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "prefix_chars": batch.column("prefix_chars"),
                "prefix_tokens": pa.array(answer, pa.int64())})
        else:
            fits = [np.flatnonzero(c <= budget)[-1] if budget >= 0 else 0 for c in counts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "fitting_chars": np.array(fits, np.int64),
                "fitting_tokens": np.array([c[f] for c, f in zip(counts, fits)], np.int64)})


def tokens_of_prefixes(table: DataFrame, chars_col: str) -> DataFrame:
    """Tokens of the first ``chars_col`` code points of every text of a prefix table that
    carries such a column; lengths beyond the text mean the whole, negative ones nothing, and
    null gives null. Columns: doc_id, prefix_chars, prefix_tokens."""
    asked = table.select("doc_id", "deltas",
                         F.col(f"`{chars_col}`").cast("long").alias("prefix_chars"))
    return asked.mapInArrow(partial(_ask, budget=None),
                            "doc_id long, prefix_chars long, prefix_tokens long")


def longest_prefixes(table: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of every text with at most ``budget`` tokens (a longer prefix may
    have fewer tokens than a shorter one). Columns: doc_id, fitting_chars, fitting_tokens."""
    return table.select("doc_id", "deltas").mapInArrow(
        partial(_ask, budget=budget), "doc_id long, fitting_chars long, fitting_tokens long")


def token_counts(table: DataFrame, limit: int) -> DataFrame:
    """Size of every text of a prefix table: doc_id, n_bytes, n_tokens, over_limit."""
    return table.select("doc_id", "n_bytes", "n_tokens",
                        (F.col("n_tokens") > limit).alias("over_limit"))
