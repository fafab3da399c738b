"""Similarity join of word shingle sets by PartEnum signatures.

The sizes of sets are cut into bands. Two sets of Jaccard similarity t that meet in a band
with sizes up to r differ in at most (1 - t) / (1 + t) * 2r features. The feature domain is
cut into n1 parts, more than half as many as that, so some part holds at most one of the
differences; each part is cut again in three, and the three choices of two thirds are
enumerated: one of them is free of differences and equal for both sets. A signature is the
hash of (band, part, choice, features there). No similar pair is missed; every candidate is
then compared in full.

Sets that are equal are one class, decided by a hash of the whole set. Candidates are not
all pairs of a signature: its members are compared with its first member, within a chunk
and then among the chunks' firsts. Where such a comparison fails, the members of that
signature that ended up in different components are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.shared import TEXT_BYTES, TEXT_ROWS, components, frugal, keep, keep_rows, texts
from gapwise.llm.words import NOT_SPACE, chunks, mix, shingles, words

# Rows of signatures a task gathers before it combines those of equal hash.
COMBINE_ROWS = 250_000
# Texts are taken together up to this many bytes.
CHUNK_BYTES = 256 << 10
# One more part than needed, so that a set with a single empty choice needs no
# signature for it (a choice that is empty in many sets would be shared by all of them).
SPARE = 1
# Pairs whose sets a task holds at a time.
PAIRS_AT_ONCE = 256
# Members of a signature that are held against each other at a time, and their pairs.
BLOCK_MEMBERS = 2_000
PAIRS_OF_MEMBERS = 1 << 17
_U = np.uint64


def shingle_sets(data, offsets, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash), distinct and in order."""
    n_docs = len(offsets) - 1
    doc, _, _, hashes = words(data, offsets, NOT_SPACE)
    of, _, value = shingles(doc, hashes, k, n_docs)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[new], value[new]


def _sum_by(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    np.add.at(out, group, value)
    return out


def _class_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in chunks(batches, CHUNK_BYTES):
        of, value = shingle_sets(data, offsets, k)
        n = len(ids)
        yield pa.RecordBatch.from_pydict({
            "doc_id": ids, "n_shingles": np.bincount(of, minlength=n),
            "sketch": _sketches(of, value, n),
            "h1": _sum_by(of, mix(value + _U(1)), n).view(np.int64),
            "h2": _sum_by(of, mix(value ^ _U(0x5851F42D4C957F2D)), n).view(np.int64)})


def _sketches(of: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """Per set, a bit for each of one to two times as many cells as features: whether an odd
    number of them fell there.

    Halving the cells combines the halves, so sketches of different sizes compare. Cells that
    differ are at most as many as the features in which two sets differ.
    """
    sizes = np.bincount(of, minlength=n)
    cells = 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    base = np.cumsum(cells // 8) - cells // 8
    code = mix(value ^ _U(0x8EBC6AF09C88C6E3))
    cell = ((code >> _U(8)) & (cells[of] - 1).astype(_U)).astype(np.int64)
    body = np.zeros(int(cells.sum()) // 8, np.uint8)
    np.bitwise_xor.at(body, base[of] + (cell >> 3), (1 << (cell & 7)).astype(np.uint8))
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(np.append(base, len(body)).astype(np.int32)),
                         pa.py_buffer(body)])


def _folded(sketches: np.ndarray, n: int) -> np.ndarray:
    """Rows of sketches in words of 64 cells, as sketches of ``n`` words."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, n), axis=1)


def _may_be_similar(batches: Iterator[pa.RecordBatch], num: int, den: int
                    ) -> Iterator[pa.RecordBatch]:
    """Pairs with sketches in; out those whose sketches do not rule similarity out."""
    for batch in batches:
        possible = []
        for sa, sb, na, nb in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb"))):
            x, y = np.frombuffer(sa, _U)[None], np.frombuffer(sb, _U)[None]
            n = min(x.size, y.size)
            apart = int(np.bitwise_count(_folded(x, n) ^ _folded(y, n)).sum())
            possible.append((den + num) * apart <= (den - num) * (na + nb))
        chosen = pa.array(possible, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).filter(chosen) for c in ("a", "b")], ["a", "b"])


class Bands:
    """Bands of set sizes and the parts of each, for ``num / den`` as least similarity.

    Band i holds sizes lows[i] to tops[i]; a set also joins the next band if a set of that
    band can still be similar to it.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.lows, self.tops = [], []
        low = 1
        while low <= largest:
            top = max(low, low * den // num)
            top = max(top, top * den // num)
            self.lows.append(low)
            self.tops.append(top)
            low = top + 1
        tops = np.array(self.tops, np.float64)
        # Differences of two sets of at most `top` features; rounded up, which costs nothing.
        self.k = np.floor(tops * 2 * (den - num) / (den + num) + 1e-9).astype(np.int64)
        # Where no difference is possible, similar sets are equal: one class, no signatures.
        self.parts = np.where(self.k > 0, self.k // 2 + 1 + SPARE, 0)
        self.num, self.den = num, den
        self.low_array = np.array(self.lows)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low_array, sizes, "right") - 1

    def reaches_next(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a set of the next band's smallest size can be similar."""
        return self.num * self.low_array[np.minimum(band + 1, len(self.lows) - 1)] <= (
            self.den * sizes)


def signatures(of: np.ndarray, value: np.ndarray, n_docs: int, bands: Bands
               ) -> tuple[np.ndarray, np.ndarray]:
    """(document number, signature) of sets given as ``shingle_sets`` gives them."""
    sizes = np.bincount(of, minlength=n_docs)
    own = bands.of(np.maximum(sizes, 1))
    place, inner = mix(value ^ _U(0xA0761D6478BD642F)), mix(value + _U(0xE7037ED1A0B428DB))
    all_docs, all_signatures = [], []
    for step in (0, 1):
        member = sizes > 0
        if step:
            member &= bands.reaches_next(sizes, own)
        band = np.minimum(own + step, len(bands.parts) - 1)
        member &= bands.parts[band] > 0
        parts = np.where(member, bands.parts[band], 0)
        cells = 3 * parts
        base = np.cumsum(cells) - cells
        total = int(cells.sum())
        if not total:
            continue
        row = member[of]
        o, p = of[row], place[row]
        part = (p >> _U(34)) % parts[o].astype(_U)
        cell = base[o] + (3 * part + (p & _U(0x3FFFFFFF)) % _U(3)).astype(np.int64)
        sums = _sum_by(cell, inner[row], total).reshape(-1, 3)
        counts = np.bincount(cell, minlength=total).reshape(-1, 3)
        chosen = sums.sum(axis=1, keepdims=True) - sums
        empty = counts.sum(axis=1, keepdims=True) - counts == 0
        doc = np.repeat(np.arange(n_docs), parts)
        number = np.arange(len(doc)) - np.repeat(base // 3, parts)
        weak = np.bincount(doc, weights=empty.any(axis=1), minlength=n_docs)
        wanted = ~empty | (weak > SPARE)[doc][:, None]
        key = mix((band[doc].astype(_U) << _U(44) | number.astype(_U) << _U(4))[:, None]
                  + np.arange(3, dtype=_U))
        code = mix(chosen + key)
        all_docs.append(np.repeat(doc, 3)[wanted.ravel()])
        all_signatures.append(code.ravel()[wanted.ravel()])
    if not all_docs:
        return np.empty(0, np.int64), np.empty(0, _U)
    return np.concatenate(all_docs), np.concatenate(all_signatures)


def _combine(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """One row per signature: its smallest document, and the others as pairs with it."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    first = doc[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
    other = ~new & (doc != first)
    kept = new | other
    return pa.RecordBatch.from_arrays(
        [pa.array(sig[kept].view(np.int64)), pa.array(first[kept]),
         pa.array(doc[kept], mask=new[kept])], ["sig", "a", "b"])


def _signature_rows(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int
                    ) -> Iterator[pa.RecordBatch]:
    bands = Bands(num, den)
    held, n = [], 0
    for ids, data, offsets in chunks(batches, CHUNK_BYTES):
        doc, sig = signatures(*shingle_sets(data, offsets, k), len(ids), bands)
        held.append((sig, ids[doc]))
        n += len(sig)
        if n >= COMBINE_ROWS:
            yield _combine(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield _combine(*map(np.concatenate, zip(*held)))


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, b null first, a) in; out the chunks' own pairs (a, b), and each
    chunk's first paired with the first of all chunks."""
    last, first = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig, a = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "a"))
        b = pc.fill_null(batch.column("b"), 0).to_numpy(zero_copy_only=False)
        inner = pc.is_valid(batch.column("b")).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = sig[1:] != sig[:-1]
        if last is not None and sig[0] == last:
            new[0] = False
        lead = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        center = np.where(lead >= 0, a[np.maximum(lead, 0)], first)
        last, first = sig[-1], center[-1]
        out = inner | (center != a)
        if out.any():
            yield pa.RecordBatch.from_pydict({
                "sig": sig[out], "a": np.where(inner, a, center)[out],
                "b": np.where(inner, b, a)[out]})


def _similar(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int
             ) -> Iterator[pa.RecordBatch]:
    """Pairs of texts in, those that are similar out."""
    for whole in batches:
        for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
            batch = whole.slice(at, PAIRS_AT_ONCE)
            similar = []
            for x, y in zip(_sets_of(batch.column("a_text"), k), _sets_of(batch.column("b_text"), k)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                similar.append(union > 0 and den * common >= num * union)
            chosen = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(chosen) for c in ("a", "b")], ["a", "b"])


def _sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each text; a text that is repeated in the next rows is taken apart once."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sets = []
    one = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(coded.dictionary))), coded.dictionary], ["doc_id", "text"])
    for ids, data, offsets in chunks([one], CHUNK_BYTES):
        of, value = shingle_sets(data, offsets, k)
        edge = np.searchsorted(of, np.arange(len(ids) + 1))
        sets += [value[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return (sets[c] for c in codes.tolist())


def with_texts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach both texts to pairs (a, b). Only texts that occur in a pair travel; both
    joins are on one id each, and adaptive execution may split a document of many pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(
        pairs.select(F.col("b").alias("doc_id"))).distinct()
    own = keep(keep_rows(rows, keep(ids, "pair-ids")), "pair-texts")
    b = own.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    a = own.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    return pairs.join(b, "b").join(a, "a")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of ``k``-word shingles have a Jaccard similarity of at
    least ``num / den``, directly or through others.

    Words are runs of characters other than white space, A-Z lower-cased. A text of fewer
    than ``k`` words, but at least one, has its whole sequence as one shingle; a null or
    empty text and one of white space have no shingles and are linked with nothing. Rows
    that repeat an id are listed each. Rows without an id are left out, other columns are
    not read; an empty table gives an empty result.
    Columns: doc_id, n_shingles, component_id (the smallest id of the group).
    """
    rows = texts(docs, id_col, text_col)
    sets = keep(rows.mapInArrow(
        frugal(partial(_class_rows, k=k)),
        "doc_id long, n_shingles long, sketch binary, h1 long, h2 long"), "sets",
        batch_rows=TEXT_ROWS)
    key = ["h1", "h2", "n_shingles"]
    classes = keep(sets.filter("n_shingles > 0").groupBy(*key).agg(
        F.min("doc_id").alias("rep")), "classes")
    member = keep(sets.join(classes, key, "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")

    found = rows.mapInArrow(frugal(partial(_signature_rows, k=k, num=num, den=den)),
                            "sig long, a long, b long")
    # The firsts of all chunks meet by signature; a chunk's own pairs are dealt out by their
    # second document too, so that a signature of very many documents is spread.
    met = found.repartition(F.xxhash64("sig", "b")).sortWithinPartitions("sig", F.col("b").isNotNull(), "a")
    pairs = keep(met.mapInArrow(frugal(_bucket_pairs), "sig long, a long, b long"), "bucket-pairs",
                 batch_bytes=TEXT_BYTES)

    def as_classes(p: DataFrame) -> DataFrame:
        """Pairs of documents as distinct pairs of classes that can be similar by size."""
        m = member.select("doc_id", "rep", "n_shingles").distinct()
        p = p.join(m.withColumnsRenamed({"doc_id": "a", "rep": "ra", "n_shingles": "na"}), "a")
        p = p.join(m.withColumnsRenamed({"doc_id": "b", "rep": "rb", "n_shingles": "nb"}), "b")
        return p.filter(
            (F.col("ra") != F.col("rb"))
            & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)).select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    def verified(p: DataFrame) -> DataFrame:
        own = sets.select("doc_id", "n_shingles", "sketch")
        p = p.join(own.withColumnsRenamed(
            {"doc_id": "b", "n_shingles": "nb", "sketch": "sb"}), "b")
        p = p.join(own.withColumnsRenamed(
            {"doc_id": "a", "n_shingles": "na", "sketch": "sa"}), "a")
        return compared(keep(p.mapInArrow(
            frugal(partial(_may_be_similar, num=num, den=den)), "a long, b long"), "close-pairs"))

    def compared(p: DataFrame) -> DataFrame:
        return keep(with_texts(p, rows).mapInArrow(
            frugal(partial(_similar, k=k, num=num, den=den)), "a long, b long"), "links",
            batch_rows=PAIRS_AT_ONCE)

    first = keep(as_classes(pairs.select("a", "b").distinct()), "candidates")
    links = verified(first)
    labels = components(links)
    label = keep(member.select("rep").distinct().join(
        labels.withColumnsRenamed({"node": "rep", "root": "label"}), "rep", "left").select(
        "rep", F.coalesce("label", "rep").alias("label")), "class-labels")
    own = sets.select(F.col("doc_id").alias("rep"), "n_shingles", "sketch")
    rest = _open_pairs(_open_members(pairs, member, label), own, num, den)
    rest = keep(rest.join(first, ["a", "b"], "left_anti"), "open-candidates")
    if not rest.isEmpty():
        labels = components(links.unionByName(compared(rest)))
    return member.join(labels.withColumnsRenamed({"node": "rep", "root": "top"}), "rep", "left"
                       ).select("doc_id", "n_shingles",
                                F.coalesce("top", "rep").alias("component_id"))


def _open_members(pairs: DataFrame, member: DataFrame, label: DataFrame) -> DataFrame:
    """(sig, rep, label): the classes in signatures whose members are not all in one component."""
    of = member.select("doc_id", "rep").distinct().join(label, "rep")
    la = of.select(F.col("doc_id").alias("a"), F.col("label").alias("la"))
    lb = of.select(F.col("doc_id").alias("b"), F.col("label").alias("lb"))
    apart = pairs.select("a", "b").distinct().join(la, "a").join(lb, "b").filter("la <> lb")
    apart = keep(apart.select("a", "b"), "apart")
    sigs = pairs.join(apart, ["a", "b"], "left_semi").select("sig").distinct()
    own = keep(pairs.join(keep(sigs, "open"), "sig", "left_semi"), "open-pairs")
    every = own.select("sig", F.col("a").alias("doc_id")).union(
        own.select("sig", F.col("b").alias("doc_id"))).distinct()
    return keep(every.join(of, "doc_id").select("sig", "rep", "label").distinct(), "open-members")


def _open_pairs(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members (sig, rep, label) of one signature, with different labels, that
    the sketches in ``sets`` (rep, n_shingles, sketch) do not rule out.

    Two members of a signature have been compared before. Very many members are dealt out in
    blocks, every block against every block; sketches join when it is known who meets where."""
    large = keep(members.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 2").select(
        "sig", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "open-sizes")
    dealt = members.join(large, "sig").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, F.col("block")).alias("p"),
                           F.greatest(j, F.col("block")).alias("q"))))
    dealt = keep(dealt.withColumn("meet", meet).select(
        "sig", "meet.p", "meet.q", "block", "rep", "label"), "dealt")
    key = ["sig", "p", "q"]
    return dealt.join(sets, "rep").repartition(*key).sortWithinPartitions(*key).mapInArrow(
        frugal(partial(_compare_blocks, num=num, den=den)), "a long, b long").distinct()


def _compare_blocks(batches: Iterator[pa.RecordBatch], num: int, den: int
                    ) -> Iterator[pa.RecordBatch]:
    """Groups (sig, p, q), sorted: members of block p against those of block q."""
    held: pa.Table | None = None

    def compared(table: pa.Table, edge: list[int]) -> Iterator[pa.RecordBatch]:
        columns = [table[c].to_numpy() for c in ("rep", "label", "n_shingles", "block", "p", "q")]
        sketches = table["sketch"].to_pylist()
        found = [pair for i, j in zip(edge[:-1], edge[1:])
                 for pair in _compare_group(*(c[i:j] for c in columns), sketches[i:j], num, den)]
        if found:
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = np.stack([table[c].to_numpy() for c in ("sig", "p", "q")])
        edge = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))).tolist()
        if table.num_rows:
            yield from compared(table.slice(0, edge[-1]), edge)
            held = table.slice(edge[-1])
    if held is not None and held.num_rows:
        yield from compared(held, [0, held.num_rows])


def _compare_group(rep: np.ndarray, label: np.ndarray, size: np.ndarray, block: np.ndarray,
                   p: np.ndarray, q: np.ndarray, sketches: list[bytes], num: int, den: int
                   ) -> Iterator[np.ndarray]:
    """Two rows, the smaller and the larger of every pair that may be similar."""
    p, q = p[0], q[0]
    length = np.array([len(s) // 8 for s in sketches])

    def by_length(chosen: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = {n: np.flatnonzero(chosen & (length == n)) for n in set(length[chosen].tolist())}
        return {n: (r, np.frombuffer(b"".join([sketches[i] for i in r.tolist()]), _U).reshape(-1, n))
                for n, r in rows.items()}

    left = by_length(block == p)
    right = left if p == q else by_length(block == q)
    for n, (one, x) in left.items():
        for m, (other, y) in right.items():
            if p == q and m < n:
                continue
            least = min(n, m)
            x_words = np.ascontiguousarray(_folded(x, least).T)
            y_words = np.ascontiguousarray(_folded(y, least).T)
            step = max(1, PAIRS_OF_MEMBERS // len(other))
            for at in range(0, len(one), step):
                # A block meets itself: every pair of it once.
                i, j = one[at:at + step], other[at if p == q and n == m else 0:]
                apart = _apart(x_words[:, at:at + step], y_words[:, len(other) - len(j):])
                near = (den + num) * apart <= (den - num) * (size[i][:, None] + size[j])
                row, col = np.nonzero(near & (label[i][:, None] != label[j]))
                i, j = i[row], j[col]
                able = den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j])
                if able.any():
                    i, j = rep[i[able]], rep[j[able]]
                    yield np.stack([np.minimum(i, j), np.maximum(i, j)])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cells in which columns of words x differ from columns of words y."""
    apart = np.zeros((x.shape[1], y.shape[1]), np.int64)
    # Three words differ in at most 192 cells, which a byte holds.
    for at in range(0, len(x), 3):
        some = np.zeros(apart.shape, np.uint8)
        for a, b in zip(x[at:at + 3], y[at:at + 3]):
            some += np.bitwise_count(a[:, None] ^ b)
        apart += some
    return apart
