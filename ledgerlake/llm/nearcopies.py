r"""Near copies on word shingles: SimHash finds the candidates, exact similarity decides.

Two texts are linked if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more; documents of one
component are near copies. At 0.8 the bits of two fingerprints differ with probability arccos(2J / (1 + J)) / pi = 0.15,
more than the radius of op8 allows, so:

1. A text has a fingerprint of BITS bits. Groups are made by samples of its bits, as many samples as a pair of just 0.8
   needs to meet in MEETINGS groups on average. In a group, a table holds each fingerprint's Hamming distances to PIVOTS
   reference fingerprints, as in op8: pairs that differ by more than RADIUS in one of them are out, the others are
   compared bit by bit, and those within RADIUS bits are candidates. The table prunes few pairs at this radius, since
   distances of unrelated fingerprints to a pivot vary by less; it loses none.
2. Candidates' components (a superset of those sought, as far as SimHash finds them) are dealt out with their texts, and
   all pairs of a component are compared by their shingle sets, exactly.

A pair that meets in no group or lies outside the radius is lost unless others join it; nothing is linked wrongly. Groups
and components of more than CHUNK or TEXTS rows are dealt out as pairs of chunks; tasks return spanning forests.

Cases: texts are compared by their hash, so equal ones are one; null texts, empty ones and white space alone have no
shingle and are alike; a text of one to five words is one shingle; null doc_ids come last in the choice of a component's
row; an empty table gives no rows.
"""

from __future__ import annotations

from math import acos, ceil, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, sized, skewed_left, written
from .components import components
from .simhash import PIVOTS, _bit_counts, forest, shingle_hashes

SHINGLE, LEAST, BITS, RADIUS, MEETINGS, CHUNK, TEXTS, SEED = 5, 0.8, 128, 32, 6, 1000, 250, 42
BYTES = 2 << 20  # of text in a chunk, very long texts apart
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Further 64 bits of a hash (the finaliser of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fingerprint(text: bytes | None) -> tuple[int, int]:
    h = shingles(text)
    halves = (np.packbits(_bit_counts(x) * 2 > len(x), bitorder="little").view("<i8")[0] for x in (h, _mixed(h)))
    return tuple(map(int, halves))


def _fingerprint_batches(batches):
    for b in batches:
        found = [fingerprint(t.as_py()) for t in b.column(2).cast(pa.binary())]
        x, y = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["doc_id", "text_hash", "x", "y"])


def samples(n: int, least: float = LEAST) -> list[tuple[int, int]]:
    """Masks (of x, of y) to group n texts by, one or two texts a group unless they are alike."""
    agree = 1 - acos(2 * least / (1 + least)) / pi
    bits = max(8, ceil(log2(max(n, 2))) - 1)
    draw = np.random.default_rng(SEED)
    chosen = (draw.choice(BITS, bits, replace=False).tolist() for _ in range(ceil(MEETINGS / agree**bits)))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(signed(sum(1 << b for b in c if b < 64)), signed(sum(1 << b - 64 for b in c if b >= 64))) for c in chosen]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of (x, y)."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, (n, 2), np.uint64)


def distances(x: np.ndarray, y: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances of fingerprints to references."""
    return (np.bitwise_count(x[:, None] ^ refs[None, :, 0]) + np.bitwise_count(y[:, None] ^ refs[None, :, 1])).astype(np.int16)


def _candidates(group: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, refs: np.ndarray):
    """Yield places (i, j) of texts of one group within the radius; rows are sorted by group."""
    coords = distances(x, y, refs)
    left = np.arange(len(group))
    for d in range(1, len(group)):
        left = left[left + d < len(group)]
        left = left[group[left] == group[left + d]]
        if not len(left):
            return
        i = left
        for p in range(len(refs)):
            i = i[np.abs(coords[i, p] - coords[i + d, p]) <= radius]
            if not len(i):
                break
        i = i[np.bitwise_count(x[i] ^ x[i + d]) + np.bitwise_count(y[i] ^ y[i + d]) <= radius]
        if len(i):
            yield i, i + d


def _joined(a: list, b: list) -> tuple[list, list]:
    fa, fb = forest(np.concatenate(a), np.concatenate(b))
    return [fa], [fb]


def _candidate_batches(batches, radius: int):
    kept, refs = None, pivots()

    def solve(group, node, x, y):
        a, b, held = [], [], 0
        for i, j in _candidates(group, x.view(np.uint64), y.view(np.uint64), radius, refs):
            a.append(node[i])
            b.append(node[j])
            held += len(i)
            if held > 1 << 20:
                a, b = _joined(a, b)
                held = len(a[0])
        if a:
            a, b = _joined(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], schema=EDGES)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            cols = [np.concatenate(c) for c in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = np.searchsorted(cols[0], cols[0][-1])  # the last group may go on in the next batch
        if cut:
            yield from solve(*(c[:cut] for c in cols))
        kept = [c[cut:] for c in cols]
    if kept is not None:
        yield from solve(*kept)


def alike(sets: list[np.ndarray], least: float = LEAST):
    """Yield places (i, places j > i) of sets with a Jaccard similarity of at least so much; two empty sets are alike."""
    size = np.array([len(s) for s in sets])
    words, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    holders, begin = row[order], np.searchsorted(column[order], np.arange(len(words) + 1))
    ends = np.cumsum(size)
    for i in range(len(sets)):
        mine = column[ends[i] - size[i] : ends[i]]
        shared = np.zeros(len(sets), np.int64)
        if len(mine):
            shared = np.bincount(np.concatenate([holders[begin[c] : begin[c + 1]] for c in mine.tolist()]), minlength=len(sets))
        j = np.flatnonzero(shared >= least * (size + size[i] - shared))
        yield i, j[j > i]


def _verify_batches(batches, least: float):
    def solve(nodes, sets):
        a, b = [], []
        for i, j in alike(sets, least):
            if len(j):
                a.append(np.full(len(j), nodes[i]))
                b.append(np.array(nodes)[j])
        if a:
            a, b = _joined(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], schema=EDGES)

    group, nodes, sets = None, [], []
    for batch in batches:
        for g, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            if g != group:
                if len(nodes) > 1:
                    yield from solve(nodes, sets)
                group, nodes, sets = g, [], []
            nodes.append(node)
            sets.append(shingles(text.as_py()))
    if len(nodes) > 1:
        yield from solve(nodes, sets)


def _dealt(rows: DataFrame, node: str, chunk: int, payload: list[str | Column], size: Column | None = None) -> DataFrame:
    """Rows by group, sorted; chunk c of a group of more than so many rows, or of more than BYTES in size, meets each chunk d once, in group (least, greatest)."""
    pieces = F.ceil(F.count("*") / chunk)
    pieces = pieces if size is None else F.greatest(pieces, F.ceil(F.sum(size) / BYTES))
    hot = written(rows.groupBy("group").agg(pieces.cast("int").alias("s")).where(F.col("s") > 1), "hot")
    own = F.pmod(F.xxhash64(node), F.col("s")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda d: F.xxhash64("group", F.least(own, d), F.greatest(own, d)))
    rows = rows.join(sized(hot, hot.count() * 32), "group", "left")
    rows = rows.select(F.explode(F.when(F.col("s").isNull(), F.array("group")).otherwise(cells)).alias("group"), *payload)
    return rows.repartition("group").sortWithinPartitions("group")


def candidates(texts: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(text_hash, x, y), one row a text, to links (a, b) that span the components of all candidate pairs."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(samples(n))])
    rows = texts.select("text_hash", "x", "y", F.explode(masks).alias("m"))
    rows = rows.withColumn("group", F.xxhash64("m.t", F.col("x").bitwiseAND(F.col("m.x")), F.col("y").bitwiseAND(F.col("m.y"))))
    return _dealt(rows.drop("m"), "text_hash", CHUNK, ["text_hash", "x", "y"]).mapInArrow(lambda it: _candidate_batches(it, radius), "a long, b long")


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, text) to (doc_id, text_hash, component_id, component_hash), a row for each row of docs.

    The last two name the row of the component that is least by doc_id (null last), then text_hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    prints = written(rows.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, x long, y long"), "fingerprints")
    texts = written(prints.groupBy("text_hash").agg(F.min("x").alias("x"), F.min("y").alias("y")), "texts")
    rough = components(candidates(texts, texts.count()))
    rough = written(rough.select(F.col("node").alias("text_hash"), F.col("label").alias("group")), "rough")
    # each text once: copies are dealt over tasks, and one a task is left before texts move again
    once = skewed_left(rows.select("text_hash", "text"), rough, "text_hash", rough.count() * 32).where("group is not null")
    once = once.groupBy("text_hash", "group").agg(F.min("text").alias("text"))
    links = _dealt(written(once, "once"), "text_hash", TEXTS, ["text_hash", "text"], F.octet_length("text")).mapInArrow(lambda it: _verify_batches(it, least), "a long, b long")
    found = components(links).withColumnRenamed("node", "text_hash")
    found = written(found, "found")
    discard(rough)
    labelled = skewed_left(prints.select("doc_id", "text_hash"), found, "text_hash", found.count() * 32).withColumn("label", F.coalesce("label", "text_hash"))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))).alias("first"))
    first = written(first, "first")
    out = skewed_left(labelled, first, "label", first.count() * 64)
    return out.select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash"))
