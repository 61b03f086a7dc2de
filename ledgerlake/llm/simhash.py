r"""SimHash near-duplicates with pivot distance tables.

A fingerprint has bit b set if over half of the hashes (XXH64, seed 42) of a text's 4-word shingles have it. Texts with
one fingerprint are one class; classes whose fingerprints differ in at most ``radius`` bits are linked, and documents
get the smallest doc_id of their component.

Pairs to look at agree in a whole block of bits: with radius r and b blocks at least b - r blocks of a linked pair are
equal, so grouping by every choice of b - r blocks loses none; b is chosen by the number of classes so that groups stay
small. In a group, a table holds each fingerprint's Hamming distances to many reference fingerprints (pivots); by the
triangle inequality a pair that differs by more than the radius in one coordinate is no link, and only the survivors are
compared bit by bit. A group of more than CHUNK classes is dealt out as pairs of chunks, so no task gets a hot group, and
a task returns a spanning forest of its links, not all pairs.

Cases: null and empty texts, and texts of white space alone, have fingerprint zero, which is linked like any other; a
text of one to three words is one shingle; repeated rows and equal texts share a class and keep a row each; null doc_ids
keep their row and never become a component_id unless all of the component are null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, sized, skewed_left, table, written
from .components import components

SHINGLE, SEED, RADIUS, PIVOTS, CHUNK = 4, 42, 4, 16, 1000
SLICE = 1 << 17  # hashes whose bits are counted at once


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    """bytes.lower() and bytes.split() know A-Z and the six ASCII white-space characters only, as wanted."""
    found = (text or b"").lower().split()
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else []
    flat = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    begins = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], SEED) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, least significant first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None) -> int:
    hashes = np.array(shingle_hashes(text), np.uint64)
    bits = _bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        out, texts = [], batch.column(1).cast(pa.binary())
        for t in texts:
            out.append(fingerprint(t.as_py()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, fp bigint)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_plan(n: int, radius: int = RADIUS) -> list[list[int]]:
    """Bit masks to group by, for n classes: the number of blocks with the least work, rows dealt out plus pairs compared."""

    def cost(blocks: int) -> float:
        tables = comb(blocks, blocks - radius)
        return tables * n * (1 + 0.02 * n / 2 ** (64 * (blocks - radius) / blocks))

    blocks = min(range(radius + 1, radius + 7), key=cost)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b, as links to each component's least node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def linked_pairs(group: np.ndarray, fp: np.ndarray, radius: int, refs: np.ndarray):
    """Yield links (as values of fp) between rows of one group; rows are sorted by group."""
    coords = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    left = np.arange(len(fp))
    for d in range(1, len(fp)):
        left = left[left + d < len(fp)]
        left = left[group[left] == group[left + d]]
        if not len(left):
            return
        i = left
        for p in range(len(refs)):
            i = i[np.abs(coords[i, p] - coords[i + d, p]) <= radius]
            if not len(i):
                break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        i = i[fp[i] != fp[i + d]]
        if len(i):
            yield fp[i], fp[i + d]


def _link(batches, radius: int, n_pivots: int):
    refs, kept = pivots(n_pivots), None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(group, fp):
        a, b, held = [], [], 0
        for x, y in linked_pairs(group, fp, radius, refs):
            a.append(x)
            b.append(y)
            held += len(x)
            if held > 1 << 20:
                fa, fb = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [fa], [fb], len(fa)
        if a:
            fa, fb = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64))], schema=schema)

    for batch in batches:
        group, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if kept is not None:
            group, fp = np.concatenate([kept[0], group]), np.concatenate([kept[1], fp])
        if not len(group):
            continue
        cut = np.searchsorted(group, group[-1])  # the last group may go on in the next batch
        if cut:
            yield from solve(group[:cut], fp[:cut])
        kept = group[cut:], fp[cut:]
    if kept is not None:
        yield from solve(*kept)


def links(classes: DataFrame, n: int, radius: int = RADIUS, n_pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that span the same components as all pairs within the radius."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(block_plan(n, radius))])
    dealt = classes.select("fp", F.explode(masks).alias("x")).select("fp", F.xxhash64("x.t", F.col("fp").bitwiseAND(F.col("x.m"))).alias("group"))
    hot = written(dealt.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "hot")
    dealt = dealt.join(sized(hot, hot.count() * 32), "group", "left")
    s = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), s).cast("int")
    # chunk c of s meets every chunk d once, in group (least, greatest)
    cells = F.transform(F.sequence(F.lit(0), s - 1), lambda d: F.xxhash64("group", F.least(own, d), F.greatest(own, d)))
    dealt = dealt.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("group")).otherwise(cells)).alias("group"))
    dealt = dealt.select("group", "fp").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(lambda it: _link(it, radius, n_pivots), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) to (doc_id, fp, component_id), a row for each row of docs."""
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    n = classes.count()
    found = components(links(classes.select("fp"), n, radius))
    labelled = written(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    least = written(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    ids = written(skewed_left(labelled, least, "label", least.count() * 24).select("fp", "component_id"), "ids")
    for used in (labelled, least, classes):
        discard(used)
    return skewed_left(prints, ids, "fp", n * 24).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
