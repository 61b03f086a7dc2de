r"""Jaccard self-join on sets of word shingles, by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct shingles. The global order of all shingles is cut into fragments;
a set is cut with it, its pieces go to different tasks, overlaps are counted in each fragment on its own, and partial
counts are summed per pair. Equal sets are one class first, so copies never pair up. Steps:

1. Which classes can have a partner. In the order of the hashes, two sets that are similar enough share at least
   ``slack`` shingles among the first ones of both (a prefix filter for several common tokens). These first ones alone are
   dealt out by fragment; a fragment tells for each class how many of them another class has, and the sums say which
   classes are out. No set is shipped whole for that.
2. The sets of the classes left are dealt out by fragment, which counts in how many sets each shingle is; a class keeps
   the first shingles of its set in the order of these counts. A similar pair has one of them in common, so classes are
   grouped by links from each such shingle's holders to the first of them: as many links as holders.
3. The pieces of a group's sets meet in each fragment, which counts all overlaps of the group through an index of its
   shingles. A pair that differs by more in one fragment than its sizes allow in all is dropped there. A group of more than
   CHUNK classes is dealt out as pairs of chunks. Partial counts travel as one row a group and fragment, are summed per
   pair, and what reaches the threshold becomes links; a task returns a spanning forest of them.

The threshold is compared in integers. Groups beyond CHUNK classes cost as the square of their size, in step 3 only.

Cases: null and empty texts, and texts of white space alone, have an empty set and no link; with fewer words than a
shingle has, the whole sequence is one; texts with one set are linked, rows that repeat keep a row each; null doc_ids never
become a component_id unless all of the component are null; an empty table gives no rows; other columns are ignored; very
long texts are hashed in one pass and shipped in pieces.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, parts, release, sized, skewed_left, table, written
from .components import components
from .ordered import numbered
from .simhash import forest, shingle_hashes

SHINGLE, PERCENT = 5, 80
GRAMS, FLUSH, CHUNK = 1 << 21, 1 << 21, 500  # shingles of a fragment, shingles a task gathers before it deals them out, classes that are compared at once
PIECES = 8  # fragments of the sets of a group


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def needed(n, percent: int = PERCENT):
    """The least overlap that a set of so many can have with a similar one."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    return 1 + n // 20


def first_ones(n: int, percent: int = PERCENT) -> int:
    """So many of the first shingles of two similar sets hold slack() of the smaller set's size in common, at least."""
    return min(n, n - int(needed(n, percent)) + slack(n))


def _digest(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def _half(digest: bytes) -> int:
    """Names an owner in step 1."""
    return int.from_bytes(digest[:8], "big", signed=True)


def fragment_of(grams: np.ndarray, fragments: int) -> np.ndarray:
    """The order of the hashes, cut evenly."""
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _prints(batches, size: int):
    for b in batches:
        sets = [shingle_set(t.as_py(), size) for t in b.column(2).cast(pa.binary())]
        digests = [_digest(s) for s in sets]
        cells = pa.array(digests, pa.binary()), pa.array(map(_half, digests), pa.int64()), pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], ["doc_id", "text_key", "digest", "half", "n"])


DEALT = pa.schema([("fragment", pa.int32()), ("grams", pa.binary()), ("owners", pa.binary())])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order that sorts values, the distinct ones, and where each of them begins and ends in that order."""
    order = np.argsort(values, kind="stable")
    found, begin, n = np.unique(values[order], return_index=True, return_counts=True)
    return order, found, list(zip(begin.tolist(), (begin + n).tolist(), strict=True))


class _Deal:
    """Gathers (owner, its shingles) and gives them out as a row a fragment."""

    def __init__(self, fragments: int):
        self.fragments, self.grams, self.owners, self.held = fragments, [], [], 0

    def add(self, owner: int, grams: np.ndarray):
        self.grams.append(grams)
        self.owners.append(np.full(len(grams), owner, np.int64))
        self.held += len(grams)

    def rows(self):
        if not self.held:
            return
        grams, owners = np.concatenate(self.grams), np.concatenate(self.owners)
        order, found, runs = _runs(fragment_of(grams, self.fragments))
        cells = [(grams[order[a:b]].tobytes(), owners[order[a:b]].tobytes()) for a, b in runs]
        self.grams, self.owners, self.held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([g for g, _ in cells], pa.binary()), pa.array([o for _, o in cells], pa.binary())], schema=DEALT)


def _first_dealt(batches, size: int, percent: int, fragments: int):
    """The first shingles of every set, once a task for equal sets. Owners are half of the set's digest."""
    deal, seen = _Deal(fragments), set()
    for b in batches:
        for t in b.column(0).cast(pa.binary()):
            s = shingle_set(t.as_py(), size)
            owner = _half(_digest(s))
            if len(s) and owner not in seen:
                if len(seen) < 1 << 18:
                    seen.add(owner)
                deal.add(owner, s[: first_ones(len(s), percent)])
                if deal.held > FLUSH:
                    yield from deal.rows()
    yield from deal.rows()


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, owner) of a fragment, by shingle."""
    grams = np.frombuffer(b"".join(group["grams"].to_pylist()), np.uint64)
    owners = np.frombuffer(b"".join(group["owners"].to_pylist()), np.int64)
    order = np.lexsort((owners, grams))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], owners[new]


def _holders(grams: np.ndarray) -> np.ndarray:
    """How many sets hold each of these shingles, which are sorted."""
    _, n = np.unique(grams, return_counts=True)
    return np.repeat(n, n)


def _shared(group: pa.Table, buckets: int) -> pa.Table:
    """How many of its first shingles each owner shares in a fragment, as a row for each bucket of owners."""
    grams, owners = _gathered(group)
    found, n = np.unique(owners[_holders(grams) > 1], return_counts=True)
    order, bucket, runs = _runs(found % buckets)
    cells = [[x[order[a:b]].tobytes() for a, b in runs] for x in (found, n)]
    return pa.table([pa.array(bucket, pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], names=["bucket", "owners", "counts"])


def _added(group: pa.Table) -> pa.Table:
    """The counts of a bucket's owners, summed over the fragments."""
    owners, counts = (np.frombuffer(b"".join(group[c].to_pylist()), np.int64) for c in ("owners", "counts"))
    found, at = np.unique(owners, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts)
    return pa.table([pa.array(found), pa.array(total)], names=["half", "shared"])


def _ranked(group: pa.Table, buckets: int) -> pa.Table:
    """The shingles that several classes hold, with the number of holders, as a row for each bucket of classes."""
    grams, owners = _gathered(group)
    n = _holders(grams)
    grams, owners, n = grams[n > 1], owners[n > 1], n[n > 1]
    order, found, runs = _runs(owners % buckets)
    cells = [[x[order[a:b]].tobytes() for a, b in runs] for x in (owners, n, grams)]
    return pa.table([pa.array(found, pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], names=["bucket", "owners", "holders", "grams"])


def _first_in_order(ranked: pa.Table, sizes: pa.Table, percent: int) -> pa.Table:
    """(class, gram): the shingles of each class that come first in the order of (holders, gram).

    Shingles that no other class holds come before all these, and link to nothing.
    """
    owners, n, grams = (np.frombuffer(b"".join(ranked[c].to_pylist()), t) for c, t in (("owners", np.int64), ("holders", np.int64), ("grams", np.uint64)))
    order = np.lexsort((grams, n, owners))
    owners, grams = owners[order], grams[order]
    found, begin, held = np.unique(owners, return_index=True, return_counts=True)
    classes, size = sizes["class"].to_numpy(), sizes["n"].to_numpy()
    by = np.argsort(classes)
    size = size[by][np.searchsorted(classes[by], found)]
    keep = size - needed(size, percent) + 1 - (size - held)
    kept = np.arange(len(owners)) - np.repeat(begin, held) < np.repeat(keep, held)
    return pa.table([pa.array(owners[kept]), pa.array(grams[kept].view(np.int64))], names=["class", "gram"])


def _sets(batches, size: int):
    for b in batches:
        sets = [shingle_set(t.as_py(), size).view(np.int64) for t in b.column(1).cast(pa.binary())]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["class", "grams"])


def _all_dealt(batches, fragments: int):
    deal = _Deal(fragments)
    for b in batches:
        for owner, grams in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            deal.add(owner, grams.values.to_numpy().view(np.uint64))
            if deal.held > FLUSH:
                yield from deal.rows()
    yield from deal.rows()


def _cut(batches):
    """Sets of groups in pieces by fragment."""
    for b in batches:
        out = {k: [] for k in ("block", "fragment", "class", "n", "side", "piece")}
        for block, owner, side, grams in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            s = np.sort(grams.values.to_numpy().view(np.uint64))
            ends = np.searchsorted(fragment_of(s, PIECES), np.arange(PIECES + 1))
            for f in range(PIECES):
                for k, v in zip(out, (block, f, owner, len(s), side, s[ends[f] : ends[f + 1]].tobytes()), strict=True):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def overlaps(pieces: list[np.ndarray]):
    """Yield (i, places j > i, shingles in common) for all pieces that share any."""
    size = np.array([len(p) for p in pieces])
    _, column, held = np.unique(np.concatenate(pieces), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(pieces)), size)
    order = np.argsort(column, kind="stable")
    holders, begin = row[order], np.concatenate([[0], np.cumsum(held)])
    ends = np.cumsum(size)
    for i in range(len(pieces)):
        mine = column[ends[i] - size[i] : ends[i]]
        mine = mine[held[mine] > 1]
        if len(mine):
            n = np.bincount(np.concatenate([holders[begin[c] : begin[c + 1]] for c in mine.tolist()]), minlength=len(pieces))
            j = np.flatnonzero(n[i + 1 :]) + i + 1
            yield i, j, n[j]


COUNTS = pa.schema([("block", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))])


def _partial_counts(batches, percent: int):
    """Rows are sorted by (block, fragment); a row of partial counts for each."""

    def solve(block, rows):
        nodes, sizes, sides = (np.array([r[i] for r in rows]) for i in range(3))
        pieces = [np.frombuffer(r[3], np.uint64) for r in rows]
        length = np.array([len(p) for p in pieces])
        two = (sides > 0).any()
        out = []
        for i, j, n in overlaps(pieces):
            both = sizes[i] + sizes[j]
            keep = (length[i] + length[j] - 2 * n) * (100 + percent) <= (100 - percent) * both  # what similar sets can differ by in all
            if two:
                keep &= sides[j] != sides[i]
            if keep.any():
                j, n, both = j[keep], n[keep], both[keep]
                out.append((np.full(len(j), nodes[i]), nodes[j], both, n))
        if out:
            a, b, both, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([v], k.type) for v, k in zip((np.minimum(a, b), np.maximum(a, b), both, n.astype(np.int32)), list(COUNTS)[1:], strict=True))], schema=COUNTS)

    key, rows = None, []
    for batch in batches:
        for block, f, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (block, f) != key:
                if len(rows) > 1:
                    yield from solve(key[0], rows)
                key, rows = (block, f), []
            rows.append(row)
    if len(rows) > 1:
        yield from solve(key[0], rows)


def _summed(batches, percent: int):
    """Rows are sorted by block: partial counts are summed per pair, pairs at the threshold are links."""

    def solve(rows):
        a, b, both, n = (np.concatenate([np.asarray(r[i]) for r in rows]) for i in range(4))
        order = np.lexsort((b, a))
        a, b, both, n = a[order], b[order], both[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        n, both = np.add.reduceat(n, first), both[first]
        linked = first[100 * n >= percent * (both - n)]
        if len(linked):
            x, y = forest(a[linked], b[linked])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        block = batch.column(0).to_pylist()
        columns = [batch.column(i) for i in range(1, 5)]
        for k in range(batch.num_rows):
            if block[k] != key:
                if rows:
                    yield from solve(rows)
                key, rows = block[k], []
            rows.append([c[k].values.to_numpy() for c in columns])
    if rows:
        yield from solve(rows)


def _blocks(grouped: DataFrame, chunk: int) -> DataFrame:
    """(class, group) to (block, class, side): chunk c of a large group meets each chunk d once; side 0 in a block of one chunk."""
    large = written(grouped.groupBy("group").agg(F.ceil(F.count("*") / chunk).cast("int").alias("s")).where(F.col("s") > 1), "large")
    own = F.pmod(F.xxhash64("class"), F.col("s")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda d: F.struct(F.xxhash64("group", F.least(own, d), F.greatest(own, d)).alias("block"), F.when(own < d, 1).when(own > d, 2).otherwise(0).alias("side")))
    alone = F.array(F.struct(F.col("group").alias("block"), F.lit(0).alias("side")))
    rows = grouped.join(sized(large, large.count() * 32), "group", "left")
    return rows.select("class", F.explode(F.when(F.col("s").isNull(), alone).otherwise(cells)).alias("cell")).select("cell.block", "class", "cell.side")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def classes_with_partners(texts: DataFrame, classes: DataFrame, total: int, size: int, percent: int) -> DataFrame:
    """Step 1: (class, n, text_key) of the classes that enough other classes share first shingles with."""
    fragments = max(parts(texts.sparkSession), total // (4 * GRAMS))
    dealt = texts.mapInArrow(lambda it: _first_dealt(it, size, percent, fragments), "fragment int, grams binary, owners binary")
    shared = dealt.groupBy("fragment").applyInArrow(lambda g: _shared(g, fragments), "bucket long, owners binary, counts binary")
    shared = shared.groupBy("bucket").applyInArrow(_added, "half long, shared long")
    smaller = F.ceil(F.col("n") * percent / 100)  # the least size of a partner
    enough = F.col("shared") >= 1 + F.floor(smaller / 20)
    return classes.join(shared, "half").where(enough).select("class", "n", "text_key")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, chunk: int) -> DataFrame:
    """classes: (class, half, n, text_key), one row a set; to links (a, b) of similar ones, as a spanning forest of each block's."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    some = written(classes_with_partners(texts, classes, classes.agg(F.sum("n")).first()[0] or 0, size, percent), "some")
    release(spark)
    n, total = some.agg(F.count("*"), F.sum("n")).first()
    rows = skewed_left(texts.withColumn("text_key", _key(F.col("text"))), some.select("text_key", "class"), "text_key", n * 48)
    once = rows.where("class is not null").groupBy("class").agg(F.min("text").alias("text"))
    sets = written(once.mapInArrow(lambda it: _sets(it, size), "class long, grams array<long>"), "sets")
    fragments = max(parts(spark), (total or 0) // GRAMS)
    dealt = sets.mapInArrow(lambda it: _all_dealt(it, fragments), "fragment int, grams binary, owners binary")
    ranked = dealt.groupBy("fragment").applyInArrow(lambda g: _ranked(g, fragments), "bucket long, owners binary, holders binary, grams binary")
    sizes = some.select("class", "n", (F.col("class") % fragments).alias("bucket"))
    firsts = ranked.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(lambda r, z: _first_in_order(r, z, percent), "class long, gram long")
    firsts = written(firsts, "firsts")
    hub = firsts.groupBy("gram").agg(F.min("class").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = firsts.join(hub, "gram").where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    groups = written(components(stars.distinct()).select(F.col("node").alias("class"), F.col("label").alias("group")), "groups")
    discard(firsts)
    release(spark)
    blocks = _blocks(groups, chunk).join(sets, "class").select("block", "class", "side", "grams")
    pieces = blocks.mapInArrow(_cut, "block long, fragment int, class long, n long, side int, piece binary")
    pieces = pieces.repartition("block", "fragment").sortWithinPartitions("block", "fragment")
    counted = pieces.mapInArrow(lambda it: _partial_counts(it, percent), "block long, a array<long>, b array<long>, sizes array<long>, n array<int>")
    counted = counted.repartition("block").sortWithinPartitions("block")
    out = written(counted.mapInArrow(lambda it: _summed(it, percent), "a long, b long"), "links")
    for used in (sets, groups, some):
        discard(used)
    return out


def ngram_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), a row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = rows.select("doc_id", _key(F.col("text")).alias("text_key"), "text").mapInArrow(lambda it: _prints(it, size), "doc_id long, text_key binary, digest binary, half long, n long")
    prints = written(prints, "prints")
    classes = prints.where("n > 0").groupBy("digest").agg(F.min("half").alias("half"), F.min("n").alias("n"), F.min("text_key").alias("text_key"), F.min("doc_id").alias("least"))
    classes = written(numbered(classes, F.asc("digest"), name="class"), "classes")
    found = components(links(rows, classes, size, percent, chunk))
    labelled = written(skewed_left(classes, found.withColumnRenamed("node", "class"), "class", found.count() * 24).select("digest", "least", F.coalesce("label", "class").alias("label")), "labelled")
    least = written(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    ids = written(skewed_left(labelled, least, "label", least.count() * 24).select("digest", "component_id"), "ids")
    out = skewed_left(prints, ids, "digest", ids.count() * 40)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and all rows that links reach: for tables of thousands of documents.
ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.r = a JOIN c y ON y.r = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS x FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.x)
SELECT d.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.x LEFT JOIN c ON c.r = d.r GROUP BY d.r, d.doc_id
"""
