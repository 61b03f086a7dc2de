r"""Removal of repeated byte strings by a sparse enhanced suffix array.

Removed is every byte covered by a string of LENGTH bytes that also starts earlier (in a smaller doc_id, or earlier in the
same document). Instead of all suffixes of the corpus, only those at anchors are sorted: in every window of LENGTH bytes the
GRAM bytes of least hash are the window's anchor, so equal windows have equal anchors, and each window has one.

1. Anchors of all texts are counted by hash; only those that occur twice matter. The bytes of all windows of an anchor
   are its cutting; the least and largest 64-bit hash of its cuttings tell whether they are all equal.
2. Of equal cuttings the earliest stands for all, any other is removed whole; this is done within a batch before the
   shuffle. Bytes are sent only of anchors with several cuttings, that is where shared passages begin, end or differ; of
   the others a 128-bit BLAKE2 digest is, so that nothing is removed on the equality of a 64-bit hash alone. Should these
   digests differ, the 64-bit hashes are distrusted and the bytes of all repeated anchors are sent.
3. Cuttings are grouped by anchor and sorted from the anchor on: a sparse suffix array with common prefixes. A stack scan
   gives its interval tree: each interval is a set of suffixes with a common prefix. Within one, the same scan over what
   precedes the anchor, backwards, gives the sets that share a left extension until it becomes diverse: with at
   least LENGTH bytes in all, these are the maximal repeats with all their occurrences. All but the earliest are removed.
   An anchor with more than CHUNK cuttings is dealt out as pairs of chunks, so that every two still meet.
4. The removed runs of a document meet its text.

Cases: a null text is empty; texts shorter than LENGTH lose nothing; matches never cross documents; null doc_ids come
last; rows that agree in id and text are one document and get the same result, a row each; rows that share only the id are
ordered by a hash of the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, sized, table, written

LENGTH, GRAM, CHUNK, SLICE = 100, 24, 4000, 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = np.uint64((1 << 20) - 1)  # positions in a slice; a slice with its overlap stays under this
#: A cutting: its anchor's place and the bytes before (backwards) and from it; if all of the anchor are equal, left is null and right is their digest.
CUTTINGS = pa.schema([("anchor", pa.int64()), ("ord", pa.int64()), ("rk", pa.int64()), ("pos", pa.int64()), ("n_left", pa.int32()), ("n_right", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
CUTTING = "anchor long, ord long, rk long, pos long, n_left int, n_right int, left binary, right binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
    return up, down


_UP, _DOWN = _powers(2 * SLICE + 4096)


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values: block-wise running minima from both sides."""
    n = len(x) - width + 1
    pad = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """For each anchor: hash, hash of its cutting, text, position, first and last window start; positions within the text."""
    for first, skip, data, cut in _slices(texts, length):
        if len(data) < length:
            continue
        sums = _prefix_hashes(data)
        h = _mixed((sums[gram:] - sums[:-gram]) * _DOWN[: len(data) - gram + 1])
        key = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
        best = (_sliding_min(key, length - gram + 1) & _MASK).astype(np.int64)
        start = np.arange(len(best))
        owner = np.searchsorted(cut, start, "right") - 1
        fits = start + length <= cut[owner + 1]
        start, best, owner = start[fits], best[fits], owner[fits]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.append(new[1:], len(start)) - 1
        own = owner[new]
        base = cut[own] - np.where(own == 0, skip, 0)
        lo, hi, at = start[new], start[last], best[new]
        shape = ((at - lo) * 4096 + hi + length - lo).astype(np.uint64)  # where in the cutting the anchor lies, and how long it is
        cutting = _mixed((sums[hi + length] - sums[lo]) * _DOWN[lo] ^ _mixed(shape * BASE))
        yield h[at].view(np.int64), cutting.view(np.int64), first + own, at - base, lo - base, hi - base


def _slices(texts: list[bytes], length: int):
    """Texts joined to runs of about SLICE bytes; a longer text comes in runs that overlap by length - 1."""
    held, size, first = [], 0, 0

    def joined():
        return first, 0, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)

    for i, t in enumerate(texts):
        if size + len(t) > SLICE and held:
            yield joined()
            held, size = [], 0
        if not held:
            first = i
        if len(t) > SLICE:
            for at in range(0, max(1, len(t) - length + 1), SLICE):
                part = t[at : at + SLICE + length - 1]
                yield i, at, np.frombuffer(part, np.uint8), np.array([0, len(part)], np.int64)
            continue
        held.append(t)
        size += len(t)
    if held:
        yield joined()


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(batches, with_key: bool):
    """Anchors of (rk, text): with the key of their text, or with their cutting's hash."""
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        for h, cutting, text, *_ in anchors(_texts(b.column(1))):
            if with_key:  # once a text
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
                h, text = h[new], text[new]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[text] if with_key else cutting)], ["anchor", "rk" if with_key else "cutting"])


def _cut(batches):
    """(rk, text, ord, repeated, alike) to cuttings of the repeated anchors; a row without anchor is a run to remove, n_right bytes from pos.

    alike holds those of the repeated anchors whose cuttings are all equal.
    """
    for b in batches:
        keys, order = b.column(0).to_pylist(), b.column(2).to_pylist()
        texts, repeated, alike = _texts(b.column(1)), b.column(3), b.column(4)
        now, wanted, same = -1, set(), set()
        rows: dict[tuple, tuple] = {}
        done: dict[int, list] = {}
        held = 0
        for h, _, text, pos, lo, hi in anchors(texts):
            for a, t, p, x, y in zip(h.tolist(), text.tolist(), pos.tolist(), lo.tolist(), hi.tolist(), strict=True):
                if t != now:
                    now, wanted, same = t, set(repeated[t].as_py()), set(alike[t].as_py())
                if a in same:
                    cutting, n = (a, None, hashlib.blake2b(texts[t][x : y + LENGTH], digest_size=16).digest()), (p - x, y + LENGTH - p)
                elif a in wanted:
                    cutting, n = (a, texts[t][x:p][::-1], texts[t][p : y + LENGTH]), (p - x, y + LENGTH - p)
                else:
                    continue
                mine, other = (order[t], keys[t], p, *n), rows.get(cutting)
                if other is None:
                    rows[cutting] = mine
                elif mine[:3] != other[:3]:
                    rows[cutting], later = (mine, other) if mine < other else (other, mine)
                    done.setdefault(later[1], []).append((later[2] - n[0], later[2] + n[1]))
                    held += 1
            if len(rows) + held > 300_000:
                yield _cuttings(rows, done)
                rows, done, held = {}, {}, 0
        if rows or done:
            yield _cuttings(rows, done)


def _cuttings(rows: dict, done: dict) -> pa.RecordBatch:
    out = [(k[0], *spot, k[1], k[2]) for k, spot in rows.items()]
    out += [(None, None, rk, x, 0, y - x, None, None) for rk, runs in done.items() for x, y in merged(*zip(*runs, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CUTTINGS.types, strict=True)], schema=CUTTINGS)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int):
    """Stack scan of an array of common prefixes (lcp[i]: of i and i + 1): every maximal (prefix, first, last) of at least so much."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][0] > v:
            value, start = stack.pop()
            yield value, start, i
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, start))


def repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH):
    """Maximal repeats around one anchor: yield (left, right, all rows that have it), left + right >= length.

    rights are sorted, lefts are reversed.
    """
    reach = max(map(len, lefts))
    for right, a, b in intervals([common(x, y) for x, y in zip(rights, rights[1:], strict=False)], length - reach):
        members = sorted(range(a, b + 1), key=lefts.__getitem__)
        need = max(length - right, 0)
        for left, c, d in intervals([common(lefts[x], lefts[y]) for x, y in zip(members, members[1:], strict=False)], need):
            yield left, right, members[c : d + 1]


def _scan(batches):
    """Cuttings sorted by group and right to runs to remove (rk, start, stop); a run of -1 tells of digests that should be equal and are not."""
    out: list[list] = [[], [], []]

    def remove(spot, left, right):
        for held, x in zip(out, (spot[1], spot[2] - left, spot[2] + right), strict=True):
            held.append(x)

    def solve(rows):
        spots = [r[1:4] for r in rows]
        if rows[0][6] is None:
            if rows[0][7] != rows[-1][7]:  # sorted by it
                remove((0, 0, -1), 0, 0)
                return
            first = min(spots)
            for r, spot in zip(rows, spots, strict=True):
                if spot != first:
                    remove(spot, r[4], r[5])
            return
        mine: list[list] = [[] for _ in rows]
        for left, right, members in repeats([r[6] for r in rows], [r[7] for r in rows]):
            first = min(spots[m] for m in members)
            for m in members:
                if spots[m] != first:
                    mine[m].append((-left, right))
        for spot, runs in zip(spots, mine, strict=True):
            for x, y in merged(*zip(*runs, strict=True)) if runs else ():
                remove(spot, -x, y)

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rk", "start", "stop"])
        for c in out:
            c.clear()
        return made

    group, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != group:
                if len(rows) > 1:
                    solve(rows)
                group, rows = r[0], []
            rows.append(r)
            if len(out[0]) > 50_000:
                yield batch()
    if len(rows) > 1:
        solve(rows)
    yield batch()


def merged(starts, stops) -> list[tuple[int, int]]:
    """Union of runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _merge(batches):
    for b in batches:
        runs = [[{"start": x, "stop": y} for x, y in merged([r["start"] for r in rs], [r["stop"] for r in rs])] for rs in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["rk", "runs"])


def _apply(batches):
    for b in batches:
        out = []
        for doc_id, text, runs in zip(b.column(0).to_pylist(), _texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            runs = [(r["start"], r["stop"]) for r in runs or ()]
            kept, at = hashlib.sha256(), 0
            for x, y in runs:
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            out.append((doc_id, len(text), sum(y - x for x, y in runs), len(runs), kept.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))


def removed_runs(docs: DataFrame, trusted: bool = True) -> DataFrame:
    """keyed() documents to (rk, runs), runs a sorted array of (start, stop). trusted: equal 64-bit hashes of cuttings save their bytes."""
    texts = docs.select("rk", "text")
    counted = texts.mapInArrow(lambda it: _anchor_rows(it, False), "anchor long, cutting long").groupBy("anchor")
    alike = (F.col("a") == F.col("b")) & F.lit(trusted)
    often = counted.agg(F.count("*").alias("n"), F.min("cutting").alias("a"), F.max("cutting").alias("b")).where("n > 1").select("anchor", alike.alias("alike"))
    # neither side has a size bound: both are shuffled; a table between lets Spark split the partition of a hot anchor
    often = written(often, "often")
    release(docs.sparkSession)
    found = texts.mapInArrow(lambda it: _anchor_rows(it, True), "anchor long, rk long").join(often.hint("merge"), "anchor")
    sets = found.groupBy("rk").agg(F.collect_set("anchor").alias("repeated"), F.collect_set(F.when(F.col("alike"), F.col("anchor"))).alias("alike"))
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    marked = docs.select("rk", "text", order.alias("ord")).join(sets.hint("merge"), "rk").select("rk", "text", "ord", "repeated", "alike")
    cuttings = written(marked.mapInArrow(_cut, CUTTING), "cuttings")
    del counted, found, sets, marked
    discard(often)
    release(docs.sparkSession)
    done = cuttings.where("anchor is null").select("rk", F.col("pos").alias("start"), (F.col("pos") + F.col("n_right")).alias("stop"))
    todo = cuttings.where("anchor is not null")
    hot = written(todo.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "hot")
    s = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("rk", "pos"), s).cast("int")
    cells = F.transform(F.sequence(F.lit(0), s - 1), lambda d: F.xxhash64("anchor", F.least(own, d), F.greatest(own, d)))
    dealt = todo.join(sized(hot, hot.count() * 32), "anchor", "left")
    dealt = dealt.select(F.explode(F.when(F.col("n").isNull(), F.array("anchor")).otherwise(cells)).alias("group"), *CUTTINGS.names[1:])
    found = dealt.repartition("group").sortWithinPartitions("group", "right").mapInArrow(_scan, "rk long, start long, stop long")
    found = written(found.unionByName(done), "found")
    discard(cuttings)
    discard(hot)
    if not found.where("start < 0").isEmpty():
        discard(found)
        return removed_runs(docs, trusted=False)
    runs = found.groupBy("rk").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    runs = written(runs.mapInArrow(_merge, "rk long, runs array<struct<start:long,stop:long>>"), "runs")
    discard(found)
    return runs


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row of docs."""
    rows = keyed(docs)
    runs = removed_runs(rows)
    size = runs.agg(F.sum(F.size("runs") * 16 + 48)).first()[0] or 0
    whole = rows.join(sized(runs, size), "rk", "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


#: Every string of LENGTH bytes by itself, over texts cut into parts that overlap (SQL finds a place in a text by counting from its start).
ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
p AS (SELECT doc_id, n, k * 2000 AS base, substr(h, k * 4000 + 1, 4198) AS part FROM (SELECT doc_id, n, h, unnest(range(0, greatest(n - 99, 0) // 2000 + 1)) AS k FROM h WHERE n >= 100)),
w AS (SELECT doc_id, base + i AS i, substr(part, 2 * i + 1, 200) AS s FROM (SELECT doc_id, base, part, unnest(range(0, least(2000, n - 99 - base))) AS i FROM p)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
l AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM f WHERE k > 1),
g AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id)
"""
