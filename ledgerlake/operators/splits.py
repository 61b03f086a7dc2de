"""Statistics over many random splits of groups, without a row a split.

A split gives every accession one of three roles. The ledger is cut into chunks: a chunk's rows share their accession, and
so their role in every split, and a chunk carries its roles as one byte a seed. A pass over the chunks counts for all seeds
at once, in NumPy, how many rows of a role lie in each of CELLS ranges of a score; Spark adds the counts up. They tell which
range holds a wanted rank. Ranges that hold many rows are cut again by a further pass, until few values are left to fetch.

What a task holds is a chunk and the counters; what reaches the driver is a row a seed, stratum and rank, numbers that the
caller's parameters fix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.sources.sinks import stored

TRAIN, CALIBRATION, TEST = 0, 1, 2
CHUNK = 4096  # rows of a chunk
CELLS = 256  # ranges that a score is cut into at once
FETCHED = 4_000_000  # values fetched at most, over all seeds and strata, unless they cannot be told apart
DEPTH = 8  # passes after which the values of a range are fetched however many they are
HELD = 1 << 21  # counted positions kept before they are added up
PACKED = 1 << 12  # counters that travel as one value
LOOKED = 1 << 20  # counters that the driver holds at once
COLUMNS = ("x", "y", "z")


def quarters(n: int) -> tuple[int, int]:
    """Where train (half) and calibration (half of the rest) end among n accessions."""
    return n // 2, n // 2 + (n - n // 2) // 2


def halves(n: int) -> tuple[int, int]:
    """No train accessions, half of all for calibration, at least one; a half is rounded to even."""
    return 0, max(1, round(n * 0.5))


def roles(accessions: DataFrame, seeds: int, share: Callable[[int], tuple[int, int]] = quarters) -> DataFrame:
    """(seed, accession, role): train, calibration, test, by hash order within a seed.

    Counts of the digests' first two digits tell all roles but those in the two ranges where a role ends; only these
    few rows are ranked.
    """
    each = accessions.select("accession").distinct()
    n = each.count()
    digest = F.sha2(F.concat_ws(":", F.col("seed").cast("string"), F.col("accession").cast("string")), 256)
    each = each.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("_d", digest).withColumn("_r", F.substring("_d", 1, 2))
    upto = F.expr("sum(m) over (partition by seed order by _r)")
    counts = each.groupBy("seed", "_r").agg(F.count("*").alias("m")).select("seed", "_r", "m", upto.alias("upto"))
    ends = share(n)
    # a row a seed: where each role ends, and how many rows lie before that range
    last = [F.min(F.when(F.col("upto") >= e, F.struct("_r", (F.col("upto") - F.col("m")).alias("before")))).alias(f"_e{i}") for i, e in enumerate(ends)]
    known = each.join(F.broadcast(counts.groupBy("seed").agg(*last)), "seed")
    open_ = (F.col("_r") == F.col("_e0._r")) | (F.col("_r") == F.col("_e1._r"))
    plain = F.when(F.col("_r") < F.col("_e0._r"), TRAIN).when(F.col("_r") < F.col("_e1._r"), CALIBRATION).otherwise(TEST)
    place = F.expr("row_number() over (partition by seed, _r order by _d, accession)") + F.when(F.col("_r") == F.col("_e0._r"), F.col("_e0.before")).otherwise(F.col("_e1.before"))
    ranked = known.where(open_).withColumn("_i", place - 1)
    told = ranked.select("seed", "accession", F.when(F.col("_i") < ends[0], TRAIN).when(F.col("_i") < ends[1], CALIBRATION).otherwise(TEST).alias("role"))
    return known.where(~open_).select("seed", "accession", plain.alias("role")).unionByName(told)


def _digests(name: str | None, seeds: int) -> list[bytes]:
    """As roles() makes them; a null name adds nothing to the number."""
    tail = b"" if name is None else b":" + name.encode()
    return [sha256(b"%d%b" % (seed, tail)).digest() for seed in range(seeds)]


def _first_bytes(batches, seeds: int) -> Iterator[pa.RecordBatch]:
    """How many accessions' digests begin with each byte, by seed."""
    total, offset = np.zeros(seeds * 256, np.int64), np.arange(seeds) * 256
    for b in batches:
        for name in b["name"].to_pylist():
            total[offset + np.fromiter((d[0] for d in _digests(name, seeds)), np.int64, seeds)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


OPEN = ord("?")


def role_bytes(accessions: DataFrame, seeds: int, share: Callable[[int], tuple[int, int]] = quarters) -> DataFrame:
    """(accession, roles): a byte a seed, in the order of seeds; the roles are those of roles().

    An accession's digests stay in its task, one row for all seeds; only the few in a range where a role ends travel as rows, to be ranked.
    """
    each = stored(accessions.select("accession").distinct().withColumn("name", F.col("accession").cast("string")), "names")
    n = each.count()
    found = each.mapInArrow(lambda it: _first_bytes(it, seeds), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros((seeds, 256), np.int64)
    count.ravel()[found["at"].to_numpy()] = found["n"].to_numpy()
    upto, ends = count.cumsum(axis=1), share(n)
    last = np.stack([((upto >= e) & (count > 0)).argmax(axis=1) for e in ends])  # the range in which each role ends
    byte = np.arange(256)[None, :]
    table = np.where(byte < last[0][:, None], TRAIN, np.where(byte < last[1][:, None], CALIBRATION, TEST)) + ord("0")
    table = np.where((byte == last[0][:, None]) | (byte == last[1][:, None]), OPEN, table).astype(np.uint8)
    before = (upto - count).astype(np.int64)

    def told(batches):
        every = np.arange(seeds)
        for b in batches:
            roles, open_ = [], []
            for name in b["name"].to_pylist():
                digests = _digests(name, seeds)
                first = np.fromiter((d[0] for d in digests), np.int64, seeds)
                mine = table[every, first]
                roles.append(mine.tobytes())
                open_.append([{"seed": s, "d": digests[s], "before": int(before[s, first[s]])} for s in np.flatnonzero(mine == OPEN).tolist()])
            kind = pa.list_(pa.struct([("seed", pa.int32()), ("d", pa.binary()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b["accession"], b["name"], pa.array(roles, pa.binary()), pa.array(open_, kind)], ["accession", "name", "roles", "open"])

    schema = f"accession {each.schema['accession'].dataType.simpleString()}, name string, roles binary, open array<struct<seed int, d binary, before bigint>>"
    known = stored(each.mapInArrow(told, schema), "known")
    place = F.expr("row_number() over (partition by seed, before order by d, accession) - 1") + F.col("before")
    ranked = known.select("accession", F.inline("open")).withColumn("_i", place)
    role = F.when(F.col("_i") < ends[0], TRAIN).when(F.col("_i") < ends[1], CALIBRATION).otherwise(TEST)
    settled = ranked.select("accession", "seed", role.alias("role")).groupBy("accession").agg(F.collect_list(F.struct("seed", "role")).alias("settled"))

    def patched(batches):
        for b in batches:
            out = []
            for roles, ranks in zip(b["roles"].to_pylist(), b["settled"].to_pylist(), strict=True):
                mine = bytearray(roles)
                for r in ranks or ():
                    mine[r["seed"]] = ord("0") + r["role"]
                out.append(bytes(mine))
            yield pa.RecordBatch.from_arrays([b["accession"], pa.array(out, pa.binary())], ["accession", "roles"])

    both = known.select("accession", "roles").join(settled.withColumnRenamed("accession", "_by"), F.col("accession").eqNullSafe(F.col("_by")), "left").select("accession", "roles", "settled")
    return both.mapInArrow(patched, f"accession {each.schema['accession'].dataType.simpleString()}, roles binary")


def chunks(rows: DataFrame, identity: list[str], seeds: int, share: Callable[[int], tuple[int, int]] = quarters) -> tuple[DataFrame, tuple[float, float], int]:
    """rows (accession, x, y, z, *identity) to written (accession, roles, x, y, z), the bounds of y and the number of accessions.

    identity tells where a row of a large accession goes.
    """
    spark = rows.sparkSession
    each = stored(rows.groupBy("accession").agg(F.count("*").alias("_n"), F.min("y").alias("_low"), F.max("y").alias("_high")), "accessions")
    low, high, n, total, large = each.agg(F.min("_low"), F.max("_high"), F.count("*"), F.sum("_n"), F.count_if(F.col("_n") > CHUNK)).first()
    rows = rows.select("accession", *COLUMNS, *identity)
    if large:  # at most rows / CHUNK of them
        pieces = each.where(F.col("_n") > CHUNK).select("accession", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_pieces"))
        rows = rows.join(F.broadcast(pieces) if large < 100_000 else pieces, "accession", "left")
        piece = F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*identity), F.col("_pieces")))
    else:
        piece = F.lit(0)
    # as many parts as will keep all cores busy, each of bounded size; a number that is given is not coalesced
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // (64 * CHUNK))
    dealt = rows.select("accession", *COLUMNS, piece.alias("_piece")).repartition(parts, "accession", "_piece")
    grouped = dealt.groupBy("accession", "_piece").agg(F.collect_list(F.struct(*COLUMNS)).alias("r"))
    out = grouped.join(role_bytes(each, seeds, share), "accession").select("accession", "roles", *[F.col(f"r.{c}").alias(c) for c in COLUMNS])
    return stored(out, "chunks"), (low or 0.0, high or 0.0), n


class Chunk:
    """A chunk in a task."""

    def __init__(self, roles: bytes, x: np.ndarray, y: np.ndarray, z: np.ndarray):
        self.raw, self.roles, self.x, self.y, self.z = roles, np.frombuffer(roles, np.uint8) - ord("0"), x, y, z

    def seeds(self, role: int) -> np.ndarray:
        return np.flatnonzero(self.roles == role)


def _chunks(batches) -> Iterator[Chunk]:
    for b in batches:
        for i in range(b.num_rows):
            yield Chunk(b["roles"][i].as_py(), *(np.asarray(b[c][i].values, np.float64) for c in COLUMNS))


BLOCK, FEW = 32_000, 16  # rows of a block, counted in 16 bits; rows an x of a block at least, on average
SAMPLE, SIGMAS = 50_000, 5  # rows that first bracket a rank, and how many errors wide


def hashed(x: np.ndarray, y: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """A number in [0, 1) for each row, the same wherever it is computed."""
    h = np.ascontiguousarray(y).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.ascontiguousarray(x).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = h + np.asarray(salt, np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sampled(chunk: Chunk, share: float) -> Chunk:
    """A share of a chunk's rows, drawn row by row: rows that are equal are drawn on their own, or copies would make a sample of few values."""
    if share >= 1:
        return chunk
    keep = hashed(chunk.x, chunk.y, (crc32(chunk.raw) << 32) + np.arange(len(chunk.x), dtype=np.uint64)) < share
    return Chunk(chunk.raw, chunk.x[keep], chunk.y[keep], chunk.z[keep])


class Block:
    """Chunks of a task taken together, for one role: rows sorted by x, then y, and how many rows of a split come before each.

    What a split has between two values at an x is told by two searches and a difference of running counts, so that a row
    costs a split one addition.
    """

    def __init__(self, chunks: list[Chunk], role: int):
        self.chunks = chunks
        self.of = np.stack([c.roles == role for c in chunks])  # by chunk and seed
        who = np.repeat(np.arange(len(chunks)), [len(c.x) for c in chunks])
        x, y = (np.concatenate([getattr(c, f) for c in chunks]) for f in "xy")
        order = np.lexsort((y, x))
        self.who, self.all_x, self.y = who[order], x[order], y[order]
        begin = np.flatnonzero(np.concatenate([[True], self.all_x[1:] != self.all_x[:-1]]))
        self.x, self.ends = self.all_x[begin], np.append(begin, len(order))
        self.few = len(self.x) * FEW <= len(order) <= BLOCK
        if self.few:
            self.before = np.zeros((len(order) + 1, self.of.shape[1]), np.int16)
            np.cumsum(self.of[self.who], axis=0, dtype=np.int16, out=self.before[1:])

    def places(self, values: np.ndarray, side: str) -> np.ndarray:
        """Places of values (by x, and anything) among the sorted rows of their x."""
        return np.stack([a + np.searchsorted(self.y[a:b], v, side) for a, b, v in zip(self.ends[:-1], self.ends[1:], values, strict=True)])

    def count(self, a: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Rows of the seeds from places a to places b, both by x and seed; none where b lies before a."""
        return self.before[np.maximum(a, b), seeds].astype(np.int64) - self.before[a, seeds]

    def rows(self, a: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of x, number in seeds, row) of those rows."""
        many = np.maximum(b - a, 0).ravel()
        at = np.repeat(np.arange(len(many)), many)
        row = np.arange(len(at)) + np.repeat(a.ravel() - (np.cumsum(many) - many), many)
        k, i = np.divmod(at, len(seeds))
        mine = self.of[self.who[row], seeds[i]]
        return k[mine], i[mine], row[mine]


def blocks(batches, role: int, share: float = 1.0) -> Iterator[Block]:
    held, n = [], 0
    for chunk in _chunks(batches):
        chunk = sampled(chunk, share)
        if n + len(chunk.x) > BLOCK and held:
            yield Block(held, role)
            held, n = [], 0
        if len(chunk.x):
            held.append(chunk)
            n += len(chunk.x)
    if held:
        yield Block(held, role)


#: The lower and the upper curve of some seeds at a level: (x, seeds, level) to two arrays of seeds by x.
Curves = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def select_beyond(table: DataFrame, n_seeds: int, n_levels: int, curves: Curves, span: tuple[float, float], ranks: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The wanted order statistic of max(lo - y, y - hi) over the calibration rows, by seed and level; NaN for a rank of 0 or beyond the count.

    A sample brackets each rank. Then all rows are counted: below the bracket by searches in sorted blocks, within it by
    CELLS ranges, until few values are left to fetch. A bracket that misses its rank is made wider.
    """
    n_targets, every = n_seeds * n_levels, np.arange(n_seeds)
    low, high = (np.full((n_seeds, n_levels), float(v)) for v in span)

    def scored(batches, share: float, low, high, sought):
        """(targets of a block, counts below their brackets, target of each value within, these values)."""
        for block in blocks(batches, CALIBRATION, share):
            for level in range(n_levels):
                s = every[sought[:, level] & block.of.any(axis=0)]
                if not len(s):
                    continue
                if not block.few:
                    for chunk in block.chunks:
                        mine = s[chunk.roles[s] == CALIBRATION]
                        lo, hi = curves(chunk.x, mine, level)
                        v = np.maximum(lo - chunk.y, chunk.y - hi)
                        i, j = np.nonzero((v >= low[mine, level, None]) & (v <= high[mine, level, None]))
                        yield mine * n_levels + level, (v < low[mine, level, None]).sum(axis=1), mine[i] * n_levels + level, v[i, j]
                    continue
                lo, hi = (e.T for e in curves(block.x, s, level))
                a, b = low[s, level], high[s, level]
                slack = 1e-12 * (1 + np.abs(lo) + np.abs(hi) + np.abs(a) + np.abs(b))
                first, last = block.places(lo - b - slack, "left"), block.places(hi + b + slack, "right")
                inner = block.places(lo - a + slack, "left")
                outer = np.maximum(block.places(hi + a - slack, "right"), inner)  # surely below from inner to outer
                inner, outer = np.clip(inner, first, np.maximum(first, last)), np.clip(outer, first, np.maximum(first, last))
                below = block.count(inner, outer, s).sum(axis=0)
                (k1, i1, r1), (k2, i2, r2) = block.rows(first, inner, s), block.rows(outer, last, s)
                k, i, r = np.concatenate([k1, k2]), np.concatenate([i1, i2]), np.concatenate([r1, r2])
                v = np.maximum(lo[k, i] - block.y[r], block.y[r] - hi[k, i])
                below += np.bincount(i[v < a[i]], minlength=len(s))
                within = (v >= a[i]) & (v <= b[i])
                yield s * n_levels + level, below, s[i[within]] * n_levels + level, v[within]

    def counted(share: float, low, high, sought):
        """Counts by target: below the bracket, and by range within it."""
        scale = np.divide(CELLS, high - low, out=np.zeros_like(low), where=high > low).ravel()

        def add(batches):
            total = np.zeros((n_targets, CELLS + 1), np.int64)
            for t, below, at, v in scored(batches, share, low, high, sought):
                total[t, 0] += below
                cell = np.clip((v - low.ravel()[at]) * scale[at], 0, CELLS - 1).astype(np.int64)
                total += np.bincount(at * (CELLS + 1) + cell + 1, minlength=total.size).reshape(total.shape)
            seen = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([total[t].tobytes() for t in seen], pa.binary())], ["at", "n"])

        def merged(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(n.as_py(), np.int64) for n in group["n"])
            return pa.table({"at": group["at"].slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((n_targets, CELLS + 1), np.int64)
        for at, n in table.mapInArrow(add, "at long, n binary").groupBy("at").applyInArrow(merged, "at long, n binary").collect():
            out[at] = np.frombuffer(n, np.int64)
        return out.reshape(n_seeds, n_levels, CELLS + 1)

    def sizes(batches, share: float = 1.0):
        total = np.zeros((n_seeds, 2), np.int64)
        for chunk in _chunks(batches):
            total[chunk.seeds(CALIBRATION)] += (len(chunk.x), len(sampled(chunk, share).x))
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(total[:, 0]), pa.array(total[:, 1])], ["seed", "n", "m"])

    def sized(share: float) -> np.ndarray:
        found = table.mapInArrow(lambda it: sizes(it, share), "seed long, n long, m long").groupBy("seed").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toPandas()
        out = np.zeros((2, n_seeds), np.int64)
        out[:, found["seed"].to_numpy()] = found[["n", "m"]].to_numpy().T
        return out

    n_rows = table.agg(F.sum(F.size("x"))).first()[0] or 0
    share = min(1.0, SAMPLE / max(n_rows, 1))
    n, m = sized(share)
    rank = ranks(n)
    rank = np.where(rank <= n[:, None], rank, 0)
    out, sought = np.full(rank.shape, np.nan), rank > 0

    def narrowed(share: float, wanted, margin):
        """Brackets about a rank give or take a margin: whether they hold it, their ends, and how many rows lie within."""
        counts = counted(share, low, high, sought)
        upto = counts.cumsum(axis=2)
        holds = (wanted - margin > upto[:, :, 0]) & (wanted + margin <= upto[:, :, -1])
        lines = [np.clip((upto[:, :, 1:] < (wanted + d)[:, :, None]).sum(axis=2), 0, CELLS - 1) for d in (-margin, margin)]
        width = (high - low) / CELLS
        slack = 1e-6 * width + 1e-13 * (np.abs(low) + np.abs(high))
        here = np.take_along_axis(upto, lines[1][:, :, None] + 1, 2)[:, :, 0] - np.take_along_axis(upto, lines[0][:, :, None], 2)[:, :, 0]
        return holds, low + lines[0] * width - slack, low + (lines[1] + 1) * width + slack, here

    if share < 1:
        for _ in range(2):
            wanted = np.clip(np.rint(rank * (m / np.maximum(n, 1))[:, None]), 1, np.maximum(m, 1)[:, None]).astype(np.int64)
            p = wanted / np.maximum(m, 1)[:, None]
            margin = np.ceil(SIGMAS * np.sqrt(m[:, None] * p * (1 - p)) + SIGMAS).astype(np.int64)
            holds, a, b, _ = narrowed(share, wanted, margin)
            low, high = np.where(holds, a, low), np.where(holds, b, high)
    for depth in range(8 * DEPTH):
        if not sought.any():
            return out
        holds, a, b, here = narrowed(1.0, rank, np.zeros_like(rank))
        wider = (high - low) * 8 + 1e-9 * (1 + np.abs(low) + np.abs(high))
        low, high = np.where(holds, a, low - wider), np.where(holds, b, high + wider)
        if not (holds | ~sought).all() or (here[sought].sum() > FETCHED and depth < DEPTH):
            continue

        def fetched(batches, low=low, high=high, sought=sought):
            """Values by target, equal ones of a task as one; those below a bracket as one that is less than any."""
            held, below, size = [], np.zeros(n_targets, np.int64), 0

            def batch():
                at, v = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((v, at))
                at, v = at[order], v[order]
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (v[1:] != v[:-1])]))
                return pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(v[new]), pa.array(np.diff(np.append(new, len(at))))], ["at", "v", "n"])

            for t, less, at, v in scored(batches, 1.0, low, high, sought):
                below[t] += less
                if len(at):
                    held.append((at, v))
                    size += len(at)
                if size > HELD:
                    yield batch()
                    held, size = [], 0
            if size:
                yield batch()
            seen = np.flatnonzero(below)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(np.full(len(seen), -np.inf)), pa.array(below[seen])], ["at", "v", "n"])

        at = np.flatnonzero(sought.ravel())
        goal = table.sparkSession.createDataFrame(list(zip(at.tolist(), rank.ravel()[at].tolist(), strict=True)), "at long, k long")
        values = table.mapInArrow(fetched, "at long, v double, n long").groupBy("at", "v").agg(F.sum("n").alias("n"))
        hit = values.select("at", "v", "n", F.expr("sum(n) over (partition by at order by v)").alias("upto")).join(F.broadcast(goal), "at").where("upto >= k and upto - n < k and v > double('-inf')").select("at", "v").toPandas()
        out.ravel()[hit["at"].to_numpy()] = hit["v"].to_numpy()
        sought = sought & np.isnan(out)
        low, high = low - wider, high + wider  # of those that a bracket missed by rounding
    raise RuntimeError("a rank was not found")


#: A score of a chunk's rows for some seeds: (chunk, seeds) to an array of rows, or of seeds by rows.
Score = Callable[[Chunk, np.ndarray], np.ndarray]
#: The stratum of each row of a chunk, from 0.
Strata = Callable[[Chunk], np.ndarray]


def _rows_of(strata: np.ndarray, stratum: int, whole: int) -> np.ndarray:
    return np.arange(len(strata)) if stratum == whole else np.flatnonzero(strata == stratum)


class Targets:
    """The ranks that are sought: one a seed and target, and the nested ranges in which they lie."""

    def __init__(self, stratum: list[int], rank: np.ndarray):
        self.stratum, self.levels, self.rank = stratum, [], rank  # a level is (low, scale, cell) by seed and target
        self.low, self.high = np.full(rank.shape, -np.inf), np.full(rank.shape, np.inf)

    @staticmethod
    def cell(score: np.ndarray, low: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The range of a score: never falls as the score rises."""
        return np.clip((score - low) * scale, 0, CELLS - 1).astype(np.int64)

    def narrow(self, low: np.ndarray, scale: np.ndarray, cell: np.ndarray):
        """A further level. Its ends are kept too, a little wider than rounding can move a score, to pass over most rows at once."""
        self.levels.append((low, scale, cell))
        width = np.divide(1.0, scale, out=np.full(scale.shape, np.inf), where=scale > 0)
        begin, end = (np.where((cell == k) | (scale <= 0), sign * np.inf, low + np.where(scale > 0, cell + (sign > 0), 0) * np.where(scale > 0, width, 0)) for k, sign in ((0, -1), (CELLS - 1, 1)))
        slack = lambda x: np.where(np.isfinite(x), 1e-12 * (np.abs(x) + np.abs(low)) + 1e-6 * np.where(np.isfinite(width), width, 0), 0)
        self.low, self.high = np.maximum(self.low, begin - slack(begin)), np.minimum(self.high, end + slack(end))

    def hits(self, chunk: Chunk, seeds: np.ndarray, score: Score, g: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(target, places i in seeds, rows, scores) of the rows whose scores lie in all ranges of their seed's target."""
        s, sorted_of, whole = score(chunk, seeds), {}, max(self.stratum)
        for t, stratum in enumerate(self.stratum):
            sought = self.rank[seeds, t] > 0
            if not sought.any():
                continue
            low, high = np.where(sought, self.low[seeds, t], np.inf), np.where(sought, self.high[seeds, t], -np.inf)
            if stratum not in sorted_of:
                rows = _rows_of(g, stratum, whole)
                part = s[:, rows]
                order = np.argsort(part[0], kind="stable") if len(s) == 1 else None
                sorted_of[stratum] = rows, part, order
            rows, part, order = sorted_of[stratum]
            if order is not None:  # one score for all seeds
                values = part[0, order]
                begin, end = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
                many = np.maximum(end - begin, 0)
                i = np.repeat(np.arange(len(seeds)), many)
                j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many - begin, many)]
                v = part[0, j]
            else:
                i, j = np.divmod(np.flatnonzero((part >= low[:, None]) & (part <= high[:, None])), max(1, len(rows)))
                v = part[i, j]
            inside = np.ones(len(v), bool)
            for level in self.levels:
                lo, scale, cell = (x[seeds[i], t] for x in level)
                inside &= self.cell(v, lo, scale) == cell
            yield t, i[inside], rows[j[inside]], v[inside]


#: The splits, or replicates, in which a chunk takes part, in blocks: their numbers, and how often each row counts (None: once).
Draws = Callable[[Chunk], Iterator[tuple[np.ndarray, np.ndarray | None]]]


def of_role(role: int) -> Draws:
    def draws(chunk: Chunk):
        seeds = chunk.seeds(role)
        if len(seeds):
            yield seeds, None

    return draws


def _often(values: np.ndarray, times: np.ndarray | None) -> np.ndarray:
    return values if times is None else np.repeat(values, times)


def _counted(batches, size: int, positions: Callable[[Chunk], Iterator]) -> Iterator[pa.RecordBatch]:
    """positions gives flat places, each counted once, or (numbers of lines, counts along a line)."""
    total, held, n = np.zeros(size, np.int64), [], 0
    for chunk in _chunks(batches):
        for p in positions(chunk):
            if isinstance(p, tuple):
                total.reshape(-1, len(p[1]))[p[0]] += p[1]
                continue
            held.append(p)
            n += len(p)
        if n > HELD:
            total += np.bincount(np.concatenate(held), minlength=size)
            held, n = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=size)
    size = -(-size // PACKED) * PACKED
    lines = np.concatenate([total, np.zeros(size - len(total), np.int64)]).reshape(-1, PACKED)
    block = np.flatnonzero(lines.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array([lines[b].tobytes() for b in block], pa.binary())], ["block", "n"])


def _added(group: pa.Table) -> pa.Table:
    total = np.zeros(PACKED, np.int64)
    for n in group["n"]:
        total += np.frombuffer(n.as_py(), np.int64)
    return pa.table({"block": group["block"].slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})


def _counts(table: DataFrame, shape: tuple[int, ...], positions: Callable[[Chunk], Iterator]) -> Iterator[tuple[slice, np.ndarray]]:
    """Counts of flat positions within the shape, whose size the caller's parameters fix: by blocks of seeds, so that the driver holds few at once."""
    size, each = int(np.prod(shape)), int(np.prod(shape[1:]))
    found = table.mapInArrow(lambda it: _counted(it, size, positions), "block long, n binary").groupBy("block").applyInArrow(_added, "block long, n binary")
    some = max(1, LOOKED // each)
    if some < shape[0]:
        found = stored(found, "counts")
    for a in range(0, shape[0], some):
        b = min(shape[0], a + some)
        first, last = a * each // PACKED, (b * each - 1) // PACKED
        out = np.zeros((last - first + 1) * PACKED, np.int64)
        for block, n in found.where(F.col("block").between(first, last)).collect() if some < shape[0] else found.collect():
            out[(block - first) * PACKED :][:PACKED] = np.frombuffer(n, np.int64)
        yield slice(a, b), out[a * each - first * PACKED :][: (b - a) * each].reshape(b - a, *shape[1:])


def select(table: DataFrame, n_seeds: int, draws: Draws, score: Score, bounds: tuple[float, float], ranks: Callable[[np.ndarray], np.ndarray], strata: Strata, n_strata: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted order statistics of a score over the rows drawn: (values by seed, stratum and rank, counts by seed and stratum).

    Stratum n_strata is the whole. ranks(counts) gives the ranks, from 1, along a last axis; those that are 0 or exceed
    the count have the value NaN. bounds should hold the scores; scores beyond fall into the outer ranges.
    """
    low, high = bounds
    first_scale = CELLS / (high - low) if high > low else 0.0

    def at_first(chunk: Chunk) -> Iterator:
        g = strata(chunk)
        for seeds, times in draws(chunk):
            cell = Targets.cell(score(chunk, seeds), low, first_scale)
            if len(cell) == 1 and times is None:
                yield seeds, np.bincount(g * CELLS + cell[0], minlength=n_strata * CELLS)
            else:
                yield _often(((seeds[:, None] * n_strata + g[None, :]) * CELLS + cell).ravel(), None if times is None else times.ravel())

    def located(block: slice, counts: np.ndarray):
        """Which range holds each wanted rank, how many rows it has, and how many lie before."""
        upto = counts.cumsum(axis=2)
        at = np.minimum((upto < targets.rank[block, :, None]).sum(axis=2), CELLS - 1)
        cell[block] = at
        here[block] = np.take_along_axis(counts, at[:, :, None], 2)[:, :, 0]
        before[block] = np.take_along_axis(upto, at[:, :, None], 2)[:, :, 0] - here[block]

    n, targets = np.zeros((n_seeds, n_strata + 1), np.int64), None
    for block, counts in _counts(table, (n_seeds, n_strata, CELLS), at_first):
        counts = np.concatenate([counts, counts.sum(axis=1, keepdims=True)], axis=1)
        n[block] = counts.sum(axis=2)
        wanted = ranks(n[block])
        wanted = np.where(wanted <= n[block, :, None], wanted, 0)
        if targets is None:
            each = wanted.shape[2]
            targets = Targets([g for g in range(n_strata + 1) for _ in range(each)], np.zeros((n_seeds, (n_strata + 1) * each), np.int64))
            cell, here, before = (np.zeros(targets.rank.shape, np.int64) for _ in range(3))
        targets.rank[block] = wanted.reshape(len(wanted), -1)
        located(block, np.repeat(counts, each, axis=1))
    stratum, rank = targets.stratum, targets.rank
    level_low, level_scale = np.full(rank.shape, float(low)), np.full(rank.shape, first_scale)
    while True:
        targets.rank = np.where(targets.rank > 0, targets.rank - before, 0)  # within the range
        targets.narrow(level_low, level_scale, cell)
        if np.where(targets.rank > 0, here, 0).sum() <= FETCHED or len(targets.levels) >= DEPTH:
            break
        width = np.divide(1.0, level_scale, out=np.zeros_like(level_scale), where=level_scale > 0)
        level_low, level_scale = level_low + cell * width, level_scale * CELLS
        cell, here, before = (np.zeros_like(x) for x in (cell, here, before))

        def again(chunk: Chunk, low=level_low, scale=level_scale) -> Iterator[np.ndarray]:
            g = strata(chunk)
            for seeds, times in draws(chunk):
                for t, i, rows, s in targets.hits(chunk, seeds, score, g):
                    at = (seeds[i] * len(targets.stratum) + t) * CELLS + Targets.cell(s, low[seeds[i], t], scale[seeds[i], t])
                    yield _often(at, None if times is None else times[i, rows])

        for block, counts in _counts(table, (n_seeds, len(stratum), CELLS), again):
            located(block, counts)

    # ranks of one range are fetched once, for the first of them
    first = np.broadcast_to(np.arange(len(stratum)), targets.rank.shape).copy()
    for t, g in enumerate(stratum):
        for u in range(stratum.index(g), t):
            same = np.all([cell[:, t] == cell[:, u] for *_, cell in targets.levels], axis=0) & (targets.rank[:, u] > 0) & (first[:, t] == t)
            first[same, t] = u
    goal_rank, goal_at = targets.rank, np.arange(n_seeds)[:, None] * len(stratum) + first
    targets.rank = np.where(first == np.arange(len(stratum)), targets.rank, 0)

    def fetched(batches):
        """Values by seed and target, equal ones of a task as one."""
        held, size = [], 0

        def batch():
            at, v = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((v, at))
            at, v = at[order], v[order]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (v[1:] != v[:-1])]))
            return pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(v[new]), pa.array(np.diff(np.append(new, len(at))))], ["at", "v", "n"])

        for chunk in _chunks(batches):
            g = strata(chunk)
            for seeds, times in draws(chunk):
                for t, i, rows, s in targets.hits(chunk, seeds, score, g):
                    often = None if times is None else times[i, rows]
                    held.append((_often(seeds[i] * len(targets.stratum) + t, often), _often(s, often)))
                    size += len(held[-1][0])
                if size > HELD:
                    yield batch()
                    held, size = [], 0
        if size:
            yield batch()

    spark = table.sparkSession
    sought = np.flatnonzero(goal_rank.ravel())
    goal = spark.createDataFrame(list(zip(sought.tolist(), goal_at.ravel()[sought].tolist(), goal_rank.ravel()[sought].tolist(), strict=True)), "goal long, at long, k long")
    values = table.mapInArrow(fetched, "at long, v double, n long").groupBy("at", "v").agg(F.sum("n").alias("n"))
    run = F.expr("sum(n) over (partition by at order by v)")
    hit = values.select("at", "v", "n", run.alias("upto")).join(F.broadcast(goal), "at").where("upto >= k and upto - n < k").select("goal", "v").toPandas()
    out = np.full(rank.size, np.nan)
    out[hit["goal"].to_numpy()] = hit["v"].to_numpy()
    return out.reshape(n_seeds, n_strata + 1, each), n


def sums(table: DataFrame, n_keys: int, fields: list[str], part: Callable[[Chunk], Iterator[tuple[np.ndarray, np.ndarray]]], of: Callable[..., Iterator] = _chunks) -> DataFrame:
    """(key, *fields): sums over all chunks, or what else of makes of them; part gives (keys, values by field) of one, keys below n_keys and without repeats."""

    def add(batches):
        total = np.zeros((n_keys, len(fields)))
        for chunk in of(batches):
            for keys, values in part(chunk):
                total[keys] += values
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, i]) for i in range(len(fields))]], ["key", *fields])

    schema = "key long, " + ", ".join(f"{f} double" for f in fields)
    return table.mapInArrow(add, schema).groupBy("key").agg(*[F.sum(f).alias(f) for f in fields])
