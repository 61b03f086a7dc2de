"""Quantile regression of y on [1, u, u^2] for many splits, exact on all rows.

All rows of a split never meet in a task. The fit is found on nested samples of the rows, each STEP times larger than the
one before: rows further from the last fit than its uncertainty are only summed up (they keep their side, so their part of
the loss is linear), and the rows of a narrow band are fetched. With all rows in play, a last pass counts rows that left
their side; where there are any, the band is widened and the fit repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlake.operators.splits import TRAIN, Block, blocks, hashed

START, STEP, WIDTH, SPREAD = 2000, 36, 6.0, 100.0  # rows of the first sample, growth, band in errors, scale of u
PIVOTS = 2000
MOST_PASSES = 30  # until a fit counts as failed
TINY = 1e-11  # ties are broken by so much
HELD = 1 << 18  # values that a task keeps before it hands them on
FLOATS = pa.list_(pa.float64())


def design(x: np.ndarray) -> np.ndarray:
    u = x / SPREAD
    return np.stack([np.ones_like(u), u, u * u], axis=-1)


def line(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Fits (..., 3) at x, the same however many are taken at once."""
    u = x / SPREAD
    return beta[..., 0, None] + beta[..., 1, None] * u + beta[..., 2, None] * (u * u)


def solve(x: np.ndarray, y: np.ndarray, tau: float, start: np.ndarray | None = None, above: np.ndarray | None = None, below: np.ndarray | None = None) -> np.ndarray | None:
    """Coefficients of the least check loss, by exchange of one of the three rows that the fit passes through; None if there is no fit.

    above, below: sums of the design over rows that are known to lie on that side.
    """
    rows, first, weight = np.unique(np.stack([x, y]), axis=1, return_index=True, return_counts=True)
    X, y = design(rows[0]), rows[1] + TINY * (hashed(rows[0], rows[1]) - 0.5)
    outside = (0 if above is None else tau * above) - (0 if below is None else (1 - tau) * below)
    at = np.linalg.lstsq(X, y, rcond=None)[0] if start is None else start
    basis: list[int] = []
    for i in np.argsort(np.abs(y - X @ at), kind="stable"):
        if all(rows[0][i] != rows[0][j] for j in basis):
            basis.append(int(i))
        if len(basis) == 3:
            break
    if len(basis) < 3:
        return None
    for _ in range(PIVOTS):
        inverse = np.linalg.inv(X[basis])
        beta = inverse @ y[basis]
        r = y - X @ beta
        free = np.ones(len(y), bool)
        free[basis] = False
        slope = inverse.T @ (((tau - (r < 0)) * weight * free) @ X + outside)
        w = weight[basis]
        up, down = slope - (1 - tau) * w, -slope - tau * w  # gain of letting a row of the basis fall below, or rise above
        j, sign = (int(np.argmax(up)), 1.0) if up.max() >= down.max() else (int(np.argmax(down)), -1.0)
        gain = max(up.max(), down.max())
        if gain <= 1e-9 * max(1.0, weight.sum()):
            return beta
        d = sign * inverse[:, j]  # the fit moves away from this row
        step = X @ d
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(free & (np.abs(step) > 1e-14), r / step, -1.0)
        ahead = np.flatnonzero(t > 0)
        order = ahead[np.argsort(t[ahead], kind="stable")]
        passed = np.cumsum(np.abs(step[order]) * weight[order])
        k = int(np.searchsorted(passed, gain))
        if k >= len(order):
            return None
        basis[j] = int(order[k])
    return None


def fit(table, n_seeds: int, taus: tuple[float, ...], n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients by seed and tau over the train rows of a table of chunks, NaN where a fit failed, and passes made for each."""
    n_fits = n_seeds * len(taus)
    beta, half, done = np.full((n_fits, 3), np.nan), np.zeros(n_fits), np.zeros(n_fits, bool)
    share, passes = min(1.0, 2 * START / max(n_rows, 1)), 0
    first = True
    while True:
        passes += 1

        def gather(batches, beta=beta, half=half, share=share, done=done, first=first):
            sides, held, size = np.zeros((n_fits, 7)), [], 0

            def batch():
                f, x, y = (np.concatenate(v) for v in zip(*held, strict=True))
                order = np.argsort(f, kind="stable")
                f = f[order]
                new = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                ends = pa.array(np.append(new, len(f)), pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(f[new]), *[pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (x, y)], pa.nulls(len(new), FLOATS)], ["fit", "x", "y", "sides"])

            def told(f):
                none = pa.array([[]] * len(f), FLOATS)
                return pa.RecordBatch.from_arrays([pa.array(f), none, none, pa.array(list(sides[f]), FLOATS)], ["fit", "x", "y", "sides"])

            for block in blocks(batches, TRAIN, share):
                for f, n, X, over, under, x, y, at in _split(block, len(taus), beta, half, done, first):
                    sides[f, 6] += n
                    if not first:
                        sides[f, :3] += over @ X
                        sides[f, 3:6] += under @ X
                    if len(at):
                        held.append((at, x, y))
                        size += len(at)
                    if size > HELD:
                        yield batch()
                        held, size = [], 0
            if held:
                yield batch()
            if (seen := np.flatnonzero(sides[:, 6])).size:
                yield told(seen)

        def solved(group: pa.Table) -> pa.Table:
            f = group["fit"][0].as_py()
            x, y = (group[c].combine_chunks().flatten().to_numpy() for c in "xy")
            sides = group["sides"].drop_null().combine_chunks().flatten().to_numpy().reshape(-1, 7).sum(axis=0)
            got = solve(x, y, taus[f % len(taus)], None if first else beta[f], sides[:3], sides[3:6])
            spread = 0.0
            if got is not None:
                r = np.abs(y - design(x) @ got)
                part = min(1.0, WIDTH / np.sqrt(sides[6])) * sides[6] / max(len(r), 1)  # of all rows, those fetched are the nearest
                spread = float(np.quantile(r, min(1.0, part)))
            return pa.table({"fit": [f], "beta": [list(map(float, got)) if got is not None else None], "half": [spread]}, schema=pa.schema([("fit", pa.int64()), ("beta", pa.list_(pa.float64())), ("half", pa.float64())]))

        rows = table.mapInArrow(gather, "fit long, x array<double>, y array<double>, sides array<double>")
        found = rows.groupBy("fit").applyInArrow(solved, "fit long, beta array<double>, half double").toPandas()
        before, last_half = beta.copy(), half.copy()
        for f, b, h in found.itertuples(index=False):
            beta[f], half[f] = (b if b is not None else np.nan), h
        if share < 1:
            share, first = min(1.0, share * STEP), False
            continue
        if first:
            return beta.reshape(n_seeds, len(taus), 3), np.full((n_seeds, len(taus)), passes)
        # rows that were summed up must still lie on their side
        def strayed(batches, beta=beta, before=before, half=last_half, done=done):
            n = np.zeros(n_fits, np.int64)
            for block in blocks(batches, TRAIN):
                f = _fits(block.of.any(axis=0), len(taus), done)
                f = f[~np.isnan(beta[f, 0]) & ~np.isnan(before[f, 0])]
                if block.few:
                    old, new = line(before[f], block.x).T, line(beta[f], block.x).T
                    n[f] += block.count(block.places(old + half[f], "right"), block.places(new, "left"), f // len(taus)).sum(axis=0)
                    n[f] += block.count(block.places(new, "right"), block.places(old - half[f], "left"), f // len(taus)).sum(axis=0)
                    continue
                for chunk in block.chunks:
                    g = f[chunk.roles[f // len(taus)] == TRAIN]
                    old, new = line(before[g], chunk.x), line(beta[g], chunk.x)
                    n[g] += (((chunk.y > old + half[g, None]) & (chunk.y < new)) | ((chunk.y < old - half[g, None]) & (chunk.y > new))).sum(axis=1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["fit", "n"])

        wrong = table.mapInArrow(strayed, "fit long, n long").groupBy("fit").agg(F.sum("n").alias("n")).toPandas()["fit"].to_numpy()
        redo = np.zeros(n_fits, bool)
        redo[wrong] = True
        redo |= np.isnan(beta[:, 0]) & ~np.isnan(before[:, 0]) & ~done  # a band without a fit is too narrow as well
        if passes > MOST_PASSES:
            beta[redo] = np.nan  # not proved: no fit, counted as a failure
        if not redo.any() or passes > MOST_PASSES:
            return beta.reshape(n_seeds, len(taus), 3), np.full((n_seeds, len(taus)), passes)
        done = ~redo
        beta[redo], half[redo] = before[redo], last_half[redo] * 3


def _fits(seeds: np.ndarray, n_taus: int, done: np.ndarray) -> np.ndarray:
    """Numbers of the fits, by seed and tau, that are still sought."""
    f = (np.flatnonzero(seeds)[:, None] * n_taus + np.arange(n_taus)).ravel()
    return f[~done[f]]


def _split(block: Block, n_taus: int, beta: np.ndarray, half: np.ndarray, done: np.ndarray, first: bool) -> Iterator[tuple]:
    """(fits, their rows, a design, how many rows lie above and below the bands at each of its lines, x, y and fit of the rows in the bands); at first all rows are in."""
    if block.few:
        f = _fits(block.of.any(axis=0), n_taus, done)
        s, X = f // n_taus, design(block.x)
        begin, end = (np.broadcast_to(e[:, None], (len(block.x), len(f))) for e in (block.ends[:-1], block.ends[1:]))
        n, none = block.count(begin, end, s).sum(axis=0), np.zeros((len(f), len(block.x)))
        if first:
            _, i, r = block.rows(begin, end, s)
            yield f, n, X, none, none, block.all_x[r], block.y[r], f[i]
            return
        yield f, n, X, none, none, np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        g = f[~np.isnan(beta[f, 0])]  # a fit that failed before has no band
        if len(g):
            s, at = g // n_taus, line(beta[g], block.x).T
            a, b = block.places(at - half[g], "left"), block.places(at + half[g], "right")
            _, i, r = block.rows(a, b, s)
            yield g, 0, X, block.count(b, end[:, : len(g)], s).T, block.count(begin[:, : len(g)], a, s).T, block.all_x[r], block.y[r], g[i]
        return
    for chunk in block.chunks:
        f = _fits(chunk.roles == TRAIN, n_taus, done)
        if first:
            yield f, len(chunk.x), None, None, None, np.tile(chunk.x, len(f)), np.tile(chunk.y, len(f)), np.repeat(f, len(chunk.x))
            continue
        at = line(beta[f], chunk.x)
        over, under = chunk.y > at + half[f, None], chunk.y < at - half[f, None]
        i, r = np.nonzero(~(over | under) & ~np.isnan(at))
        yield f, len(chunk.x), design(chunk.x), over, under, chunk.x[r], chunk.y[r], f[i]
