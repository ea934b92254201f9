"""Many k-means fits in shared scans (M2, M3): every start of every k is one set of centres, and
one aggregation over the rows moves all sets at once.

The rows are vectors in one array column, packed once into blocks that all scans read. A scan compares each batch of rows with the centres of
all sets that still move and hands out, per task, a count, a cost and a sum for each centre; Spark
adds these up. What returns to the driver is sets x centres x dimensions, whatever the number of
rows. Starts are chosen as in k-means||, all sets in the same scans; a row's random number is a
hash of its values, so a lost task draws the same rows again and the partitioning does not matter.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers held at a time while a task compares rows with centres; rounds and oversampling of the start.
HELD, ROUNDS, OVERSAMPLING = 1 << 20, 2, 2
#: Rows that make a task of their own worth it, and those that a task gets at most.
LEAST_TASK_ROWS, MOST_TASK_ROWS = 2_000, 1_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass
class CentreSet:
    """One start: its centres as they move, and what they cost in the last scan."""
    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    moving: bool = True


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def row_hash(rows: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(rows + 0.0).view(np.uint64)  # -0.0 is 0.0
    h = np.zeros(len(rows), np.uint64)
    for j in range(bits.shape[1]):
        h = _scrambled(h ^ _scrambled(bits[:, j] + np.uint64(j + 1)))
    return h


def uniform(h: np.ndarray, *salts: int) -> np.ndarray:
    for s in salts:
        h = _scrambled(h + np.uint64(s * 2 + 1))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (rows * rows).sum(1)[:, None] - 2.0 * rows @ centres.T + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0.0)


def packed(vectors: DataFrame) -> DataFrame:
    """The vectors as blocks of numbers (d, block), dealt evenly to the cores: every scan reads
    them as they are. Rows with a missing number are left out (they are in no cluster)."""
    n = vectors.count()
    tasks = max(1, min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_TASK_ROWS), -(-n // MOST_TASK_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if len(column) == column.null_count:
                continue
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(len(column) - column.null_count, -1)
            rows, step = rows[~np.isnan(rows).any(axis=1)], max(1, HELD // max(1, rows.shape[1]))
            for low in range(0, len(rows), step):
                yield pa.RecordBatch.from_arrays([pa.array([rows.shape[1]], pa.int32()), pa.array([rows[low:low + step].tobytes()], pa.binary())],
                                                 names=["d", "block"])

    return vectors.repartition(tasks).mapInArrow(pack, "d int, block binary")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The vectors of a task, so many at a time as can be held with ``width`` numbers each."""
    step = max(1, HELD // max(1, width))
    for batch in batches:
        for d, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, d)
            for low in range(0, len(rows), step):
                yield rows[low:low + step]


def _parts(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["part"])


def _scan(blocks: DataFrame, sets: Sequence[np.ndarray]) -> list[tuple]:
    """(set, centre, n, cost, sums): every set's rows per nearest centre (ties: the first)."""
    if not sets:
        return []
    ends = np.cumsum([len(c) for c in sets])
    starts, every, d = ends - [len(c) for c in sets], np.concatenate(list(sets)), sets[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, sums = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros((len(every), d))
        for rows in _blocks(batches, len(every)):
            dist = distances(rows, every)
            for low, high in zip(starts, ends):
                part = dist[:, low:high]
                near = part.argmin(1)
                n[low:high] += np.bincount(near, minlength=high - low)
                cost[low:high] += np.bincount(near, part[np.arange(len(near)), near], minlength=high - low)
                sums[low:high] += (near[None, :] == np.arange(high - low)[:, None]).astype(np.float64) @ rows
        yield _parts(np.column_stack([n, cost, sums]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(every), d + 2))
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer(), dtype=np.float64).reshape(total.shape)
        yield _parts(total)

    # the tasks' sums, one small row each, are added up by one task as they come
    parts = blocks.mapInArrow(run, "part binary").repartition(1).mapInArrow(add, "part binary")
    total = np.frombuffer(parts.collect()[0]["part"], dtype=np.float64).reshape(len(every), d + 2)
    out = []
    for at in np.flatnonzero(total[:, 0]).tolist():
        i = int(np.searchsorted(ends, at, side="right"))
        out.append((i, at - int(starts[i]), int(total[at, 0]), float(total[at, 1]), total[at, 2:].copy()))
    return out


def _draw(blocks: DataFrame, found: Sequence[np.ndarray], cost: Sequence[float], keys: Sequence[tuple[int, int]], round_: int) -> list[list]:
    """Each set's rows that its random number picks, by their squared distance to what is found."""
    ends = np.cumsum([len(c) for c in found])
    starts, every = ends - [len(c) for c in found], np.concatenate(list(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[] for _ in keys]
        for rows in _blocks(batches, len(every)):
            rows = np.unique(rows, axis=0)
            dist, h = distances(rows, every), row_hash(rows)
            for i, ((k, seed), low, high) in enumerate(zip(keys, starts, ends)):
                if cost[i] > 0:
                    chance = OVERSAMPLING * k * dist[:, low:high].min(1) / cost[i]
                    seen[i] += [rows[uniform(h, seed, k, round_) < chance]]
        chosen = [np.unique(np.concatenate(s), axis=0) if s else np.zeros((0, every.shape[1])) for s in seen]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(keys)), [len(c) for c in chosen])),
            pa.array([x.tolist() for c in chosen for x in c], pa.list_(pa.float64()))], names=["at", "x"])

    out: list[list] = [[] for _ in keys]
    for r in blocks.mapInArrow(run, "at long, x array<double>").distinct().collect():  # about 2k rows per set
        out[r["at"]].append(r["x"])
    return [sorted(x) for x in out]


def _weighted_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over the weighted candidates, and rounds of moving centres among them."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < min(k, len(points)):
        w = weights * distances(points, np.array(centres)).min(1)
        if w.sum() <= 0:
            break
        centres.append(points[rng.choice(len(points), p=w / w.sum())])
    out = np.array(centres)
    for _ in range(30):
        near = distances(points, out).argmin(1)
        moved = np.array([np.average(points[near == c], axis=0, weights=weights[near == c]) if weights[near == c].sum() > 0 else out[c]
                          for c in range(len(out))])
        if np.allclose(moved, out, atol=1e-12):
            break
        out = moved
    return out


def starts(vectors: DataFrame, blocks: DataFrame, ks: Sequence[int], seeds: Sequence[int]) -> list[CentreSet]:
    """A start for each (k, seed), all from the same scans of the ``blocks`` of ``vectors``."""
    keys = [(k, s) for k in ks for s in seeds]
    firsts = vectors.agg(*[F.min_by("x", F.xxhash64(F.lit(s), "x")).alias(f"f{i}") for i, s in enumerate(seeds)]).first()
    if firsts is None or firsts["f0"] is None:
        return []
    found = [np.array([firsts[f"f{seeds.index(s)}"]], dtype=np.float64) for _, s in keys]
    for round_ in range(ROUNDS):
        cost = [0.0] * len(keys)
        for i, _, _, c, _ in _scan(blocks, found):
            cost[i] += c
        for i, more in enumerate(_draw(blocks, found, cost, keys, round_)):
            if more:
                found[i] = np.unique(np.concatenate([found[i], np.array(more)]), axis=0)
    weights = [np.zeros(len(f)) for f in found]
    for i, c, n, _, _ in _scan(blocks, found):
        weights[i][c] = n
    return [CentreSet(k, s, _weighted_start(f, w, k, s)) for (k, s), f, w in zip(keys, found, weights)]


def fit_sets(vectors: DataFrame, ks: Sequence[int], seeds: Sequence[int], max_iter: int = 300, tol: float = 1e-4,
             watch: Callable[[list[CentreSet]], None] | None = None) -> list[CentreSet]:
    """All (k, seed) fits of the array column ``x``. A set moves until no centre moves by more than
    ``tol`` or ``max_iter`` scans are done; sets at rest leave the scans, and all get their final
    cost in one last scan. A centre without rows stays where it is."""
    blocks = packed(vectors).persist()
    try:
        return _moved(vectors, blocks, ks, seeds, max_iter, tol, watch)
    finally:
        blocks.unpersist()


def _moved(vectors: DataFrame, blocks: DataFrame, ks: Sequence[int], seeds: Sequence[int], max_iter: int, tol: float,
           watch: Callable[[list[CentreSet]], None] | None) -> list[CentreSet]:
    sets = starts(vectors, blocks, list(ks), list(seeds))
    for _ in range(max_iter):
        live = [s for s in sets if s.moving]
        if not live:
            break
        moved = [s.centres.copy() for s in live]
        for i, c, n, _, sums in _scan(blocks, [s.centres for s in live]):
            moved[i][c] = sums / n
        for s, m in zip(live, moved):
            s.moving = bool((((m - s.centres) ** 2).sum(1) > tol * tol).any())
            s.centres = m
        if watch:
            watch(sets)
    for s in sets:
        s.cost = 0.0
    for i, _, _, cost, _ in _scan(blocks, [s.centres for s in sets]):
        sets[i].cost += cost
    return sets


def best_sets(sets: Sequence[CentreSet]) -> dict[int, CentreSet]:
    """The cheapest set of each k (ties: the earlier seed)."""
    best: dict[int, CentreSet] = {}
    for s in sets:
        if s.k not in best or s.cost < best[s.k].cost:
            best[s.k] = s
    return best
