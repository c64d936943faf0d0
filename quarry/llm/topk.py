"""Exact top-k inner product search with a pivot table.

Distances of every vector to fixed pivots are computed once.  For a query q and a vector x each
pivot p gives ``d(q, x) >= |d(q, p) - d(x, p)|``, and since ``<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2``
the largest such bound limits the score from above.  Candidates are evaluated in the order of these
limits until no limit reaches the k-th best score: the result is exact.

Both sides travel as packed blocks, each ordered by nearest pivot so that the pivot distances inside
one vary little.  The k-th best score of a query in the pivots' own sample is a threshold that its
result cannot stay below.  A block of candidates and a block of queries meet only if the limit that
the ranges of their pivot distances leave reaches the least threshold of the query block.  Queries are
the small side (a stated set), so they are copied to the candidate blocks they meet; every candidate
block is shuffled once, whatever the number of queries, and each pair of blocks can run in a task of its own.
"""

from __future__ import annotations

from decimal import Decimal
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixtures import spread
from . import common

PIVOTS = 32
#: Most rows, and most bytes of components, of a block; smaller tables are cut so that there are ``BLOCKS_PER_CORE`` blocks for each core.
BLOCK, BLOCK_BYTES, BLOCKS_PER_CORE = 16384, 16_000_000, 3
QUERY_BLOCK = 512
#: Bytes of query blocks that one pass broadcasts.
PASS_BYTES = 64_000_000
#: Bytes of components that are ordered by nearest pivot together.
ORDERED_BYTES = 64_000_000
#: Rows (smallest hash first) from which the pivots are picked: a bounded sample, which affects speed only.
PIVOT_SAMPLE = 2000
#: A score outside 64 bits is ranked by its own column.
_LONG, _WIDE = 1 << 63, 10**38 - 1


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) as doubles (whole numbers of any size).

    Vectors that are null or empty, or have null or non-finite components, or a component whose multiple is not finite, take no part.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: e * scale)
    good = (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.when(F.abs(e) < 2.0**53, F.floor(e).cast("double")).otherwise(e))  # larger doubles are whole already
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", whole.alias("v"))


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far-apart rows: each next one maximises the least distance to those before."""
    if not len(sample):
        return sample
    chosen = [0]
    least = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances rows x pivots, by differences (no cancellation)."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(rows), 0))


def products(x: np.ndarray, q: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of whole-number rows with a whole-number vector: doubles, 64-bit or Python integers, as their size needs."""
    bound = float(np.abs(x).max(initial=0.0)) * float(np.abs(q).sum())
    if bound < 2.0**53:
        return (x @ q).astype(np.int64)
    if bound < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(a) for a in q]
    return [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x]


def limits(q2: float, x2: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of scores from squared lengths and a lower bound of the distance; rounding is far below the slack added here."""
    with np.errstate(invalid="ignore", over="ignore"):
        out = (q2 + x2 - np.maximum(low - 1e-6 * (1 + low), 0) ** 2) / 2 + 1e-6 * (1 + np.abs(x2) + q2)
    return np.where(np.isnan(out), np.inf, out)


def search_block(q: np.ndarray, q_ids: np.ndarray, q_d: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, x_d: np.ndarray, k: int, step: int = 256):
    """For each query up to k best of the block with scores of ``least`` or more, as ``(query row, [(-score, id)])``.

    Candidates are evaluated in the order of their limits, until the next limit is below the k-th score.
    """
    with np.errstate(over="ignore"):
        q2, x2 = (q**2).sum(1), (x**2).sum(1)
    for i in range(len(q)):
        limit = limits(q2[i], x2, np.abs(x_d - q_d[i]).max(1) if x_d.shape[1] else np.zeros(len(x)))
        limit[ids == q_ids[i]] = -np.inf
        near = np.flatnonzero((limit >= least[i]) & (limit > -np.inf))
        order = near[np.argsort(-limit[near], kind="stable")]
        best: list[tuple[int, int]] = []
        at, size = 0, step
        while at < len(order) and (len(best) < k or limit[order[at]] >= -best[-1][0]):
            some = order[at : at + size]
            s, n = products(x[some], q[i]), ids[some]
            if isinstance(s, np.ndarray):
                first = np.lexsort((n, -s))[:k]
                s, n = s[first].tolist(), n[first]
            best = sorted([*best, *zip((-a for a in s), n.tolist(), strict=True)])[:k]
            at, size = at + size, size * 2
        yield i, best


def _rows_by_length(batch: pa.RecordBatch):
    """``(dim, ids, rows)`` of an Arrow batch for each length of vector."""
    ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        yield dim, ids[sizes == dim], flat[np.repeat(sizes == dim, sizes)].reshape(-1, dim)


_BLOCK = "block long, dim int, n int, low array<double>, high array<double>, norm double, least double, ids binary, v binary, d binary, bars binary"


def _blocks(vectors: DataFrame, sample, size: int, k: int = 0) -> DataFrame:
    """Packed blocks of at most ``size`` rows of one length, with the ranges of their pivot distances and their greatest squared length.

    With ``k``, each row's bar is its k-th best score in the sample (other ids only; minus infinity where it has fewer).
    """

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def out(dim: int):
            nonlocal number
            ids, v = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            pivots, s_ids, s_v = sample.value.get(dim, (np.empty((0, dim)), np.empty(0, np.int64), np.empty((0, dim))))
            d = distances(v, pivots)
            order = np.argsort(d.argmin(1), kind="stable") if d.shape[1] else np.arange(len(v))
            for at in range(0, len(order), size):
                rows = order[at : at + size]
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = float((v[rows] ** 2).sum(1).max())
                    bars = np.full(len(rows), -np.inf)
                    if k and len(s_ids) > k:
                        scores = np.where(s_ids == ids[rows][:, None], -np.inf, v[rows] @ s_v.T)
                        bars = np.partition(scores, -k, 1)[:, -k] - 1e-6 * (1 + norm + float((s_v**2).sum(1).max()))
                        bars = np.where(np.isfinite(bars), bars, -np.inf)
                yield {
                    "block": number, "dim": dim, "n": len(rows), "low": d[rows].min(0).tolist(), "high": d[rows].max(0).tolist(), "norm": norm, "least": float(bars.min()),
                    "ids": ids[rows].astype("<i8").tobytes(), "v": v[rows].astype("<f8").tobytes(), "d": d[rows].astype("<f8").tobytes(), "bars": bars.astype("<f8").tobytes(),
                }
                number += 1

        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}.get(t, pa.list_(pa.float64()))) for n, t in (f.split() for f in _BLOCK.split(", "))])
        for batch in batches:
            for dim, ids, rows in _rows_by_length(batch):
                held.setdefault(dim, []).append((ids, rows))
                if sum(r.nbytes for _, r in held[dim]) >= ORDERED_BYTES:
                    for row in out(dim):
                        yield pa.RecordBatch.from_pylist([row], schema)
        for dim in list(held):
            for row in out(dim):
                yield pa.RecordBatch.from_pylist([row], schema)

    return vectors.mapInArrow(pack, _BLOCK)


def _passes(asked: DataFrame) -> list:
    """The query blocks in broadcasts of about ``PASS_BYTES``, one a pass."""
    spark, out, held, size = asked.sparkSession, [], [], 0
    for r in asked.toLocalIterator():
        held.append(r.asDict())
        size += len(r["v"]) + len(r["d"])
        if size >= PASS_BYTES:
            out.append(spark.sparkContext.broadcast(held))
            held, size = [], 0
    return [*out, spark.sparkContext.broadcast(held)] if held or not out else out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of rows ``vec_id, embedding``: each query's k best, ties to the smaller id.

    A query never finds rows with its own id.  Repeated rows are separate candidates; of rows that repeat a
    query id the smallest vector asks.  Vectors of several lengths meet those of their own length.  Scores are
    exact for components of any size; one outside 64 bits is ranked by up to 38 digits and shown as the nearest long.
    Fewer than k candidates give all; empty tables give an empty table; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = integers(spread(vectors))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    picked: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).collect():
        picked.setdefault(len(r["v"]), []).append(r)
    sampled = {dim: np.array([r["v"] for r in rs]) for dim, rs in picked.items()}
    sample = spark.sparkContext.broadcast({dim: (pick_pivots(v, pivots), np.array([r["vec_id"] for r in picked[dim]], np.int64), v) for dim, v in sampled.items()})

    even = -(-n // (BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism))
    size = max(1, min(block, BLOCK_BYTES // (8 * (width or 1)), max(even, 256)))
    one = integers(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = common.cut(_blocks(one, sample, query_block, k), "topk-queries")
    found_in = common.cut(_blocks(rows, sample, size), "topk-candidates")

    def search(own, batches):
        for batch in batches:
            for j in range(batch.num_rows):
                r = batch.slice(j, 1).to_pylist()[0]
                low, high, norm = np.array(r["low"]), np.array(r["high"]), np.array([r["norm"]])
                of = lambda data, m: np.frombuffer(data, "<f8").reshape(m, -1) if data else np.empty((m, 0))
                ids = np.frombuffer(r["ids"], "<i8")
                x, x_d = of(r["v"], len(ids)), of(r["d"], len(ids))
                for q in own.value:
                    if q["dim"] != r["dim"]:
                        continue
                    apart = np.maximum(np.maximum(low - np.array(q["high"]), np.array(q["low"]) - high), 0).max(initial=0.0)
                    if limits(q["norm"], norm, np.array([apart]))[0] < q["least"]:
                        continue
                    q_ids = np.frombuffer(q["ids"], "<i8")
                    best = search_block(of(q["v"], len(q_ids)), q_ids, of(q["d"], len(q_ids)), np.frombuffer(q["bars"], "<f8"), x, ids, x_d, k)
                    out = [(int(q_ids[i]), n, max(-_LONG, min(_LONG - 1, -s)), Decimal(max(-_WIDE, min(_WIDE, -s))) if abs(s) >= _LONG - 1 else None) for i, some in best for s, n in some]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0)), strict=True)], names=["query_id", "vec_id", "score", "wide"])

    kinds = "query_id long, vec_id long, score long, wide decimal(38,0)"
    found = [found_in.mapInArrow(partial(search, own), kinds) for own in _passes(asked)]
    found = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
