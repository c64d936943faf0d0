"""Best-fit packing by the linear grouping scheme.

The plan depends only on how many pieces have each length, and there are at most ``capacity``
lengths, so the driver plans over a histogram of bounded size whatever the number of documents:

1. *Linear grouping*: pieces above ``small`` are cut, in order of length, into groups of equal
   cardinality, and each length counts as the largest of its group.
2. *Few-size configurations*: over these few sizes, the least number of bins is a linear programme
   over configurations, solved by column generation (``optimised``); whole multiples of its
   configurations are used first, and what is left is filled by the fullest configuration that the
   stock allows, again and again.  The programme is solved for a few sizes, the rest rule alone also for
   many (finer rounding), and the plan with the fewest sequences counts.
3. *Substitution*: real lengths, longest first, take the places of the rounded ones.  Bins that
   received the same lengths form one *run* (a count and a free space), so the plan stays small.
4. *Best fit*: small lengths, longest first, go to the runs with the least free space that holds
   them, which is the very result of best fit on single bins; what is left opens new bins.

On the cluster each piece gets its rank among the pieces of its length (salted by the count of the
length, so a task ranks about ``RANKED`` pieces), and a lookup in the broadcast plan turns (length,
rank) into (sequence, offset).  Pieces that fill a sequence alone need no rank, only a number of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Size groups of the linear programme, and of the rest rule alone.
FEW, GROUPS = 48, 512
#: Pieces of a length that are ranked in one task, about.
RANKED = 200_000
#: Columns that the linear programme may generate.
COLUMNS = 400


def _fullest(sizes: list[int], stock: list[int], capacity: int) -> list[tuple[int, int]]:
    """The configuration [(size index, count)] of most rounded length within the stock, large sizes first on ties."""
    reach = np.full(capacity + 1, -1, np.int32)  # last size index that reached this sum
    before = np.zeros(capacity + 1, np.int32)
    reach[0] = len(sizes)
    for i, (size, left) in enumerate(zip(sizes, stock, strict=True)):
        if not left:
            continue
        frontier = np.flatnonzero(reach >= 0)
        for _ in range(min(left, capacity // size)):
            to = frontier + size
            ok = to <= capacity
            frontier, to = frontier[ok], to[ok]
            fresh = reach[to] < 0
            frontier, to = frontier[fresh], to[fresh]
            if not len(to):
                break
            reach[to], before[to] = i, frontier
            frontier = to
        if reach[capacity] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    counts: dict[int, int] = {}
    while at:
        counts[int(reach[at])] = counts.get(int(reach[at]), 0) + 1
        at = int(before[at])
    return sorted(counts.items())


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth, any number of each size: a knapsack over sums 0 ... capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if w <= 1e-9:
            continue
        for _ in range(capacity // size):  # one more piece of this size wherever it pays
            more = value[:-size] + w
            better = more > value[size:] + 1e-12
            if not better.any():
                break
            value[size:][better], last[size:][better] = more[better], i
    counts, at = np.zeros(len(sizes), int), int(value.argmax())
    while at > 0 and last[at] >= 0:
        counts[last[at]] += 1
        at -= int(sizes[last[at]])
    return float(worth @ counts), counts


def optimised(sizes: list[int], stock: list[int], capacity: int, columns: int = COLUMNS) -> list[tuple[int, list[tuple[int, int]]]]:
    """``[(times, [(size index, count)])]``: whole multiples of the configurations that an optimal linear programme uses.

    Minimise the bins over all configurations of the sizes; the revised simplex method keeps one
    configuration for each size, and a knapsack finds the next one to bring in.
    """
    size, need = np.array(sizes), np.array(stock, float)
    n = len(size)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(columns):
        prices = np.linalg.solve(basis.T, np.ones(n))
        worth, column = _best_pattern(size, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        held, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(held, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    used, left, out = np.floor(np.linalg.solve(basis, need) + 1e-6), np.array(stock), []
    for k in np.argsort(-used, kind="stable").tolist():
        config = basis[:, k].astype(int)
        inside = np.flatnonzero(config)
        times = int(min(used[k], *(left[inside] // config[inside]))) if len(inside) else 0
        if times > 0:
            left -= times * config
            out.append((times, [(int(i), int(config[i])) for i in inside]))
    return out


def plan(histogram: dict[int, int], capacity: int, small: int | None = None, groups: int = GROUPS, few: int = FEW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """``([(length, first rank, count, first sequence, per sequence, offset)], sequences)``.

    The ranks [first, first + count) of a length fill consecutive sequences from ``first sequence``,
    ``per sequence`` pieces in each, from ``offset`` on.  Of the optimised plan over ``few`` sizes and the
    plan of fullest configurations over ``groups`` sizes, the one with fewer sequences (the former on ties).
    """
    return min((_plan(histogram, capacity, small, few, True), _plan(histogram, capacity, small, groups, False)), key=lambda p: p[1])


def _plan(histogram: dict[int, int], capacity: int, small: int | None, groups: int, optimise: bool) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    small = capacity // 8 if small is None else small
    lengths = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    if lengths and lengths[0] > capacity:
        raise ValueError(f"a piece of {lengths[0]} tokens exceeds the capacity {capacity}")
    large = [n for n in lengths if n > small]
    total = sum(histogram[n] for n in large)
    per_group = max(1, -(-total // groups))

    # 1. groups of equal cardinality: their rounded size and their real lengths, longest first
    sizes: list[int] = []
    members: list[list[list[int]]] = []
    room = 0
    for n in large:
        left = histogram[n]
        while left:
            if not room:
                sizes.append(n)
                members.append([])
                room = per_group
            take = min(left, room)
            members[-1].append([n, take])
            room -= take
            left -= take
    merged: dict[int, list[list[int]]] = {}
    for size, rows in zip(sizes, members, strict=True):  # a length may fill whole groups: same size, one stock
        merged.setdefault(size, []).extend(rows)
    sizes, members = list(merged), list(merged.values())
    stock = [sum(c for _, c in rows) for rows in members]

    # 2. and 3. configurations, with real lengths put in: runs of equal bins
    runs: list[tuple[int, int, list[tuple[int, int]]]] = []  # (bins, free, [(length, count)])
    chosen = optimised(sizes, stock, capacity) if optimise and sizes else []
    chosen.reverse()
    while any(stock):
        if chosen:
            times, config = chosen.pop()
        else:
            config = _fullest(sizes, stock, capacity)
            times = min(stock[i] // c for i, c in config)
        places = [i for i, c in config for _ in range(c)]
        for i, c in config:
            stock[i] -= c * times
        # each place takes `times` pieces of its group in a row; bins between two changes of length are alike
        takes = []
        for i in places:
            own, need = [], times
            while need:
                row = members[i][0]
                take = min(need, row[1])
                own.append([row[0], take])
                row[1] -= take
                need -= take
                if not row[1]:
                    members[i].pop(0)
            takes.append(own)
        done = 0
        while done < times:
            step = min(own[0][1] for own in takes)
            inside = [own[0][0] for own in takes]
            runs.append((step, capacity - sum(inside), [(n, 1) for n in inside]))
            for own in takes:
                own[0][1] -= step
                if not own[0][1]:
                    own.pop(0)
            done += step

    # 4. best fit of the small ones over runs ordered by free space
    order: list[tuple[int, int]] = []  # (free, run id), sorted
    table: dict[int, tuple[int, int, list[tuple[int, int]]]] = {}

    def put(bins: int, free: int, inside: list[tuple[int, int]]) -> None:
        if bins:
            key = len(table)
            table[key] = (bins, free, inside)
            insort(order, (free, key))

    for run in runs:
        put(*run)
    for n in (n for n in lengths if n <= small):
        left = histogram[n]
        while left:
            at = bisect_left(order, (n, -1))
            if at == len(order):
                per = capacity // n
                put(left // per, capacity - per * n, [(n, per)])
                if left % per:
                    put(1, capacity - (left % per) * n, [(n, left % per)])
                break
            free, key = order.pop(at)
            bins, _, inside = table[key]
            per = free // n
            full = min(bins, left // per)
            rest = left - full * per if full < bins else 0
            rest = min(rest, per - 1) if full < bins else 0
            put(full, free - per * n, [*inside, (n, per)])
            if rest:
                put(1, free - rest * n, [*inside, (n, rest)])
            put(bins - full - bool(rest), free, inside)
            table[key] = (0, 0, [])
            left -= full * per + rest

    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, _, inside in table.values():
        offset = 0
        for n, per in inside if bins else ():
            first = rank.get(n, 0)
            rows.append((n, first, bins * per, sequence, per, offset))
            rank[n] = first + bins * per
            offset += n * per
        sequence += bins
    return rows, sequence


def pack(pieces: DataFrame, capacity: int = 4096, groups: int = GROUPS, few: int = FEW, ranked: int = RANKED) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length`` (other columns pass through).

    The rows are stored once with a number each.  Repeated rows are packed each; rows of no or null length
    get a null sequence; a piece longer than the capacity is an error.  Within a length any rank will do, so
    ranks follow the numbers, and neither a hot document nor a hot length reaches one task.  Given columns
    ``sequence_id`` and ``offset`` are replaced, ``_row`` is reserved.  An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "_row")  # the first two are given anew
    with common.small_batches(spark):  # the pieces come from whole texts
        stored = common.cut(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counted = {int(r["length"]): int(r["count"]) for r in stored.where("length > 0").groupBy("length").count().collect()}  # at most `capacity` rows
    if max(counted, default=0) > capacity:
        raise ValueError(f"a piece of {max(counted)} tokens exceeds the capacity {capacity}")
    shorter = {n: c for n, c in counted.items() if n < capacity}
    rows, used = plan(shorter, capacity, groups=groups, few=few)
    table = np.array(sorted(rows) or [(0,) * 6], np.int64)
    shared = spark.sparkContext.broadcast(table)

    # rank within a length in two steps: inside (length, salt), plus the counts of lower salts
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // ranked)) for n, c in shorter.items()], "_of long, _salts long"))
    salted = stored.where(F.col("length").between(1, capacity - 1)).join(salts, F.col("length") == F.col("_of")).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts"))).drop("_of", "_salts")
    below = (
        salted.groupBy("length", "_salt").count()
        .withColumn("_below", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("length", "_salt", "_below")
    )
    inner = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    below, _ = common.sized(below, "packing-below")
    numbered = salted.withColumn("_inner", inner).join(below, ["length", "_salt"]).withColumn("_rank", F.col("_inner") + F.col("_below"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = shared.value
        n, r = length.fillna(0).to_numpy(np.int64), rank.fillna(0).to_numpy(np.int64)
        ok = (n > 0) & rank.notna().to_numpy()
        # rows are sorted by (length, first rank): find the last row at or before each piece
        shift = np.int64(1) << np.int64(48)
        at = np.searchsorted(t[:, 0] * shift + t[:, 1], n * shift + r, side="right") - 1
        row = t[np.maximum(at, 0)]
        j = r - row[:, 1]
        per = np.maximum(row[:, 4], 1)
        out = pd.DataFrame({"sequence_id": row[:, 3] + j // per, "offset": row[:, 5] + j % per * n})
        return out.where(pd.Series(ok), None).astype("Int64")

    placed = numbered.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")
    full = stored.where(F.col("length") == capacity).select(*pieces.columns, (F.col("_row") + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    none = stored.where("length is null or length <= 0").select(*pieces.columns, *(F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset")))
    return placed.unionByName(full).unionByName(none)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (32-bit little-endian), from rows that kept ``ids``.

    A sequence holds at most ``capacity`` ids, so each group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.where("sequence_id is not null").groupBy("sequence_id").agg(parts.alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))
    )
