"""Mixing sources to target weights by Sainte-Lague apportionment.

Word counts per source give capped targets; equal blocks of words are allocated to sources by the
highest quotients ``target / (2k + 1)``, and every output shard gets a whole number of each source's
blocks.  A source's quota becomes a number of full passes over its documents and one partial pass in a
seeded order: hash bins of documents, by the running sum of their words, until the words still wanted
are reached.  The same running sum says which shard's blocks a bin belongs to.  Documents that hold more
than a small share of the quota are decided first, longest first, and so are groups of equal rows, copy by
copy: of n equal rows as many are taken once more as the words that are due allow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
#: Least number of blocks shared out, and the least number for the smallest target; a source's quota is exact to half a block.
BLOCKS, LEAST_BLOCKS = 1 << 20, 1 << 12
#: Hash bins that order a source's documents.
BINS = 1 << 16
#: A document (or a group of equal rows) of more than one in so many words of its source's quota is decided apart; a source has fewer than ``BINS`` of them.
APART = 4096
#: What the mix adds.
ADDED = ("size", "source_size", "target", "times", "taken", "shard")


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of ``sum(sizes)`` in proportion to the weights, none above ``cap * size``, the excess reshared."""
    total = float(sum(sizes))
    target = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        scale = left / sum(weights[i] for i in free)
        over = [i for i in free if scale * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = scale * weights[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def sainte_lague(target: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients target / (2k + 1); ties go to the earlier source.

    The lowest winning quotient is found by bisection, so the work does not grow with the seats.
    """
    t = np.asarray(target, float)
    if seats <= 0 or t.sum() <= 0:
        return [0] * len(t)
    won = lambda q: np.where(t >= q, np.floor((t / q + 1) / 2), 0).astype(np.int64)  # noqa: E731  quotients of at least q
    low, high = t.sum() / (4.0 * seats + 4 * len(t)), t.max() * 2
    for _ in range(200):
        mid = (low + high) / 2
        if won(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    got = won(high)
    nxt = t / (2 * got + 1)
    for i in sorted(range(len(t)), key=lambda i: (-nxt[i], i))[: seats - int(got.sum())]:
        got[i] += 1
    return got.tolist()


def plan(sources: list[tuple[str | None, int]], weights=WEIGHTS, cap: float = 3.0, shards: int = 16) -> list[tuple]:
    """``(source, source_size, target, quota words, passes, rest words, quota words per shard)``; sources by code point, null last."""
    sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [int(n) for _, n in sources]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    total = sum(sizes)
    least = min((t for t in target if t > 0), default=0.0)
    seats = min(total, max(BLOCKS, int(LEAST_BLOCKS * total / least))) if least else 0
    got = sainte_lague(target, seats)
    out = []
    for (name, size), t, blocks in zip(sources, target, got, strict=True):
        words = min(cap * size, blocks * total / seats) if seats else 0.0
        passes = min(int(words // size), int(cap)) if size else 0
        rest = max(0.0, words - passes * size) if passes < cap else 0.0
        scale = words / blocks if blocks else 0.0
        quotas = [scale * (blocks * (h + 1) // shards - blocks * h // shards) for h in range(shards)]
        out.append((name, size, float(t), float(words), passes, float(rest), quotas))
    return out


def choose(sizes: list[int], copies: list[int], share: float) -> list[int]:
    """For groups of equal rows in a row, the copies taken once more: as many as bring the words taken nearest to the words due."""
    due = taken = 0.0
    more = []
    for size, n in zip(sizes, copies, strict=True):
        due += share * size * n
        c = min(n, max(0, int((due - taken) / size + 0.5))) if size else 0
        taken += c * size
        more.append(c)
    return more


def deal(size: int, n: int, passes: int, more: int, lacking: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Copies of a group per shard, as ``(copies before each next shard, words per shard)``.

    A single document goes to the shard that lacks most words; the copies of several are shared out by what the shards lack.
    """
    if n == 1:
        own = int(lacking.argmax())
        share = np.arange(len(lacking)) == own
    else:
        share = np.maximum(lacking, 0) if (lacking > 0).any() else np.ones(len(lacking))
    words = lambda j: size * (passes * j + np.minimum(j, more))  # noqa: E731  of the first j copies
    goal = np.cumsum(share) / share.sum() * float(words(n))
    first = float(words(more))
    with np.errstate(divide="ignore", invalid="ignore"):
        place = np.where(goal <= first, goal / (size * (passes + 1)), more + (goal - first) / (size * passes) if passes else n)
    ends = np.minimum(np.floor(place + 0.5), n).astype(np.int64)
    ends[share.cumsum() >= share.sum()] = n
    return ends[:-1].tolist(), np.diff(words(ends), prepend=0.0)


def _marked(docs: DataFrame, weights, cap: float, seed: int, shards: int) -> DataFrame:
    """Every row of ``docs`` as ``_row`` (a struct, so its columns cannot clash) with ``_size, _source_size, _target, _times, _shard``."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(F.struct("*").alias("_row"), "source", "doc_id", size.alias("_size"), key.alias("_key")).withColumn("_bin", F.pmod("_key", F.lit(BINS)).cast("int"))
    narrow = common.cut(rows.select("source", "doc_id", "_size", "_key", "_bin"), "mix-sizes")
    # the plan is the driver's: a name and three numbers for each source
    per_source = narrow.groupBy("source").agg(F.sum("_size").alias("words")).collect()
    planned = plan([(r["source"], r["words"]) for r in per_source], weights, cap, shards)
    own = F.col("source").eqNullSafe(F.col("_source"))
    small = (lambda df: F.broadcast(df)) if len(planned) <= common.BROADCAST_ROWS // shards else (lambda df: df)

    head = [(s, n, t, passes, rest, max(n / BINS, min(n, words) / APART), quotas) for s, n, t, words, passes, rest, quotas in planned]
    head = small(spark.createDataFrame(head, "_source string, _source_size long, _target double, _passes int, _rest double, _long double, _quotas array<double>"))
    sized = narrow.where("_size > 0").join(head, own)
    group = ["source", "doc_id", "_key", "_size", "_bin"]

    # groups of equal rows that hold many words make a heavy bin, so only rows of heavy bins are grouped
    short = sized.where("_size <= _long").groupBy("source", "_bin").agg(F.sum("_size").alias("words"), F.first("_long").alias("_long"))
    short = common.cut(short, "mix-bins")
    heavy, _ = common.sized(short.where("words > _long").select(F.col("source").alias("_of"), F.col("_bin").alias("_heavy")), "mix-heavy")
    inside = sized.where("_size <= _long").join(heavy, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_bin") == F.col("_heavy")))
    plans = ["_source_size", "_rest", "_passes", "_quotas"]
    many = inside.groupBy(*group, *plans, "_long").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and n * _size > _long").drop("_long")
    apart = sized.where("_size > _long").groupBy(*group, *plans).agg(F.count(F.lit(1)).alias("n")).unionByName(many)

    def decide(pdf):
        pdf = pdf.sort_values(["_size", "_key", "doc_id"], ascending=[False, True, True], kind="stable")
        lacking, passes = np.array(pdf["_quotas"].iloc[0], float), int(pdf["_passes"].iloc[0])
        pdf["more"] = choose(pdf["_size"].tolist(), pdf["n"].tolist(), pdf["_rest"].iloc[0] / max(pdf["_source_size"].iloc[0], 1))
        ends, words = [], []
        for size, n, more in zip(pdf["_size"].tolist(), pdf["n"].tolist(), pdf["more"].tolist(), strict=True):
            a, w = deal(size, n, passes, more, lacking)
            lacking -= w
            ends.append(a)
            words.append(w.tolist())
        pdf["ends"], pdf["words"] = ends, words
        return pdf[[*group, "n", "more", "ends", "words"]]

    kinds = "source string, doc_id long, _key long, _size long, _bin int, n long, more long, ends array<long>"
    apart = common.cut(apart.groupBy("source").applyInPandas(decide, f"{kinds}, words array<double>"), "mix-apart")
    held: dict[str | None, np.ndarray] = {}
    for r in apart.select("source", F.posexplode("words").alias("h", "w")).groupBy("source", "h").agg(F.sum("w").alias("w")).collect():
        held.setdefault(r["source"], np.zeros(shards))[r["h"]] = r["w"]
    once = {r["source"]: r["w"] for r in apart.groupBy("source").agg(F.sum(F.col("_size") * F.col("more")).alias("w")).collect()}

    # the bin in which each source's partial pass ends, and the bins at which its shards begin
    rest = []
    for s, _, _, _, passes, wanted, quotas in planned:
        lacking = np.maximum(np.array(quotas) - held.get(s, 0.0), 0.0)
        rest.append((s, float(max(0.0, wanted - once.get(s, 0))), np.cumsum(lacking).tolist(), passes))
    rest = small(spark.createDataFrame(rest, "_source string, rest double, lacking array<double>, passes int"))
    less = apart.join(head.select("_source", "_long"), own).where("_size <= _long").select("source", "_bin", (-F.col("_size") * F.col("n")).alias("words"))
    counts = short.select("source", "_bin", "words").unionByName(less).groupBy("source", "_bin").agg(F.sum("words").alias("words"))
    everything = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = counts.withColumn("upto", F.sum("words").over(run)).withColumn("pool", F.sum("words").over(everything)).join(rest, own)
    reached = lambda words: F.col("passes") * words + F.least(words, F.col("rest"))  # noqa: E731  words taken when so many were passed
    goal = F.element_at("lacking", -1)
    place = reached(F.col("upto") - F.col("words") / 2) * goal / F.greatest(reached(F.col("pool")), F.lit(1.0))
    at = at.withColumn("shard", F.least(F.size(F.filter("lacking", lambda x: x <= place)), F.lit(shards - 1)))
    ends = at.groupBy("source", "shard").agg(
        F.min("_bin").alias("first"), F.min(F.when((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")), F.struct("_bin", (F.col("rest") - F.col("upto") + F.col("words")).alias("part"), "words"))).alias("end")
    )
    ends = common.cut(ends.groupBy("source").agg(F.min("end").alias("_end"), F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("_begins")), "mix-ends")
    ends = rest.join(ends, own, "left").select("_source", "_end", "_begins", (F.col("rest") > 0).alias("_some"))
    table = head.drop("_rest", "_quotas").withColumnRenamed("_source", "_s").join(small(ends), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s")
    table = small(common.cut(table.coalesce(1), "mix-plan"))

    # inside the end bin the words taken come within a document of the part that is still wanted
    def fit(pdf):
        pdf = pdf.sort_values(["_size", "_key", "doc_id"], ascending=[False, True, True], kind="stable")
        pdf["more"] = choose(pdf["_size"].tolist(), pdf["n"].tolist(), pdf["part"].iloc[0] / max(pdf["words"].iloc[0], 1))
        pdf["ends"] = None
        return pdf[[*group, "n", "more", "ends"]]

    done = apart.select(*(F.col(c).alias(f"_{c}_") for c in ("source", "doc_id", "_key", "_size")))
    same = F.col("_key") == F.col("__key_")
    last = narrow.where("_size > 0").join(table, own).where("_size <= _long and _bin = _end._bin").join(done, same & F.col("source").eqNullSafe(F.col("_source_")) & F.col("doc_id").eqNullSafe(F.col("_doc_id_")) & (F.col("_size") == F.col("__size_")), "left_anti")
    last = last.groupBy(*group, F.col("_end.part").alias("part"), F.col("_end.words").alias("words")).agg(F.count(F.lit(1)).alias("n")).groupBy("source").applyInPandas(fit, kinds)
    picked = apart.drop("words").unionByName(last.where("more > 0"))
    picked, _ = common.sized(picked.select(F.col("source").alias("_of"), F.col("_key").alias("_k"), F.col("doc_id").alias("_d"), F.col("_size").alias("_z"), "n", "more", "ends"), "mix-picked")
    copies = picked.where("n > 1").limit(1).count() > 0

    all_rows = rows.join(table, own, "left").join(
        picked, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("_size") == F.col("_z")), "left"
    )
    if copies:
        all_rows = all_rows.where("n is null or n = 1").withColumn("_j", F.lit(0).cast("long")).unionByName(_numbered(all_rows.where("n > 1")))
    else:
        all_rows = all_rows.withColumn("_j", F.lit(0).cast("long"))
    # before the end bin, or anywhere where the pass ends in none, every document not decided apart is taken once more
    early = F.col("n").isNull() & (F.col("_size") <= F.col("_long")) & F.col("_some") & F.coalesce(F.col("_bin") < F.col("_end._bin"), F.lit(True))
    times = F.col("_passes") + F.when(F.col("n").isNotNull(), (F.col("_j") < F.col("more")).cast("int")).otherwise(early.cast("int"))
    times = F.when(F.col("_size") > 0, F.least(times, F.lit(int(cap)))).otherwise(F.lit(0)).cast("int")
    by_bin = F.element_at(F.filter("_begins", lambda b: b["first"] <= F.col("_bin")), -1)["shard"]
    shard = F.when(F.col("ends").isNotNull(), F.size(F.filter("ends", lambda e: e <= F.col("_j")))).otherwise(F.coalesce(by_bin, F.lit(0)))
    return all_rows.withColumn("_times", times).select("_row", "_size", "_source_size", "_target", "_times", F.when(F.col("_times") > 0, shard).alias("_shard"))


def _numbered(equal: DataFrame) -> DataFrame:
    """Rows of groups of equal rows with ``_j``, each one's number in its group.

    Rows are sorted by group inside their own partition and stored with running numbers, so that a group's rows
    of one partition are consecutive; the counts of earlier partitions are added.  No group goes to one task.
    """
    spark = equal.sparkSession
    group = ["source", "doc_id", "_key", "_size"]
    stored = common.cut(equal.sortWithinPartitions(*group).withColumn("_at", F.monotonically_increasing_id()), "mix-copies").withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    parts, _ = common.sized(parts.select(*(F.col(c).alias(f"p_{c}") for c in (*group, "_part")), "_first", "_before"), "mix-parts")
    same = (F.col("_key") == F.col("p__key")) & (F.col("_part") == F.col("p__part")) & (F.col("_size") == F.col("p__size"))
    for c in ("source", "doc_id"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return stored.join(parts, same).withColumn("_j", F.col("_at") - F.col("_first") + F.col("_before")).select(*equal.columns, "_j")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = 3.0, seed: int = 7, shards: int = 16) -> DataFrame:
    """Add ``size, source_size, target, times, taken, shard`` to every row; given columns of these names are replaced.

    ``times`` says how often the mix takes the row (0 to ``cap``), ``taken`` is ``times * size`` words,
    ``shard`` the output shard (null for rows not taken).  Null or empty text: size 0, never taken.  A null
    source is a source of its own, last in order.  The order inside a source follows a seeded hash of
    ``doc_id`` (then the text's hash), so reruns and other partitionings agree.  Equal rows (one id, source and
    text) are single copies: some of them may be taken once more than the others, and which ones is not told apart.
    Empty tables stay empty.  A very long text is one document: it is never cut, so a source that is one document
    meets its target to half of that document.

    Nothing is shuffled but counts for each (source, bin), the long documents and the rows of heavy bins
    (without their texts), and the documents of the one bin per source in which the partial pass ends.
    """
    marked = _marked(docs, weights, cap, seed, shards)
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return marked.select(*kept, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_times").alias("times"), (F.col("_times").cast("long") * F.col("_size")).alias("taken"), F.col("_shard").alias("shard"))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: float = 3.0, seed: int = 7, shards: int = 16) -> DataFrame:
    """The mix as documents: every row as often as it is taken, with the columns of ``docs`` as they were."""
    marked = _marked(docs, weights, cap, seed, shards).where("_times > 0")
    return marked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
