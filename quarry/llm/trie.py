"""Prefix trie of conversations by truncation peeling.

Every conversation is laid out as the hashes of its turns.  Equal sequences are one row from the start.
Then the deepest nodes go first: at depth d the conversations that end there are merged with the nodes
that survived from depth d + 1, which gives the nodes of depth d with all their figures; their last turn
is stripped, and the next level regroups what is left.  So nodes are found and aggregated in one descent,
and no conversation is exploded into its prefixes.

* Shallow levels (``SHALLOW`` turns) are one aggregation each: partial sums are made before the shuffle, so a
  first turn that a third of all conversations share is no hot key.
* Deeper levels are few conversations.  They are dealt by a prefix of theirs and peeled in the task, level by
  level, down to that prefix; the prefix is made longer until no group has more than ``GROUP_TURNS`` turns,
  and if even that fails a level is peeled by an aggregation like the shallow ones.
* A conversation longer than ``band`` turns lies in several rows; the bands are peeled one after the other.

A node is known by its depth and the 128-bit xor of its turns' hashes, which depend on their place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BAND = 4096
SHALLOW = 8
GROUP_TURNS = 1_000_000
#: Ids that are joined to one text at most, on the way to the digest of a node's ends.
IDS = 4096


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, place, digest, bytes`` for rows ``conv_id, turn, role, text``: places from 1 by turn (null first), role and text.

    Null roles and texts are empty; rows without a ``conv_id`` are left out; repeated rows are turns of their own.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *common.turn_parts(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*common.turn_order())).cast("long")
    return rows.select("conv_id", place.alias("place"), "digest", "bytes")


def rebuilt(rows: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """The conversations with beginnings of others: the first h turns of conversation c - c % step, then c's own after its first h; h = crc32(c) % most.

    A row of place 0 stands for each conversation, also for one that is left without turns.
    """
    lengths = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % step
    convs = lengths.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    facts = common.cut(
        convs.join(lengths.where(f"conv_id % {step} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "facts",
    )
    own = rows.join(facts, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "bytes")
    heads = rows.where(f"conv_id % {step} = 0 and place < {most}").withColumnRenamed("conv_id", "base")
    given = facts.where("taken > 0").join(heads, "base").where("place <= taken").select("conv_id", "place", "digest", "bytes")
    marks = facts.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("bytes"))
    return own.unionByName(given).unionByName(marks)


def _laid(rows: DataFrame, band: int) -> DataFrame:
    """``conv_id, band, last, x, y, turns``: a row for each band of a conversation; x, y is the key of the prefix before it."""
    turn = F.struct("place", F.xxhash64("place", "digest").alias("a"), F.xxhash64("digest", "place").alias("b"), F.col("bytes").alias("n"))
    at = F.greatest(F.floor((F.col("place") - 1) / band), F.lit(0)).cast("int")
    parts = (
        rows.withColumn("band", at).repartition("conv_id").groupBy("conv_id", "band").agg(F.array_sort(F.collect_list(F.when(F.col("place") > 0, turn))).alias("ts"))
        .select("conv_id", "band", F.transform("ts", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))).alias("turns"))
    )
    conv = Window.partitionBy("conv_id").orderBy("band")
    before = lambda c: F.coalesce(F.bit_xor(_xor("turns", c, F.lit(0).cast("long"))).over(conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return parts.select("conv_id", "band", F.lead("band").over(conv).isNull().alias("last"), before("a").alias("x"), before("b").alias("y"), "turns")


def _xor(turns, name: str, start: Column) -> Column:
    return F.aggregate(turns, start, lambda k, t: k.bitwiseXOR(t[name]))


def _ends(seqs: DataFrame) -> DataFrame:
    """``kx, ky, depth, ends_sha256`` of conversations ``kx, ky, depth, conv_id``: ids in ascending order, comma-joined, hashed as they pass."""
    key = ["kx", "ky", "depth"]
    parts = seqs.groupBy(*key, F.floor(F.col("conv_id") / IDS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        now, sha = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if own == now:
                    sha.update(b"," + ids.encode())
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = own, hashlib.sha256(ids.encode())
            yield _batch(done, zip([*key, "ends_sha256"], [pa.int64()] * 3 + [pa.string()], strict=True))
        if now:
            yield _batch([(*now, sha.hexdigest())], zip([*key, "ends_sha256"], [pa.int64()] * 3 + [pa.string()], strict=True))

    dealt = parts.repartition(*key).sortWithinPartitions(*key, "part").select(*key, "ids")
    return dealt.mapInArrow(digest, "kx long, ky long, depth long, ends_sha256 string")


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    fields = list(fields)
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


_FIGURES = ("n", "conv", "children", "leaves", "saved")
_TURNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))
_PEELED = [(c, pa.int64()) for c in ("x", "y", "size", "kx", "ky", "px", "py", *_FIGURES)] + [("ends_sha256", pa.string()), ("turns", _TURNS)]


def peel(rows: list[dict], low: int) -> list[tuple]:
    """Rows ``_PEELED`` of all nodes deeper than ``low`` of sequences with the same first ``low`` turns, and at last what survives at ``low`` (with its turns)."""
    ka = [np.bitwise_xor.accumulate(np.array([r["x"], *(t["a"] for t in r["turns"])], np.int64)) for r in rows]
    kb = [np.bitwise_xor.accumulate(np.array([r["y"], *(t["b"] for t in r["turns"])], np.int64)) for r in rows]
    ended: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        ended.setdefault(len(r["turns"]), []).append(i)
    out, level = [], {}

    def merge(level: dict, key: tuple, i: int, n: int, conv: int, children: int, leaves: int, saved: int, ends) -> None:
        if key in level:
            own = level[key]
            own[1:] = own[1] + n, min(own[2], conv), own[3] + children, own[4] + leaves, own[5] + saved, own[6] or ends
        else:
            level[key] = [i, n, conv, children, leaves, saved, ends]

    for d in range(max(ended), low - 1, -1):
        for i in ended.get(d, ()):
            merge(level, (int(ka[i][d]), int(kb[i][d])), i, *(rows[i][c] for c in _FIGURES), rows[i]["ends_sha256"])
        if d == low:
            break
        above: dict = {}
        for key, (i, n, conv, children, leaves, saved, ends) in level.items():
            leaves, saved = leaves if children else 1, saved + (n - 1) * rows[i]["turns"][d - 1]["n"]
            parent = (int(ka[i][d - 1]), int(kb[i][d - 1]))
            out.append((rows[i]["x"], rows[i]["y"], d, *key, *parent, n, conv, children, leaves, saved, ends, None))
            merge(above, parent, i, n, conv, 1, leaves, saved, None)
        level = above
    for key, (i, n, conv, children, leaves, saved, ends) in level.items():
        out.append((rows[i]["x"], rows[i]["y"], low, *key, *key, n, conv, children, leaves, saved, ends, rows[i]["turns"][:low]))
    return out


def _peeled(rows: DataFrame, low: int) -> DataFrame:
    """``peel`` for every group of sequences with equal first ``low`` turns."""
    key = ["x", "y", "pa", "pb"]
    named = rows.withColumn("first", F.slice("turns", 1, low)).withColumn("pa", _xor("first", "a", F.col("x"))).withColumn("pb", _xor("first", "b", F.col("y"))).drop("first")

    def run(batches):
        now, held, done = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                own = tuple(r[c] for c in key)
                if own != now and held:
                    done += peel(held, low)
                    held = []
                    if len(done) > 20_000:
                        yield _batch(done, _PEELED)
                        done = []
                now = own
                held.append(r)
        if held:
            done += peel(held, low)
        yield _batch(done, _PEELED)

    schema = ", ".join(f"{c} long" for c, _ in _PEELED[:-2]) + ", ends_sha256 string, turns array<struct<a:long,b:long,n:long>>"
    return common.cut(named.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema), "peeled")


def _level(parts: DataFrame) -> DataFrame:
    """Nodes of one depth from what survived below and what ends there: one aggregation with partial sums."""
    sums = [F.sum("n").alias("n"), F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("children", "leaves", "saved")), F.max("ends_sha256").alias("ends_sha256")]
    last = F.coalesce(F.try_element_at("turns", F.lit(-1))["n"], F.lit(0))
    grouped = parts.groupBy("x", "y", "turns").agg(*sums)
    return common.cut(grouped.withColumns({"leaves": F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")), "saved": F.col("saved") + (F.col("n") - 1) * last}), "level")


def nodes(rows: DataFrame, band: int = BAND, shallow: int = SHALLOW, group_turns: int = GROUP_TURNS) -> DataFrame:
    """All nodes of the trie of conversations ``conv_id, place, digest, bytes`` (places from 1; a row of place 0 names a conversation only).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (over the subtree, (members - 1) times the bytes of the last text) and ``ends_sha256`` (ids that end here,
    ascending, comma-joined).  The root has depth 0 and no parent; conversations without turns end at it.
    No conversations give no rows, not even a root.
    """
    laid = common.cut(_laid(rows, band), "laid")
    ended = laid.where("last").select(
        "conv_id", "band", "x", "y", "turns", (F.col("band").cast("long") * band + F.size("turns")).alias("depth"), _xor("turns", "a", F.col("x")).alias("kx"), _xor("turns", "b", F.col("y")).alias("ky")
    )
    key = ["band", "x", "y", "turns", "kx", "ky", "depth"]
    seqs = (
        ended.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).join(_ends(ended), ["kx", "ky", "depth"])
        .select("band", F.size("turns").alias("size"), "x", "y", "turns", "n", "conv", *(F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")), "ends_sha256")
    )
    seqs = common.cut(seqs.repartition("x", "y", "turns").sortWithinPartitions("band", "size"), "sequences")
    found: list[DataFrame] = []
    columns = ["x", "y", "turns", *_FIGURES, "ends_sha256"]
    deepest = {r["band"]: r["size"] for r in seqs.groupBy("band").agg(F.max("size").alias("size")).collect()}  # a row for each band
    alive: DataFrame | None = None

    def keep(level: DataFrame, offset: int) -> None:
        size, x, y = F.size("turns"), F.col("x"), F.col("y")
        up = F.slice("turns", 1, F.greatest(size - 1, F.lit(0)))
        found.append(level.select(
            (offset + size.cast("long")).alias("depth"), _xor("turns", "a", x).alias("kx"), _xor("turns", "b", y).alias("ky"), _xor(up, "a", x).alias("px"), _xor(up, "b", y).alias("py"), *_FIGURES, "ends_sha256",
        ))

    def stripped(level: DataFrame) -> DataFrame:
        none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
        return level.select("x", "y", F.slice("turns", 1, F.size("turns") - 1).alias("turns"), "n", "conv", one.alias("children"), "leaves", "saved", none.alias("ends_sha256"))

    for k in range(max(deepest, default=-1), -1, -1):
        waiting = seqs.where(F.col("band") == k)
        if alive is not None:  # the survivors' turns of the band above
            alive = alive.drop("x", "y", "turns").join(laid.where(F.col("band") == k).select(F.col("conv_id").alias("conv"), "x", "y", "turns"), "conv").select(*columns)
        size = max(deepest.get(k, 0), band if alive is not None else 0)
        while size > shallow:
            here = lambda low: waiting.where((F.col("size") > low) & (F.col("size") <= size)).select(*columns)  # noqa: B023, E731
            with_alive = lambda df: df if alive is None else df.unionByName(alive)  # noqa: B023, E731
            low = next((low for low in _cuts(shallow, size) if _largest(with_alive(here(low)), low) <= group_turns), None)
            if low is None:
                level = _level(with_alive(here(size - 1)))
                keep(level, k * band)
                alive, size = stripped(level), size - 1
                continue
            peeled = _peeled(with_alive(here(low)), low)
            found.append(peeled.where("turns is null").select((k * band + F.col("size")).alias("depth"), "kx", "ky", "px", "py", *_FIGURES, "ends_sha256"))
            alive, size = peeled.where("turns is not null").select(*columns), low
        for d in range(size, -1 if k == 0 else 0, -1):
            parts = waiting.where(F.col("size") == d).select(*columns)
            level = _level(parts if alive is None else parts.unionByName(alive))
            keep(level, k * band)
            alive = stripped(level) if d else None
    if not found:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    parents = every.where("children > 0").select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("conv").alias("parent_conv_id"))
    return every.join(parents, ["depth", "px", "py"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _cuts(shallow: int, size: int) -> list[int]:
    """Prefix lengths to deal by, from the shortest."""
    out = [shallow]
    while out[-1] * 4 < size:
        out.append(out[-1] * 4)
    return [c for c in out if c < size]


def _largest(rows: DataFrame, low: int) -> int:
    """Turns of the largest group of rows with the same first ``low`` turns."""
    return rows.groupBy("x", "y", F.slice("turns", 1, low).alias("first")).agg(F.sum(F.size("turns")).alias("t")).agg(F.max("t")).first()[0] or 0


def trie(turns: DataFrame) -> DataFrame:
    """``nodes`` of conversations ``conv_id, turn, role, text`` as they are; see ``numbered`` for nulls, ties and repeated rows."""
    return nodes(numbered(turns))


def oracle() -> str:
    """The nodes of the rebuilt conversations by prefixes, in DuckDB SQL."""
    table = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    crc = f"""xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''), lambda s: [(ord(s) & 15)::bigint, (ord(s) >> 4)::bigint]))),
      lambda a, n: xor(a >> 4, {table}[(xor(a, n) & 15) + 1]::bigint)), 4294967295::bigint)"""
    return f"""
with t as (select conv_id c, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) place from conversations where conv_id is not null),
l as (select c, count(*) n from t group by c),
f as (select l.c, l.c - l.c % 5 base, h, least(h, coalesce(b.n, 0)) taken from (select c, {crc} % 9 h from l) l left join l b on b.c = l.c - l.c % 5),
r as (select f.c, place - h + taken pos, role, text from t join f using (c) where place > h union all select f.c, place, role, text from f join t on t.c = f.base where place <= taken),
m as (select c, 0 d, '' k, 0 n from l union all select c, pos, md5(string_agg(md5(strlen(role) || ':' || role || text), '') over (partition by c order by pos)), strlen(text) from r),
p as (select *, lag(k) over (partition by c order by d) pk, max(d) over (partition by c) = d ends from m),
v as (select d, k, min(c) c, count(*) n_convs, any_value(n) n, any_value(pk) pk, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) ends_sha256 from p group by d, k),
ch as (select d - 1 d, pk k, count(*) n_children from v where d > 0 group by d, pk),
w as (select v.*, coalesce(n_children, 0) n_children from v left join ch on ch.d = v.d and ch.k = v.k),
s as (select m.d, m.k, count(*) filter (where w.n_children = 0) n_leaves, sum((w.n_convs - 1) * w.n)::bigint saved_tokens from w join m on m.c = w.c and m.d <= w.d group by m.d, m.k)
select w.c conv_id, w.d depth, u.c parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
from w join s on s.d = w.d and s.k = w.k left join v u on u.d = w.d - 1 and u.k = w.pk"""
