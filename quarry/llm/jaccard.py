"""Jaccard join on word n-grams: size-aware, with light and heavy sets.

A set's partners have sizes within the threshold, and two sets of sizes s and t are linked just when they
share a subset of ``need(s, t)`` elements.

* Light sets (below a boundary) enumerate their subsets of these fixed sizes, one list of subsets for each
  partner size.  Equal subsets of the right sizes are links; nothing has to be compared.
* Heavy sets scan inverted lists.  Elements are ordered by how frequent they are (a sketch of counts over
  all documents, of fixed size), the rarest first; two linked sets share one of their first
  ``s - ceil(threshold * s) + 1`` elements, so only these are in lists.  Light sets that could be partners
  of heavy ones are in the lists too.
* The boundary is the size at which enumerating and scanning cost least, from the histogram of small sizes.

Lists name no pairs.  Lists of the same documents are one list.  First every set goes to the few of its
lists that come first by hash, which its near copies choose as well; inside a list sets are compared by
parity bitmaps, whose Hamming distance never exceeds the symmetric difference, so no link is lost.
Candidates form clusters, and clusters are verified on whole sets.  Then all lists follow, but only those
that hold sets of more than one component, and in them only sets of different components are compared.

The result is exact (up to collisions of 64-bit element hashes and 128-bit subset hashes).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, neardup

WIDTH, PERCENT = 3, 90
#: Counters of the frequency sketch, and the slices in which partitions send them.
COUNTERS, SLICES = 1 << 20, 64
#: Sets of this size or more are heavy in any case; so many sizes are counted for the boundary.
SIZES = 64
#: Cost of one list entry (with its bitmap and its share of the verification) in enumerated subsets.
SCAN = 8
#: Lists that a set goes to at first, and sets of a list that one task compares.
FIRST, LIST_DOCS = 3, 8192
LEAST_BITS = 512


def need(s: int, t: int, percent: int) -> int:
    """Fewest common elements with which sets of sizes s and t are linked: 100 both >= percent (s + t - both)."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix(s: int, percent: int) -> int:
    """So many elements in the common order go to lists."""
    return s - -(-percent * s // 100) + 1


def boundary(counts: dict[int, int], percent: int) -> int:
    """The size from which sets are heavy, with the least cost over sets of the counted sizes."""
    light = lambda s, x: sum(math.comb(s, s - need(s, t, percent)) for t in partners(s, percent) if t < x and need(s, t, percent) <= s)
    heavy = lambda s, x: SCAN * prefix(s, percent) if 100 * s >= percent * x else 0

    def cost(x: int) -> int:
        return sum(n * ((light(s, x) if s < x else 0) + heavy(s, x)) for s, n in counts.items())

    return min(range(1, SIZES + 1), key=lambda x: (cost(x), x))


# --- shingles --------------------------------------------------------------

#: Bytes of texts that are split and hashed together.
TOGETHER = 3_000_000
#: A random number for each byte at each place of a word (places beyond the table's use it again, times odd numbers).
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, (64, 256), np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty strings: mixed sums of the numbers of their bytes and places."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    numbers = _BYTES[place & 63, data]
    if sizes.max() > 64:
        numbers = numbers * (2 * (place >> 6) + 1).astype(np.uint64)
    return neardup._mix(np.add.reduceat(numbers, starts) + sizes.astype(np.uint64) * _STEP)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    again = x[1:] == x[:-1]
    return x[np.concatenate([[True], ~again])] if again.any() else x


def shingled(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes in order, and sorted distinct shingle hashes, of each text.

    Words are parts between ASCII white space of the ASCII-lower-cased text; fewer words than ``width`` are one shingle.
    Texts of about ``TOGETHER`` bytes are split and hashed at once.
    """
    column = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
        split = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(at, stop - at)))
        words = split.flatten()
        owner = np.repeat(np.arange(stop - at), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        kept = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # there are empty ones around white space at the ends of a text
        if not kept.all():
            words, owner = words.filter(pa.array(kept)), owner[kept]
        h, counts = word_hashes(words), np.bincount(owner, minlength=stop - at)
        rolled = np.full(max(len(h) - width + 1, 0), width, np.uint64)
        for k in range(width):
            rolled = rolled * _STEP + h[k : k + len(rolled)]
        rolled = neardup._mix(rolled)
        begin = 0
        for n in counts.tolist():
            own = h[begin : begin + n]
            if n >= width:
                yield own, distinct(rolled[begin : begin + n - width + 1])
            else:
                whole = np.full(min(n, 1), n, np.uint64)
                for x in own:
                    whole = whole * _STEP + x
                yield own, neardup._mix(whole)
            begin += n
        at = stop


# --- frequencies -----------------------------------------------------------


def sketch(docs: DataFrame, width: int) -> tuple[np.ndarray, dict[int, int]]:
    """Orders of magnitude of the counters that elements fall on, over all documents, and the histogram of sizes below ``SIZES``."""
    step = COUNTERS // SLICES

    def add(counters: np.ndarray, held: list[np.ndarray]) -> None:
        if held:
            counters += np.bincount((np.concatenate(held) >> np.uint64(44)).view(np.int64), minlength=COUNTERS)
            held.clear()

    def count(batches):
        counters, sizes = np.zeros(COUNTERS, np.int64), np.zeros(SIZES, np.int64)
        for batch in batches:
            held = []
            for _, s in shingled(batch.column("text"), width):
                if 0 < len(s) < SIZES:
                    sizes[len(s)] += 1
                held.append(s)
                if len(held) == 512:
                    add(counters, held)
            add(counters, held)
        parts = [*counters.reshape(SLICES, step), sizes]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "counts"])

    def total_of(batches):
        now, total = None, None
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(data), np.int64)
                if k == now:
                    total = total + own
                else:
                    if now is not None:
                        yield _slice(now, total)
                    now, total = k, own
        if now is not None:
            yield _slice(now, total)

    kinds = "slice int, counts binary"
    sums = docs.select("text").mapInArrow(count, kinds).repartition("slice").sortWithinPartitions("slice").mapInArrow(total_of, kinds).collect()  # SLICES rows of fixed size
    found = {r["slice"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in sums}
    counters = np.concatenate([found.get(k, np.zeros(step, np.int64)) for k in range(SLICES)])
    return np.log2(counters + 1).astype(np.uint8), {s: int(n) for s, n in enumerate(found.get(SLICES, ())) if n}


def _slice(k: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "counts"])


# --- profiles --------------------------------------------------------------


def bits(n: int) -> int:
    b = LEAST_BITS
    while 2 * b < n:
        b *= 2
    return b


def parity(s: np.ndarray) -> bytes:
    """Bitmap of the parities of the elements that fall on each bit; half as wide a bitmap is the xor of its halves."""
    b = bits(len(s))
    return np.packbits((np.bincount((s & np.uint64(b - 1)).view(np.int64), minlength=b) & 1).astype(np.uint8)).tobytes()


def subsets(s: np.ndarray, x: int, percent: int) -> list[dict]:
    """The subsets ``lo, hi, a, b`` of a light set: for each partner size the sums of two hashes over the elements that stay."""
    n, h = len(s), (s.view(np.int64), neardup._mix(s ^ np.uint64(0x5BD1E9955BD1E995)).view(np.int64))
    whole, out = tuple(int(v.sum()) for v in h), []
    left = [(int(a), int(b)) for a, b in zip(*h, strict=True)]
    for t in partners(n, percent):
        gone = n - need(n, t, percent)
        if t < x and 0 <= gone < n:
            for some in itertools.combinations(left, gone):
                a, b = whole[0] - sum(e[0] for e in some), whole[1] - sum(e[1] for e in some)
                out.append({"lo": min(n, t), "hi": max(n, t), "a": _wrapped(a), "b": _wrapped(b)})
    return out


def _wrapped(v: int) -> int:
    return ((v + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def profiles(docs: DataFrame, classes: np.ndarray, x: int, width: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, digest, prefix, bitmap, subsets``; no digest without words."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # COUNTERS bytes
    subset = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), subset)
    names = ["doc_id", "n_shingles", "digest", "prefix", "bitmap", "subsets"]

    def profile(batches):
        rank = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, (words, s) in zip(ids, shingled(batch.column("text"), width), strict=True):
                if not len(words):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                n, first, bitmap, light = len(s), None, None, None
                if 100 * n >= percent * x:
                    k = prefix(n, percent)
                    order = np.lexsort((s, rank[(s >> np.uint64(44)).view(np.int64)]))[:k]
                    first, bitmap = s[order].view(np.int64).tolist(), parity(s)
                if n < x:
                    light = subsets(s, x, percent)
                rows.append((doc_id, n, hashlib.blake2b(words.tobytes(), digest_size=16).digest(), first, bitmap, light))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        common.released()

    schema = "doc_id long, n_shingles long, digest binary, prefix array<long>, bitmap binary, subsets array<struct<lo:int,hi:int,a:long,b:long>>"
    return docs.select("doc_id", "text").mapInArrow(profile, schema)


# --- comparisons -----------------------------------------------------------


class Bitmaps:
    """Bitmaps of some documents, folded to the widths that comparisons ask for."""

    def __init__(self, maps: list[bytes]) -> None:
        self.width = np.array([8 * len(m) for m in maps])
        self.at = np.zeros(len(maps), int)
        self.own: dict[int, np.ndarray] = {}
        for b in np.unique(self.width):
            rows = np.flatnonzero(self.width == b)
            self.at[rows] = np.arange(len(rows))
            self.own[int(b)] = np.frombuffer(b"".join(maps[r] for r in rows), np.uint8).reshape(len(rows), -1)

    def of(self, rows: np.ndarray, b: int) -> np.ndarray:
        """Bitmaps of documents of one width, folded to ``b`` bits (bit i of the wide one falls on i modulo b)."""
        m = self.own[int(self.width[rows[0]])][self.at[rows]]
        while 8 * m.shape[1] > b:
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
        return m

    def distance(self, i: int, near: np.ndarray) -> np.ndarray:
        out = np.zeros(len(near), int)
        for b in np.unique(self.width[near]):
            at = np.flatnonzero(self.width[near] == b)
            least = int(min(b, self.width[i]))
            out[at] = np.bitwise_count(self.of(near[at], least) ^ self.of(np.array([i]), least)).sum(1)
        return out


def possible(i: int, roots: np.ndarray, sizes: np.ndarray, maps: Bitmaps, percent: int) -> np.ndarray:
    """Positions outside the component of i that sizes and bitmaps do not rule out."""
    near = np.flatnonzero((roots != roots[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
    if not len(near):
        return near
    both = sizes[near] + sizes[i]
    most = both - 2 * -(-percent * both // (100 + percent))  # of the symmetric difference
    return near[maps.distance(i, near) <= most]


def linked(ids: list[int], sets: list[np.ndarray], percent: int, labels: list[int] | None = None) -> np.ndarray:
    """For ascending ids, the position of the smallest member of each one's component of exact links (and known labels)."""
    n, roots = len(sets), neardup.known_roots(ids, labels)
    sizes, maps = np.array([len(s) for s in sets]), Bitmaps([parity(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    by_name = np.argsort(flat, kind="stable")
    posting = np.repeat(np.arange(n, dtype=np.int32), sizes)[by_name]
    first_at = np.searchsorted(flat[by_name], np.arange(len(names) + 1))
    del by_name

    def hits(i: int) -> np.ndarray:
        near = possible(i, roots, sizes, maps, percent)
        if not len(near):
            return near
        if len(near) <= 3:
            both = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in near])
        else:  # the inverted lists of i's elements, counted
            own = flat[starts[i] : starts[i + 1]]
            a, spans = first_at[own], first_at[own + 1] - first_at[own]
            where = np.repeat(a - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            both = np.bincount(posting[where], minlength=n)[near]
        return near[100 * both >= percent * (sizes[near] + sizes[i] - both)]

    return neardup.united(roots, hits)


def _candidates(member: DataFrame, reps: DataFrame, percent: int, meet: bool) -> DataFrame:
    """``a, b``: members ``w, doc_id, label`` of a list, each with the smallest of its component of possible pairs, where that joins several labels."""
    key = ["w", "i", "k"]
    dealt = neardup.in_blocks(member, ["w"], "label", LIST_DOCS, meet)
    rows = dealt.join(reps.select("doc_id", "n_shingles", "bitmap"), "doc_id").repartition(*key).sortWithinPartitions(*key, "doc_id").select(*key, "doc_id", "label", "n_shingles", "bitmap")

    def settle(w, i, k, ids, labels, sizes, maps):
        sizes, maps = np.array(sizes), Bitmaps(list(maps))
        roots = neardup.known_roots(ids, labels)
        roots = neardup.united(roots, lambda at: possible(at, roots, sizes, maps, percent))
        several: dict[int, set] = {}
        for r, label in zip(roots.tolist(), labels, strict=True):
            several.setdefault(r, set()).add(label)
        return [(a, ids[r], 1) for a, r in zip(ids, roots.tolist(), strict=True) if len(several[r]) > 1]

    return common.cut(rows.mapInArrow(lambda batches: neardup._grouped(batches, key, settle), "a long, b long, slices int").select("a", "b"), "possible")


def light_links(reps: DataFrame) -> DataFrame:
    """``a, b``: light sets with the smallest set that shares one of their subsets, where both sizes of the subset's pair are there."""
    key = ["lo", "hi", "x", "y"]
    rows = reps.where("subsets is not null").select("doc_id", F.col("n_shingles").alias("n"), F.explode("subsets").alias("s")).select("doc_id", "n", "s.lo", "s.hi", F.col("s.a").alias("x"), F.col("s.b").alias("y"))
    groups = rows.groupBy(*key).agg(F.min("doc_id").alias("b"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("c")).where("c > 1 and least = lo and most = hi")
    return rows.join(groups.select(*key, "b"), key).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()


def heavy_links(docs: DataFrame, reps: DataFrame, x: int, width: int, percent: int) -> DataFrame:
    """``a, b``: exact links that connect all heavy sets that belong together."""

    def link(ids, texts, sigs, labels):
        return linked(ids, [s for _, s in shingled(pa.array(texts, pa.string()), width)], percent, labels)

    def verified(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
        cluster = neardup.connected(pairs).withColumnRenamed("node", "doc_id")
        member = reps.select("doc_id", "n_shingles", F.lit(None).cast("binary").alias("sig")).join(cluster, "doc_id")
        member = member.withColumn("label", F.col("doc_id")) if label is None else member.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        return neardup.settled(docs, member, link).select("a", F.col("root").alias("b"))

    entry = reps.where("prefix is not null").select("doc_id", F.col("n_shingles").alias("n"), F.explode("prefix").alias("w"))
    lists = entry.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where(f"c > 1 and most >= {x}")
    one = lists.groupBy("c", "x", "y").agg(F.min("w").alias("w")).select("w")
    shared = common.cut(entry.join(one, "w").select("w", "doc_id"), "lists")

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("w"), "w"))
    chosen = shared.withColumn("place", place).where(F.col("place") <= FIRST).select("w", "doc_id", F.col("doc_id").alias("label"))
    links = common.cut(verified(_candidates(chosen, reps, percent, False), None), "first-links")

    label = common.cut(neardup.connected(links).select(F.col("node").alias("doc_id"), F.col("root").alias("label")), "labels")
    named = shared.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = named.groupBy("w").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("w")
    rest = _candidates(named.join(mixed, "w").select("w", "doc_id", "label"), reps, percent, True)
    return links.unionByName(verified(rest, label))


def components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the smallest ``doc_id`` reachable by links 100 * |a & b| >= percent * |a | b|.

    Sets are the distinct ``width``-word shingles of the ASCII-lower-cased text; fewer words are one shingle.  Null, empty and
    blank texts have empty sets and are linked with nothing; texts of any length are compared whole.  Rows that repeat a
    ``doc_id`` each get a row (of several texts of one id each is compared); a null ``doc_id`` takes the component of its
    equal texts, and null where it has none.  An empty table gives an empty one; further columns are ignored.
    """
    classes, counts = sketch(docs, width)
    x = boundary(counts, percent)
    known = common.cut(profiles(docs, classes, x, width, percent), "profiles")
    names = common.cut(known.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(names.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    reps = common.cut(reps, "reps")
    links = light_links(reps).unionByName(heavy_links(docs, reps, x, width, percent))
    joined = neardup.connected(links)
    roots = names.join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    return known.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def oracle(percent: int = PERCENT, width: int = WIDTH) -> str:
    """The same by all pairs of distinct sets that share an element, in DuckDB SQL (for small tables)."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < {width} then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width} - 1], ' ')) end) sh from w),
k as (select doc_id, md5(array_to_string(list_sort(sh), chr(10))) h, sh, len(sh) n from s),
c as (select h, min(doc_id) rep, any_value(n) n, any_value(sh) sh from k where n > 0 group by h),
e as (select rep, n, unnest(sh) x from c),
p as (select a.rep a, b.rep b, any_value(a.n) na, any_value(b.n) nb, count(*) common from e a join e b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by a.rep, b.rep),
l as (select a, b from p where 100 * common >= {percent} * (na + nb - common)),
u as (select a, b from l union all select b, a from l),
r as (select rep node, rep root from c union select u.b, r.root from r join u on u.a = r.node),
m as (select node, min(root) root from r group by node)
select k.doc_id, k.n n_shingles, coalesce(m.root, k.doc_id) component_id from k left join c on c.h = k.h and k.n > 0 left join m on m.node = c.rep"""
