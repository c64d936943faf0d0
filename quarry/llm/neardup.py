"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts with equal word sequences form a class; only its smallest document goes on.
2. Minwise signatures are cut into bands whose number and rows follow the wanted similarity (``shape``).
   Documents that share a band value are a bucket; buckets of the same documents are one.
3. In every bucket, whatever its size, signatures are compared in batches of ``BATCH`` values; a pair is
   dropped once the posterior probability of the wanted similarity, given the matches so far, falls below
   ``MISS``.  Only pairs that survive connect documents: clusters are the components of survivors.
4. Inside a cluster survivors are verified exactly on their full shingle sets.

No pairs are listed at any time.  Documents already known to belong together need no comparison, so all
but the largest component of a group are explored, one document against all others at a time.  Large
groups are cut: a bucket of more than ``BUCKET_DOCS`` into blocks, a cluster of more than ``BLOCK_SHINGLES``
into slices, each verified together with a few common documents, so that in one pass the slices of a
group of near copies become one component; only documents outside a group's largest component then meet
all blocks or slices.

A pair of similarity 0.85 shares no band with probability (1 - 0.85**5) ** 25 < 5e-7, one of 0.80 (32 bands of 4) with probability (1 - 0.8**4) ** 32 < 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HASHES = 128
#: Probability with which a pair of exactly the wanted similarity may share no band.
UNBANDED = 1e-6
BATCH = 32
#: Posterior probability below which a candidate is dropped.
MISS = 1e-6
BUCKET_DOCS, BLOCK_DOCS, BLOCK_SHINGLES = 8192, 8192, 1_500_000
#: Documents of a large cluster that every slice of it sees.
COMMON = 8
#: Tasks over which the neighbours of a node are spread in the star steps.
SALTS = 8
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(97)
_A = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_BAND = _rng.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``width`` count as one shingle, none as an empty set."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.uint64(_MASK))
    for at in range(0, len(s), 1024):
        best = np.minimum(best, (s[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(1))
    return _mix(best)


@lru_cache(maxsize=8)
def shape(percent: int) -> tuple[int, int]:
    """``bands, rows``: the longest bands with which a pair of that similarity is missed with less than ``UNBANDED``."""
    rows = max((r for r in range(1, HASHES + 1) if (1 - (percent / 100) ** r) ** (HASHES // r) < UNBANDED), default=1)
    return HASHES // rows, rows


def bands(sig: np.ndarray, percent: int = 85) -> np.ndarray:
    n, rows = shape(percent)
    values = (sig[: n * rows] * _BAND[: n * rows]).reshape(n, rows)
    return _mix(values.sum(1, dtype=np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)


def normal(text: str) -> list[bytes]:
    return text.encode().lower().split()


def profiles(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sig``: digest of the word sequence (null: no words), band values, the signature's bytes."""

    def profile(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                words = normal(text or "")
                if not words:
                    rows.append((doc_id, 0, None, None, None))
                    continue
                s = shingles(words)
                sig = signature(s)
                rows.append((doc_id, len(s), hashlib.blake2b(b" ".join(words), digest_size=16).digest(), bands(sig, percent).tolist(), sig.astype(np.uint8).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_shingles", "digest", "bands", "sig"])
        _words.clear()
        common.released()

    return docs.select("doc_id", "text").mapInArrow(profile, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary")


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For 32, 64, ... compared bytes the fewest matches with which P(similarity >= percent) is not below ``miss``.

    The prior of the similarity is uniform; two bytes also match by chance, once in 256.
    """
    j = (np.arange(20000) + 0.5) / 20000
    p = j + (1 - j) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)
        log = m[:, None] * np.log(p) + (n - m)[:, None] * np.log1p(-p)
        like = np.exp(log - log.max(1, keepdims=True))
        posterior = like[:, j >= percent / 100].sum(1) / like.sum(1)
        out.append(int(np.argmax(posterior >= miss)))
    return tuple(out)


def united(roots: np.ndarray, hits: Callable[[int], np.ndarray]) -> np.ndarray:
    """Components (smallest position) of a symmetric relation on positions, starting from known ones in ``roots``.

    ``hits(i)`` gives the positions related to i.  A pair is settled once either side is explored, so the
    members of the largest component may stay unexplored.
    """
    n = len(roots)

    def explore(i: int) -> None:
        found = hits(i)
        if len(found):
            own = np.unique(np.append(roots[found], roots[i]))
            if len(own) > 1:
                roots[np.isin(roots, own)] = own[0]

    pending = np.random.default_rng(n).permutation(n).tolist()
    while True:
        later = []
        for i in pending:
            counts = np.bincount(roots, minlength=n)
            if counts[roots[i]] > 1 and counts[roots[i]] == counts.max():
                later.append(i)
            else:
                explore(i)
        if len(later) == len(pending) or len(set(roots[later])) <= 1:
            if len(set(roots[later])) > 1:  # components of equal size: all but one are explored
                for i in [i for i in later if roots[i] != roots[later[0]]]:
                    explore(i)
            return roots
        pending = later


def surviving(i: int, roots: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, percent: int) -> np.ndarray:
    """Positions outside the component of i whose sizes allow the similarity and whose signatures survive batch after batch."""
    near = np.flatnonzero((roots != roots[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
    matches = np.zeros(len(near), int)
    for k, low in enumerate(least_matches(percent)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (sigs[near, part] == sigs[i, part]).sum(1)
        near, matches = near[matches >= low], matches[matches >= low]
        if not len(near):
            break
    return near


def _positions(ids: list[int]) -> np.ndarray:
    """First position of each of the ascending ids, so that equal ids are one document."""
    return np.searchsorted(np.array(ids, np.int64), ids)


def known_roots(ids: list[int], labels: list[int] | None) -> np.ndarray:
    """For ascending ids, the position of the first document that is known to belong to each one."""
    roots = _positions(ids)
    if labels is not None:
        first: dict[int, int] = {}
        roots = np.array([min(r, first.setdefault(label, int(r))) for r, label in zip(roots, labels, strict=True)])
    return roots


def clustered(ids: list[int], sizes: list[int], sigs: list[bytes], percent: int, labels: list[int] | None = None) -> np.ndarray:
    """For ascending ids, the position of the smallest member of each one's component of surviving pairs (and known labels)."""
    roots, sizes_, sigs_ = known_roots(ids, labels), np.array(sizes), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1)
    return united(roots, lambda i: surviving(i, roots, sizes_, sigs_, percent))


def linked(ids: list[int], sets: list[np.ndarray], percent: int, sigs: list[bytes] | None = None, labels: list[int] | None = None) -> np.ndarray:
    """For ascending ids, the position of the smallest member of each one's component under 100 * |a & b| >= percent * |a | b|.

    ``labels`` say which documents are known to belong together.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    roots = known_roots(ids, labels)
    sigs_ = np.frombuffer(b"".join(sigs), np.uint8).reshape(n, -1) if sigs else np.stack([signature(s).astype(np.uint8) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    by_shingle = np.argsort(flat, kind="stable")
    posting = owner[by_shingle]
    first_at = np.searchsorted(flat[by_shingle], np.arange(len(names) + 1))

    def hits(i: int) -> np.ndarray:
        near = surviving(i, roots, sizes, sigs_, percent)
        if not len(near):
            return near
        if len(near) <= 3:
            both = np.array([sizes[i] + sizes[k] - len(np.union1d(sets[i], sets[k])) for k in near])
        else:
            own = flat[starts[i] : starts[i + 1]]
            a, spans = first_at[own], first_at[own + 1] - first_at[own]
            where = np.repeat(a - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            both = np.bincount(posting[where], minlength=n)[near]
        return near[100 * both >= percent * (sizes[near] + sizes[i] - both)]

    return united(roots, hits)


def _grouped(batches, key: list[str], settle: Callable[..., Iterable[tuple]]):
    """``settle(columns)`` for each group of consecutive rows of Arrow batches with equal key columns; results in batches."""
    now, held, done = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in batch.schema.names]
        at = [batch.schema.names.index(c) for c in key]
        for row in zip(*columns, strict=True):
            own = tuple(row[c] for c in at)
            if own != now:
                if held:
                    done += settle(*zip(*held, strict=True))
                    if len(done) > 5000:
                        yield _edge_batch(done)
                        done = []
                now, held = own, []
            held.append(row)
    if held:
        done += settle(*zip(*held, strict=True))
    if done:
        yield _edge_batch(done)
    held.clear()
    _words.clear()
    common.released()


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["a", "b", "slices"])


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for edges ``a, b``: the smallest node of every connected component (nodes of some edge only).

    Each partition first contracts its own edges; then large-star and small-star steps alternate until
    nothing changes.  Every step is a join and an aggregate of narrow rows, stored in between.
    """

    def contract(batches):
        index: dict[int, int] = {}
        a_all, b_all = [], []
        for batch in batches:
            a_all.append(batch.column("a").to_numpy(zero_copy_only=False))
            b_all.append(batch.column("b").to_numpy(zero_copy_only=False))
        if not a_all:
            return
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        roots = nodes[[find(i) for i in range(len(nodes))]]
        keep = roots != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(roots[keep], pa.int64())], names=["a", "b"])

    now = common.cut(edges.where("a <> b").mapInArrow(contract, "a long, b long").distinct(), "edges")
    def met(rows: DataFrame, low: DataFrame) -> DataFrame:
        """Rows joined with the row of their ``a``; the neighbours of one node are spread over ``SALTS`` tasks."""
        spread = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        return rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("long")).join(spread, ["a", "salt"]).drop("salt")

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = met(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.cut(large, "edges")  # oriented: a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = met(large, low).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = common.cut(small, "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def in_blocks(member: DataFrame, key: list[str], label: str, rows: int, meet: bool) -> DataFrame:
    """Members ``key, doc_id, label`` with ``i, k``: groups of more than ``rows`` documents are cut into blocks.

    Without ``meet`` every block stands alone.  With it the documents outside a group's most frequent label meet
    every block of the group, and no others do: documents of that label are known to belong together.
    """
    load = member.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks"))
    dealt = member.join(load, key).withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("k", F.lit(0))
    if not meet:
        return dealt.drop("blocks")
    dealt = common.cut(dealt, "dealt")
    large = dealt.where("blocks > 1")
    if not large.limit(1).count():
        return dealt.drop("blocks")
    most = large.groupBy(*key, label).agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max(F.struct("n", label))[label].alias("most"))
    outside = large.join(most, key).where(F.col(label) != F.col("most")).drop("most")
    rest = outside.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int")
    asks = outside.join(rest, key).withColumn("k", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts")
    met = large.join(rest, key).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.where("blocks = 1").unionByName(met.unionByName(asks).distinct()).drop("blocks")


def _clusters(reps: DataFrame, percent: int) -> DataFrame:
    """``node, root``: components of pairs that share a band and whose signatures survive (documents of some such pair only)."""
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    # one bucket for every set of documents, named by its count and 128 bits of hashes
    same = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("n > 1")
    bucket = common.cut(same.groupBy("n", "x", "y").agg(F.min("band").alias("band")), "buckets")
    key = ["band", "i", "k"]

    def settle(band, i, k, ids, labels, sizes, sigs):
        return [(a, ids[r], 1) for a, r in zip(ids, clustered(ids, sizes, sigs, percent, labels).tolist(), strict=True) if ids[r] != a]

    def survivors(member: DataFrame) -> DataFrame:
        rows = member.join(reps.select("doc_id", "n_shingles", "sig"), "doc_id").repartition(*key).sortWithinPartitions(*key, "doc_id").select(*key, "doc_id", "label", "n_shingles", "sig")
        # stored, so that a task runs one Python worker at a time
        return common.cut(rows.mapInArrow(lambda batches: _grouped(batches, key, settle), "a long, b long, slices int").select("a", "b"), "survivors")

    member = banded.join(bucket.select("band", "n"), "band").select("band", "n", "doc_id", F.col("doc_id").alias("label"))
    pairs = survivors(in_blocks(member.drop("n"), ["band"], "label", BUCKET_DOCS, False))
    found = connected(pairs)
    if bucket.where(F.col("n") > BUCKET_DOCS).limit(1).count():
        known = found.select(F.col("node").alias("doc_id"), "root")
        again = member.where(F.col("n") > BUCKET_DOCS).join(known, "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("label"))
        found = connected(pairs.unionByName(survivors(in_blocks(again, ["band"], "label", BUCKET_DOCS, True))))
    return found


Linker = Callable[[tuple, tuple, tuple, tuple], np.ndarray]


def _verified(docs: DataFrame, dealt: DataFrame, link: Linker) -> DataFrame:
    """Exact links ``a, b, slices`` (each document to the smallest one of its component) inside every group ``(root, i, k)`` of ``dealt``."""
    key = ["root", "i", "k"]
    # only texts of cluster members travel: their ids are broadcast while their counted number is small
    dealt, _ = common.sized(dealt, "dealt")
    rows = docs.select("doc_id", "text").join(dealt, "doc_id").repartition(*key).sortWithinPartitions(*key, "doc_id").select(*key, "doc_id", "label", "slices", "sig", "text")

    def settle(root, i, k, ids, labels, slices, sigs, texts):
        return [(a, ids[r], n) for a, r, n in zip(ids, link(ids, texts, sigs, labels).tolist(), slices, strict=True)]

    return common.cut(rows.mapInArrow(lambda batches: _grouped(batches, key, settle), "a long, b long, slices int"), "links").where("a <> b")


def settled(docs: DataFrame, member: DataFrame, link: Linker) -> DataFrame:
    """``a, root`` of every document that has an exact link inside its cluster.

    ``member``: ``doc_id, n_shingles, sig, root, label``, where ``root`` names the cluster and documents of equal ``label``
    are known to belong together.  ``link`` gives, for ascending ids, texts, signatures and labels, the position of the
    smallest member of each one's component.  Large clusters are cut into slices that share a few documents; then only
    documents outside a cluster's largest component meet all slices.
    """
    shared = [F.min(F.struct(F.xxhash64("doc_id", F.lit(c)), "doc_id", "sig", "label")).alias(f"c{c}") for c in range(COMMON)]
    load = member.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("slices"), *shared)
    load = common.cut(load, "loads")
    slices = member.join(load.select("root", "slices"), "root").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    slices = common.cut(slices, "slices")
    none = F.lit(0)
    large = load.where("slices > 1")
    everywhere = (
        large.select("root", "slices", F.explode(F.array_distinct(F.array(*(F.struct(f"c{c}.doc_id", f"c{c}.sig", f"c{c}.label") for c in range(COMMON))))).alias("c"))
        .select("root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"), none.alias("k"), "c.doc_id", "c.label", "slices", "c.sig")
    )
    columns = ["root", "i", "k", "doc_id", "label", "slices", "sig"]
    first = slices.withColumn("k", none).select(*columns).unionByName(everywhere)
    links = _verified(docs, first, link)
    joined = links.where("slices = 1").select("a", F.col("b").alias("root"))
    if large.limit(1).count():
        many = links.where("slices > 1").select("a", "b")
        label = connected(many).select(F.col("node").alias("doc_id"), F.col("root").alias("now"))
        parts = common.cut(slices.where("slices > 1").join(label, "doc_id", "left").withColumn("label", F.coalesce("now", "label")).drop("now"), "parts")
        most = parts.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max(F.struct("n", "label"))["label"].alias("most"))
        outside = parts.join(most, "root").where("label <> most")
        rest = outside.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        # every block of outside documents meets every slice once
        asks = outside.join(rest, "root").withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        met = parts.join(rest, "root").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        second = _verified(docs, met.select(*columns).unionByName(asks.select(*columns)).distinct(), link)
        joined = joined.unionByName(connected(many.unionByName(second.select("a", "b"))).select(F.col("node").alias("a"), "root"))
    return joined


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents whose sets of five-word shingles (ASCII lower case) have 100 * |a & b| >= percent * |a | b| are
    linked; ``component_id`` is the smallest ``doc_id`` reachable.  Null, empty and blank texts have empty
    sets and are linked with nothing; texts of any length are compared whole.  Rows that repeat a ``doc_id`` each
    get a row (of several texts of one id each is compared); a null ``doc_id`` takes the component of its equal
    texts, and null where it has none.  Empty tables give an empty table; further columns are ignored.
    """
    known = common.cut(profiles(docs, percent), "profiles")
    classes = known.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = common.cut(classes, "classes")
    reps = (
        known.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
        .select("doc_id", "digest", "n_shingles", "bands", "sig").dropDuplicates(["digest", "doc_id"])
    )
    reps = common.cut(reps, "reps")
    cluster = _clusters(reps, percent)

    member = reps.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "sig")).alias("p")).select("doc_id", "p.*").join(cluster.withColumnRenamed("node", "doc_id"), "doc_id")

    def link(ids, texts, sigs, labels):
        known = sigs if len(set(ids)) == len(ids) else None  # rows that repeat an id may have other texts
        return linked(ids, [shingles(normal(t or "")) for t in texts], percent, known, labels)

    joined = settled(docs, member.withColumn("label", F.col("doc_id")), link)
    names = classes.join(joined, F.col("rep") == F.col("a"), "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    return (
        known.select("doc_id", "n_shingles", "digest").join(names, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def oracle(percent: int = 85) -> str:
    """The same by all pairs of distinct sets that share a shingle, in DuckDB SQL (for small tables)."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])) end) sh from w),
k as (select doc_id, md5(array_to_string(list_sort(sh), chr(10))) h, sh, len(sh) n from s),
c as (select h, min(doc_id) rep, any_value(n) n, any_value(sh) sh from k where n > 0 group by h),
e as (select rep, n, unnest(sh) x from c),
p as (select a.rep a, b.rep b, any_value(a.n) na, any_value(b.n) nb, count(*) both_ from e a join e b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by a.rep, b.rep),
l as (select a, b from p where 100 * both_ >= {percent} * (na + nb - both_)),
u as (select a, b from l union all select b, a from l),
r as (select rep node, rep root from c union select u.b, r.root from r join u on u.a = r.node),
m as (select node, min(root) root from r group by node)
select k.doc_id, k.n n_shingles, coalesce(m.root, k.doc_id) component_id, k.doc_id = coalesce(m.root, k.doc_id) kept
from k left join c on c.h = k.h and k.n > 0 left join m on m.node = c.rep"""


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document is kept, once each, with all their columns; rows with a null ``doc_id`` stay.

    Of several rows with one id the one with the smallest text (null first) stays.  Only ids of dropped
    documents are joined back (an anti join), by broadcast while they are few.
    """
    verdict = components(docs.where("doc_id is not null"), percent)
    gone, n = common.sized(verdict.where("not kept").select("doc_id").distinct(), "dropped")
    kept = docs.join(gone, "doc_id", "left_anti")
    again, n = common.sized(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not n:
        return kept
    row = F.struct(F.col("text").alias("_text"), F.xxhash64(*docs.columns).alias("_hash"), F.struct(*docs.columns).alias("_row"))
    twice = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("_one")).select("_one._row.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(twice)
