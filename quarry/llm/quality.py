"""Quality: random-indexing vectors pooled per document, and a two-layer network with calibrated probabilities.

Each token has a fixed sparse ternary index vector; a token's context vector is the sum of the
index vectors of its neighbours, over *all* documents.  The sums are whole numbers, so they merge
exactly in any order.  A document is the weighted mean of its tokens' vectors, and the largest and
smallest means of its stretches of 64 tokens, so that a bad passage shows in a long text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import word_codes

#: Hash places of tokens (the last one is the mark of a repeated word): sums of 33 numbers each reach the driver.
BUCKETS = 1 << 15
DIM = 32
NONZERO = 4
STRETCH = 64
MAX_LABELLED = 20_000
_RUN = re.compile(r"[^\W\d_]+|[\W\d_]+")


def word_tokens(word: str) -> bytes:
    """Tokens of a word as 32-bit numbers: its runs of letters (folded) with their case, and of other characters."""
    out = []
    for run in _RUN.findall(word):
        if run[0].isalpha():
            out.append("w" + run.lower())
            if len(run) > 1 and run.isupper():
                out.append("case:upper")
        else:
            out.append("s" + run)
    return np.array([zlib.crc32(t.encode()) % (BUCKETS - 1) for t in out], "<i4").tobytes()


#: The token put after a word that equals the word before it.
_SAME = np.array([BUCKETS - 1], "<i4").tobytes()


def tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    """The tokens of each text."""
    for codes in word_codes(texts, lambda words: list(map(word_tokens, words.to_pylist())), _SAME):
        yield np.frombuffer(codes, "<i4")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero parts of each bucket's index vector (fixed seed)."""
    rng = np.random.default_rng(20240101)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def context_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context sums and counts of every bucket over all documents: BUCKETS x DIM numbers, whatever the data's size."""

    def gather(batches):
        places, signs = index_vectors()
        stop = np.full(2, BUCKETS, np.uint16)  # between texts: two tokens with an empty index vector
        rows = np.zeros((BUCKETS + 1, DIM), np.int8)
        np.add.at(rows, (np.arange(BUCKETS)[:, None], places), signs.astype(np.int8))
        sums, counts = np.zeros((BUCKETS + 1, DIM), np.int64), np.zeros(BUCKETS + 1, np.int64)
        held: list[np.ndarray] = []

        def add():
            """Each token's neighbours up to two places away, then the sums of equal tokens side by side."""
            t = np.concatenate([x for h in held for x in (h.astype(np.uint16), stop)])
            held.clear()
            own = rows[t]
            near = np.zeros_like(own)
            for gap in (1, 2):
                near[gap:] += own[:-gap]
                near[:-gap] += own[gap:]
            order = np.argsort(t, kind="stable")
            found, starts, n = np.unique(t[order], return_index=True, return_counts=True)
            counts[found] += n
            sums[found] += np.add.reduceat(near[order], starts, 0, np.int32)

        size = 0
        for batch in batches:
            for own in tokens(batch.column("text")):
                held.append(own)
                size += len(own)
                if size > 500_000:
                    add()
                    size = 0
        if held:
            add()
        used = np.flatnonzero(counts[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), *(pa.array(sums[used, k]) for k in range(DIM))], names=["bucket", "n", *(f"v{k}" for k in range(DIM))])
        common.released()

    columns = ["n", *(f"v{k}" for k in range(DIM))]
    merged = docs.select("text").mapInArrow(gather, "bucket int, " + ", ".join(f"{c} long" for c in columns)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns))
    vectors, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for r in merged.toLocalIterator():
        counts[r["bucket"]] = r["n"]
        vectors[r["bucket"]] = [r[c] for c in columns[1:]]
    return vectors, counts


def word_vectors(vectors: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors around their mean, and smooth inverse frequency weights."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    total = max(counts.sum(), 1.0)
    v = v - (v * counts[:, None]).sum(0) / total
    return v.astype(np.float32), (1e-3 / (1e-3 + counts / total)).astype(np.float32)


def pooled(t: np.ndarray, weighted: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest stretch means, and the log length of a text's tokens (``weighted``: vectors times weights)."""
    if not len(t):
        return np.zeros(3 * DIM + 1, np.float32)
    starts = np.arange(0, len(t), STRETCH)
    w = weight[t]
    sums = np.add.reduceat(weighted[t], starts, 0)
    mass = np.add.reduceat(w, starts)
    means = sums / np.maximum(mass, 1e-9)[:, None]
    return np.concatenate([sums.sum(0) / max(mass.sum(), 1e-9), means.max(0), means.min(0), [np.log1p(len(t)) / 10]]).astype(np.float32)


class Network:
    """features -> tanh layer -> logit / temperature."""

    def __init__(self, arrays: tuple):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = arrays

    @property
    def arrays(self) -> tuple:
        return self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> Network:
    """Adam on mini-batches; the epoch and the temperature are chosen on a fifth of the rows that is not trained on."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    val, fit_ = order[:cut], order[cut:] if len(x) > 1 else order
    mean, scale = x[fit_].mean(0), x[fit_].std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -60, 60)))
    nll = lambda s, t: float(-np.mean(t * np.log(sig(s) + 1e-12) + (1 - t) * np.log(1 - sig(s) + 1e-12)))
    best, kept, t = np.inf, [a.copy() for a in p], 0
    for _ in range(epochs):
        rng.shuffle(fit_)
        for at in range(0, len(fit_), 128):
            b = fit_[at : at + 128]
            h = np.tanh(z[b] @ p[0] + p[1])
            d = (sig(h @ p[2] + p[3]) - y[b]) / len(b)
            dh = np.outer(d, p[2]) * (1 - h**2)
            t += 1
            for i, g in enumerate((z[b].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        loss = nll(np.tanh(z[val] @ p[0] + p[1]) @ p[2] + p[3], y[val])
        if loss < best:
            best, kept = loss, [a.copy() for a in p]
    s = np.tanh(z[val] @ kept[0] + kept[1]) @ kept[2] + kept[3]
    temperature = min(np.geomspace(0.25, 8, 61), key=lambda q: nll(s / q, y[val]))
    return Network((mean, scale, *kept, float(temperature)))


def _pool_column(docs: DataFrame, v: np.ndarray, weight: np.ndarray, then):
    """``then`` of the pooled features of each batch of texts, as a pandas UDF over ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast((v * weight[:, None], weight))

    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [pooled(t, *shared.value) for t in tokens(pa.array(part, pa.string()))]
            yield then(np.stack(rows) if rows else np.zeros((0, 3 * DIM + 1), np.float32))

    return apply


def scorer(docs: DataFrame, labels: DataFrame, held_out: int = 0, modulus: int = 5, max_labelled: int = MAX_LABELLED) -> Column:
    """The score of ``text`` as a column, learnt from ``docs`` and ``labels``.

    The network is fitted on at most ``max_labelled`` labelled documents outside the fold (those of smallest hash,
    so ties and partitioning do not matter); vectors come from all documents, whole.  A null or blank text is empty
    and has a score too; without both labels the score is the share of good ones (0.5 with none at all, or with
    an empty table).
    """
    v, weight = word_vectors(*context_vectors(docs))
    sample = common.labelled_sample(docs, labels, "quality", modulus, held_out, max_labelled)
    pool = F.pandas_udf(_pool_column(docs, v, weight, lambda x: pd.Series(list(x.astype(np.float32)))), "array<float>")
    rows = sample.select("doc_id", "label", pool("text").alias("x")).orderBy("doc_id").collect()  # bounded: max_labelled rows of 97 numbers
    x, y = np.array([r["x"] for r in rows], float).reshape(-1, 3 * DIM + 1), np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return F.lit(float((y.sum() + 0.5) / (len(y) + 1)))
    net = docs.sparkSession.sparkContext.broadcast(train(x, y).arrays)
    return F.pandas_udf(_pool_column(docs, v, weight, lambda x: pd.Series(Network(net.value).score(x.astype(float)))), "double")(F.coalesce("text", F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted`` (given columns of these names are replaced).

    A score of exactly ``threshold`` is predicted 1.  Repeated rows count in the vectors and score alike; very long
    texts are pooled whole; an empty table gives an empty table.  See ``scorer`` for nulls and ``how``.
    """
    return docs.withColumn("score", scorer(docs, labels, **how)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches the threshold."""
    return docs.where(scorer(docs, labels, **how) >= threshold)
