"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the words of a text and the beginnings of its words; a beginning counts once for each
distinct word that has it, up to ``CAP``.  Those that depart most from independence of the label (by
their likelihood ratio on the labelled sample) are chosen.  Every labelled text
that names a group is also seen with its identity terms swapped for each other one of their kind, and
without them, and the loss penalises the squared change of the score, so naming a group carries no weight by itself.
Labelled texts rarely name one.  Into a text that names none, a term is inserted first (its kind, the term and the place
follow the id's hash), so every labelled sentence has counterfactuals: identity terms share beginnings with
other words, and what those weigh must not fall on the group.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Terms that name groups of people, by kind; a swap stays within a line.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "katholiken"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "catholiques"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "católicos"),
)
MAX_LABELLED = 20_000
FEATURES = 1500
#: Words with one beginning that count at most; a linear score of unbounded counts would judge a text by its length.
CAP = 3
#: Hash space of candidate features.
SPACE = 1 << 22
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”…¡¿"
_PREFIXES = (4, 5, 6)

_KIND = {t: line for line in IDENTITY_TERMS for t in line}
_WORD = re.compile(common.WORD)


def bare(word: str) -> str:
    return word.lower().strip(_STRIP)


def word_features(word: str) -> list[int]:
    """Hashes of a bare word and its beginnings."""
    data = [f"={word}"] + [f"^{word[:n]}" for n in _PREFIXES if len(word) > n]
    return [zlib.crc32(d.encode()) % SPACE for d in data]


def text_words(text: str) -> set[str]:
    return {bare(w.decode()) for w in set(text.encode().split())} - {""}


def text_features(words: set[str]) -> Counter[int]:
    """Number of distinct words behind each feature."""
    return Counter(f for w in words for f in word_features(w))


def swapped(text: str, step: int = 1) -> str | None:
    """The text with every identity term replaced by the one ``step`` places on in its kind, case and marks kept; None if it names none.

    With step 0 the terms are left out.
    """
    found = False

    def other(m: re.Match) -> str:
        nonlocal found
        core = bare(m[0])
        kind = _KIND.get(core)
        if kind is None:
            return m[0]
        found = True
        new = kind[(kind.index(core) + step) % len(kind)] if step else ""
        if len(m[0].lower()) != len(m[0]):
            return new
        at = m[0].lower().index(core)
        old = m[0][at : at + len(core)]
        return m[0][:at] + (new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[0].isupper() else new) + m[0][at + len(core) :]

    out = _WORD.sub(other, text)
    return out if found else None


def counterfactuals(text: str) -> list[str]:
    """The text with its terms swapped for every partner of their kinds, and without them: partners alone could all gain weight together."""
    kinds = {_KIND[w] for w in text_words(text) if w in _KIND}
    return [swapped(text, step) for step in range(max(map(len, kinds), default=0))]


def term_of(seed: int) -> str:
    """The identity term that is inserted under a seed."""
    h = zlib.crc32(f"identity {seed}".encode())
    kind = IDENTITY_TERMS[h % len(IDENTITY_TERMS)]
    return kind[(h // 97) % len(kind)]


def planted(text: str, seed: int) -> str:
    """A text with the seed's identity term inserted between two words, or before the first; the place follows the seed too."""
    ends = [0, *(m.end() for m in _WORD.finditer(text))]
    at = ends[zlib.crc32(f"place {seed}".encode()) % len(ends)]
    return f"{text[:at]} {term_of(seed)}{text[at:]}" if at else f"{term_of(seed)} {text}"


def changes(text: str, seed: int, words: set[str], base: Counter[int]) -> list[tuple[Counter[int], Counter[int]]]:
    """Features (up to ``CAP``) that each counterfactual of a text takes away and adds; of the planted text where it names no group.

    ``words`` and ``base`` are the text's words and features.
    """
    if not words.isdisjoint(_KIND):
        capped = lambda c: Counter({f: min(n, CAP) for f, n in c.items()})
        own = capped(base)
        return [(own - c, c - own) for c in (capped(text_features(text_words(t))) for t in counterfactuals(text))]
    # where the term stands makes no difference to features, and only those of its kind's words can change
    term = term_of(seed)
    features = {w: Counter(word_features(w)) for w in _KIND[term]}
    moved = set().union(*features.values())
    with_ = lambda w: Counter({f: min(base[f] + (features[w][f] if w else 0), CAP) for f in moved})
    own = with_(term)
    return [(own - c, c - own) for c in (with_(None), *(with_(p) for p in features if p != term))]


class Model:
    """Weights by feature hash; ``score`` maps a text to (0, 1)."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self._memo: dict[bytes, tuple[str, tuple[int, ...]]] = {}

    def score(self, text: str) -> float:
        memo, found = self._memo, Counter()
        if len(memo) > 100_000:
            memo.clear()
        seen = set()
        for word in set(text.encode().split()):
            if word not in memo:
                b = bare(word.decode())
                memo[word] = b, tuple(f for f in word_features(b) if f in self.weights) if b else ()
            b, features = memo[word]
            if features and b not in seen:
                seen.add(b)
                found.update(features)
        z = self.bias + math.fsum(self.weights[f] * min(n, CAP) for f, n in found.items())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def choose_features(sample: DataFrame, n: int = FEATURES) -> tuple[list[int], int, int]:
    """The ``n`` features that speak most clearly for the label, and the label counts."""

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                yield pd.DataFrame({"f": np.fromiter(text_features(text_words(text)), np.int32), "label": np.int32(label)})

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return [], pos, neg
    counts = sample.mapInPandas(present, "f int, label int").groupBy("f").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    # twice the log of the likelihood ratio against a feature that says nothing about the label
    share = pos / (pos + neg)
    part = lambda c, expected: F.when(c > 0, c * F.log(c / expected)).otherwise(F.lit(0.0))
    n_ = F.col("p") + F.col("q")
    strength = part(F.col("p"), n_ * share) + part(F.col("q"), n_ * (1 - share))
    # only what speaks for the label: in a long clean text, words that are rare in toxic ones would add up against it
    best = counts.where((n_ >= 3) & (F.col("p") > n_ * share)).orderBy(F.desc(F.round(strength, 9)), "f").limit(n).select("f").collect()
    return [r["f"] for r in best], pos, neg


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, modulus: int = 3, max_labelled: int = MAX_LABELLED, threshold: float = 0.7, penalty: float = 1.0, l2: float = 1e-3, steps: int = 400) -> Model:
    """Learn from at most ``max_labelled`` rows outside the fold; with no usable label the score is 0.5 (one label: its share).

    Rows are chosen by the hash of their id and features by rounded strength, then hash, so ties and partitioning do
    not matter; a document with several rows or labels counts once (smallest text, largest label); null texts are
    empty; empty tables give the model without labels; further columns are ignored.

    The bias is placed so that on the sample the cut at ``threshold`` has the best F1.
    """
    sample = common.labelled_sample(docs, labels, "toxic", modulus, held_out, max_labelled)
    chosen, pos, neg = choose_features(sample)
    if not pos or not neg:
        share = (pos + 0.5) / (pos + neg + 1)
        return Model({}, math.log(share / (1 - share)))
    names = sorted(set(chosen) | {f for t in _KIND for f in word_features(t)})
    index = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                code = lambda c: sorted(index[f] for f, n in c.items() if f in index for _ in range(min(n, CAP)))
                words = text_words(text)
                base = text_features(words)
                moved = [[code(a), code(b)] for a, b in changes(text, doc_id, words, base)]
                out.append((doc_id, label, code(base), [m for m in moved if m[0] or m[1]], len(moved)))
            yield pd.DataFrame(out, columns=["doc_id", "label", "x", "moved", "n"])

    # indices of chosen features only: a few dozen numbers for each of a bounded number of rows
    data = sample.mapInPandas(rows, "doc_id long, label int, x array<int>, moved array<array<array<int>>>, n int").orderBy("doc_id").collect()
    x, y = [np.array(r["x"], int) for r in data], np.array([r["label"] for r in data], float)
    pairs = [(np.array(a, int), np.array(b, int)) for r in data for a, b in r["moved"]]
    w, b = train(x, y, pairs, len(names), penalty, l2, steps)
    z = np.array([w[i].sum() for i in x]) + b
    b += math.log(threshold / (1 - threshold)) - best_cut(z, y)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(b))


def train(x, y, pairs, n, penalty, l2, steps):
    """Logistic loss (labels balanced) + penalty * mean squared score change of the swapped pairs + l2, by Adam."""
    rows = np.repeat(np.arange(len(x)), [len(i) for i in x])
    cols = np.concatenate([*x, np.empty(0, int)]).astype(int)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    d_rows, d_cols, d_sign = [], [], []
    for k, (a, s) in enumerate(pairs):
        plus, minus = (list((Counter(u.tolist()) - Counter(v.tolist())).elements()) for u, v in ((a, s), (s, a)))
        d_rows += [k] * (len(plus) + len(minus))
        d_cols += [*plus, *minus]
        d_sign += [1.0] * len(plus) + [-1.0] * len(minus)
    d_rows, d_cols, d_sign = np.array(d_rows, int), np.array(d_cols, int), np.array(d_sign)
    w, b = np.zeros(n), 0.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(x)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        grad = np.bincount(cols, g[rows], n) + l2 * w / 10
        if len(pairs):
            change = np.bincount(d_rows, d_sign * w[d_cols], len(pairs))
            grad += 2 * penalty / len(pairs) * np.bincount(d_cols, d_sign * change[d_rows], n)
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= 0.03 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, b


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    s = z[order]
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1)


def scorer(spark: SparkSession, model: Model) -> Column:
    """The score of ``text`` as a column; a null text counts as empty, a very long one is read whole."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for part in parts:
            yield pd.Series([own.score(t or "") for t in part], dtype=float)

    return score(F.coalesce("text", F.lit("")))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted`` (given columns of these names are replaced).

    A score of exactly ``threshold`` is predicted 1.  Repeated rows score alike; an empty table gives an empty table.
    """
    return docs.withColumn("score", scorer(docs.sparkSession, model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score stays below the threshold."""
    return docs.where(scorer(docs.sparkSession, model) < threshold)
