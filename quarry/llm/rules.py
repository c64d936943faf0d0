"""Quality rules with adaptive thresholds.

Four ratios of each document and its number of words go into quantile sketches per language and
source: counts of logarithmic buckets (256 to a doubling), which merge by addition, so partial sketches
of tasks, and sketches of sources, merge without error.  A group's sketch is merged with its language's,
scaled to ``PRIOR`` documents, so small groups lean on their language and large ones on themselves, by one
rule at every size.  Fences from its quartiles take the place of fixed cutoffs and are joined back to the
documents: the upper quartile plus ``reach`` times its distance from the median (and the lower one less
likewise).  Quartiles do not break down: a group of which a fifth is junk has the fences of its other
documents.  The first occurrence of a mark in a document never counts, neither in the sketches nor in the
verdict, so an ordinary repeated line is no outlier in a short text.  Where most documents have no mark
(quartiles of zero) the distance is what one more occurrence makes in a document of the group's median
length; where marks are usual the fences follow the marks.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_SYMBOLS = b"#*$%&|<>"
_SPACE = " \t\n\v\f\r"

#: name: (ratio over n_words, times; counts that one more occurrence adds; has a lower fence).  A repeated window is six words at least.
RATIOS = {
    "word_length": ("word_chars", 100, 10, True),
    "symbols": ("n_symbols", 100_000, 1, False),
    "dup_lines": ("n_dup_lines", 100_000, 1, False),
    "repeats": ("n_repeat_words", 100_000, 6, False),
}
REACH = 6
#: Documents as which a language counts in the sketches of its sources.
PRIOR = 100


def features_of(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one whole text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        seen, twice = set(), set()
        if len(set(grams)) < len(grams):
            for g in grams:
                (twice if g in seen else seen).add(g)
            upto = 0  # words before it are counted
            for i, g in enumerate(grams):
                if g in twice:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, dup, repeat


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the five counts; a null text has no words, characters or lines."""

    def count(batches):
        for batch in batches:
            rows = [features_of(t or "") for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(count, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def bucket(value: Column) -> Column:
    """Lower bound of the sketch bucket of a whole number: exact below 512, then 256 buckets to a doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 9, F.lit(0))
    return F.when(value < 512, value).otherwise((F.floor(value / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)).cast("long"))


def ratio(name: str) -> Column:
    """A document's value of a ratio, as a whole number; of marks the first occurrence does not count."""
    count, times, more, lower = RATIOS[name]
    beyond = F.col(count) if lower else F.greatest(F.col(count) - more, F.lit(0))
    return F.floor(beyond * times / F.col("n_words")).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """``lang, source, ratio, bucket, n``: mergeable by summing ``n``.  Documents that failed the base rules do not count."""
    value = {name: ratio(name) for name in RATIOS} | {"words": F.col("n_words")}
    each = F.array(*(F.struct(F.lit(name).alias("ratio"), bucket(v).alias("bucket")) for name, v in value.items()))
    return counts.where("not base_failed").select("lang", "source", F.explode(each).alias("r")).groupBy("lang", "source", "r.ratio", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """``lang, source`` and a ``low`` and ``high`` for each ratio, from the quantiles of every group's merged sketch."""
    wide = "decimal(38,0)"  # weights are products of counts
    own = sketch.groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    langs = own.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    docs = langs.groupBy(F.col("lang").alias("_lang"), F.col("ratio").alias("_ratio")).agg(F.sum("n").cast(wide).alias("_docs"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_ratio"))
    scaled = own.join(docs, same).select("lang", "source", "ratio", "bucket", (F.col("n").cast(wide) * F.col("_docs")).cast(wide).alias("w"))
    groups = own.select(F.col("lang").alias("_lang"), "source", F.col("ratio").alias("_ratio")).distinct()
    lent = langs.join(groups, same).select("lang", "source", "ratio", "bucket", (F.col("n").cast(wide) * prior).cast(wide).alias("w"))
    merged = scaled.unionByName(lent).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("w").cast(wide).alias("w"))
    key = ["lang", "source", "ratio"]
    run = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("upto", F.sum("w").over(run).cast(wide)).withColumn("all", F.sum("w").over(Window.partitionBy(*key)).cast(wide))
    q = lambda name, p: F.min(F.when((F.col("ratio") == name) & (F.col("upto") * 100 >= F.col("all") * p), F.col("bucket"))).alias(f"{name}_{p}")
    marks = merged.groupBy("lang", "source").agg(q("words", 50), *(q(name, p) for name in RATIOS for p in (25, 50, 75)))
    out = []
    for name, (_, times, more, _) in RATIOS.items():
        low, mid, high = (F.col(f"{name}_{p}") for p in (25, 50, 75))
        least = F.greatest(F.floor(F.lit(times * more) / F.col("words_50")).cast("long"), F.lit(1).cast("long"))
        out += [(low - reach * F.greatest(mid - low, least)).alias(f"{name}_low"), (high + reach * F.greatest(high - mid, least)).alias(f"{name}_high")]
    return marks.select("lang", "source", *out)


def filtered(docs: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` for every document.

    Base rules: fewer than 50 words, or more than half of the words in repeated 3-word windows.  Of the
    rest, a document is kept if each ratio lies within its group's fences (a value on a fence is inside).
    Null languages and sources are groups of their own; a null, empty or blank text has no words and fails.
    Repeated rows count and are judged each, alike; texts of any length are read whole; an empty table gives an
    empty table; further columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = common.cut(features(docs).withColumn("base_failed", failed), "rules")
    own, _ = common.sized(fences(common.cut(sketches(counts), "rules-sketch"), reach, prior), "rules-fences")
    own = own.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    verdict = F.lit(True)
    for name, (_, _, _, lower) in RATIOS.items():
        verdict = verdict & (ratio(name) <= F.col(f"{name}_high"))
        if lower:
            verdict = verdict & (ratio(name) >= F.col(f"{name}_low"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict).alias("kept"))


def oracle(reach: int = REACH, prior: int = PRIOR) -> str:
    """The same in DuckDB SQL."""
    values = {name: f"(greatest({c} - {0 if lower else more}, 0) * {times} // n_words)" for name, (c, times, more, lower) in RATIOS.items()}
    sketch = " union all ".join(f"select lang, source, '{name}' ratio, {v} v from base where not base_failed" for name, v in (values | {"words": "n_words"}).items())
    q = lambda name, p: f"min(case when ratio = '{name}' and upto * 100 >= total * {p} then bucket end)"
    sides = []
    for name, (_, times, more, _) in RATIOS.items():
        least = f"{times * more} // words_50, 1"
        sides += [f"{name}_25 - {reach} * greatest({name}_50 - {name}_25, {least}) {name}_low", f"{name}_75 + {reach} * greatest({name}_75 - {name}_50, {least}) {name}_high"]
    checks = " and ".join(f"{values[k]} <= {k}_high" + (f" and {values[k]} >= {k}_low" if RATIOS[k][3] else "") for k in RATIOS)
    return f"""
with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') text from documents),
w as (select rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') ws from d),
u as (select rid, unnest(range(len(ws) - 2)) i, ws from w where len(ws) >= 3),
g as (select rid, i, concat_ws(' ', ws[i + 1], ws[i + 2], ws[i + 3]) gram from u),
t as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) c from g) where c > 1),
rep as (select rid, count(distinct i + k) n from t, range(3) r(k) group by rid),
ln as (select rid, count(*) - count(distinct line) n from (select rid, unnest(string_split(text, chr(10))) line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
base as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from (
    select d.doc_id, lang, source, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols,
      coalesce(ln.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
    from d join w using (rid) left join ln using (rid) left join rep using (rid))),
own as (select lang, source, ratio, bucket, count(*) n from (select lang, source, ratio, case when v < 512 then v else (v >> (length(bin(v)) - 9)) << (length(bin(v)) - 9) end bucket from ({sketch})) group by all),
langs as (select lang, ratio, bucket, sum(n)::hugeint n from own group by all),
docs as (select lang, ratio, sum(n)::hugeint n from langs group by all),
merged as (select lang, source, ratio, bucket, sum(w)::hugeint w from (
  select own.*, own.n * docs.n w from own join docs on own.lang is not distinct from docs.lang and own.ratio = docs.ratio
  union all by name select langs.lang, x.source, langs.ratio, langs.bucket, langs.n, langs.n * {prior} w from langs join (select distinct lang, source, ratio from own) x on x.lang is not distinct from langs.lang and x.ratio = langs.ratio
) group by lang, source, ratio, bucket),
run as (select *, sum(w) over (partition by lang, source, ratio order by bucket) upto, sum(w) over (partition by lang, source, ratio) total from merged),
marks as (select lang, source, {q("words", 50)} words_50, {", ".join(f"{q(k, p)} {k}_{p}" for k in RATIOS for p in (25, 50, 75))} from run group by lang, source),
f as (select lang, source, {", ".join(sides)} from marks)
select base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, case when base_failed then false else {checks} end kept
from base left join f on base.lang is not distinct from f.lang and base.source is not distinct from f.source"""
