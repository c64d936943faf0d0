"""Extension points: embedding and pair-scoring models, and a table function for chunks.

A caller hands in its own model; the defaults are deterministic and need none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text


def hashed_vector(s: Column, dim: int = 64) -> Column:
    """Default embedding: counts of tokens by hash bucket with a hashed sign, on the JVM."""
    ts = F.transform(text.tokens(s), lambda t: F.xxhash64(t))
    at = lambda i: F.aggregate(ts, F.lit(0.0), lambda a, h: a + F.when(F.pmod(h, F.lit(dim)) == i, F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function from a model: ``load`` runs once for each task, its result once for each Arrow batch."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series(list(np.asarray(model(part.fillna("").tolist()), float)))

    return embed


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]]):
    """The same for (query, text) pairs; without a model use ``text.coverage``."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(np.asarray(model(list(zip(q.fillna(""), t.fillna(""), strict=True))), float))

    return score


def register(spark: SparkSession) -> None:
    """Make ``chunk_text(text, size, overlap, most, least)`` known to SQL as a table function."""
    from pyspark.sql.functions import udtf

    class ChunkText:
        def eval(self, s: str, size: int, overlap: int, most: int, least: int):
            from quarry.operators.chunking import split

            yield from enumerate(split(s or "", size, overlap, most, least))

    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, content string"))


def register_triples(spark: SparkSession) -> None:
    """Make ``text_triples(text, relations[, source])`` known to SQL: a row for each triple of known relation in the JSON of a text.

    The JSON may stand in a fenced block or among other text; broken JSON gives no rows.  With a literal ``source`` the rows
    have a column more (the plan asks ``analyze`` for the columns of each call).
    """
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import StringType, StructType

    class TextTriples:
        @staticmethod
        def analyze(s: AnalyzeArgument, relations: AnalyzeArgument, source: AnalyzeArgument | None = None) -> AnalyzeResult:
            names = ["head", "head_type", "relation", "tail", "tail_type", *(["source"] if source is not None else [])]
            schema = StructType()
            for n in names:
                schema = schema.add(n, StringType())
            return AnalyzeResult(schema)

        def eval(self, s: str, relations: list, *source):
            from quarry.functions.triples import parsed

            for row in parsed(s, set(relations or ())):
                yield (*row, *source)

    spark.udtf.register("text_triples", udtf(TextTriples))
