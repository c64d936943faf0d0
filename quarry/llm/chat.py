"""Chat formatting in budgeted windows.

Prefix sums of turn costs lay a coarse grid over each conversation: a stretch of ``STRETCH`` windows of
tokens.  The turns that begin in a stretch are cut into windows in order: a window takes turns up to the
furthest one whose prefix sum still fits the budget, so only the last window of a stretch may stay short.
Stretches do not wait for each other, so one very long conversation is spread over many tasks.  A window
holds, in this order, the conversation's system turn, as much directly preceding history as ``history``
tokens (and the budget) allow, and its new turns.  Only the text of new assistant turns is under the loss
mask, so each target is learnt once however often it is repeated as history.

Template: ``### role\\n`` text ``</turn>\\n`` for each turn.  Inside roles and texts ``\\``, ``#`` and
``<`` are written ``\\\\``, ``\\h`` and ``\\l`` (a line end in a role ``\\n``), so no text can imitate a mark
and the original is restored exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
#: Turns of a prefix-sum chunk.
CHUNK = 256
#: Windows in a stretch of a conversation, about.
STRETCH = 32


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


_CODES = {"\\": "\\", "h": "#", "l": "<", "n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _CODES[m[1]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """``[(role, text)]`` of a formatted window."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(HEAD).partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def fill(at: np.ndarray, cost: np.ndarray, first: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """``(from, start, stop)`` of each window over turns with prefix sums ``at``: repeats from ``from``, new turns from ``start``.

    Turns before ``first`` are known from earlier windows.  A window takes at least one new turn, then as many as the
    budget allows beside the system turn and the history; history gives way to the first new turn.
    """
    out, ends, start = [], at + cost, first
    while start < len(at):
        alone = system if at[start] > 0 else 0
        spare = min(history, budget - alone - int(cost[start]))
        begin = min(int(np.searchsorted(at, at[start] - max(spare, 0))), start)
        if alone and at[begin] == 0:  # the system turn is no history of its own
            begin += 1
        room = budget - alone - int(at[start] - at[begin]) if begin < start else budget - alone
        stop = max(start + 1, int(np.searchsorted(ends, at[start] + room, side="right")))
        out.append((begin, start, stop))
        start = stop
    return out


def windows(turns: DataFrame, budget: int = 1024, history: int = 128, reserve: int = 256) -> DataFrame:
    """``conv_id, window, formatted, n_context, spans, cost, over_budget`` for rows ``conv_id, turn, role, text``.

    A token is counted as four characters, begun.  ``budget`` bounds a window with its system turn and repeated
    turns; only a new turn that does not fit beside the system turn makes a window ``over_budget``, and turns are
    never cut.  ``reserve`` is the room for a system turn that the grid reckons with.  ``n_context`` leading turns
    are repeats.  ``spans`` are [start, stop) code points of the formatted text under the loss mask.  Windows of
    a conversation follow each other by ``window``.

    Null roles and texts are empty; rows of equal turn follow role and text, so repeated rows stay side by side;
    null turns come first; rows of a null ``conv_id`` form one conversation.  An empty table gives an empty table.
    Further columns are ignored, whatever their names.
    """
    cell = STRETCH * max(1, budget - reserve - history)
    history = min(history, cell)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.ceil((F.length(role) + F.length(text) + len(HEAD) + len(END) + 1) / 4).cast("long").alias("cost"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK).cast("long").alias("chunk"),
    )
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy("conv_id", "chunk").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("n"))
        .select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("at", F.coalesce(F.sum("cost").over(earlier), F.lit(0))).withColumn("seq", F.row_number().over(inside) - 1)
        .join(base, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
        .select("conv_id", "role", "text", "cost", (F.col("at") + F.col("_c")).alias("at"), (F.col("seq") + F.col("_n")).alias("seq"))
        .withColumn("system", (F.col("seq") == 0) & (F.col("role") == "system"))
    )
    # a turn belongs to the stretch it begins in, and may be history of the next one
    own = F.floor(F.col("at") / cell).cast("long")
    reaches = (F.col("at") + history >= (own + 1) * cell) & ~F.col("system")
    spread = placed.select("*", own.alias("own"), F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))).alias("stretch"))
    turn = F.struct("seq", "at", "cost", (F.col("stretch") == F.col("own")).alias("new"), "role", "text")
    grouped = spread.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(turn)).alias("turns")).where(F.exists("turns", lambda t: t["new"]))
    system = placed.where("system").select(F.col("conv_id").alias("_conv"), F.struct("seq", "at", "cost", F.lit(False).alias("new"), "role", "text").alias("_system"))
    whole = grouped.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")

    @F.pandas_udf("array<struct<f:int,s:int,e:int>>")
    def cut_up(at: pd.Series, cost: pd.Series, known: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([[{"f": f, "s": s, "e": e} for f, s, e in fill(np.asarray(a), np.asarray(c), int(n), int(k), budget, history)] for a, c, n, k in zip(at, cost, known, first, strict=True)], dtype=object)

    field = lambda name: F.transform("turns", lambda t: t[name])
    n_known = F.size(F.filter("turns", lambda t: ~t["new"]))
    cuts = cut_up(field("at"), field("cost"), n_known, F.coalesce(F.col("_system.cost"), F.lit(0)))
    pieces = whole.withColumn("cuts", cuts).select("conv_id", "stretch", "turns", "_system", F.posexplode("cuts").alias("k", "w"))
    shown = F.slice("turns", F.col("w.f") + 1, F.col("w.e") - F.col("w.f"))
    marked = F.transform(shown, lambda t, i: t.withField("new", i >= F.col("w.s") - F.col("w.f")))
    with_system = F.when(F.col("_system").isNotNull() & (F.element_at("turns", F.col("w.s") + 1)["at"] > 0), F.concat(F.array("_system"), marked)).otherwise(marked)
    whole = pieces.select("conv_id", (F.col("stretch") * (1 << 32) + F.col("k")).alias("window"), with_system.alias("turns"))
    shaped = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(HEAD), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["new"] & (t["role"] == "assistant")).alias("target"),
        ),
    )
    spans = F.expr(
        f"""aggregate(shaped, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,stop:int>>)),
        (a, t) -> named_struct('at', a.at + length(t.head) + length(t.body) + {len(END)}, 'spans',
          if(t.target, concat(a.spans, array(named_struct('start', a.at + length(t.head), 'stop', a.at + length(t.head) + length(t.body)))), a.spans)),
        a -> a.spans)"""
    )
    cost = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["cost"])
    return whole.withColumn("shaped", shaped).select(
        "conv_id", "window",
        F.array_join(F.transform("shaped", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_context"),
        spans.alias("spans"), cost.alias("cost"), (cost > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows in order and nothing else.

    A digest needs its conversation in sequence; rows stream through one task sorted, and only hash states
    and one window are held.
    """

    def stream(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = ()
        done: list[tuple] = []
        for batch in batches:
            for conv, window, known, context, spans in zip(batch["conv_id"], batch["formatted"], batch["known"], batch["n_context"], batch["spans"], strict=True):
                key = (known, conv if known else None)
                if key != now:
                    if now:
                        done.append(row(now))
                    now, n_turns, n_loss, n_chars, all_, loss = key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(window)[context:]:
                    all_.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                for span in spans:
                    part = unescape(window[span["start"] : span["stop"]])
                    loss.update(part.encode())
                    n_loss += len(part)
                n_chars += len(window)
                row = lambda k, v=(n_turns, all_, n_loss, loss, n_chars): (k[1], v[0], v[1].hexdigest(), v[2], v[3].hexdigest(), v[4])
            yield frame(done)
            done = []
        if now:
            yield frame([row(now)])

    def frame(rows):
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return out.astype({"conv_id": "Int64"})

    dealt = (
        formatted.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNotNull().alias("known"), "window", "formatted", "n_context", "spans")
        .repartition("conv_id").sortWithinPartitions("conv_id", "known", "window")
    )
    return dealt.mapInPandas(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
