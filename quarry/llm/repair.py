"""Repair of conversation structure by a dynamic programme over a grammar.

1. Every row of a conversation becomes one symbol: the initial of its role and its fault.  Symbols are strung
   together, in blocks of ``BLOCK`` rows; equal strings are kept once.
2. Re-Pair: the most frequent neighbours are replaced by a new symbol, round after round.  A round takes many
   pairs at once, of which none can overlap another, so a few passes over the distinct strings are enough.
   Pairs are counted over all strings, weighted by how many conversations have them.
3. Every symbol has one min-plus transfer matrix over the automaton's states (start, after s, after u, after a):
   the cheapest edits that lead from one state to another, with their audit as a rope.  A rule's matrix is the
   product of its two sides, made bottom-up and once, whatever the number of conversations it occurs in.
4. A string's audit is the product of the few symbols that are left; a conversation of several blocks folds
   their matrices in order.

Ties: of equal costs the ASCII-least audit wins.  Within one cell no audit of equal cost is the beginning of
another one (more insertions cost more), so the least whole is made of least parts and the product is exact.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Characters that count as blank, and those that end a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block.
BLOCK = 1024
#: Rules made in a round, rounds and rules at most: they bound how much work is shared, never a result.
ROUND_RULES, ROUNDS, RULES = 64, 12, 512
FIRST_RULE = 0x4E00
#: Characters of a text that travel in one row.
PIECE = 4096


# --- rows ------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage of crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes ``.!?`` away, 3 repeats, 4 makes it the user's.

    Nulls count as one space, in roles, texts and the damage's key; a null turn stays null.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    code, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    return (
        turns.withColumn("_code", code).where("_code <> 0")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
            F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
            F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"),
        )
        .withColumn("_copy", F.explode("_copies")).drop("_copies", "_copy")
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``conv``, the id as text (empty for null), so that a null id is a conversation like others."""
    return rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


def faults(rows: DataFrame) -> DataFrame:
    """``conv, place, turn, initial, fault, symbol, illegal, first_of_turn`` of rows in their order; texts stay behind.

    ``fault`` is the first of blank (b), duplicate (d) and truncated (t), else empty.  Rows of equal turn follow role and text.
    """
    said = F.rtrim("text", F.lit(BLANKS))
    narrow = _keyed(rows).select(
        "conv", F.col("turn"), *common.turn_parts(F.col("role"), F.col("text")), F.substring("role", 1, 1).alias("initial"),
        (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(*ENDS)).alias("cut"),
    )
    conv = Window.partitionBy("conv").orderBy(*common.turn_order())
    placed = narrow.withColumns({"place": F.row_number().over(conv), "before": F.lag("initial").over(conv), "turn_before": F.lag("turn").over(conv)})
    placed = placed.withColumn("again", F.row_number().over(Window.partitionBy("conv", "digest").orderBy("place")) > 1)
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), "t").otherwise("")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return placed.withColumn("fault", fault).select(
        "conv", "place", "turn", "initial", "fault",
        F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper(known)).otherwise(known).alias("symbol"),
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("first_of_turn"),
    )


def blocks(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, block, seq`` and the block's counts ``blank, duplicate, truncated, illegal, distinct, low, high``."""
    n = lambda fault, name: F.count_if(F.col("fault") == fault).alias(name)
    return (
        marked.groupBy("conv", F.floor((F.col("place") - 1) / block).cast("int").alias("block"))
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda t: t["symbol"]), "").alias("seq"),
            n("b", "blank"), n("d", "duplicate"), n("t", "truncated"), F.count_if("illegal").alias("illegal"), F.count_if("first_of_turn").alias("distinct"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        )
    )


# --- grammar ---------------------------------------------------------------


def chosen(counts: list[tuple[str, int]], most: int) -> list[str]:
    """Of pairs by falling count those that can be replaced at once: no symbol is the left side of one and the right side of another."""
    left, right, out = set(), set(), []
    for pair, n in counts:
        a, b = pair
        free = a not in right and b not in left and (a != b or (a not in left and b not in right))
        if n >= 2 and free and len(out) < most:
            out.append(pair)
            left.add(a)
            right.add(b)
    return out


def grammar(seqs: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> tuple[DataFrame, list[str]]:
    """Strings ``seq, weight`` with their compressed form ``c``, and the rules: rule k stands for symbol chr(FIRST_RULE + k)."""
    made: list[str] = []
    now = seqs.withColumn("c", F.col("seq"))
    for _ in range(rounds):
        now = common.cut(now, "grammar")
        letters = now.where(F.length("c") > 1).select("weight", F.split("c", "").alias("l"))
        pairs = letters.select("weight", F.explode(F.zip_with(F.slice("l", F.lit(1), F.size("l") - 1), F.slice("l", F.lit(2), F.size("l") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
        top = pairs.groupBy("pair").agg(F.sum("weight").alias("n")).orderBy(F.desc("n"), "pair").limit(4 * ROUND_RULES)
        new = chosen([(r["pair"], r["n"]) for r in top.collect()], min(ROUND_RULES, rules - len(made)))
        if not new:
            break
        now = now.withColumn("c", reduce(lambda c, k: F.replace(c, F.lit(new[k]), F.lit(chr(FIRST_RULE + len(made) + k))), range(len(new)), F.col("c")))
        made += new
    return now, made


# --- transfer matrices -----------------------------------------------------

_P, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A text as a tree of shared parts, with its length and hash."""

    __slots__ = ("hash", "left", "n", "right", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.n, self.hash = len(text), reduce(lambda h, c: (h * _BASE + ord(c)) % _P, text, 0)
        else:
            self.n, self.hash = left.n + right.n, (left.hash * pow(_BASE, right.n, _P) + right.hash) % _P

    def __add__(self, other: Rope) -> Rope:
        if not self.n or not other.n:
            return self if self.n else other
        if self.text is not None and other.text is not None and self.n + other.n <= 16:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        """Code point order; equal parts are skipped by length and hash."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.n == y.n and x.hash == y.hash:
                continue
            if x.text is not None and y.text is not None:
                k = min(x.n, y.n)
                if x.text[:k] != y.text[:k]:
                    return x.text < y.text
                a += [Rope(x.text[k:])] * (x.n > k)
                b += [Rope(y.text[k:])] * (y.n > k)
            elif x.text is None and (y.text is not None or x.n >= y.n):
                a += [x.right, x.left]
                b.append(y)
            else:
                b += [y.right, y.left]
                a.append(x)
        return bool(b)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.text is not None:
                out.append(x.text)
            else:
                todo += [x.right, x.left]
        return "".join(out)


Matrix = dict[tuple[int, int], tuple[int, Rope]]
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: What a role leads to from each state, and the state behind an inserted or rewritten turn.
STEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}, "x": {}}
TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
#: Insertions that end a conversation from each state.
CLOSING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}


def _better(cells: dict, key, cost: int, rope: Rope) -> None:
    if key not in cells or cost < cells[key][0] or (cost == cells[key][0] and rope < cells[key][1]):
        cells[key] = cost, rope


def symbol_matrix(symbol: str) -> Matrix:
    """Edits of one row: insertions before it, then keep, rewrite or delete."""
    cells: Matrix = {}
    extra = TRUNCATED if symbol.isupper() else 0
    for start in range(4):
        at = start
        for k in range(3):
            before = INSERT * k
            edits = [(at, DELETE, "D")]
            if symbol != "d":
                edits.append((TURN[at], REROLE + extra, "R"))
                if at in STEPS[symbol.lower()]:
                    edits.append((STEPS[symbol.lower()][at], extra, "K"))
            for end, cost, edit in edits:
                _better(cells, (start, end), before + cost, Rope("I" * k + edit))
            at = TURN[at]
    return cells


def times(a: Matrix, b: Matrix) -> Matrix:
    cells: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for (m, j), (more, tail) in b.items():
            if k == m and ((i, j) not in cells or cost + more <= cells[i, j][0]):
                _better(cells, (i, j), cost + more, rope + tail)
    return cells


def closed(cells: Matrix) -> tuple[int, Rope]:
    """The cheapest way from the start to an accepted end."""
    ends: dict = {}
    for (i, j), (cost, rope) in cells.items():
        if i == START:
            _better(ends, 0, cost + INSERT * len(CLOSING[j]), rope + Rope(CLOSING[j]))
    return ends[0]


class Rules(dict):
    """Matrices of symbols, each made once from its two sides."""

    def __init__(self, rules: list[str]) -> None:
        super().__init__()
        self.rules = rules

    def __missing__(self, symbol: str) -> Matrix:
        k = ord(symbol) - FIRST_RULE
        cells = self[symbol] = symbol_matrix(symbol) if k < 0 else times(self[self.rules[k][0]], self[self.rules[k][1]])
        return cells

    def of(self, c: str) -> Matrix:
        return reduce(times, (self[s] for s in c))


_CELL = "array<struct<i:int,j:int,cost:long,audit:string>>"


def evaluated(strings: DataFrame, rules: list[str]) -> DataFrame:
    """``seq, cost, audit, cells`` of distinct strings ``seq, c, many``; the whole matrix only where ``many`` (its conversation has further blocks)."""
    cell = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches):
        known = Rules(rules)
        for symbol in range(FIRST_RULE, FIRST_RULE + len(rules)):  # bottom-up: a rule is made of earlier symbols
            known[chr(symbol)]  # noqa: B018
        for batch in batches:
            seqs, rows = batch.column("seq").to_pylist(), []
            for c, many in zip(batch.column("c").to_pylist(), batch.column("many").to_pylist(), strict=True):
                m = known.of(c)
                cost, audit = closed(m)
                rows.append((cost, str(audit), [{"i": i, "j": j, "cost": v, "audit": str(r)} for (i, j), (v, r) in m.items()] if many else None))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], cell)], names=["seq", "cost", "audit", "cells"])

    return strings.select("seq", "c", "many").mapInArrow(run, f"seq string, cost long, audit string, cells {_CELL}")


def _folded(rows: DataFrame) -> DataFrame:
    """``conv, cost, audit`` of conversations of several blocks ``conv, block, cells``, folded in order."""

    def run(batches):
        now, state, done = None, {}, []
        for batch in batches:
            for conv, cells in zip(batch.column("conv").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                m = {(x["i"], x["j"]): (x["cost"], Rope(x["audit"])) for x in cells}
                if conv == now:
                    state = times(state, m)
                else:
                    if now is not None:
                        done.append((now, *closed(state)))
                    now, state = conv, {k: v for k, v in m.items() if k[0] == START}
        if now is not None:
            done.append((now, *closed(state)))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([str(d[2]) for d in done], pa.string())], names=["conv", "cost", "audit"])

    return rows.repartition("conv").sortWithinPartitions("conv", "block").select("conv", "cells").mapInArrow(run, "conv string, cost long, audit string")


def audits(parts: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> DataFrame:
    """``conv, cost, audit`` for blocks ``conv, block, seq``."""
    marked = parts.select("conv", "block", "seq", (F.max("block").over(Window.partitionBy("conv")) > 0).alias("many"))
    strings = marked.groupBy("seq").agg(F.count(F.lit(1)).alias("weight"), F.max("many").alias("many"))
    compressed, made = grammar(strings, rounds, rules)
    results = common.cut(evaluated(compressed, made), "results")
    single = marked.where("not many").join(results, "seq").select("conv", "cost", "audit")
    several = marked.where("many").join(results.where("cells is not null"), "seq").select("conv", "block", "cells")
    return single.unionByName(_folded(several))


# --- results ---------------------------------------------------------------


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: the repaired turns as ``role:text`` lines, hashed as they pass in order, at constant memory.

    Texts travel in pieces of ``PIECE`` characters; the audit comes before a conversation's rows.
    """
    piece = F.when(F.length("text") <= PIECE, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))
    own = _keyed(rows).select("conv", "turn", *common.turn_parts(F.col("role"), F.col("text"))[:3], F.monotonically_increasing_id().alias("row"), F.posexplode(piece).alias("piece", "text"))
    none = lambda kind: F.lit(None).cast(kind)
    both = own.select("conv", F.lit(1).alias("kind"), "turn", "role", "head", "digest", "row", "piece", "text").unionByName(
        found.select("conv", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("head"), none("binary").alias("digest"), none("long").alias("row"), F.lit(0).alias("piece"), F.col("audit").alias("text"))
    )

    def run(batches):
        conv, audit, at, sha, state, first, kept = None, "", 0, None, START, True, False
        done: list[tuple[str, str]] = []

        def add(role: str) -> None:
            nonlocal first
            sha.update((b"" if first else b"\n") + role.encode() + b":")
            first = False

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = TURN[state], at + 1
                add("assistant" if state == AFTER_A else "user")

        def end() -> None:
            if conv is not None:
                inserted()
                done.append((conv, sha.hexdigest()))

        for batch in batches:
            for own, kind, role, number, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "piece", "text")), strict=True):
                if kind == 0:
                    end()
                    conv, audit, at, sha, state, first = own, text, 0, hashlib.sha256(), START, True
                    continue
                if number == 0:
                    inserted()
                    edit, at = audit[at], at + 1
                    kept = edit != "D"
                    if edit == "K":
                        state = STEPS[role[:1]][state]
                        add(role)
                    elif edit == "R":
                        state = TURN[state]
                        add("assistant" if state == AFTER_A else "user")
                if kept:
                    sha.update(text.encode())
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["conv", "repaired_sha256"])
                done.clear()
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["conv", "repaired_sha256"])

    sent = both.repartition("conv").sortWithinPartitions("conv", "kind", *common.turn_order(), "row", "piece").select("conv", "kind", "role", "piece", "text")
    return sent.mapInArrow(run, "conv string, repaired_sha256 string")


def repaired(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK, rounds: int = ROUNDS, rules: int = RULES) -> DataFrame:
    """Faults, cheapest edits and the repaired digest of conversations ``conv_id, turn, role, text``.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; ``ids`` names conversations that
    may have no rows left (zeros, an empty audit, the empty text's digest).  Rows of a null ``conv_id`` are one
    conversation; a null role or text is one space; null turns come first; equal turns follow role and text, so repeated
    rows are neighbours.  A role that begins with none of s, u, a (or is empty) cannot be kept.  Texts of any length are
    read whole; an empty table gives no rows; further columns are ignored.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    parts = common.cut(blocks(faults(rows), block), "blocks")
    found = common.cut(audits(parts, rounds, rules), "audits")
    n = lambda c: F.sum(c).cast("long").alias(c)
    counts = parts.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct"), F.lit(0)).cast("long").alias("gaps"), n("blank"), n("duplicate"), n("truncated"), n("illegal"),
    )
    every = _keyed(rows if ids is None else ids).select("conv").distinct()
    out = every.join(counts, "conv", "left").join(found, "conv", "left").join(digests(rows, found), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )



def oracle() -> str:
    """The same by a recursion over rows with four states, in DuckDB SQL."""
    table = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    crc = f"""xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(k, ''), lambda s: [(ord(s) & 15)::bigint, (ord(s) >> 4)::bigint]))),
      lambda a, n: xor(a >> 4, {table}[(xor(a, n) & 15) + 1]::bigint)), 4294967295::bigint)"""
    return f"""
with recursive k as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
c as (select *, {crc} % 20 code from k),
d as (select coalesce(conv_id::varchar, '') conv, turn, case when code = 4 then 'user' else coalesce(role, ' ') end role,
  case when code = 1 then '' when code = 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end text, unnest(range(case when code = 3 then 2 else 1 end)) copy from c where code <> 0),
o as (select *, row_number() over w place, lag(role[1]) over w || role[1] pair, 
  rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) said from d window w as (partition by conv order by turn nulls first, role, text, copy)),
f as (select *, case when said = '' then 'b' when row_number() over (partition by conv, role, text order by place) > 1 then 'd' when right(said, 1) not in ('.', '!', '?') then 't' else '' end fault from o),
ins(a, k, b) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
edit(e, initial, a, b, cost) as (values ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0), ('R', null, 0, 2, 3), ('R', null, 1, 2, 3), ('R', null, 2, 3, 3), ('R', null, 3, 2, 3),
  ('D', null, 0, 0, 4), ('D', null, 1, 1, 4), ('D', null, 2, 2, 4), ('D', null, 3, 3, 4)),
dp as (
  select distinct conv, 0::bigint place, 0 state, 0 cost, '' audit from d
  union all
  select conv, place, state, cost, audit from (
    select x.conv, f.place, e.b state, x.cost + 3 * i.k + e.cost + case when e.e <> 'D' and f.fault = 't' then 3 else 0 end cost, x.audit || repeat('I', i.k) || e.e audit,
      row_number() over (partition by x.conv, e.b order by x.cost + 3 * i.k + e.cost + case when e.e <> 'D' and f.fault = 't' then 3 else 0 end, x.audit || repeat('I', i.k) || e.e) best
    from dp x join f on f.conv = x.conv and f.place = x.place + 1 join ins i on i.a = x.state
    join edit e on e.a = i.b and (e.initial is null or e.initial = f.role[1]) and (e.e = 'D' or f.fault not in ('b', 'd'))) where best = 1),
n as (select conv, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'b') blank, count(*) filter (where fault = 'd') duplicate,
  count(*) filter (where fault = 't') truncated, count(*) filter (where place > 1 and pair not in ('su', 'ua', 'au')) illegal from f group by conv),
z as (select conv, cost + 3 * length(tail) cost, audit || tail audit, row_number() over (partition by conv order by cost + 3 * length(tail), audit || tail) best
  from (select dp.*, case state when 1 then 'II' when 2 then 'I' else '' end tail from dp join n on n.conv = dp.conv and n.n = dp.place)),
p as (select conv, e, i, count(*) filter (where e <> 'I') over w place, count(*) filter (where e <> 'D') over w made
  from (select conv, unnest(string_split(audit, '')) e, unnest(range(length(audit))) i from z where best = 1 and audit <> '') window w as (partition by conv order by i)),
s as (select conv, count(*) > 0 sys from p join f using (conv, place) where e = 'K' and f.role[1] = 's' group by conv),
t as (select p.conv, string_agg(case when e = 'K' then f.role when (made + case when s.sys then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else f.text end, chr(10) order by i) lines
  from p left join f on f.conv = p.conv and f.place = p.place left join s on s.conv = p.conv where e <> 'D' group by p.conv)
select q.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(cost, 0)::bigint cost,
  coalesce(audit, '') audit, sha256(coalesce(lines, '')) repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, '') conv from conversations) q left join n using (conv) left join (select * from z where best = 1) z using (conv) left join t using (conv)"""
