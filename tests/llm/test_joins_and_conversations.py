"""Size-aware join, prefix trie and structure repair: SQL twins on the tables, brute force on odd rows, every setting."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from quarry.llm import jaccard, neardup, repair, trie


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def in_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        pdf = df.toPandas()
        for c in ("conv_id", "turn", "doc_id"):
            if c in pdf:
                pdf[c] = pdf[c].astype("Int64")
        con.register(name, pdf)
    return sorted(con.execute(sql).fetchall(), key=repr)


@pytest.fixture(scope="module")
def turns(spark):
    r, rows = random.Random(1), []
    for c in [None, -7, -6, 0, 1, 2, 5, *range(10, 40)]:
        for k in range(r.choice([0, 1, 2, 3, 5, 9, 14, 30])):
            role = r.choice(["user", "assistant", "system", None, "", "tool", "user", "assistant"])
            rows.append((c, r.choice([None, k, k, k, 0]), role, r.choice([None, "", " \n", "Yes.", "No", "Why?", "Oh!  ", "a.b!c?", "same.", "x" * 5000]), " z"))
    rows += [rows[0], rows[3]]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").cache()


# --- join ------------------------------------------------------------------


@pytest.fixture(scope="module")
def near(spark):
    r, rows = random.Random(3), []
    for g in range(50):
        base = [f"w{g}_{k}" for k in range(r.choice([1, 2, 3, 8, 12, 15, 20, 21, 22, 25, 40, 80, 200, 900]))]
        for _ in range(r.choice([1, 2, 3, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3]) if len(w) > 3 else 0):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[], ["x"], [w[i], "y"]])
            rows.append((len(rows) * 3 % 977, " ".join(w) + r.choice([""," ", "\n"]), 1))
    rows += [(5000 + k, t, 1) for k, t in enumerate([None, "", " ", "a", "A", "b c", "B  C"])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").cache()


def test_join_equals_sql(near):
    assert rows_of(jaccard.components(near)) == in_sql(jaccard.oracle(), documents=near)


def test_join_in_small_blocks_equals_sql(near, monkeypatch):
    """Lists and clusters are cut, and most links are only found where lists meet again."""
    monkeypatch.setattr(jaccard, "LIST_DOCS", 2)
    monkeypatch.setattr(jaccard, "FIRST", 1)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    assert rows_of(jaccard.components(near, 70, 2)) == in_sql(jaccard.oracle(70, 2), documents=near)


def test_join_of_odd_rows(docs, empty):
    got = jaccard.components(docs).collect()
    assert len(got) == docs.count() and {r.doc_id: r.component_id for r in got}[6] == 5
    assert jaccard.components(empty).count() == 0


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 100])
def test_sizes_and_prefixes_lose_no_link(percent):
    for s, t in itertools.product(range(1, 40), repeat=2):
        for both in range(1, min(s, t) + 1):
            if 100 * both >= percent * (s + t - both):
                assert t in jaccard.partners(s, percent) and both >= jaccard.need(s, t, percent)
                assert both + jaccard.prefix(s, percent) > s and both + jaccard.prefix(t, percent) > t  # prefixes meet


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in (3, 60, 500, 520, 3000, 3100, 9000)]
    sets += [np.unique(np.concatenate([s[: -max(1, len(s) // 25)], r.integers(0, 1 << 63, len(s) // 40 + 1).astype(np.uint64)])) for s in sets]
    maps = jaccard.Bitmaps([jaccard.parity(s) for s in sets])
    for i in range(len(sets)):
        for k, d in enumerate(maps.distance(i, np.arange(len(sets)))):
            assert d <= len(np.setxor1d(sets[i], sets[k]))
    assert maps.distance(0, np.array([6]))[0] > 100


def test_the_boundary_follows_the_cost():
    assert jaccard.boundary({}, 90) == 1 and jaccard.boundary({5: 100}, 90) > 5
    assert jaccard.boundary({60: 1000}, 90) <= 60  # subsets of 60 elements cost more than lists


# --- trie ------------------------------------------------------------------


def test_trie_equals_sql(spark, turns, sf):
    for df in (turns, spark.read.parquet(f"{sf}/conversations.parquet")):
        assert rows_of(trie.nodes(trie.rebuilt(trie.numbered(df)))) == in_sql(trie.oracle(), conversations=df)


@pytest.mark.parametrize("how", [{"band": 3, "shallow": 2}, {"shallow": 1, "group_turns": 1}, {"shallow": 1, "band": 50}])
def test_trie_in_bands_and_groups_equals_sql(turns, how):
    assert rows_of(trie.nodes(trie.rebuilt(trie.numbered(turns)), **how)) == in_sql(trie.oracle(), conversations=turns)


def test_trie_of_shared_beginnings(spark):
    rows = [(c, t, "user", f"t{t}" if t < 2 else f"c{c % 3}") for c in range(30) for t in range(3)]
    got = {(r.depth, r.conv_id): r for r in trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2)}
    root = got[0, 0]
    assert (root.n_convs, root.n_children, root.n_leaves, root.parent_conv_id, root.saved_tokens) == (30, 1, 3, None, 29 * 2 * 2 + 3 * 9 * 2)
    assert got[3, 1].ends_sha256 == hashlib.sha256(",".join(str(c) for c in range(1, 30, 3)).encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(none).count() == 0


# --- repair ----------------------------------------------------------------


def cheapest(symbols):
    """Costs and audits of all ways to edit a short conversation, by states, without matrices."""
    best = {0: (0, "")}

    def put(into, state, value):
        into[state] = min(into.get(state, value), value)

    def grown(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit) in list(out.items()):
                put(out, repair.TURN[s], (cost + 3, audit + "I"))
        return out

    for s in symbols:
        now = {}
        for state, (cost, audit) in grown(best).items():
            put(now, state, (cost + 4, audit + "D"))
            if s != "d":
                extra = 3 if s.isupper() else 0
                put(now, repair.TURN[state], (cost + 3 + extra, audit + "R"))
                if state in repair.STEPS[s.lower()]:
                    put(now, repair.STEPS[s.lower()][state], (cost + extra, audit + "K"))
        best = now
    ends = [(cost + 3 * len(repair.CLOSING[s]), audit + repair.CLOSING[s]) for s, (cost, audit) in best.items()]
    return min(ends)


def test_matrices_equal_a_plain_recursion():
    r = random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("suaxSUAXd") for _ in range(r.randrange(1, 14)))
        k = r.randrange(len(s) + 1)
        rules = [s[:2]] if len(s) > 2 else []
        known = repair.Rules(rules)
        m = known.of((chr(repair.FIRST_RULE) + s[2:]) if rules else s)
        assert (lambda c: (c[0], str(c[1])))(repair.closed(m)) == cheapest(s), s
        if 0 < k < len(s):  # products of any cut agree
            assert (lambda c: (c[0], str(c[1])))(repair.closed(repair.times(known.of(s[:k]), known.of(s[k:])))) == cheapest(s)


def test_ropes_compare_as_texts():
    r = random.Random(4)

    def rope(text):
        if len(text) < 2 or r.random() < 0.3:
            return repair.Rope(text)
        k = r.randrange(len(text))
        return repair.Rope(None, rope(text[:k]), rope(text[k:])) if k else rope(text)

    for _ in range(500):
        a, b = ("".join(r.choice("DK") for _ in range(r.randrange(1, 30))) for _ in range(2))
        b = r.choice([b, a, a + b, a[: len(a) // 2 + 1]])
        assert (rope(a) < rope(b)) == (a < b) and str(rope(a)) == a


def test_pairs_of_a_round_do_not_overlap():
    new = repair.chosen([("ua", 9), ("au", 8), ("us", 7), ("uu", 6), ("dd", 5), ("dx", 4), ("xx", 1)], 10)
    assert new == ["ua", "us", "dd"]


@pytest.mark.parametrize("how", [{}, {"block": 4}, {"rounds": 0}, {"block": 7, "rules": 3}])
def test_repair_equals_sql(turns, how):
    assert rows_of(repair.repaired(repair.damaged(turns), turns, **how)) == in_sql(repair.oracle(), conversations=turns)


def test_repair_of_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}." + " more." * (k % 40 * 30)) for k in range(5000)] + [(2, 0, "user", "Hi.")]
    got = {r.conv_id: r for r in repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].cost, set(got[1].audit), len(got[1].audit)) == (0, {"K"}, 5000) and (got[2].cost, got[2].audit) == (3, "KI")
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in rows[:-1]).encode()).hexdigest()


def test_damage_is_by_crc(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(8) for t in range(8)]
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        code = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, "A b c")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(code, [(role, text)])
        assert got.get((c, t)) == want
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(repair.damaged(empty), empty).count() == 0


def test_shingles_of_many_texts_equal_those_of_each(monkeypatch):
    import pyarrow as pa

    texts = [None, "", "  ", "One", "one", " a B ", "x y z", "x y z x y z\t\n", "é É ß" * 5, "w " * 50, "last one here to end", "y x z", "xy z", "x" * 200, "x" * 136, "x" * 64 + "y"]
    for together in (10, 40, 1 << 20):
        monkeypatch.setattr(jaccard, "TOGETHER", together)
        for width in (1, 2, 3, 5):
            seen: dict = {}
            for text, (words, s) in zip(texts, jaccard.shingled(pa.array(texts, pa.string()), width), strict=True):
                plain = neardup.normal(text or "")
                want = {tuple(plain[i : i + width]) for i in range(max(len(plain) - width + 1, min(len(plain), 1)))}
                assert len(words) == len(plain) and len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
                for w, h in zip(plain, words.tolist(), strict=True):
                    assert seen.setdefault(("word", w), h) == h
                if len(want) == 1:
                    assert seen.setdefault(want.pop(), s[0]) == s[0]
            assert len(set(seen.values())) == len(seen)
