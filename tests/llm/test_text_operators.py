"""Chat windows, rules, WARC, mixing: odd cases and brute force."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, common, mixing, queries, rules, warc


def turns_of(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello " * 80)]
    rows += [(1, 3 + i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7 + 1)) for i in range(60)]
    rows += [(2, 0, "user", said), (2, 1, "assistant", said), (3, 0, None, None), (3, None, "assistant", ""), (None, 0, "assistant", "x"), (4, 5, "assistant", "same"), (4, 5, "assistant", "same"), (5, 0, "odd\nrole", "a#b<c\\d")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")


def test_windows_give_back_every_turn(spark):
    turns = turns_of(spark)
    made = chat.windows(turns, 100, 20, 20)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    convs = {}
    for r in turns.collect():
        convs.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    assert set(got) == set(convs)
    for conv, rows in convs.items():
        rows.sort()
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in rows).encode()).hexdigest()
        loss = "".join(text for _, _, role, text in rows if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(rows), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_system_and_budget(spark):
    made = chat.windows(turns_of(spark), 100, 20, 20).where("conv_id = 1").orderBy("window").collect()
    assert len(made) > 3
    for k, r in enumerate(made):
        parsed = chat.parse(r.formatted)
        assert parsed[0] == ("system", "be brief")
        assert r.over_budget == (r.cost > 100) and (not r.over_budget or len(parsed) - r.n_context == 1)
        assert k == 0 or r.n_context >= 1
    assert any(r.n_context > 1 for r in made)  # some history is repeated


def test_long_conversations_fill_their_windows(spark):
    """Windows take turns up to the furthest that fits, across the grid's stretches too."""
    rows = [(1, i, ("user", "assistant")[i % 2] if i else "system", f"turn {i} " * (i % 23 + 1)) for i in range(6000)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).orderBy("window").collect()
    costs = [r.cost for r in made]
    assert max(costs) <= 1024 and sum(costs) / len(costs) >= 0.9 * 1024
    seen = [text for r in made for _, text in chat.parse(r.formatted)[r.n_context :]]
    assert seen == [t for _, _, _, t in rows]
    assert all(chat.parse(r.formatted)[0] == ("system", "turn 0 ") and r.n_context >= 2 for r in made[1:])


@pytest.mark.parametrize("seed", range(4))
def test_fill_equals_a_plain_loop(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    cost = rng.integers(1, 60, 200)
    at = np.cumsum(cost) - cost + (0 if seed % 2 else 500)
    system, first = int(cost[0]) if at[0] == 0 else 11, 0 if at[0] == 0 else 3
    got, start = chat.fill(at, cost, first, system, 100, 30), first
    for f, s, e in got:
        alone = system if at[s] > 0 else 0
        past = []
        for i in range(s - 1, 0 if at[0] == 0 and alone else -1, -1):
            if sum(past) + cost[i] > min(30, 100 - alone - cost[s]):
                break
            past.append(cost[i])
        assert s == start and f == s - len(past) and e > s
        total = alone + sum(past) + cost[s:e].sum()
        assert (total <= 100 or e == s + 1) and (e == len(cost) or total + cost[e] > 100)
        start = e
    assert start == len(cost)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_chat_query_against_brute_force(spark, sf):
    convs = {}
    for r in queries.table(spark, f"/root/testdata/{sf}", "conversations").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    said = r"\### Assistant: </turn> ok"
    convs[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op1_chat_windows(spark, f"/root/testdata/{sf}").collect()}
    assert set(got) == set(convs)
    for conv, rows in convs.items():
        rows.sort()
        loss = "".join(text for _, role, text in rows if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in rows).encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_conversations(spark):
    assert chat.read_back(chat.windows(turns_of(spark).where("false"))).count() == 0


def test_rules_on_odd_documents(docs, empty):
    got = {r.doc_id: r for r in rules.filtered(docs).collect()}
    assert len(got) == docs.select("doc_id").distinct().count()
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[9].n_dup_lines == 2
    assert got[10].n_words == 30000 and got[10].n_repeat_words == 30000 and got[10].base_failed
    assert rules.filtered(docs).count() == docs.count()
    assert rules.filtered(empty).count() == 0


def test_buckets_are_fine_and_ordered(spark):
    rows = spark.range(0, 40000, 7).select("id", rules.bucket(F.col("id")).alias("b")).orderBy("id").collect()
    assert all(r.b <= r.id <= r.b * 65 / 64 + 1 for r in rows) and all(a.b <= b.b for a, b in zip(rows, rows[1:]))


def test_fences_are_the_groups_own(spark):
    """No fence is a constant: groups with other texts get other fences, also where most documents have none of a mark."""
    sf = "/root/testdata/sf0.01"
    counts = common.cut(rules.features(queries.table(spark, sf, "documents")).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")))
    rows = rules.fences(rules.sketches(counts)).collect()
    assert len(rows) > 60
    assert all(len({r[f"{name}_high"] for r in rows}) >= 3 for name in rules.RATIOS)
    assert len({r.word_length_low for r in rows}) > 10


def test_small_groups_lean_on_their_language(spark):
    text = lambda word, k: " ".join([f"{word}{i}" for i in range(k)])
    rows = [(i, text("abcd", 100 + i % 50), "en", "big") for i in range(400)] + [(500, text("abcdefghijkl", 100), "en", "tiny"), (501, text("abcd", 120), "en", "tiny")]
    got = {r.doc_id: r.kept for r in rules.filtered(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500] and got[501] and all(got[i] for i in range(400))


def test_sketches_merge(docs):
    counts = rules.features(docs).withColumn("base_failed", F.lit(False)).where("n_words > 0")
    whole = rules.sketches(counts)
    parts = rules.sketches(counts.where("doc_id % 2 = 0")).unionByName(rules.sketches(counts.where("doc_id % 2 <> 0 or doc_id is null")))
    key = ["lang", "source", "ratio", "bucket"]
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.groupBy(*key).agg(F.sum("n").alias("n")).collect()))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nWARC-Type: request", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (2, "http://b", "<p>x</p>"), (7, "u", "big " * 50000)]
    return spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int")


def test_archives_give_back_every_page(spark, pages):
    path = warc.new_path(spark)
    warc.write(pages, path, records_per_file=4)
    captures = common.cut(warc.transactions(warc.read(spark, path)))
    got = captures.collect()
    assert len(got) == pages.count()
    page = lambda block: int(bytes(block).decode().split("page-id: ")[1].split()[0])
    refers = {r.record_id: str(page(r.original.block)) for r in warc.originals(captures).collect()}
    seen = sorted((page(r.metadata.block), r.response.type, r.response.payload_bytes, r.response.payload_digest, refers.get(r.record_id)) for r in got)
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.response.payload) == html[page(r.metadata.block)] for r in got if r.response.type == "response")
    want = []
    first = {}
    for r in sorted(pages.collect(), key=lambda r: r.page_id):
        data = (r.html or "").encode()
        revisit = data in first
        want.append((r.page_id, "revisit" if revisit else "response", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), str(first[data]) if revisit else None))
        first.setdefault(data, r.page_id)
    assert seen == sorted(want)
    assert all(r.request is not None for r in got)


def test_missing_and_doubled_partners(spark):
    rows = [("response", "r1", None), ("request", "q1", "r1"), ("request", "q2", "r1"), ("metadata", "m1", "r1"), ("revisit", "r2", None), ("request", "q3", "gone"), ("response", None, None), ("response", "r1", None)]
    made = spark.createDataFrame(rows, "type string, record_id string, concurrent_to string")
    made = made.selectExpr("*", "'r1' refers_to", "'u' uri", "null digest", "cast('b' as binary) block", "cast('p' as binary) payload", "1L payload_bytes", "'d' payload_digest")
    got = {r.record_id: r for r in warc.transactions(made).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1"
    assert got["r2"].request is None and got["r2"].metadata is None
    assert [(r.record_id, r.original.record_id) for r in warc.originals(warc.transactions(made)).collect()] == [("r2", "m1")]


def test_small_payloads_are_not_revisits(spark, pages):
    path = warc.new_path(spark)
    warc.write(pages, path, min_revisit_bytes=1)
    kinds = warc.read(spark, path).where("type in ('response', 'revisit') and payload_bytes = 0").select("type").collect()
    assert [r.type for r in kinds] == ["response", "response"]


def test_parse_takes_member_after_member():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one)
    assert [b for _, b in warc.parse_archive(data)] == [b"abc", b"abc"]


def test_no_pages(spark, pages):
    path = warc.new_path(spark)
    warc.write(pages.where("false"), path)
    assert warc.transactions(warc.read(spark, path)).count() == 0


def test_targets_and_apportionment():
    assert mixing.targets([10, 10, 80], [5, 2, 1]) == pytest.approx([30, 30, 40])
    assert mixing.targets([0, 5], [5, 2]) == [0, 5]

    def brute(target, seats):
        got = [0] * len(target)
        for _ in range(seats):
            i = max(range(len(target)), key=lambda i: (target[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        return got

    for target, seats in (([53, 24, 23], 10), ([1, 1, 1], 2), ([100.5, 3, 0, 7.25], 37), ([5], 4)):
        assert mixing.sainte_lague(target, seats) == brute(target, seats)


def test_mix_is_near_its_targets(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}
    by = {}
    for r in rows:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)
        assert sum(r["size"] for r in own) == own[0].source_size


def test_mix_on_odd_documents(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken == 0 for r in got if not r.text)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_large_sources_end_in_one_bin(spark, monkeypatch):
    monkeypatch.setattr(mixing, "APART", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in rows)


def test_words_per_shard_follow_the_quotas(spark):
    docs = spark.range(6003).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(if(id < 3, 9000, 1 + id % 50) as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    rows = mixing.mix(docs).groupBy("source", "shard").agg(F.sum("taken").alias("taken"), F.max("source_size").alias("size")).where("shard is not null").collect()
    quotas = {p[0]: p[6] for p in mixing.plan(list({(r.source, r["size"]) for r in rows}))}
    got = {(r.source, r.shard): r.taken for r in rows}
    for s, quota in quotas.items():
        # a copied long document may fill more than one quota; the other shards share what is left of them
        free = [h for h in range(16) if got[s, h] < 9000]
        share = (sum(quota) - sum(got[s, h] for h in range(16) if h not in free)) / len(free)
        assert sum(quota) > 0 and all(abs(got[s, h] - share) <= 0.02 * share + 100 for h in free)


@pytest.mark.parametrize("n", [50, 5000])
def test_a_very_long_document_does_not_move_the_mix(spark, n):
    # the first document of each source holds a third of its words
    docs = spark.range(3 * n).select(
        F.col("id").alias("doc_id"), F.expr(f"repeat('w ', cast(if(id < 3, {n} * 5, 1 + (id div 3) % 19) as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")
    )
    for seed in range(3):
        rows = mixing.mix(docs, weights=(5.0, 2.5, 1.7), seed=seed).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert all(abs(r.taken - r.target) <= 0.001 * r.target + 5 for r in rows)


def test_blocks_follow_the_smallest_target():
    plan = mixing.plan([("large", 10**10), ("small", 30000)], weights=(1.0, 1.4e-6))
    assert plan[1][3] == pytest.approx(plan[1][2], rel=0.001)


def brute_mix(rows, weights=(5.0, 2.0, 1.0)):
    """Words wanted of each source, by plain loops over blocks of one word."""
    sizes = {}
    for source, words in rows:
        sizes[source] = sizes.get(source, 0) + words
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total, target, free = sum(sizes.values()), {s: 0.0 for s in sizes}, {s for s in names if sizes[s]}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left = total
    while free:
        scale = left / sum(weight[s] for s in free)
        over = {s for s in free if scale * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else scale * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    return sizes, target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_query_against_brute_force(spark, sf):
    rows = queries.op10_mixing(spark, f"/root/testdata/{sf}").collect()
    docs = {r.doc_id: (r.source, len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")])) for r in queries.table(spark, f"/root/testdata/{sf}", "documents").collect()}
    sizes, target = brute_mix(docs.values())
    assert len(rows) == len(docs)
    taken = {}
    for r in rows:
        source, size = docs[r.doc_id]
        assert (r["size"], r.source_size) == (size, sizes[source]) and r.target == pytest.approx(target[source]) and r.taken in (0, size, 2 * size, 3 * size)
        taken[source] = taken.get(source, 0) + r.taken
    longest = {}
    for source, size in docs.values():
        longest[source] = max(size, longest.get(source, 0))
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] + 5 or abs(taken[s] - target[s]) <= longest[s] / 2 for s in sizes)


def test_equal_rows_are_taken_one_by_one(spark):
    text = F.expr("repeat('w ', 100)")
    same = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), text.alias("text"), F.lit("b").alias("source"))
    other = spark.range(4000).select((F.col("id") + 10).alias("doc_id"), text.alias("text"), F.lit("a").alias("source"))
    docs = same.unionByName(other).withColumn("target", F.lit("mine"))
    rows = mixing.mix(docs, weights=(2.3, 0.7)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert {r.source for r in rows} == {"a", "b"} and all(abs(r.taken - r.target) <= 100 for r in rows)
    per_shard = mixing.mix(docs.repartition(9), weights=(2.3, 0.7)).where("source = 'b' and times > 0").groupBy("shard").agg(F.sum("taken").alias("taken")).collect()
    assert len(per_shard) == 16 and max(r.taken for r in per_shard) - min(r.taken for r in per_shard) <= 200


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit(777).alias("size"), F.lit("t").alias("target"), F.lit(-1).alias("shard"), F.lit(9).alias("_key"), F.lit("x").alias("_row"))
    got = mixing.mixed(docs).distinct().collect()
    assert mixing.mixed(docs).columns == docs.columns and len(got) == 300
    assert all((r["size"], r.target, r.shard, r._key, r._row) == (777, "t", -1, 9, "x") for r in got)


def test_junk_does_not_move_the_fences(spark):
    """A fifth of a group is junk: it is rejected, and the others stay."""
    import random

    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 7))) for _ in range(r.randrange(80, 160)))
    marked = lambda: text().replace(" ", " ### ")
    lines = lambda: "\n".join([text(), *["home about"] * 12])  # noqa: E731  repeated lines too short for repeated windows within them
    rows = [(i, text(), "en", "clean") for i in range(300)] + [(1000 + i, text(), "en", "mixed") for i in range(400)]
    rows += [(2000 + i, marked(), "en", "mixed") for i in range(50)] + [(3000 + i, lines(), "en", "mixed") for i in range(50)]
    got = {r.doc_id: r.kept for r in rules.filtered(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(v for k, v in got.items() if k >= 2000) and sum(v for k, v in got.items() if k < 2000) >= 0.98 * 700


def test_usual_marks_are_no_outliers(spark):
    """Where marks are usual the fence follows them: the same text is junk elsewhere."""
    import random

    r = random.Random(2)
    words = lambda i: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(100 + i % 7))
    code = lambda i: words(i) + " " + "# $ " * (10 + i % 8)
    rows = [(i, code(i), "en", "code") for i in range(600)] + [(1000 + i, words(i), "en", "prose") for i in range(600)] + [(5000, code(1), "en", "prose")]
    got = {r.doc_id: r for r in rules.filtered(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    fails = [k for k, r in got.items() if not r.kept and not r.base_failed]
    assert 5000 in fails and not any(k < 600 for k in fails)
