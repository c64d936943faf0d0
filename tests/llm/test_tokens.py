"""Token pieces, packing and token files against the library itself."""

import array
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, queries, token_files, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_encode_as_whole_texts(texts):
    own = tokens.encoder(queries.vocabulary())
    want = [array.array("I", e.ids).tobytes() for e in own._tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(own.encode(texts)) == want


def test_pieces_join_to_the_document(docs, tokenizer):
    got = {}
    for r in tokens.pieces(docs.dropDuplicates(), queries.vocabulary(), 100).orderBy("doc_id", "piece").collect():
        assert r.start == 100 * r.piece and len(r.ids) == 4 * r.length <= 400
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    want = {r.doc_id: ids_of(tokenizer, r.text) for r in docs.dropDuplicates().collect()}
    assert got == want


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=100, deadline=None)
def test_plan_packs_every_piece_once(lengths):
    hist = {n: lengths.count(n) for n in set(lengths)}
    rows, sequences = packing.plan(hist, 64, groups=5)
    placed, used = {n: 0 for n in hist}, [[] for _ in range(sequences)]
    for n, first, count, sequence, per, offset in sorted(rows):
        assert first == placed[n]
        placed[n] += count
        for j in range(count):
            used[sequence + j // per].append((offset + j % per * n, n))
    assert placed == hist
    for inside in used:
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert 0 < at <= 64
    firstfit: list[int] = []
    for n in sorted(lengths, reverse=True):
        for i, u in enumerate(firstfit):
            if u + n <= 64:
                firstfit[i] += n
                break
        else:
            firstfit.append(n)
    assert sequences <= len(firstfit) * 1.25 + 1


def least_bins(lengths, capacity):
    """Fewest bins, by trying every way."""
    best = len(lengths)

    def put(at, room):
        nonlocal best
        if len(room) >= best:
            return
        if at == len(lengths):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= lengths[at] and room[k] not in room[:k]:
                put(at + 1, [*room[:k], room[k] - lengths[at], *room[k + 1 :]])
        put(at + 1, [*room, capacity - lengths[at]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


@given(st.lists(st.integers(5, 30), min_size=1, max_size=9))
@settings(max_examples=80, deadline=None)
def test_small_plans_are_close_to_the_fewest_bins(lengths):
    assert packing.plan({n: lengths.count(n) for n in set(lengths)}, 40)[1] <= least_bins(lengths, 40) + 1


def test_optimised_configurations_fill_bins():
    # three sizes that fit exactly in two ways only; the fullest-first rule alone needs more bins
    got = packing.optimised([2000, 1096, 1048], [300, 200, 100], 4096)
    assert sum(t * sum(c for _, c in config) for t, config in got) >= 580
    lengths = np.random.default_rng(1).integers(1, 4097, 20000).tolist()
    hist = {n: lengths.count(n) for n in set(lengths)}
    assert packing.plan(hist, 4096)[1] <= 1.05 * sum(lengths) / 4096


def test_query_packs_every_piece_of_the_table(spark, tokenizer):
    """op3 against a plain loop: pieces, digests, gapless places, and no more than 1 % over the least possible count."""
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in queries.table(spark, sf, "documents").collect():
        ids = np.array(ids_of(tokenizer, r.text), "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = queries.op3_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1.01 * -(-sum(ends.values()) // 4096) + 1


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    import json

    rules = json.load(open(queries.vocabulary()))
    rules["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(rules))
    text = "Some CAPITAL words, \n and lines"
    own = tokens.WordEncoder(str(other))
    assert not own.by_words and list(own.encode([text])) == [array.array("I", Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids).tobytes()]


def test_memos_keep_their_bound(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    monkeypatch.setattr(tokens, "TOGETHER", 200)
    own = tokens.WordEncoder(queries.vocabulary())
    texts = [" ".join(f"word{(i * k) % 90}, don't" for k in range(9)) for i in range(60)]
    want = [array.array("I", e.ids).tobytes() for e in own._tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(own.encode(texts)) == want and len(own._parts.now) < 150


def test_pack_is_gapless(docs, empty):
    packed = packing.pack(tokens.pieces(docs, queries.vocabulary(), 256), 256)
    rows = packed.orderBy("sequence_id", "offset").collect()
    assert len(rows) == tokens.pieces(docs, queries.vocabulary(), 256).count()
    ends = {}
    for r in rows:
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    assert {len(r.ids) // 4 for r in packing.sequences(packed).collect()} == set(ends.values())
    assert packing.pack(tokens.pieces(empty, queries.vocabulary())).count() == 0


def test_pack_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, 5, 9, 9), (1, 0, 5, 9, 9), (2, 0, None, 9, 9)], "doc_id long, piece int, length long, sequence_id long, offset long")
    got = packing.pack(df, 8).orderBy("doc_id", "sequence_id").collect()
    assert [(r.sequence_id, r.offset) for r in got] == [(0, 0), (1, 0), (None, None)]


def test_too_long_a_piece_is_an_error(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8).count()


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(lengths):
    ends = np.cumsum(lengths)
    code = token_files.EliasFano.of(ends)
    assert code.select(0, len(ends)).tolist() == ends.tolist()
    assert [int(code.select(i)[0]) for i in range(len(ends))] == ends.tolist()
    assert all(code.select(a, 70).tolist() == ends[a : a + 70].tolist() for a in range(0, len(ends) - 70, 31))
    for x in (0, int(ends[0]), int(ends[-1]), int(ends[-1]) + 1):
        assert code.find(x, len(ends)) == int(np.searchsorted(ends, x))


def test_elias_fano_codes_wide_numbers_in_little_space():
    wide = np.sort(np.random.default_rng(1).integers(0, 2**64 - 1, 5000, np.uint64))
    assert token_files.EliasFano.of(wide).select(0, 5000).tolist() == wide.tolist()
    close = np.cumsum(np.random.default_rng(2).integers(1, 20, 20000))
    code = token_files.EliasFano.of(close)
    assert len(code.low) + len(code.high) + len(code.samples) < 20000 * 8 / 8


def test_files_hold_every_document_in_order(spark, docs, empty, tokenizer):
    path = token_files.new_path(spark)
    token_files.write(docs, path, queries.vocabulary(), shards=3)
    got = token_files.read(spark, path).orderBy("start").collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in want]
    at = 0
    for r, (_, _, text) in zip(got, want, strict=True):
        ids = np.array(ids_of(tokenizer, text), "<u4").tobytes()
        assert r.start == at and zlib.crc32(r.ids) == zlib.crc32(ids)
        at += len(ids) // 4
    every = {i for known, i, _ in want if known}
    asked = token_files.lookup(spark, path, [*every, 77]).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in asked) == sorted((r.doc_id, r.start, r.ids) for r in got if r.doc_id is not None)
    assert [r.doc_id for r in token_files.lookup(spark, path, [5]).collect()] == [5, 5] and token_files.lookup(spark, path, []).count() == 0
    none = token_files.new_path(spark)
    token_files.write(empty, none, queries.vocabulary(), shards=2)
    assert token_files.read(spark, none).count() == 0


def test_texts_reach_python_in_small_batches(spark):
    """Whole texts come in bounded batches (before, 10,000 rows at once), and the session's own setting is back afterwards."""
    from quarry.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 9000, 1, 1).selectExpr("id doc_id", "concat('text ', id) text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0] * batch.num_rows), pa.array([batch.num_rows] * batch.num_rows), pa.array([1] * batch.num_rows)], names=["doc_id", "piece", "length"])

    packed = packing.pack(docs.mapInArrow(sizes, "doc_id long, piece long, length long"))
    assert packed.agg({"piece": "max"}).first()[0] <= common.TEXT_ROWS and packed.count() == 9000
    assert spark.conf.get(name) == before


def test_words_are_coded_from_arrow(spark):
    """Plain and other words, an empty one and repeated ones: each the ids that the library gives."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    own, library = tokens.WordEncoder(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    want = lambda w: array.array("I", library.encode(w, add_special_tokens=False).ids).tobytes()
    for words in (["plain", "Words,", "x1y22", "caf\u00e9"], ["plain", "", "it's", "\u4f60\u597d"], [""], []):
        assert own._code_words(pa.array(words, pa.string())) == [want(w) for w in words]
