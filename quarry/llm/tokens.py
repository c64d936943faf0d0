"""Token ids of whole texts, computed inside tasks with the ``tokenizers`` library.

The vocabulary used here never joins characters across ASCII white space, so a text's ids are the
ids of its white-space separated words put together, and a distinct word of some texts is coded once.
Any vocabulary with other rules of normalising and splitting is left to the library, text by text.
Machines are taken to be little-endian.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries of each of the two generations of a worker's memos, about 150 bytes each.
MEMO_WORDS = 100_000
#: Bytes of texts whose words are coded together.
TOGETHER = 3_000_000

# The normaliser and the splitting for which words may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Words of these characters alone (no apostrophe) fall into runs of letters, single digits and runs of marks,
#: as that splitting has it; composed Latin letters need no further normalisation than lower case.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|\n|[!-&(-/:-@\[-`{-~]+")
_ONLY_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9\n!-&(-/:-@\[-`{-~]+")
#: Stands for a line end among ids; no id has all bits set.
_STOP = b"\xff\xff\xff\xff"


def byte_letters() -> dict[int, str]:
    """The usual letter for each byte of byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo:
    """A bounded table with two generations: a full one becomes the old one, whose entries return when they are asked for."""

    def __init__(self, make: Callable[[list], Iterable], room: int = 0):
        self.now: dict = {}
        self._old: dict = {}
        self._make, self._room = make, room or MEMO_WORDS

    def all_of(self, keys: set) -> dict:
        """The table, once it holds all keys."""
        if len(self.now) > self._room:
            self._old, self.now = self.now, {}
        missing = keys.difference(self.now)
        known = missing.intersection(self._old)
        self.now.update(zip(known, map(self._old.__getitem__, known)))
        new = list(missing - known)
        self.now.update(zip(new, self._make(new)))
        return self.now


def word_codes(column: pa.Array, code: Callable[[pa.Array], list[bytes]], same: bytes = b"") -> Iterator[bytes]:
    """The codes of each text's words (parts between ASCII white space) one after the other, ``same`` after a word that equals the one before.

    Words of about ``TOGETHER`` bytes of texts are split and numbered by Arrow, so ``code`` sees each distinct one once.
    """
    column = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
        split = pc.ascii_split_whitespace(column.slice(at, stop - at))
        numbered = split.flatten().dictionary_encode()
        codes = code(numbered.dictionary)
        words, order = numbered.dictionary, numbered.indices.to_numpy()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        if same and len(order):
            empty = pc.index(words, "").as_py()  # around white space at the ends of a text
            again = np.flatnonzero((order[1:] == order[:-1]) & (order[1:] != empty)) + 1
            again = again[~np.isin(again, first)] + 1
            order, first = np.insert(order, again, len(codes)), first + np.searchsorted(again, first, side="right")
        # taking the coded words in the order of the texts lays their codes out in a row
        laid = pa.array([*codes, same], pa.binary()).take(pa.array(order, pa.int32()))
        _, ends, data = laid.buffers()
        ends = np.frombuffer(ends, "<i4", len(laid) + 1)
        for begin, end in itertools.pairwise(ends[first].tolist()):
            yield data[begin:end].to_pybytes() if end > begin else b""
        at = stop


class WordEncoder:
    """``text -> little-endian unsigned 32-bit ids``.

    Distinct words are coded once for some texts at a time: plain words part by part by the vocabulary's model
    (parts are kept in a bounded memo), all others by the whole encoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = byte_letters()
        self._parts = Memo(self._code_parts)
        rules = json.loads(self._tokenizer.to_str())
        self.by_words = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == SPLITTER and rules["post_processor"] is None
        del rules
        common.released()

    def _ids(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _code_parts(self, parts: list[str]) -> Iterator[bytes]:
        model, letters = self._model.tokenize, self._letters
        for some in itertools.batched(parts, 4096):  # so few of the model's token objects live at once
            coded = [() if part == "\n" else model(part if part.isascii() else "".join([letters[b] for b in part.encode()])) for part in some]
            data, at = array("I", [t.id for own in coded for t in own]).tobytes(), 0
            for part, own in zip(some, coded, strict=True):
                yield _STOP if part == "\n" else data[at : at + 4 * len(own)]
                at += 4 * len(own)

    def _code_plain(self, text: str) -> list[bytes]:
        """Codes of plain words, one a line: the ids of their parts in a row, cut at the code of the line ends between them."""
        parts = _PLAIN.findall(text.lower())
        return b"".join(map(self._parts.all_of(set(parts)).__getitem__, parts)).split(_STOP)

    def _code_words(self, words: pa.Array) -> list[bytes]:
        """Plain words are coded together, as one text that Arrow joins."""
        if not len(words):
            return []
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        if _ONLY_PLAIN.fullmatch(text) and "<|" not in text and "\n\n" not in text and text[0] != "\n" and text[-1] != "\n":
            return self._code_plain(text)
        listed = words.to_pylist()
        plain = [w for w in listed if _ONLY_PLAIN.fullmatch(w) and "<|" not in w]
        found = dict(zip(plain, self._code_plain("\n".join(plain)), strict=True)) if plain else {}
        return [found[w] if w in found else self._ids(w) for w in listed]

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """Ids of each text, nulls as empty ones."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_words:
            yield from map(self._ids, pc.fill_null(column, "").to_pylist())
            return
        yield from word_codes(column, self._code_words)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process and vocabulary file; its memo outlives the task."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_ids(batches: Iterable[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[tuple[int | None, bytes]]:
    """``(doc_id, ids)`` of Arrow batches with ``doc_id`` and ``text``; a null text is empty."""
    enc = encoder(path)
    end = b"" if end_id is None else struct.pack("<I", end_id)
    for batch in batches:
        for doc_id, coded in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
            yield doc_id, coded + end
        common.released()


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int | None = 1) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids`` (binary, 32-bit little-endian).

    Only documents of more than ``capacity`` ids are cut; a null or empty text gives the end id alone
    (no row if ``end_id`` is None).  Repeated rows give repeated pieces.  Other columns are ignored.
    """

    def cut_up(batches):
        rows: list[tuple] = []
        size = 0
        step = 4 * capacity

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

        for doc_id, ids in token_ids(batches, vocabulary, end_id):
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                rows.append((doc_id, k, at // 4, len(part) // 4, part))
                size += len(part)
                if size > 4_000_000:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids binary")


def with_digest(rows: DataFrame) -> DataFrame:
    """Replace the id array by its crc32 (unsigned, of the little-endian bytes)."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
