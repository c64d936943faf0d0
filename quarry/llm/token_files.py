"""Token-id files: concatenated id arrays with Elias-Fano coded document boundaries.

A file set is a folder of Parquet files.  Each row is a block of consecutive documents (in
ascending ``doc_id``) of at most ``BLOCK_IDS`` ids, or one longer document:

========== =====================================================================
shard      range partition of doc_id; blocks are ordered by (shard, block)
block      number within the shard, from 0
before     ids of the shard's earlier blocks
n_docs     documents in the block
n_ids      ids in the block
null_ids   number of leading documents whose id is null
first_id   smallest and largest document id of the block (null: none); Parquet keeps their
last_id    statistics, so a lookup reads only blocks that can hold the document
doc_ids    Elias-Fano code of the known document ids less ``first_id``
ends       Elias-Fano code of the n_docs end offsets
ids        the ids, 32-bit little-endian, one document after the other
========== =====================================================================

An Elias-Fano code of n non-decreasing numbers holds ``low_bits`` l, ``low`` (the low bits, l each,
little-endian bit order), ``high`` (unary coded high parts: bit (x >> l) + i is set for the i-th number)
and ``samples`` (position of every 64th set bit of ``high``, 32-bit little-endian).  The i-th number is
``(select1(high, i) - i) << l | low[i]``: readers select the few numbers they are at, and no table of
64-bit numbers is stored or built.
Parquet is the container because Spark's committer then makes a lost or repeated task harmless,
and any store that Spark reaches can hold the files.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK_IDS = 2_000_000
SAMPLE = 64
#: Documents whose ends a reader selects at once.
AHEAD = 1024
_CODE = "struct<low_bits:int,low:binary,high:binary,samples:binary>"
SCHEMA = f"shard int, block int, before long, n_docs int, n_ids long, null_ids int, first_id long, last_id long, doc_ids {_CODE}, ends {_CODE}, ids binary"


class EliasFano(NamedTuple):
    """Code of non-decreasing numbers from 0 to 2**64 - 1."""

    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = numbers.astype(np.uint64)
        n = len(numbers)
        top = int(numbers[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            bits[:, k] = (numbers >> np.uint64(k)) & np.uint64(1)
        places = (numbers >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """The numbers ``first ... first + count - 1``: only the stretch of ``high`` between two samples around them is looked at."""
        if count <= 0:
            return np.empty(0, np.uint64)
        samples = np.frombuffer(self.samples, "<u4")
        begin = int(samples[first // SAMPLE]) // 8
        beyond = (first + count - 1) // SAMPLE + 1
        stop = int(samples[beyond]) // 8 + 1 if beyond < len(samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, stop - begin, begin), bitorder="little")) + 8 * begin
        # set bits of the first byte that lie before the sample belong to earlier numbers
        skip = int(np.searchsorted(ones, samples[first // SAMPLE])) + first % SAMPLE
        high = (ones[skip : skip + count] - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low_bits)
        at = first * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[at // 8 : (at + count * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: count * self.low_bits]
        for k in range(self.low_bits):
            high |= bits[k :: self.low_bits].astype(np.uint64) << np.uint64(k)
        return high

    def find(self, number: int, n: int) -> int:
        """How many of the n numbers are smaller, by halving: about log2(n) selects."""
        low, high = 0, n
        while low < high:
            mid = (low + high) // 2
            if int(self.select(mid)[0]) < number:
                low = mid + 1
            else:
                high = mid
        return low


def write(docs: DataFrame, path: str, vocabulary: str, shards: int | None = None, end_id: int | None = 1) -> None:
    """Encode every whole text and write the file set.

    Documents are dealt by ranges of ``doc_id`` (then text hash and row, so that a hot id does not end in one
    task) and sorted inside a range; a hot source or a very long text has no effect on the deal.  There are
    at least as many ranges as input splits.  Null ids come first; rows with equal ids stay adjacent; a null
    text is empty.  An empty table gives an empty file set; further columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(shards, *order, F.col("_row")).sortWithinPartitions(*order).select("doc_id", "text")

    kind = pa.struct([("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
    fields = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("null_ids", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", kind), ("ends", kind), ("ids", pa.binary())])

    def blocks(batches):
        from pyspark import TaskContext

        shard, block, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def out():
            known = [n for n in names if n is not None]
            first, last = (known[0], known[-1]) if known else (None, None)
            code = lambda numbers: EliasFano.of(numbers)._asdict()
            ids_less = np.array(known, np.int64).view(np.uint64) - np.array(first or 0, np.int64).view(np.uint64)
            row = [shard, block, before, len(names), size, len(names) - len(known), first, last, code(ids_less), code(np.cumsum([len(p) // 4 for p in parts])), b"".join(parts)]
            return pa.RecordBatch.from_pylist([dict(zip(fields.names, row, strict=True))], fields)

        for doc_id, ids in tokens.token_ids(batches, vocabulary, end_id):
            if names and size + len(ids) // 4 > BLOCK_IDS:
                yield out()
                before += size
                names, parts, size, block = [], [], 0, block + 1
            names.append(doc_id)
            parts.append(ids)
            size += len(ids) // 4
        if names:
            yield out()

    with common.small_batches(spark):
        dealt.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


def _bases(rows: DataFrame) -> dict[int, int]:
    """Ids before each shard (a row for each shard goes to the driver: as many as the writer had tasks)."""
    base, total = {}, 0
    for r in rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        base[r.shard] = total
        total += r.n
    return base


def _documents(r: dict, base: dict[int, int], first: int, stop: int) -> pa.RecordBatch:
    """Documents ``first ... stop - 1`` of a block, through select."""
    ends = EliasFano(**r["ends"]).select(max(first - 1, 0), stop - max(first - 1, 0)).astype(np.int64)
    begins, ends = (ends[:-1], ends[1:]) if first else (np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
    nulls = max(0, min(r["null_ids"], stop) - first)
    known = EliasFano(**r["doc_ids"]).select(first + nulls - r["null_ids"], stop - first - nulls)
    names = (known + np.array(r["first_id"] or 0, np.int64).view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None] * nulls + names.tolist(), pa.int64()),
            pa.array(begins + (r["before"] + base[r["shard"]])),
            pa.array([r["ids"][4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
        ],
        names=["doc_id", "start", "ids"],
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a file set: ``doc_id, start`` (ids of all documents before it), ``ids`` (binary).

    Null and repeated ids come back as they were written; an empty file set gives no rows.  A task holds one
    block and the boundaries of ``AHEAD`` documents.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    base = _bases(rows)

    def documents(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                for at in range(0, r["n_docs"], AHEAD):
                    yield _documents(r, base, at, min(at + AHEAD, r["n_docs"]))

    return rows.mapInArrow(documents, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of a given list of ids, as ``read`` gives them.

    Only blocks whose id range meets the list are read; in them each id is found by halving over the coded
    ids, and its offsets by select.  Ids that are not there give no row, repeated ones all their rows.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    base, wanted = _bases(rows), sorted(set(doc_ids))
    near = rows.where(F.exists(F.array(*(F.lit(i).cast("long") for i in wanted)), lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id")))) if wanted else rows.where("false")
    if wanted:  # reaches the scan
        near = near.where(F.col("first_id").isNotNull() & (F.col("last_id") >= wanted[0]) & (F.col("first_id") <= wanted[-1]))

    def found(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                code, n = EliasFano(**r["doc_ids"]), r["n_docs"] - r["null_ids"]
                for i in wanted:
                    if r["first_id"] <= i <= r["last_id"]:
                        a, b = (code.find(i - r["first_id"] + more, n) for more in (0, 1))
                        if a < b:
                            yield _documents(r, base, r["null_ids"] + a, r["null_ids"] + b)

    return near.mapInArrow(found, "doc_id long, start long, ids binary")


def new_path(spark: SparkSession) -> str:
    return f"{common.work_dir(spark)}/quarry-token-files-{uuid.uuid4().hex}"
