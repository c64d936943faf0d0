"""Text to chunks: recursive split, sentence split, merging of short neighbours, section paths, row slices."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Boundaries of the recursive split, strongest first: heading, code fence, table row, paragraph, line, word.
#: Separators of the recursive split in their order, and the ends of sentences.
BOUNDARIES = (r"(?=\n#{1,6} )", r"(?=\n```\n)", r"(?=\n\|)", r"(?=\n\n)", r"(?=\n)", r"(?= )")
_ENDS = "。？！.\n"


def recursive(s: str, size: int, level: int = 0) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the strongest boundary that helps; they join to the text."""
    if len(s) <= size:
        return [s] if s else []
    if level == len(BOUNDARIES):
        return [s[i : i + size] for i in range(0, len(s), size)]
    out: list[str] = []
    for part in re.split(BOUNDARIES[level], s):
        if out and len(out[-1]) + len(part) <= size:
            out[-1] += part
        elif len(part) <= size:
            out.append(part)
        else:
            out += recursive(part, size, level + 1)
    return [p for p in out if p]


def split(s: str, size: int = 1000, overlap: int = 100, most: int = 1200, least: int = 200) -> list[str]:
    """Chunks of a text: pieces with an overlap at word starts, a hard cap at sentence ends, short neighbours merged.

    Nothing is dropped: a piece over the cap is cut again.  Blank texts give none.
    """
    if not s or not s.strip():
        return []
    pieces = recursive(s, size)
    chunks = []
    for i, piece in enumerate(pieces):
        tail = pieces[i - 1][-overlap:] if i and overlap else ""
        tail = tail[tail.find(" ") + 1 :] if " " in tail else tail
        chunks.append(tail + piece)
    capped: list[str] = []
    for c in chunks:
        while len(c) > most:
            cut = max(c.rfind(e, 0, most) for e in _ENDS) + 1
            cut = cut if cut > most // 2 else most
            capped.append(c[:cut])
            c = c[cut:]
        capped.append(c)
    return merge_short([c for c in capped if c.strip()], least, most)


def merge_short(chunks: list[str], least: int = 200, most: int = 1200) -> list[str]:
    """Join a chunk below ``least`` with those after it while the sum stays within ``most``."""
    out: list[str] = []
    open_ = False
    for c in chunks:
        if open_ and len(out[-1]) + 1 + len(c) <= most:
            out[-1] += "\n" + c
        else:
            out.append(c)
        open_ = len(out[-1]) < least
    return out


def sentence_split(s: str, most: int) -> list[str]:
    """Sentences packed up to ``most`` characters; longer ones are cut."""
    out: list[str] = []
    for sentence in re.findall(r"[^。！？.!?\n]*[。！？.!?\n]+|[^。！？.!?\n]+$", s):
        while len(sentence) > most:
            out.append(sentence[:most])
            sentence = sentence[most:]
        if out and len(out[-1]) + len(sentence) <= most:
            out[-1] += sentence
        elif sentence:
            out.append(sentence)
    return out


def paragraph_packs(s: Column, most: int = 2000) -> Column:
    """Paragraphs (parted by an empty line) put together while they stay within ``most`` characters; blank packs are left out.

    A text within the limit stays as it is.  One fold on the JVM; a paragraph is never cut.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    kept = lambda done, c: F.when(trim(c) != "", F.concat(done, F.array(trim(c)))).otherwise(done)
    state = lambda now, done: F.struct(now.alias("now"), done.alias("done"))
    step = lambda a, p: F.when(F.length(a["now"]) + F.length(p) > most, state(p, kept(a["done"], a["now"]))).otherwise(state(F.concat(a["now"], F.lit("\n\n"), p), a["done"]))
    folded = F.aggregate(F.split(s, "\n\n"), state(F.lit(""), F.array().cast("array<string>")), step, lambda a: kept(a["done"], a["now"]))
    return F.when(F.length(s) > most, folded).otherwise(F.filter(F.array(s), lambda c: trim(c) != ""))


#: Characters of the rows that a task holds before it passes them on.
HELD = 2_000_000


def packed(rows: Iterable[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows with a text at their end as Arrow batches of about ``HELD`` characters, however many rows came in together."""
    schema = pa.schema(fields)
    held: list[tuple] = []
    size = 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > HELD:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def chunk_table(docs: DataFrame, how=split, **options) -> DataFrame:
    """``doc_id, chunk_index, content`` of every text; a task turns one text at a time into Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d.as_py(), i, c) for b in batches for d, t in zip(b.column(0), b.column(1), strict=True) for i, c in enumerate(how(t.as_py() or "", **options)))
        return packed(rows, [("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string())])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index int, content string")


def merged_text(s: str, least: int = 200, most: int = 1200) -> list[str]:
    """The lines of a text that are not blank, short neighbours merged."""
    return merge_short([line for line in s.split("\n") if line.strip(" ")], least, most)


def merged_lines(docs: DataFrame, least: int = 200, most: int = 1200) -> DataFrame:
    """``doc_id, chunk_index, content`` of ``doc_id, text``: an ordered fold inside each row, so nothing is shuffled."""
    return chunk_table(docs, merged_text, least=least, most=most)


def merge_headings(items: Iterable[tuple[str, int, str | None]], short: int = 80, most: int = 800, cap: int = 1200) -> list[tuple[str, str]]:
    """``(kind, content)`` of items ``(kind, level, content)`` in order: headings open a chunk, short bodies join it up to ``most``,
    tables and pictures stand alone, empty items go, long chunks are split."""
    rows: list[tuple[str, str]] = []
    buffer = ""

    def close() -> None:
        nonlocal buffer
        if buffer.strip():
            rows.extend(("text", p) for p in (sentence_split(buffer, cap) if len(buffer) > cap else [buffer]))
        buffer = ""

    for kind, level, content in items:
        content = (content or "").strip()
        if not content:
            continue
        if kind != "text":
            close()
            rows.append((kind, content))
        elif level > 0 or not buffer or len(buffer) + 1 + len(content) > most or (len(content) >= short and len(buffer) >= short):
            if not (level > 0 and buffer and len(buffer) < short and len(buffer) + 1 + len(content) <= most):
                close()
            buffer = f"{buffer}\n{content}" if buffer else content
        else:
            buffer += "\n" + content
    close()
    return rows


_MERGED = "doc_id long, chunk_index int, chunk_type string, content string"


def heading_merge(items: DataFrame, **how) -> DataFrame:
    """``merge_headings`` of rows ``doc_id, pos, chunk_type, text_level, content``, gathered by document."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = merge_headings(zip(pdf["chunk_type"], pdf["text_level"], pdf["content"], strict=True), **how)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "chunk_index": range(len(rows)), "chunk_type": [r[0] for r in rows], "content": [r[1] for r in rows]})

    return items.groupBy("doc_id").applyInPandas(fold, _MERGED)


def heading_merge_in_row(docs: DataFrame, **how) -> DataFrame:
    """The same for ``doc_id, items`` with the items ``chunk_type, text_level, content`` of a document in one row: nothing is shuffled.

    A task turns the items of one document at a time into Python objects.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for d, items in zip(b.column("doc_id"), b.column("items"), strict=True):
                own = items.values
                columns = (own.field(c).to_pylist() for c in ("chunk_type", "text_level", "content")) if own is not None else ([], [], [])
                for i, row in enumerate(merge_headings(zip(*columns, strict=True), **how)):
                    yield d.as_py(), i, *row

    fields = [("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("chunk_type", pa.string()), ("content", pa.string())]
    return docs.select("doc_id", "items").mapInArrow(lambda batches: packed(merged(batches), fields), _MERGED)


def section_paths(items: DataFrame) -> DataFrame:
    """Add ``section_path`` to ``doc_id, pos, line, level``: open headings of level 1 to 3 joined by ' > '.

    A level's heading is open while no higher one came after it.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = {n: F.last(F.when(F.col("level") == n, F.struct("pos", F.trim("line").alias("title"))), ignorenulls=True).over(w) for n in (1, 2, 3)}
    rows = items.select("*", *(at[n].alias(f"_h{n}") for n in at))
    pos = lambda n: F.coalesce(F.col(f"_h{n}.pos"), F.lit(-1))
    open_ = {1: F.col("_h1.title"), 2: F.when(pos(2) > pos(1), F.col("_h2.title")), 3: F.when((pos(3) > pos(2)) & (pos(3) > pos(1)), F.col("_h3.title"))}
    return rows.withColumn("section_path", F.concat_ws(" > ", *open_.values())).drop("_h1", "_h2", "_h3")


def row_slices(rows: DataFrame, size: int = 200) -> DataFrame:
    """Pipe text of every ``size`` rows of ``sheet, row_no, cells`` (row 1 is the header, repeated in each slice)."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    lines = rows.select("sheet", "row_no", line.alias("line"))
    head = lines.where("row_no = 1").select("sheet", F.col("line").alias("head"))
    body = lines.where("row_no > 1").withColumn("slice", F.floor((F.col("row_no") - 2) / size).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"])
    cut = body.groupBy("sheet", "slice").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.array_join(parts, "\n").alias("body"))
    return cut.join(F.broadcast(head), "sheet").select("sheet", "slice", "first_row", "last_row", F.concat_ws("\n", "head", "body").alias("content"))


def levels(lines: DataFrame) -> DataFrame:
    return lines.withColumn("level", tx.heading_level(F.col("line")))
