"""Chunk structure: sections, neighbours, slices, images and outlines, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, search
from .fixtures import view
from .registry import n_rows, query


@query("l1_recursive_chunks")
def recursive_chunks(spark, sf_dir):
    return chunking.chunk_table(view(spark, sf_dir, "documents"))


@query("l2_sentence_chunks")
def sentence_chunks(spark, sf_dir):
    return chunking.chunk_table(view(spark, sf_dir, "documents"), chunking.sentence_split, most=500)


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("l3_paragraph_packs", f"""
with p as (select doc_id, text, list_prepend({{'cur': '', 'packs': []::varchar[]}}, list_transform(string_split(text, chr(10) || chr(10)), lambda x: {{'cur': x, 'packs': []::varchar[]}})) ps from documents),
f as (select doc_id, text, list_reduce(ps, lambda a, x: case when length(a.cur) + length(x.cur) > 500
  then {{'cur': x.cur, 'packs': case when {_TRIM.format("a.cur")} <> '' then list_append(a.packs, {_TRIM.format("a.cur")}) else a.packs end}}
  else {{'cur': a.cur || chr(10) || chr(10) || x.cur, 'packs': a.packs}} end) f from p),
l as (select doc_id, case when length(text) <= 500 then [text] else list_append(f.packs, {_TRIM.format("f.cur")}) end packs from f)
select doc_id, unnest(range(len(packs)))::int pack, unnest(packs) content from (select doc_id, list_filter(packs, lambda x: {_TRIM.format("x")} <> '') packs from l)""")
def paragraph_packs(spark, sf_dir):
    """Paragraphs put together up to 500 characters; a longer one is a pack of its own."""
    d = view(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.paragraph_packs(F.col("text"), 500)).alias("pack", "content"))


@query("e18_merged_lines")
def merged_lines(spark, sf_dir):
    return chunking.merged_lines(view(spark, sf_dir, "documents"))


@query("e19_heading_merge")
def heading_merge(spark, sf_dir):
    kind = lambda i: F.when(i % 10 == 8, "table").otherwise("text")
    item = lambda line, i: F.struct(kind(i).alias("chunk_type"), text.heading_level(line).alias("text_level"), line.alias("content"))
    items = F.filter(F.transform(F.split("text", "\n"), item), lambda x: F.trim(x["content"]) != "")
    return chunking.heading_merge_in_row(view(spark, sf_dir, "documents").where("text is not null").select("doc_id", items.alias("items")))


@query("e2_section_numbers", "select chunk_id, cast(row_number() over (partition by source, section order by case chunk_type when 'text' then 0 when 'table' then 1 else 2 end, chunk_index, chunk_id) as int) section_chunk_id from chunks")
def section_numbers(spark, sf_dir):
    kind = F.when(F.col("chunk_type") == "text", 0).when(F.col("chunk_type") == "table", 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("source", "section").orderBy(kind, "chunk_index", "chunk_id"))
    return view(spark, sf_dir, "chunks").select("chunk_id", n.alias("section_chunk_id"))


_LEVELS = "lv as (select doc_id, pos, line, case when length(line) < 40 then 1 when length(line) < 80 then 2 when length(line) < 120 then 3 else 0 end level from doc_lines)"


def _levelled(spark, sf_dir):
    n = F.length("line")
    return view(spark, sf_dir, "doc_lines").withColumn("level", F.when(n < 40, 1).when(n < 80, 2).when(n < 120, 3).otherwise(0))


@query("e3_section_paths", f"""
with {_LEVELS}, h as (select *, max(case when level = 1 then pos end) over w p1, max(case when level = 2 then pos end) over w p2, max(case when level = 3 then pos end) over w p3 from lv window w as (partition by doc_id order by pos rows unbounded preceding))
select h.doc_id, h.pos, concat_ws(' > ', trim(a.line), case when h.p2 > coalesce(h.p1, -1) then trim(b.line) end, case when h.p3 > coalesce(h.p1, -1) and h.p3 > coalesce(h.p2, -1) then trim(c.line) end) section_path
from h left join lv a on a.doc_id = h.doc_id and a.pos = h.p1 left join lv b on b.doc_id = h.doc_id and b.pos = h.p2 left join lv c on c.doc_id = h.doc_id and c.pos = h.p3""")
def section_paths(spark, sf_dir):
    """Line lengths stand in for levels here, so that the invented prose has headings."""
    return chunking.section_paths(_levelled(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "section_path")


@query("l5_outline", f"with {_LEVELS} select doc_id, string_agg(concat(repeat('#', level + 1), ' ', trim(line)), chr(10) order by pos) outline from lv where level > 0 group by doc_id")
def outline(spark, sf_dir):
    line = F.concat(F.expr("repeat('#', level + 1)"), F.lit(" "), F.trim("line"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda r: r["l"])
    return _levelled(spark, sf_dir).where("level > 0").groupBy("doc_id").agg(F.array_join(rows, "\n").alias("outline"))


# the table of rules HEADINGS in its order; white space and line ends as Spark's patterns have them
@query("h19_heading_levels", r"""
select doc_id, pos, cast(case when regexp_matches(t, '^第[一二三四五六七八九十百千万]+[章节篇部]') then 1 when regexp_matches(t, '^第[一二三四五六七八九十百千万]+[条款]') then 2
  when regexp_matches(t, '^\d+[.、\s\x0B]') and n < 50 then 1 when regexp_matches(t, '^\d+\.\d+[.、\s\x0B]') and n < 80 then 2 when regexp_matches(t, '^\d+\.\d+\.\d+[.、\s\x0B]') and n < 100 then 3
  when regexp_matches(t, '^([Cc][Hh][Aa][Pp][Tt][Ee][Rr]|[Ss][Ee][Cc][Tt][Ii][Oo][Nn]|[Pp][Aa][Rr][Tt])') then 1
  when regexp_matches(t, '^\*\*[^\r\n\x{85}\x{2028}\x{2029}]+\*\*[\r\x{85}\x{2028}\x{2029}]?$') and n < 50 then 2 when regexp_matches(t, '[一-鿿]') and n < 20 then 2 else 0 end as int) "level"
from (select doc_id, pos, trim(line, ' ') t, length(trim(line, ' ')) n from (select doc_id, unnest(range(len(l))) pos, unnest(l) line from (select doc_id, string_split(text, chr(10)) l from documents)) where trim(line, ' ') <> '')""")
def heading_levels(spark, sf_dir):
    return view(spark, sf_dir, "doc_lines").select("doc_id", F.col("pos").cast("long").alias("pos"), text.heading_level(F.col("line")).alias("level"))


@query("e20_row_slices", """
with b as (select sheet, row_no, concat('| ', array_to_string(list_transform(cells, lambda c: replace(c, '|', '\\|')), ' | '), ' |') line from table_rows),
s as (select sheet, cast((row_no - 2) // 200 as int) slice, min(row_no) first_row, max(row_no) last_row, string_agg(line, chr(10) order by row_no) body from b where row_no > 1 group by all)
select s.sheet, slice, first_row, last_row, concat(h.line, chr(10), body) content from s join b h on h.sheet = s.sheet and h.row_no = 1""")
def row_slices(spark, sf_dir):
    r = chunking.row_slices(view(spark, sf_dir, "table_rows"))
    return r.withColumn("first_row", F.col("first_row").cast("long")).withColumn("last_row", F.col("last_row").cast("long"))


@query("e21_header_row", "with s as (select sheet, row_no, list_sum(list_transform(cells, lambda c: case when regexp_matches(c, '^-?[0-9.]+$') then -3 else 0 end + case when length(c) <= 10 then 1 else 0 end)) score from table_rows where row_no <= 5) select sheet, arg_max(row_no, score * 100 - row_no) header_row from s group by sheet")
def header_row(spark, sf_dir):
    """Best of the first five rows: short cells count, numbers count against; the first wins ties."""
    one = F.aggregate("cells", F.lit(0), lambda a, c: a + F.when(c.rlike("^-?[0-9.]+$"), -3).otherwise(0) + F.when(F.length(c) <= 10, 1).otherwise(0))
    return view(spark, sf_dir, "table_rows").where("row_no <= 5").groupBy("sheet").agg(F.max_by("row_no", one * 100 - F.col("row_no")).cast("long").alias("header_row"))


@query("d36_table_metadata", "select sheet, count(*) - 1 n_rows, max(len(cells)) n_columns from table_rows group by sheet")
def table_metadata(spark, sf_dir):
    return view(spark, sf_dir, "table_rows").groupBy("sheet").agg((n_rows() - 1).alias("n_rows"), F.max(F.size("cells")).cast("long").alias("n_columns"))


@query("b14_image_noise", "select chunk_id from (select *, row_number() over (partition by source, hash order by chunk_id) d from images where width between 100 and 2000 and height between 100 and 2000 and greatest(width, height) <= 10 * least(width, height)) where d = 1")
def image_noise(spark, sf_dir):
    i = view(spark, sf_dir, "images").where("width between 100 and 2000 and height between 100 and 2000 and greatest(width, height) <= 10 * least(width, height)")
    return search.topk(i, ["source", "hash"], [F.col("chunk_id")], 1, "d").select("chunk_id")


@query("c9_page_images", "select chunk_id, list(image_id order by r) images from (select c.chunk_id, i.image_id, row_number() over (partition by c.chunk_id order by i.chunk_id) r from chunks c join images i on i.source = c.source and i.page = c.page where c.chunk_type = 'text' and c.page = c.page_end) where r <= 3 group by chunk_id")
def page_images(spark, sf_dir):
    i = view(spark, sf_dir, "images").select("source", "page", "image_id", F.col("chunk_id").alias("image_chunk"))
    c = view(spark, sf_dir, "chunks").where("chunk_type = 'text' and page = page_end").select("chunk_id", "source", "page")
    r = search.topk(c.join(i, ["source", "page"]), ["chunk_id"], [F.col("image_chunk")], 3, "r")
    return r.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "image_id"))), lambda x: x["image_id"]).alias("images"))


@query("e4_image_context", "select image, string_agg(content, chr(10) order by chunk_index) before_text from (select i.chunk_id image, c.content, c.chunk_index, row_number() over (partition by i.chunk_id order by c.chunk_index desc) r from chunks i join chunks c on c.document_id = i.document_id and c.chunk_index < i.chunk_index and c.page >= i.page - 1 where i.chunk_type = 'image' and c.chunk_type = 'text') where r <= 3 group by image")
def image_context(spark, sf_dir):
    """The three texts before each picture, not further back than the page before.

    Only chunks of the same page or the one before can qualify, so the join goes by document and page.
    """
    c = view(spark, sf_dir, "chunks").select("document_id", "chunk_type", "chunk_id", "chunk_index", "page", "content")
    i = c.where("chunk_type = 'image'").select("document_id", F.col("chunk_id").alias("image"), F.col("chunk_index").alias("at"), F.explode(F.array(F.col("page"), F.col("page") - 1)).alias("page"))
    t = c.where("chunk_type = 'text'").select("document_id", "page", "chunk_index", "content")
    r = search.topk(i.join(t, ["document_id", "page"]).where("chunk_index < at"), ["image"], [F.desc("chunk_index")], 3, "r")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return r.groupBy("image").agg(F.array_join(rows, "\n").alias("before_text"))


@query("c13_figure_references", "select c.chunk_id, i.chunk_id image from chunks c join images i on i.source = c.source and i.page = c.page and i.caption like concat('%.', 7 + c.chunk_index % 2) where c.chunk_type = 'text'")
def figure_references(spark, sf_dir):
    i = view(spark, sf_dir, "images").select("source", "page", F.col("chunk_id").alias("image"), F.element_at(F.split("caption", r"\."), -1).alias("n"))
    c = view(spark, sf_dir, "chunks").where("chunk_type = 'text'").select("chunk_id", "source", "page", (F.col("chunk_index") % 2 + 7).cast("string").alias("n"))
    return c.join(i, ["source", "page", "n"]).select("chunk_id", "image")


@query("d21_item_types", "select chunk_type, count(*) n, count(*) filter (where length(content) < 20) short from chunks group by chunk_type")
def item_types(spark, sf_dir):
    return view(spark, sf_dir, "chunks").groupBy("chunk_type").agg(n_rows().alias("n"), F.count_if(F.length("content") < 20).alias("short"))


@query("d22_image_statistics", "select regexp_extract(image_id, '\\.([a-z]+)$', 1) format, count(*) n, cast(sum(width * height) as bigint) pixels, round(sum(width * height) / 1048576.0, 2) megapixels from images group by 1")
def image_statistics(spark, sf_dir):
    px = F.sum(F.col("width") * F.col("height"))
    return view(spark, sf_dir, "images").groupBy(F.regexp_extract("image_id", r"\.([a-z]+)$", 1).alias("format")).agg(n_rows().alias("n"), px.cast("long").alias("pixels"), F.round(px / 1048576.0, 2).alias("megapixels"))


@query("d33_rich_media", """
with m as (select source, page, image_id, null table_id from images union all select source, page, null, chunk_id from chunks where chunk_type = 'table'
  union all select c.source, c.page, i.image_id, null from chunks c join images i on i.source = c.source and i.page = c.page_end where c.chunk_type = 'text' and c.page_end > c.page)
select source, coalesce(list_sort(list(distinct image_id) filter (where image_id is not null)), []) images, coalesce(list_sort(list(distinct table_id) filter (where table_id is not null)), []) tables, list_sort(list(distinct page)) pages from m group by source""")
def rich_media(spark, sf_dir):
    """Pictures and tables of each source, from three places: image chunks, table chunks, and pictures of a page that a text runs on to."""
    i, c = view(spark, sf_dir, "images"), view(spark, sf_dir, "chunks")
    none = F.lit(None).cast("string")
    on = c.where("chunk_type = 'text' and page_end > page").select(F.col("source").alias("s"), F.col("page").alias("p"), "page_end")
    rows = (
        i.select("source", "page", "image_id", none.alias("table_id"))
        .unionByName(c.where("chunk_type = 'table'").select("source", "page", none.alias("image_id"), F.col("chunk_id").alias("table_id")))
        .unionByName(i.join(on, (i["source"] == on["s"]) & (i["page"] == on["page_end"])).select("source", F.col("p").alias("page"), "image_id", none.alias("table_id")))
    )
    each = lambda name: F.sort_array(F.collect_set(name))
    return rows.groupBy("source").agg(each("image_id").alias("images"), each("table_id").alias("tables"), each("page").alias("pages"))


@query("h10_figure_numbers", r"select chunk_id, replace(regexp_extract(caption, '图\s*(\d+[\.\-]\d+)', 1), '-', '.') figure_number from images")
def figure_numbers(spark, sf_dir):
    return view(spark, sf_dir, "images").select("chunk_id", text.figure_number(F.col("caption"), F.lit("")).alias("figure_number"))


@query("h11_references", r"select chunk_id, list_distinct(regexp_extract_all(caption, '图\s*(\d+\.?\d*)', 1)) refs from images")
def references(spark, sf_dir):
    return view(spark, sf_dir, "images").select("chunk_id", text.figure_references(F.col("caption")).alias("refs"))


@query("h12_section_tail", "select chunk_id, case when page >= 3 then concat(section, ' > p', page, ' > ', chunk_type) else concat(section, ' > ', chunk_type) end tail from chunks")
def section_tails(spark, sf_dir):
    path = F.when(F.col("page") >= 3, F.concat(F.lit("all > "), "section", F.lit(" > p"), "page", F.lit(" > "), "chunk_type")).otherwise(F.concat("section", F.lit(" > "), "chunk_type"))
    return view(spark, sf_dir, "chunks").select("chunk_id", text.section_tail(path).alias("tail"))


@query("h17_table_text", "select sheet, row_no, concat('fields: ', array_to_string(list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> ''), ', ')) described from table_rows")
def table_text(spark, sf_dir):
    md = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    return view(spark, sf_dir, "table_rows").select("sheet", "row_no", F.concat(F.lit("fields: "), F.array_join(text.markdown_cells(md), ", ")).alias("described"))


@query("h31_image_scores", "select chunk_id, round(least(8, 2 * (case when contains(caption, '1') then 1 else 0 end + case when contains(caption, '2') then 1 else 0 end)) + case when width > 800 then 1.5 else 0 end, 4)::double score from images")
def image_scores(spark, sf_dir):
    words = F.array(F.lit("1"), F.lit("2"))
    hit = F.size(F.filter(words, lambda w: F.contains(F.col("caption"), w)))
    return view(spark, sf_dir, "images").select("chunk_id", F.round(F.least(F.lit(8), 2 * hit) + F.when(F.col("width") > 800, 1.5).otherwise(0.0), 4).alias("score"))


@query("f10_image_selection", "select source, chunk_id, cast(r as int) as rank from (select *, row_number() over (partition by source order by width * height desc, chunk_id) r from images) where r <= case when page % 2 = 0 then 3 else 2 end")
def image_selection(spark, sf_dir):
    """A budget from a column: cut at the largest budget first, then by the row's own."""
    i = view(spark, sf_dir, "images").withColumn("px", F.col("width") * F.col("height"))
    top = search.topk(i, ["source"], [F.desc("px"), F.col("chunk_id")], 3)
    return top.where(F.col("rank") <= F.when(F.col("page") % 2 == 0, 3).otherwise(2)).select("source", "chunk_id", "rank")


@query("f12_scored_chunks", "select document_id, chunk_id, cast(r as int) as rank from (select *, row_number() over (partition by document_id order by case when contains(content, 'the') then 10 else 0 end + case when contains(content, 'and') then 1 else 0 end desc, chunk_index) r from chunks) where r <= 5")
def scored_chunks(spark, sf_dir):
    s = F.when(F.contains("content", F.lit("the")), 10).otherwise(0) + F.when(F.contains("content", F.lit("and")), 1).otherwise(0)
    return search.topk(view(spark, sf_dir, "chunks").withColumn("s", s), ["document_id"], [F.desc("s"), F.col("chunk_index")], 5).select("document_id", "chunk_id", "rank")


@query("l4_rag_rows", "select doc_id, pos, case when pos % 10 = 8 then concat('[table] ', line) when length(line) < 40 then concat('# ', line) else line end content from doc_lines")
def rag_rows(spark, sf_dir):
    c = F.when(F.col("pos") % 10 == 8, F.concat(F.lit("[table] "), "line")).when(F.length("line") < 40, F.concat(F.lit("# "), "line")).otherwise(F.col("line"))
    return view(spark, sf_dir, "doc_lines").select("doc_id", F.col("pos").cast("long").alias("pos"), c.alias("content"))
