"""Rules about questions, answers and query wording, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Signs of a comparison, links between the compared things, words cut from their names.
COMPARISON_SUFFIX = r"(?:有什么区别|的区别是什么|有什么不同|的不同是什么|的区别|的不同|对比|比较|哪个更好|哪个更)$"
CONNECTORS = r"和|与|跟|及|vs|VS|还是"
ENTITY_PREFIX = r"^(?:请问|我想知道|帮我查|查一下)+"
ENTITY_TAIL = r"(?:[？?！!。，,、]|是什么|有什么|有哪些|怎么样|如何|的区别|的不同|区别|不同)+$"


def compared(q: Column, connectors: str = CONNECTORS, signs: tuple[str, ...] = text.COMPARISON, most: int = 2, longest: int = 10) -> Column:
    """The things a query compares (2 to ``longest`` characters each, distinct, ``most`` at most), else an empty array."""
    parts = F.split(F.regexp_replace(F.regexp_replace(q, r"[？?！!。]+$", ""), COMPARISON_SUFFIX, ""), connectors)
    clean = F.transform(F.slice(parts, 1, most), lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), ENTITY_PREFIX, ""), ENTITY_TAIL, "")))
    good = F.array_distinct(F.filter(clean, lambda e: F.length(e).between(2, longest)))
    return F.when((F.size(parts) >= 2) & text.any_of(q, signs), good).otherwise(F.array().cast("array<string>"))


#: What is asked of each compared thing, of the first two together, and of a reason.
ASKED, TOGETHER, BACKGROUND, AND = ("是什么？", "的主要特点有哪些？"), "的主要区别有哪些？", "...的相关背景", "和"
REASONS = ("为什么", "原因", "导致", "影响")


def sub_queries(q: Column, reasons: tuple[str, ...] = REASONS, asked: tuple[str, ...] = ASKED, together: str = TOGETHER, background: str = BACKGROUND, joint: str = AND, **things) -> Column:
    """2n + 1 questions of a comparison of n things; two of a long question for reasons; else the query itself.

    Word lists and wordings are the caller's where given; ``things`` goes to ``compared``.
    """
    found = compared(q, **things)
    each = F.flatten(F.transform(found, lambda e: F.array(*(F.concat(e, F.lit(a)) for a in asked))))
    both = F.array(F.concat(F.array_join(F.slice(found, 1, 2), joint), F.lit(together)))
    why = text.any_of(q, reasons) & (F.length(q) > 30)
    return F.when(F.size(found) >= 2, F.array_distinct(F.concat(each, both))).when(why, F.array(q, F.concat(F.substring(q, 1, 10), F.lit(background)))).otherwise(F.array(q))


def expansions(q: Column, terms: dict[str, list[str]], most: int = 5) -> Column:
    """The query and its variants with a known term replaced by each of its synonyms, distinct, ``most`` at most."""
    made = [F.when(F.contains(q, F.lit(k)), F.array(*(F.replace(q, F.lit(k), F.lit(s)) for s in v))).otherwise(F.array().cast("array<string>")) for k, v in terms.items()]
    return F.slice(F.array_distinct(F.concat(F.array(q), *made)), 1, most)


def mapped(q: Column, terms: dict[str, str]) -> Column:
    """Each colloquial term followed by its professional one in brackets, in dictionary order."""
    return reduce(lambda c, kv: F.when(F.contains(c, F.lit(kv[0])) & ~F.contains(c, F.lit(kv[1])), F.replace(c, F.lit(kv[0]), F.lit(f"{kv[0]}（{kv[1]}）"))).otherwise(c), terms.items(), q)


def answer_score(actual: Column, expected: Column) -> Column:
    """0 to 100: share of the expected words that the answer has, 20 more if it holds the expected text; 50 without words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[，、。]", " "), r"\s+"), lambda w: F.length(w) >= 2))
    want = words(expected)
    share = F.when(F.size(want) == 0, 50).otherwise(F.floor(F.size(F.array_intersect(want, words(actual))) / F.size(want) * 100 + 1e-9))
    bonus = F.when(F.contains(F.lower(actual), F.lower(expected)), 20).otherwise(0)
    return F.when(F.coalesce(F.length(actual), F.lit(0)) == 0, 0).otherwise(F.least(F.lit(100), share + bonus)).cast("int")


def grade_band(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def grade_objective(answer: Column, correct: Column, points: Column) -> Column:
    """Full points if the chosen letters are the correct ones in any order (case and spaces aside)."""
    letters = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.upper(F.regexp_replace(c, r"[\s,，、]", "")), ""), lambda x: x != "")))
    return F.when((F.size(letters(correct)) > 0) & (letters(answer) == letters(correct)), points).otherwise(F.lit(0)).cast("double")


def grade_blanks(answers: Column, correct: Column, points: Column) -> Column:
    """Equal share of the points for each blank whose answer is one of its accepted wordings; one decimal."""
    norm = lambda c: F.lower(F.trim(c))
    hit = F.transform(correct, lambda words, i: F.when(F.exists(words, lambda w: (norm(w) == norm(F.get(answers, i))) & (F.length(norm(w)) > 0)), 1.0).otherwise(0.0))
    share = F.try_divide(points, F.size(correct))
    return F.coalesce(F.round(F.aggregate(hit, F.lit(0.0), lambda a, x: a + x) * share, 1), F.lit(0.0))


def json_array(noisy: Column, schema: str) -> Column:
    """Items of a JSON array in noisy text: the text itself, a fenced block, or its first [...] part."""
    fenced = F.regexp_extract(noisy, r"(?s)```(?:json)?\s*(.*?)```", 1)
    first = F.regexp_extract(noisy, r"(?s)(\[.*\])", 1)
    tries = [F.when(F.trim(c).startswith("["), F.from_json(c, schema)) for c in (noisy, fenced, first)]
    return F.coalesce(*(F.when(F.size(F.filter(t, lambda x: x.isNotNull())) > 0, t) for t in tries))


def knowledge_point(content: Column) -> Column:
    """A short content (below 100 characters when cleaned) that itself makes a point of 5 to 30 characters, else null."""
    clean = F.trim(F.regexp_replace(content, r"[#*\s]+", " "))
    return F.when((F.length(clean) < 100) & F.length(clean).between(5, 30), clean)


def table_title(markdown: Column) -> Column:
    """Title of a table: after its mark, else up to four header cells, else a default."""
    marked = F.trim(F.regexp_extract(markdown, r"【表格】\s*([^\n|]*)", 1))
    strong = F.array_join(F.slice(F.regexp_extract_all(markdown, F.lit(r"<strong>(.*?)</strong>"), F.lit(1)), 1, 4), "、")
    header = F.array_join(F.slice(text.markdown_cells(F.element_at(F.split(markdown, "\n"), 1)), 1, 4), "、")
    return F.when(marked != "", marked).when(strong != "", strong).when(F.contains(markdown, F.lit("|")) & (header != ""), header).otherwise(F.lit("表格"))


def image_summary(kind: Column, number: Column, caption: Column, section: Column) -> Column:
    """Label by kind and number, the caption, a year span and the section's topic, those that exist."""
    label = F.when(kind == "table", "表").when(kind == "chart", "图表").otherwise("图")
    years = F.regexp_extract(caption, r"((?:19|20)\d{2}\s*[-–~至到]\s*(?:19|20)\d{2})", 1)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", F.concat(label, F.coalesce(number, F.lit(""))), blank(caption), F.concat(F.lit("时间 "), blank(years)), F.concat(F.lit("主题 "), blank(text.section_tail(section, 1))))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        both = row & at.get(ch, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - bin(row).count("1")
