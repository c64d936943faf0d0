"""Text functions, all on the JVM: each takes and returns columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-龥"


def tokens(s: Column) -> Column:
    """Lower-case runs of letters and digits; runs of CJK characters become overlapping pairs."""
    low = F.lower(s)
    runs = F.regexp_extract_all(low, F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))
    pairs = lambda r: F.when(
        r.rlike(f"^[{CJK}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    ).otherwise(F.array(r))
    return F.when(s.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, pairs))).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def keywords(s: Column, least: int = 2) -> Column:
    """Distinct tokens of at least two characters, in order."""
    return F.array_distinct(F.filter(tokens(s), lambda t: F.length(t) >= least))


def characters(s: Column) -> Column:
    """Distinct characters, in order."""
    return F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")


def coverage(s: Column, terms: Column, scale: float = 0.8) -> Column:
    """Share of the terms that the text holds, times 0.8; 0.5 without terms."""
    low = F.lower(s)
    hit = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(F.size(terms) > 0, hit / F.size(terms) * scale).otherwise(F.lit(0.5))


def any_of(s: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether the text holds any of the words."""
    return reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))


def _first(s: Column, patterns: list[str], otherwise: str = "") -> Column:
    """First non-empty capture of the patterns, in order."""
    return F.coalesce(*(F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in patterns), F.lit(otherwise))


#: Fixed patterns: ways to write a figure number.
FIGURE_PATTERNS = [
    r"(?i)图\s*(\d+[\.\-]\d+)",
    r"(?i)Fig\.?\s*(\d+[\.\-]\d+)",
    r"(?i)Figure\s*(\d+[\.\-]\d+)",
    r"(?i)[（(]\s*图\s*(\d+)\s*[)）]",
]


def figure_number(caption: Column, section: Column) -> Column:
    """Figure number of a caption or section, '-' written as '.'; empty if there is none."""
    both = F.concat(F.coalesce(caption, F.lit("")), F.lit(" "), F.coalesce(section, F.lit("")))
    return F.replace(_first(both, FIGURE_PATTERNS), F.lit("-"), F.lit("."))


def figure_references(s: Column) -> Column:
    """Distinct figure numbers, then table numbers, that a text refers to."""
    one = lambda mark: F.regexp_extract_all(s, F.lit(rf"{mark}\s*(\d+\.?\d*)"), F.lit(1))
    return F.array_distinct(F.concat(one("图"), one("表")))


def section_tail(path: Column, levels: int = 3) -> Column:
    """Last levels of a ' > ' path, blank parts left out."""
    parts = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - levels + 1, F.lit(1)), levels), " > ")


#: Document type by extension.
DOC_TYPES = {"pdf": "pdf", "docx": "word", "doc": "word", "xlsx": "excel", "xls": "excel", "pptx": "ppt", "ppt": "ppt"}


def doc_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.\\/]*)$", 1))
    return F.coalesce(*(F.when(ext == k, F.lit(v)) for k, v in DOC_TYPES.items()), F.lit("other"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def preview(s: Column, n: int = 200) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


#: What a heading looks like, fewer characters than this (none: any number), and its level; the first row that fits counts.
HEADINGS = (
    ("^第[一二三四五六七八九十百千万]+[章节篇部]", None, 1),
    ("^第[一二三四五六七八九十百千万]+[条款]", None, 2),
    (r"^\d+[.、\s]", 50, 1),
    (r"^\d+\.\d+[.、\s]", 80, 2),
    (r"^\d+\.\d+\.\d+[.、\s]", 100, 3),
    ("^(?i)(Chapter|Section|Part)", None, 1),
    (r"^\*\*.+\*\*$", 50, 2),
    ("[一-鿿]", 20, 2),
)


def heading_level(s: Column, rules=HEADINGS) -> Column:
    """0 (body) to 3 by a table of rules ``pattern, length, level``."""
    line = F.trim(s)

    def fits(pattern: str, below: int | None) -> Column:
        return line.rlike(pattern) if below is None else line.rlike(pattern) & (F.length(line) < below)

    return reduce(lambda rest, rule: F.when(fits(*rule[:2]), rule[2]).otherwise(rest), reversed(rules), F.lit(0))


def sentences(s: Column) -> Column:
    """Trimmed parts between sentence ends, blank ones left out."""
    return F.filter(F.transform(F.split(s, r"[。！？.!?]\s*"), lambda x: F.trim(x)), lambda x: x != "")


#: Words of hedged and of factual claims.
HEDGED = ("可能", "也许", "大概", "应该", "估计", "通常", "一般", "往往", "多半", "我认为", "我猜测", "似乎", "看起来")
FACTUAL = ("是", "有", "包括", "规定", "要求", "标准", "流程", "步骤", "时间", "金额", "数量")


def claim_type(s: Column, hedged=HEDGED, factual=FACTUAL) -> Column:
    return F.when(any_of(s, hedged), "hedged").when(any_of(s, factual), "factual").otherwise("inference")


def claim_confidence(s: Column, verified: Column, hedged=HEDGED) -> Column:
    base = F.when(verified, 0.8).otherwise(0.4) - F.when(any_of(s, hedged), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), base))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def set_key(ids: Column) -> Column:
    """Key of a set of ids: order does not matter."""
    return F.md5(F.array_join(F.sort_array(ids), "|").cast("binary"))


def safe_name(s: Column, longest: int = 100) -> Column:
    """File name without path and control characters, at most 100 characters, never empty."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"^\.+", ""))
    return F.coalesce(F.nullif(F.substring(clean, 1, longest), F.lit("")), F.lit("unnamed"))


def token_estimate(s: Column) -> Column:
    return F.floor(F.length(s) / 2)


def semantic_text(title: Column, section: Column, body: Column) -> Column:
    """Title, section line and body, one below the other; empty parts left out."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n", blank(title), F.concat(F.lit("主题："), blank(section)), blank(body))


def markdown_cells(line: Column) -> Column:
    """Trimmed, non-empty cells of a pipe row."""
    return F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda c: c != "")


#: Fixed patterns: secrets and settings that must not be shown, by label.
SENSITIVE = {
    "api_key": r"(?i)\b(?:sk|pk|api|key)[-_][A-Za-z0-9_-]{16,}",
    "password": r"(?i)(?:password|passwd|pwd)\s*[:=]\s*\S+",
    "setting": r"\b[A-Z][A-Z0-9]*_(?:KEY|SECRET|TOKEN|PASSWORD)\s*=\s*\S+",
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
}


def sensitive_labels(s: Column) -> Column:
    """Labels of the sensitive patterns found, in a fixed order."""
    return F.array_compact(F.array(*(F.when(s.rlike(p), F.lit(k)) for k, p in SENSITIVE.items())))


def redacted(s: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, "[removed]"), SENSITIVE.values(), s)


def images_in_markup(s: Column) -> Column:
    """Distinct image names of Markdown and HTML, in order of kind, without folders, parameters and fragments."""
    md = F.regexp_extract_all(s, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    html = F.regexp_extract_all(s, F.lit(r"""(?i)<img[^>]*src=["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.transform(F.concat(md, html), lambda x: basename(F.regexp_replace(x, r"[?#].*$", ""))))


def html_rows(s: Column) -> Column:
    """Cells of each row of an HTML table, tags removed."""
    rows = F.regexp_extract_all(s, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", ""))))


def html_markdown(s: Column) -> Column:
    """The table as pipe rows with a rule below the first; pipes in cells are escaped."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rows = html_rows(s)
    rule = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = F.flatten(F.transform(rows, lambda r, i: F.when(i == 0, F.array(line(r), rule(r))).otherwise(F.array(line(r)))))
    return F.array_join(lines, "\n")


#: Fixed values of the query rules, tried in this order.
META = (
    "有哪些文件", "什么文件", "哪些文件", "文件列表", "文件目录", "能查看", "可以查看", "有权限查看", "权限查看", "能访问", "可以访问", "有权限访问",
    "我的权限", "用户权限", "查看权限", "访问权限", "权限能", "权限可以", "有什么权限", "有哪些权限", "我能看", "我可以看", "我能查", "我可以查",
    "能看到什么", "能查到什么", "可以看什么", "可以查什么", "知识库有哪些", "库里有", "文档有哪些", "有哪些文档", "有什么文档", "有什么文件",
    "包含什么", "包含哪些", "你知道什么", "你都知道", "你能回答什么", "系统里有什么", "库里有什么", "能做什么", "可以帮助",
    "public_kb", "dept_tech", "dept_hr", "dept_finance", "dept_operation", "kb里", "向量库", "有哪些库", "库列表", "kb有哪些",
)
REALTIME = ("今天", "昨天", "最新", "最近", "当前", "天气", "新闻", "股价", "汇率", "实时", "现在", "本周", "本月", "今年", "发生了", "热点", "动态")
COMPARISON = ("区别", "对比", "差异", "比较", "不同", "哪个更好", "哪个更", "vs", "还是", "一样吗", "有什么不同", "有什么区别", "优缺点", "利弊", "优劣")
PROCESS = ("流程", "步骤", "怎么办理", "如何申请", "操作流程", "办理流程", "申请流程", "怎么做", "怎样", "操作步骤", "审批流程", "审批步骤", "办理手续")
IMAGE_REFERENCE = r"这[张些]图片|那[张些]图片|上面的图片|刚才的图片|这[张些]图|那[张些]图|上面的图|刚才的图|这几张图|那几张图|这两张图|那两张图|图片里是什么|图里是什么|图片中是什么|图中是什么|看下图片|看下这几张"
BUSINESS = ("报销", "出差", "请假", "工资", "合同", "审批", "招聘", "培训", "考核", "绩效", "调岗", "离职", "入职", "试用期", "加班", "考勤", "年假", "病假", "婚假", "产假", "陪产假", "补助", "补贴", "奖金")
FILE_NAME = r"(?i)([^\s，。？!！?？]+?\.(?:pdf|docx?|xlsx?|txt|md|pptx?))"


def query_type(q: Column, meta=META, realtime=REALTIME, comparison=COMPARISON, process=PROCESS, business=BUSINESS) -> Column:
    """Class of a query; the word lists can be replaced by the caller's (custom rules)."""
    simple = (F.length(q) <= 20) & any_of(q, business) & (F.size(keywords(q)) <= 3)
    return (
        F.when(any_of(q, meta), "meta").when(q.rlike(IMAGE_REFERENCE), "image_reference").when(any_of(q, realtime), "realtime")
        .when(q.rlike(FILE_NAME), "file_specific").when(any_of(q, comparison), "comparison").when(any_of(q, process), "process")
        .when(simple, "simple").otherwise("fact")
    )


def query_confidence(kind: Column) -> Column:
    return F.when(kind.isin("meta", "image_reference", "realtime", "file_specific", "simple"), 0.95).otherwise(0.75)


def file_in_query(q: Column) -> Column:
    return F.nullif(F.regexp_extract(q, FILE_NAME, 1), F.lit(""))


#: Order in which the built-in rules are tried; a caller's rows take any priority, negative ones come first.
RULE_CLASSES = (("meta", META, 10), ("realtime", REALTIME, 30), ("comparison", COMPARISON, 50), ("process", PROCESS, 60))


def rule_rows() -> list[tuple[str, str, str, int]]:
    """The built-in rules ``pattern, kind, class, priority``; kind is ``word`` (the text holds it) or ``regex``."""
    words = [(w, "word", name, priority) for name, own, priority in RULE_CLASSES for w in own]
    return [*words, (IMAGE_REFERENCE, "regex", "image_reference", 20), (FILE_NAME, "regex", "file_specific", 40)]


def first_rule(s: Column, rules: Column) -> Column:
    """``struct(priority, pattern, class)`` of the first rule that fits: least priority, then pattern; null without one.

    ``rules`` is an array of ``struct(priority, pattern, class, kind)``.
    """
    fits = lambda r: F.when(r["kind"] == "word", F.contains(s, r["pattern"])).otherwise(F.regexp_like(s, r["pattern"]))
    return F.array_min(F.transform(F.filter(rules, fits), lambda r: F.struct(r["priority"].alias("priority"), r["pattern"].alias("pattern"), r["class"].alias("class"))))
