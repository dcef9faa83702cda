"""Column expressions for cleaning, titles, identity and query text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"

# Substrings that decide a query's intent, first match wins, in this order.
INTENTS = {
    "trend": ["trend", "trends", "趋势", "变化", "走势"],
    "comparison": ["compare", "comparison", "vs", "versus", "对比", "比较"],
    "benchmark": ["benchmark", "ranking", "rank", "排行", "榜单", "top"],
    "diagnosis": ["why", "reason", "impact", "原因", "影响", "为什么"],
    "strategy": ["how", "strategy", "strategies", "advice", "建议", "策略", "如何"],
}
# Terms that are never searched, and connectors cut from Chinese terms.
STOP_TERMS = (
    "the and for with from into that this what which when where why how "
    "关于 有关 以及 还有 什么 哪个 哪些 如何 为什么 一下 看看 一下子 一个 一种 这个 那个 趋势 分析 问题 报告 研究"
).split()
LEADING_CONNECTORS = "^[的和与及并就把将向对从在按为于]+"
TRAILING_CONNECTORS = "(的|和|与|及|并|等|方面|情况)+$"
# Quarter names.
QUARTERS = {"1季度": "Q1", "2季度": "Q2", "3季度": "Q3", "4季度": "Q4", "第一季度": "Q1", "第二季度": "Q2", "第三季度": "Q3", "第四季度": "Q4"}


def line_count(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1


def squeeze(t: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(t, SPACE, " "))


def compare_key(t: Column) -> Column:
    return F.lower(F.regexp_replace(t, SPACE, ""))


def display_title(t: Column, level: Column) -> Column:
    t = F.trim(t)
    t = F.when(level >= 2, F.regexp_replace(t, r"^前言[：:]\s*", "")).otherwise(t)
    return F.regexp_replace(t, r"(?U)(\d)\s+年", "$1年")


def markdown_key(t: Column) -> Column:
    """Title key: no white space, full-width punctuation halved, lower case."""
    t = F.translate(F.regexp_replace(t, SPACE, ""), "：；，。（）【】—–“”‘’", ":;,.()[]--\"\"''")
    return F.lower(F.replace(t, F.lit("…"), F.lit("...")))


def page_key(t: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(t, SPACE, ""), "：·.()（）", ":"))


def collapse_cjk(t: Column) -> Column:
    near = "[一-鿿\\p{Nd}年月日！：:（）()·]"
    return F.regexp_replace(t, f"(?<={near}) (?={near})", "")


def output_title(t: Column) -> Column:
    return F.regexp_replace(collapse_cjk(squeeze(t)), r"^前言[：:]\s*", "")


def strip_nul(t: Column) -> Column:
    return F.replace(t, F.char(F.lit(0)), F.lit(""))


def nul_count(t: Column) -> Column:
    return F.length(t) - F.length(strip_nul(t))


def clip(t: Column, limit: int) -> Column:
    cut = F.substring(t, 1, limit) if limit <= 3 else F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def truncate_summary(t: Column, limit: int = 160) -> Column:
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), "[，。；;:： ]+$", ""), F.lit("…")))


def heuristic_summary(t: Column, title: Column, limit: int = 320) -> Column:
    s = squeeze_ends(F.replace(t, F.lit("\n"), F.lit(" ")))
    s = F.when(F.length(s) <= limit, s).otherwise(squeeze_ends(F.concat(F.substring(s, 1, limit - 1), F.lit("…"))))
    return F.coalesce(F.nullif(s, F.lit("")), title)


def trimmed_lines(text: Column) -> Column:
    """The lines of a text, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def section_body(text: Column, title: Column) -> Column:
    """Lines trimmed, blank ones dropped, a first line that repeats the title dropped."""
    lines = trimmed_lines(text)
    same = compare_key(F.try_element_at(lines, F.lit(1))) == compare_key(title)
    return F.array_join(F.when(same, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines), "\n")


def share_prefix(left: Column, right: Column) -> Column:
    """Whether the keys of two titles begin with the same four characters."""
    x, y = page_key(left), page_key(right)
    return (F.length(x) >= 4) & (F.length(y) >= 4) & (F.substring(x, 1, 4) == F.substring(y, 1, 4))


def short_page_title(text: Column, page: Column, limit: int = 30) -> Column:
    """The beginning of a page's text in one line, or its number."""
    body = squeeze_ends(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = squeeze_ends(F.concat(F.substring(body, 1, limit - 1), F.lit("…")))
    return F.when(body == "", F.concat(F.lit("第 "), page, F.lit(" 页"))).when(F.length(body) <= limit, body).otherwise(cut)


# Prefixes that models put before a title.
TITLE_PREFIXES = ("标题：", "标题:", "Title:", "输出：", "输出:")


def clean_title_line(raw: Column, limit: int = 30) -> Column:
    """The first line of a model's answer without quotes and prefixes, cut to limit; empty where nothing is left."""
    t = squeeze_ends(F.split(raw, "\n")[0])
    for mark in ('"', "'"):
        t = F.regexp_replace(t, f"^{mark}+|{mark}+$", "")
    for prefix in TITLE_PREFIXES:
        t = F.when(t.startswith(prefix), squeeze_ends(F.substring(t, len(prefix) + 1, 1 << 20))).otherwise(t)
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?U)\s+$", ""), F.lit("…"))).otherwise(t)


def node_summary(text: Column, title: Column, whole: int = 600) -> Column:
    """Texts shorter than whole are their own summary, empty ones have their title; longer ones are cut to one line."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.length(body) < whole, F.coalesce(F.nullif(body, F.lit("")), title)).otherwise(heuristic_summary(body, title))


def nullable_int(value: Column) -> Column:
    """A page number given as text; null where it is no integer."""
    t = squeeze_ends(value.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def contextual_text(path: Column, title: Column, body: Column) -> Column:
    last = F.element_at(F.split(path, " > "), -1)
    own = F.when(compare_key(last) == compare_key(title), F.lit(None)).otherwise(F.nullif(title, F.lit("")))
    return F.concat_ws("\n", F.nullif(path, F.lit("")), own, F.nullif(body, F.lit("")))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?s).+?(?:[。！？!?；;](?=\s|$)|$)"), F.lit(0)), squeeze_ends), lambda x: x != "")


def uuid5(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def section_id(doc: Column, node: Column) -> Column:
    return uuid5(F.concat_ws(":", doc, node))


def chunk_id(doc: Column, section: Column, index: Column) -> Column:
    return uuid5(F.concat_ws(":", doc, section, index.cast("string")))


def document_id(seed: Column) -> Column:
    """An id from a seed: the SHA-256 of a file's bytes, its path, or the beginning of its text."""
    return uuid5(seed)


def text_hash(t: Column) -> Column:
    return F.sha2(F.encode(t, "UTF-8"), 256)


def section_number(title: Column) -> Column:
    """struct(key, level, rest) of a numbered title, null fields where it has no number."""
    t = F.trim(title)
    forms = (
        (r"^(\d+(?:\.\d+)+)\s*(.*)$", 1, 2),
        (r"^(\d{1,2})(?:[\s、.．:：\-]+(.*))?$", 1, 2),
        (r"^第((?:[一二三四五六七八九十]|\d)+)章\s*(.*)$", 1, 2),
        (r"^[（(]([一二三四五六七八九十\d]+)[）)]\s*(.*)$", 1, 2),
        (r"^([一二三四五六七八九十]+)[、.]\s*(.*)$", 1, 2),
    )
    key = rest = F.lit(None).cast("string")
    for pattern, k, r in reversed(forms):
        found = F.regexp_extract(t, pattern, k)
        use = (found != "") & ~(found.rlike(r"^\d{3,}$"))
        key, rest = F.when(use, found).otherwise(key), F.when(use, F.trim(F.regexp_extract(t, pattern, r))).otherwise(rest)
    level = F.when(key.isNotNull(), F.size(F.split(key, r"\.")))
    return F.struct(key.alias("key"), level.alias("level"), rest.alias("rest"))


_NUMERAL = r"(?:\d{1,2}|[一二三四五六七八九十\d]*[一二三四五六七八九十][一二三四五六七八九十\d]*)"
_PREFIXES = (r"\d+(?:\.\d+)+", rf"第{_NUMERAL}章", rf"[（(]{_NUMERAL}[）)]", "[一二三四五六七八九十]+[、.]")


def is_numbered(title: Column) -> Column:
    """Whether section_number finds a number, as one expression."""
    return F.trim(title).rlike("^(?:" + "|".join((*_PREFIXES, r"\d{1,2}(?:[\s、.．:：\-]|$)")) + ")")


def without_number(title: Column) -> Column:
    """A title without its number; as it is where nothing would be left."""
    t = F.trim(title)
    rest = F.trim(F.regexp_replace(t, "^(?:(?:" + "|".join(_PREFIXES) + r")\s*|\d{1,2}[\s、.．:：\-]+)", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), t)


def parent_number(key: Column) -> Column:
    return F.when(F.contains(key, F.lit(".")), F.regexp_replace(key, r"\.[^.]*$", ""))


def chapter_marker(title: Column) -> Column:
    return F.trim(title).rlike(r"^(\d{2}|第[一二三四五六七八九十\d]+章|[一二三四五六七八九十]+)$")


def sentence_like(title: Column) -> Column:
    t = F.trim(title)
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return (F.length(t) >= 36) | t.rlike("[，。；;？！、]") | ((spaces >= 5) & (F.length(t) >= 24))


def caption_like(title: Column) -> Column:
    t = F.trim(title)
    return t.rlike(r"^[图表]\s*\d+") | t.startswith("资料来源") | t.startswith("来源：")


def titles_overlap(left: Column, right: Column) -> Column:
    both = (F.length(left) >= 4) & (F.length(right) >= 4)
    return (left == right) | F.contains(left, right) | F.contains(right, left) | (both & (F.substring(left, 1, 4) == F.substring(right, 1, 4)))


def language(q: Column) -> Column:
    cjk, ascii_ = q.rlike("[一-鿿]"), q.rlike("[A-Za-z]")
    return F.when(cjk & ascii_, "mixed").when(cjk, "zh").when(ascii_, "en").otherwise("unknown")


def intent(q: Column) -> Column:
    low, out = F.lower(q), None
    for name, words in INTENTS.items():
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def years(q: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))))


def quarter(raw: Column) -> Column:
    """Qn of a quarter's name; an unknown name in capitals."""
    low, out = F.lower(F.regexp_replace(raw, " ", "")), F.upper(raw)
    for k, v in (QUARTERS | {f"q{i}": f"Q{i}" for i in range(1, 5)}).items():
        out = F.when(low == k, v).otherwise(out)
    return out


def unique_strings(values: Column) -> Column:
    """Trimmed strings without blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, squeeze_ends), lambda x: x != ""))


def squeeze_ends(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def time_scope(q: Column) -> Column:
    """struct(years, quarters, mentions): a quarter after a year is joined to it."""
    pattern = r"(?i)(?:\b(20\d{2})(?U:\s*))?(Q[1-4]|[1-4](?U:\s*)季度|第[一二三四1-4]季度)"
    part = lambda group: F.regexp_extract_all(q, F.lit(pattern), F.lit(group))
    found = F.arrays_zip(part(1).alias("year"), part(2).alias("quarter"))
    quarters = F.transform(found, lambda x: F.concat(F.coalesce(x["year"], F.lit("")), quarter(x["quarter"])))
    mentions = F.transform(found, lambda x: F.trim(F.concat_ws(" ", F.coalesce(x["year"], F.lit("")), x["quarter"])))
    named = F.regexp_extract_all(q, F.lit(r"\b(20\d{2})\b"), F.lit(1))
    return F.struct(years(q).alias("years"), unique_strings(quarters).alias("quarters"), unique_strings(F.concat(mentions, named)).alias("mentions"))


def raw_terms(q: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(q, F.lit(r"[A-Za-z0-9+\-.]{2,}|[一-鿿]{2,}"), F.lit(0)))


def _expanded(t: Column) -> Column:
    """A token's terms: ASCII ones as they are, Chinese ones without connectors and with their first and last two characters."""
    core = F.regexp_replace(F.regexp_replace(t, LEADING_CONNECTORS, ""), TRAILING_CONNECTORS, "")
    n = F.length(core)
    none = F.filter(F.array(core), lambda x: F.lit(False))
    parts = F.when(n >= 3, F.array(core, F.substring(core, 1, 2), F.right(core, F.lit(2)))).when(n == 2, F.array(core)).otherwise(none)
    stop = F.array(*map(F.lit, STOP_TERMS))
    return F.filter(F.when(t.rlike("^[A-Za-z0-9+.-]+$"), F.array(t)).otherwise(parts), lambda x: ~F.array_contains(stop, F.lower(x)))


def query_terms(q: Column) -> Column:
    """Distinct terms of a query in order, with their case."""
    return F.array_distinct(F.flatten(F.transform(raw_terms(q), _expanded)))


def search_terms(q: Column) -> Column:
    """Distinct lower-cased terms: stop words go, Chinese terms lose connectors and gain their first and last two characters."""
    return F.array_distinct(F.filter(F.transform(query_terms(q), F.lower), lambda t: F.length(t) >= 2))


def derived_terms(q: Column) -> Column:
    """The terms to search for: those of the query (taken whole if it is one Chinese run), its years and its quarters."""
    one = ~q.contains(" ") & ~(q.rlike("[A-Za-z0-9]") & q.rlike("[一-鿿]"))
    scope = time_scope(q)
    times = F.concat(F.transform(scope["years"], lambda y: y.cast("string")), scope["quarters"])
    whole = F.when(one & (q != ""), F.transform(_expanded(q), F.lower)).otherwise(F.array().cast("array<string>"))
    tail = F.flatten(F.transform(times, lambda t: F.when(t.rlike("^[A-Za-z0-9]+$"), F.array(F.lower(t))).otherwise(F.flatten(F.transform(raw_terms(t), _expanded)))))
    return F.array_distinct(F.filter(F.concat(whole, search_terms(q), tail), lambda t: F.length(t) >= 2))


def matched_names(q: Column, names: dict[str, list[str]]) -> Column:
    """Canonical names of which an alias stands in the query, in order."""
    hits = [F.when(_any([alias_match(q, a) for a in aliases]), F.lit(name)) for name, aliases in names.items()]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def canonical(values: Column, names: dict[str, list[str]]) -> Column:
    """Values replaced by the name whose alias they are, whatever the case; the last name of a shared alias counts."""
    known = {a.lower(): name for name, aliases in names.items() for a in [name, *aliases]}
    if not known:
        return F.array_distinct(values)
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.array_distinct(F.transform(values, lambda v: F.coalesce(F.element_at(lookup, F.lower(v)), v)))


def enrichment_reason(q: Column) -> Column:
    """Why a query should be enriched by a model; null where the rules suffice."""
    scope, n = time_scope(q), F.size(query_terms(q))
    no_time = (F.size(scope["years"]) == 0) & (F.size(scope["quarters"]) == 0)
    return (
        F.when(language(q) == "unknown", "unknown_language").when(F.length(q) <= 4, "very_short_query").when((n < 2) & no_time, "insufficient_terms_and_time_scope")
        .when((intent(q) == "general") & (n < 3) & no_time, "generic_intent_with_sparse_terms")
    )


def term_hits(text: Column, terms: Column) -> Column:
    """How many distinct terms of two characters or more occur in text, whatever the case."""
    low = F.lower(text)
    return F.size(F.filter(F.array_distinct(F.transform(terms, F.lower)), lambda t: (F.length(t) >= 2) & F.contains(low, t)))


def time_hits(text: Column, times: Column) -> Column:
    """Like term_hits for years and quarters: one that begins or ends within a longer number (2024 in 000002024) is none."""
    low = F.lower(text)
    whole = lambda t: F.concat(F.lit(r"(?:(?<![0-9])|(?![0-9]))\Q"), F.replace(t, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?:(?![0-9])|(?<![0-9]))"))
    return F.size(F.filter(F.array_distinct(F.transform(times, F.lower)), lambda t: (F.length(t) >= 2) & F.rlike(low, whole(t))))


def alias_match(q: Column, alias: str) -> Column:
    """A name with letters must stand alone among ASCII letters and digits; others match anywhere."""
    if any(c.isascii() and c.isalpha() for c in alias):
        return F.lower(q).rlike(r"(?<![a-z0-9])\Q" + alias.lower() + r"\E(?![a-z0-9])")
    return F.contains(q, F.lit(alias))


def json_payload(t: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(t, r"(?s)\{.*\}", 0), schema)
