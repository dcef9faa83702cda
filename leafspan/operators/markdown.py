"""Markdown lines to section trees, as window functions over (doc_id, line).

Input of most steps: doc_id, line (from 0), text. Every step partitions by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.operators.outline import match_entries


def by_line(*more: str) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("line")


def to_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "text"))


def page_of_lines(lines: DataFrame) -> DataFrame:
    """Adds page: the last page comment on an earlier line, 1 before the first."""
    mark = F.regexp_extract("text", r"<!--\s*page:\s*(\d+)\s*-->", 1)
    own = F.when(mark != "", mark.cast("int"))
    return lines.withColumn("page", F.coalesce(F.last(own, True).over(by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)))


def headers(lines: DataFrame) -> DataFrame:
    """Header lines outside fenced code, with level and raw_title."""
    fence = F.col("text").rlike(r"^\s*(```|~~~)").cast("int")
    open_ = F.sum(fence).over(by_line().rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    pattern = r"^(#{1,6})\s+(.+?)\s*$"
    found = lines.withColumn("_open", open_).filter(~F.col("_open") & F.col("text").rlike(pattern)).drop("_open")
    return found.withColumn("level", F.length(F.regexp_extract("text", pattern, 1))).withColumn("raw_title", F.regexp_extract("text", pattern, 2))


def clamp_levels(found: DataFrame) -> DataFrame:
    """No level is more than one deeper than the deepest before it (1 at first); if none is 1 then, all rise by one.

    The deepest level becomes k at the first header after it became k - 1 whose level is k or more.
    """
    doc = Window.partitionBy("doc_id")
    rows = found.withColumn("_deepest", F.lit(1)).withColumn("_since", F.lit(-1).cast("long"))
    for k in range(2, 7):
        rows = rows.withColumn("_since", F.min(F.when((F.col("line") > F.col("_since")) & (F.col("level") >= k), F.col("line").cast("long"))).over(doc))
        rows = rows.withColumn("_deepest", F.col("_deepest") + F.coalesce((F.col("_since") < F.col("line")).cast("int"), F.lit(0)))
    rows = rows.withColumn("level", F.greatest(F.lit(1), F.least(F.lit(6), "level", F.col("_deepest") + 1)))
    lift = F.when(F.min("level").over(doc) >= 2, 1).otherwise(0)
    return rows.withColumn("level", F.col("level") - lift).drop("_deepest", "_since")


def override_levels(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Levels from an outline (doc_id, entry, title, level) where its entries match headers one to one; see match_entries."""
    given = match_entries(entries, found.select("doc_id", "line", F.col("raw_title").alias("title"))).select("doc_id", "line", F.col("level").alias("_given"))
    rows = found.withColumn("line", F.col("line").cast("long")).join(given, ["doc_id", "line"], "left")
    return rows.withColumn("level", F.coalesce("_given", "level")).withColumn("line", F.col("line").cast("int")).drop("_given")


def top_headers(found: DataFrame) -> DataFrame:
    return found.filter("level = 1")


def headers_between(found: DataFrame, ranges: DataFrame, least: int = 1) -> DataFrame:
    """Headers of level least or deeper on the lines of each range (doc_id, range, first_line, last_line), ends included."""
    return found.filter(F.col("level") >= least).join(ranges, "doc_id").filter(F.col("line").between(F.col("first_line"), F.col("last_line")))


def after_first_top(found: DataFrame, strict: bool = False) -> DataFrame:
    """Headers from a document's first one of level 1 on; what stands before is in no tree. strict: fail where there is none."""
    first = F.min(F.when(F.col("level") == 1, F.col("line"))).over(Window.partitionBy("doc_id"))
    rows = found.withColumn("_first", first)
    if strict:
        rows = rows.withColumn("_first", F.coalesce("_first", F.raise_error(F.concat(F.lit("no heading of level 1 in "), F.col("doc_id").cast("string"))).cast("int")))
    return rows.filter(F.col("line") >= F.col("_first")).drop("_first")


def page_forest(lines: DataFrame, found: DataFrame) -> DataFrame:
    """A root for each document and a node for each run of lines on one page.

    lines: doc_id, line, text, page; found: headers with their levels. The root is the first heading of level 1 with its
    text up to the next heading, or "Document". A page is called after its first heading of level 1, else after its first
    of level 2, else by its number (untitled). Columns: doc_id, node_id, parent_id, ord, title, page_index, text, untitled.
    """
    w = by_line()
    at = found.select("doc_id", "line", "level", "raw_title", F.lead("line").over(w).alias("next_line"))
    top = at.filter("level = 1").groupBy("doc_id").agg(F.min(F.struct("line", "raw_title", "next_line")).alias("h")).select("doc_id", F.col("h.line").alias("top_line"), "h.raw_title", "h.next_line")
    own = lines.join(top, "doc_id").filter((F.col("line") >= F.col("top_line")) & (F.col("next_line").isNull() | (F.col("line") < F.col("next_line"))))
    own = own.groupBy("doc_id").agg(_joined().alias("text"))
    first = lines.groupBy("doc_id").agg(F.min_by("page", "line").alias("first_page"))
    pages = lines.select("doc_id", "line", "page").join(top.select("doc_id", F.col("top_line").alias("line"), "raw_title"), ["doc_id", "line"]).select("doc_id", F.col("page").alias("top_page"), F.col("raw_title").alias("top_title"))
    root = first.join(pages, "doc_id", "left").join(own, "doc_id", "left").select(
        "doc_id", F.lit("0000").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), F.coalesce(T.display_title(F.col("top_title"), F.lit(1)), F.lit("Document")).alias("title"),
        F.coalesce("top_page", "first_page").alias("page_index"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("untitled"),
    )
    change = F.coalesce(F.col("page") != F.lag("page").over(w), F.lit(True)).cast("int")
    runs = lines.withColumn("_new", change).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    titles = runs.select("doc_id", "line", "run").join(found.filter("level <= 2").select("doc_id", "line", "level", "raw_title"), ["doc_id", "line"])
    titles = titles.groupBy("doc_id", "run").agg(F.min(F.struct("level", "line", "raw_title")).alias("t")).select("doc_id", "run", T.display_title(F.col("t.raw_title"), F.col("t.level")).alias("own_title"))
    nodes = runs.groupBy("doc_id", "run").agg(F.first("page").alias("page_index"), _joined().alias("text")).join(titles, ["doc_id", "run"], "left")
    nodes = nodes.select(
        "doc_id", F.format_string("%04d", "run").alias("node_id"), F.lit("0000").alias("parent_id"), F.col("run").alias("ord"), F.coalesce("own_title", F.concat(F.lit("第 "), "page_index", F.lit(" 页"))).alias("title"),
        "page_index", "text", F.col("own_title").isNull().alias("untitled"),
    )
    return root.unionByName(nodes)


def _joined():
    """Lines of a group joined in order, without line breaks at the ends."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return F.regexp_replace(whole, r"^\n+|\n+$", "")


def title_pages(nodes: DataFrame, limit: int = 30, titles: DataFrame | None = None) -> DataFrame:
    """Untitled pages called after their text, or after a model's titles (doc_id, node_id, answer) where those are usable."""
    rows = nodes if titles is None else nodes.join(titles.select("doc_id", "node_id", T.clean_title_line(F.col("answer"), limit).alias("_given")), ["doc_id", "node_id"], "left")
    made = T.short_page_title(F.col("text"), F.col("page_index"), limit)
    made = made if titles is None else F.coalesce(F.nullif("_given", F.lit("")), made)
    return rows.withColumn("title", F.when(F.col("untitled"), made).otherwise(F.col("title"))).select(nodes.columns)


def untitled_pages(nodes: DataFrame) -> DataFrame:
    return nodes.filter("untitled")


def summarised(nodes: DataFrame, keep: bool = True) -> DataFrame:
    """Adds summary from text and title, or an empty one."""
    return nodes.withColumn("summary", T.node_summary(F.col("text"), F.col("title")) if keep else F.lit(""))


def document_summaries(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, titles and summary: the roots' titles, or those of a single root and of its first 25 children.

    nodes: doc_id, node_id, parent_id, ord, title. The summary names twelve of them and the number of lines.
    """
    order = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("ord", "node_id", "title")))), lambda x: x["title"])
    is_root = F.col("parent_id").isNull()
    roots = nodes.groupBy("doc_id").agg(order(is_root).alias("roots"), F.count_if(is_root).alias("n"), F.max(F.when(is_root, F.col("node_id"))).alias("root"))
    below = nodes.join(roots.select("doc_id", F.col("root").alias("parent_id")), ["doc_id", "parent_id"]).groupBy("doc_id").agg(order(F.lit(True)).alias("children"))
    count = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    rows = roots.join(below, "doc_id", "left").join(count, "doc_id")
    rows = rows.withColumn("titles", F.when(F.col("n") == 1, F.concat("roots", F.slice(F.coalesce("children", F.array().cast("array<string>")), 1, 25))).otherwise(F.col("roots")))
    text = F.concat(F.lit("本文档共 "), "n_lines", F.lit(" 行，包含以下主要部分："), F.array_join(F.slice("titles", 1, 12), "、"), F.when(F.size("titles") > 12, "等。").otherwise("。"))
    return rows.select("doc_id", "titles", text.alias("summary"))


def section_rows(lines: DataFrame, found: DataFrame) -> DataFrame:
    """One row per header: its text up to the next header, its parent (nearest earlier header of a smaller level)."""
    w = by_line()
    rows = found.withColumn("next_line", F.lead("line").over(w)).withColumn("preorder", F.row_number().over(w) - 1)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.array(*[F.last(F.when(F.col("level") == k, F.col("line")), True).over(before) for k in range(1, 6)]))
    rows = rows.withColumn("parent_line", F.array_max(F.slice("_last", F.lit(1), F.col("level") - 1))).drop("_last", "text")
    rows = rows.filter(F.col("level") >= 1).withColumn("title", T.display_title(F.col("raw_title"), F.col("level")))
    at = F.last(F.when(F.col("level").isNotNull(), F.col("line")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    body = lines.join(found.select("doc_id", "line", "level"), ["doc_id", "line"], "left").withColumn("at", at).filter("at is not null")
    body = body.groupBy("doc_id", F.col("at").alias("line")).agg(_joined().alias("text"))
    out = rows.join(body, ["doc_id", "line"])
    return out.withColumn("node_id", F.format_string("%04d", "preorder"))


def with_paths(sections: DataFrame, most: int = 6) -> DataFrame:
    """Adds depth, title_path, ancestor lines, subtree_end and is_leaf to (doc_id, line, parent_line, title, preorder)."""
    up = sections.select("doc_id", F.col("line").alias("parent_line"), F.array("title").alias("p_titles"), F.array("line").alias("p_lines"), F.col("parent_line").alias("pp"))
    rows = sections.withColumn("titles", F.array("title")).withColumn("ancestors", F.slice(F.array("line"), 1, 0)).withColumn("up", F.col("parent_line"))
    for _ in range(most):
        hop = up.select("doc_id", F.col("parent_line").alias("up"), "p_titles", "p_lines", "pp")
        rows = rows.join(hop, ["doc_id", "up"], "left")
        rows = rows.withColumn("titles", F.concat(F.coalesce("p_titles", F.slice("titles", 1, 0)), "titles")).withColumn("ancestors", F.concat(F.coalesce("p_lines", F.slice("ancestors", 1, 0)), "ancestors"))
        rows = rows.withColumn("up", F.col("pp")).drop("p_titles", "p_lines", "pp")
    rows = rows.drop("up").withColumn("title_path", F.array_join("titles", " > ")).withColumn("depth", F.size("ancestors"))
    below = rows.select("doc_id", F.explode("ancestors").alias("line"), "preorder").groupBy("doc_id", "line").agg(F.max("preorder").alias("last_below"))
    rows = rows.join(below, ["doc_id", "line"], "left").withColumn("subtree_end", F.coalesce("last_below", "preorder"))
    return rows.withColumn("is_leaf", F.col("last_below").isNull()).drop("titles", "last_below")


def page_runs(lines: DataFrame) -> DataFrame:
    """Runs of lines on one page: doc_id, run, page, first_line, last_line."""
    w = by_line()
    change = F.coalesce(F.col("page") != F.lag("page").over(w), F.lit(True)).cast("int")
    runs = lines.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.first("page").alias("page"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def layout(t):
    return F.when(F.contains(t, F.lit("<!-- page:")), "page_per_page").otherwise("h1_forest")
