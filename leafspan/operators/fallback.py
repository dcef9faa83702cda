"""Trees of paged documents without a model: page and cover titles, seeded outlines, one section a page.

Pages, lines and headings are those of outline.py: pages (doc_id, page, plain_text, block_count, page_height), lines
(doc_id, page, line, text, x, y), headings (doc_id, page, rank, title, size). Every step partitions by document or page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.operators.normalize import bare_key

CONTENTS = "目录"
COVER_TOP, COVER_CHARS = 260.0, 20
TOP_SHARE = 0.35
TITLE_CHARS = 80
DEEPEST = 8


def page_has_text(plain: Column, blocks: Column) -> Column:
    return (F.length(T.squeeze_ends(F.coalesce(plain, F.lit("")))) >= 8) | (F.coalesce(blocks, F.lit(0)) >= 2)


def documents_with_text(pages: DataFrame) -> DataFrame:
    """doc_id, meaningful pages, characters, and whether that is enough for a tree."""
    plain = F.col("plain_text")
    rows = pages.groupBy("doc_id").agg(F.count_if(page_has_text(plain, F.col("block_count"))).alias("meaningful"), F.sum(F.length(T.squeeze_ends(F.coalesce(plain, F.lit(""))))).alias("characters"))
    return rows.withColumn("enough", (F.col("meaningful") >= 2) & (F.col("characters") >= 80))


def heading_titles(headings: DataFrame) -> DataFrame:
    """doc_id, page, title: each page's first heading that is long enough or numbered, and not the contents'."""
    t = T.squeeze(F.col("title"))
    rows = headings.filter("rank <= 5").select("doc_id", "page", "rank", t.alias("title"))
    key = T.page_key(F.col("title"))
    rows = rows.filter((key != "") & (key != CONTENTS) & ((F.length("title") >= 4) | T.is_numbered(F.col("title"))))
    return rows.groupBy("doc_id", "page").agg(F.min_by("title", "rank").alias("title"))


def dominant_headings(headings: DataFrame) -> DataFrame:
    """doc_id, page, dominant, size: the largest of a page's first headings, joined with those nearly as large."""
    rows = headings.filter("rank <= 5").withColumn("top", F.max("size").over(Window.partitionBy("doc_id", "page")))
    parts = F.array_sort(F.collect_list(F.when(F.col("size") >= F.col("top") * 0.95, F.struct("rank", F.trim("title").alias("t")))))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("dominant"), F.max("size").alias("size"))


def effective_level(level: Column, title: Column, dominant: Column, size: Column) -> Column:
    """1 where the page's dominant heading is very large and agrees with the title, else the level."""
    a, b = T.page_key(title), T.page_key(F.coalesce(dominant, F.lit("")))
    agree = F.contains(b, a) | F.contains(a, b)
    return F.when((F.coalesce(dominant, F.lit("")) != "") & (size >= 32.0) & agree, 1).otherwise(F.greatest(F.lit(1), level))


def resolved_title(title: Column, dominant: Column, size: Column) -> Column:
    """The page's dominant heading where it is large and begins like the title."""
    return F.when((size >= 22.0) & T.share_prefix(title, F.coalesce(dominant, F.lit(""))), dominant).otherwise(title)


def cover_titles(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, cover: the first two short lines near the top of the first page, else its first heading, else a line."""
    first = lines.filter("page = 1").withColumn("t", T.squeeze(F.col("text")))
    near = F.array_sort(F.collect_list(F.when((F.col("y") < COVER_TOP) & (F.length("t") <= COVER_CHARS), F.struct("line", "t"))))
    some = F.min(F.when(F.length("t") >= 4, F.struct("line", "t")))["t"]
    rows = first.groupBy("doc_id").agg(F.transform(F.slice(near, 1, 2), lambda x: x["t"]).alias("near"), some.alias("some"))
    head = headings.filter("page = 1").groupBy("doc_id").agg(F.trim(F.min_by("title", "rank")).alias("head"))
    rows = rows.join(head, "doc_id", "full_outer")
    both = F.trim(F.array_join("near", ""))
    return rows.select("doc_id", F.coalesce(F.when((F.size("near") >= 2) & (F.length(both) >= 8), both), "head", "some").alias("cover")).filter("cover is not null")


def seeded_outline(entries: DataFrame, lines: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, seq, structure, title, page of the mapped entries, numbered by level, after cover and contents if any.

    A number counts the entries of its level since the last one above that level. With a cover, which needs contents after
    page 1, everything is below 0, and the contents are its first section. entries: outline.outline_entries.
    """
    covers = cover_titles(lines, headings).join(entries.groupBy("doc_id").agg(F.min("toc_page").alias("toc_page")), "doc_id").filter("toc_page > 1 and cover <> ''")
    top = dominant_headings(headings).withColumnRenamed("page", "physical_page")
    rows = entries.filter("physical_page is not null").join(top, ["doc_id", "physical_page"], "left").join(covers.select("doc_id", "cover"), "doc_id", "left")
    rows = rows.withColumn("lv", F.least(F.lit(DEEPEST), effective_level(F.col("level"), F.col("title"), F.col("dominant"), F.col("size"))).cast("int"))
    rows = rows.withColumn("title", resolved_title(F.col("title"), F.col("dominant"), F.col("size")))
    order = Window.partitionBy("doc_id").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, DEEPEST + 1):
        rows = rows.withColumn(f"_g{k}", F.sum((F.col("lv") < k).cast("int")).over(order))
        count = F.sum((F.col("lv") == k).cast("int")).over(Window.partitionBy("doc_id", f"_g{k}").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(f"_c{k}", count)
    seed = F.when(F.col("cover").isNotNull() & (F.col("_c1") > 0), 1).otherwise(0)
    numbers = F.slice(F.array((F.col("_c1") + seed).cast("string"), *[F.col(f"_c{k}").cast("string") for k in range(2, DEEPEST + 1)]), F.lit(1), F.col("lv"))
    numbers = F.when(F.col("cover").isNotNull(), F.concat(F.array(F.lit("0")), numbers)).otherwise(numbers)
    body = rows.select("doc_id", (F.col("entry") + 2).cast("long").alias("at"), F.array_join(numbers, ".").alias("structure"), "title", F.col("physical_page").cast("long").alias("page"))
    front = covers.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("0").alias("structure"), F.col("cover").alias("title"), F.lit(1).cast("long").alias("page")),
        F.struct(F.lit(1).cast("long").alias("at"), F.lit("0.1").alias("structure"), F.lit(CONTENTS).alias("title"), F.col("toc_page").cast("long").alias("page")),
    )).alias("f")).select("doc_id", "f.*")
    out = front.unionByName(body)
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).drop("at")


def heading_outline(headings: DataFrame) -> DataFrame:
    """doc_id, structure, title, page: the pages' headings as chapters, those that repeat the one before left out."""
    rows = heading_titles(headings).withColumn("key", T.page_key(F.col("title")))
    w = Window.partitionBy("doc_id").orderBy("page")
    rows = rows.withColumn("_last", F.lag("key").over(w)).filter(~F.col("key").eqNullSafe(F.col("_last")))
    return rows.select("doc_id", F.row_number().over(w).cast("string").alias("structure"), "title", "page")


def top_line_titles(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, title: up to three lines from the top of a page, until they are long enough or numbered."""
    near = lines.join(pages.select("doc_id", "page", "page_height"), ["doc_id", "page"]).filter(F.col("y") <= F.col("page_height") * TOP_SHARE)
    w = Window.partitionBy("doc_id", "page").orderBy("y", "x", "line")
    rows = near.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").withColumn("t", T.squeeze(F.col("text")))
    rows = rows.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]).alias("parts"))
    for k in (1, 2, 3):  # columns of their own, so that each is computed once
        rows = rows.withColumn(f"_t{k}", T.output_title(F.array_join(F.filter(F.slice("parts", 1, k), lambda x: x != ""), " ")))
    good = [F.when((F.length(f"_t{k}") >= 6) | T.is_numbered(F.col(f"_t{k}")), F.col(f"_t{k}")) for k in (1, 2, 3)]
    title = F.trim(F.substring(F.coalesce(*good, F.col("_t3")), 1, TITLE_CHARS))
    return rows.select("doc_id", "page", F.nullif(title, F.lit("")).alias("title")).filter("title is not null")


def plain_title(plain: Column) -> Column:
    """The first sentence of a page's text."""
    t = T.output_title(F.trim(F.split(T.squeeze(plain), "[。！？!?；;\\n]", 2)[0]))
    return F.nullif(F.when(F.length(t) > TITLE_CHARS, F.regexp_replace(F.substring(t, 1, TITLE_CHARS), "[，。；;:： ]+$", "")).otherwise(t), F.lit(""))


def viable_title(title: Column) -> Column:
    """Whether a trimmed title is short and telling enough for a section; not if it is null."""
    t, numbered = title, T.is_numbered(title)
    short = (F.length(t) < 4) & ~numbered & ~t.rlike(r"(?i)^Q\d+$")
    return t.isNotNull() & (t != "") & (T.page_key(t) != CONTENTS) & ~short & ~(T.sentence_like(t) & ~numbered)


def page_titles(pages: DataFrame, lines: DataFrame, headings: DataFrame) -> DataFrame:
    """pages with title: from a heading, the top lines or the text, the first that is viable; null where none is."""
    rows = pages.join(heading_titles(headings).withColumnRenamed("title", "_h"), ["doc_id", "page"], "left")
    rows = rows.join(top_line_titles(lines, pages).withColumnRenamed("title", "_l"), ["doc_id", "page"], "left")
    rows = rows.withColumn("_p", plain_title(F.coalesce("plain_text", F.lit(""))))
    return rows.withColumn("title", F.coalesce(*[F.when(viable_title(F.col(c)), F.col(c)) for c in ("_h", "_l", "_p")])).drop("_h", "_l", "_p")


def page_tree(pages: DataFrame, lines: DataFrame, headings: DataFrame) -> DataFrame:
    """A root section for each page with a title and text, if its title is not that of the section before.

    Columns as normalize.normalise_trees takes them.
    """
    text = T.squeeze_ends(F.coalesce("plain_text", F.lit("")))
    rows = page_titles(pages, lines, headings).filter(page_has_text(F.col("plain_text"), F.col("block_count")) & F.col("title").isNotNull())
    rows = rows.select("doc_id", "page", "title", text.alias("text")).filter("text <> ''").withColumn("key", bare_key(F.col("title")))
    w = Window.partitionBy("doc_id").orderBy("page")
    rows = rows.withColumn("_last", F.lag("key").over(w)).filter((F.col("key") == "") | ~F.col("key").eqNullSafe(F.col("_last")))
    return rows.select(
        "doc_id", F.col("page").cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), (F.row_number().over(w) - 1).alias("ord"), "title", F.col("page").cast("int").alias("page_index"), "text",
        T.truncate_summary(T.squeeze(F.col("text"))).alias("summary"), F.lit("").alias("node_id"),
    )


def candidate_plan(confidence: Column, n_entries: Column, strategy: str = "auto") -> Column:
    """The builders to try, in order; a strategy that is not auto stands alone."""
    if strategy != "auto":
        return F.array(F.lit(strategy))
    of = lambda *names: F.array(*map(F.lit, names))
    sure = F.when(confidence == "high", of("outline", "native", "layout")).when((confidence == "low") & (n_entries > 0), of("native", "outline", "layout"))
    return sure.otherwise(of("native", "layout"))


def out_of_cover(sections: DataFrame) -> DataFrame:
    """Sections after the second below a cover become its siblings, right after it.

    A cover is the first of its siblings, on page 1, with three children or more of which the first is the contents.
    sections: doc_id, node, parent, ord, title, page_index and others, which are kept; ord is numbered anew.
    """
    w = Window.partitionBy("doc_id", "parent").orderBy("ord", "node")
    rows = sections.withColumn("_nth", F.row_number().over(w))
    kids = rows.filter("parent is not null").groupBy("doc_id", F.col("parent").alias("node")).agg(F.count("*").alias("_n"), F.max(F.when(F.col("_nth") == 1, F.col("title"))).alias("_first"))
    covers = rows.filter("_nth = 1 and page_index = 1").join(kids.filter((F.col("_n") >= 3) & (F.col("_first") == CONTENTS)), ["doc_id", "node"])
    covers = covers.select("doc_id", F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("_nth").alias("_at"), F.lit(True).alias("_out"))
    rows = rows.join(covers, ["doc_id", "parent"], "left").withColumn("_out", F.coalesce("_out", F.lit(False)) & (F.col("_nth") > 2))
    place = F.struct(F.when(F.col("_out"), F.col("_at")).otherwise(F.col("_nth")).alias("a"), F.when(F.col("_out"), F.col("_nth")).otherwise(0).alias("b"))
    rows = rows.withColumn("_place", place).withColumn("parent", F.when(F.col("_out"), F.col("_up")).otherwise(F.col("parent")))
    order = Window.partitionBy("doc_id", "parent").orderBy("_place")
    return rows.withColumn("ord", F.row_number().over(order) - 1).select(sections.columns)
