"""Outlines of paged documents: contents pages, entries and levels, page offsets, headings, picture regions.

Pages come as tables, extracted beforehand: pages (doc_id, page from 1, plain_text, block_count), lines (doc_id, page,
line, text, x), spans (doc_id, page, span, text, size, bold, x, y). Every step partitions by document or page, so no
step gathers more than one document's front matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as T

FRONT_PAGES = 20
OFFSETS = (-3, 5)
PROBED_ENTRIES = 8
COLUMN_GAP, LEVEL_GAP = 120.0, 15.0
STRUCTURE_NUMBER = r"^(?:\d+(?:\.\d+)*|[一二三四五六七八九十]+[、.]|[（(][一二三四五六七八九十\d]+[）)])"


def contents_line(t: Column) -> Column:
    """struct(title, page) of a line that ends in a page number; null where it has none or no title."""
    t = T.squeeze(t)
    page = F.regexp_extract(t, r"(\d+)$", 1)
    title = F.regexp_replace(F.regexp_replace(t, r"[ .…:：\t\x{FFFD}]*\d+$", ""), r"^•+", "")
    title = F.trim(title)
    return F.when((page != "") & (title != ""), F.struct(title.alias("title"), F.try_to_number(page, F.lit("9" * 18)).cast("long").alias("page")))


def plausible_page(page: Column, total: Column) -> Column:
    return F.coalesce(page.between(1, F.greatest(3 * total, total + 20)), F.lit(False))


def contents_scores(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, score, titled of the front pages that look like contents."""
    front = pages.filter(F.col("page") <= FRONT_PAGES)
    parsed = lines.filter(F.col("page") <= FRONT_PAGES).groupBy("doc_id", "page").agg(F.count(contents_line(F.col("text"))).alias("parsed"))
    leaders = F.size(F.regexp_extract_all("plain_text", F.lit(r"(?:\.{4,}|…{2,}|：|:)\s*\d+"), F.lit(0)))
    rows = front.join(parsed, ["doc_id", "page"], "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    rows = rows.withColumn("leaders", leaders).withColumn("titled", F.contains("plain_text", F.lit("目录")))
    rows = rows.filter(F.col("titled") | (F.greatest("leaders", "parsed") >= 2))
    score = F.when(F.col("titled"), 10).otherwise(0) + F.col("leaders") + F.least("parsed", F.lit(5)) + F.when(F.col("block_count") <= 20, 1).otherwise(0)
    return rows.select("doc_id", "page", score.cast("long").alias("score"), "titled").filter("score > 0")


def contents_pages(scores: DataFrame) -> DataFrame:
    """The run of consecutive scored pages around the best one (the lowest of equals): doc_id, page, score, titled."""
    run = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    rows = scores.withColumn("run", run)
    best = F.max_by("run", F.struct("score", -F.col("page"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("best", best).filter("run = best").drop("run", "best")


def indent_levels(rows: DataFrame, x: str = "x", key: str = "doc_id") -> DataFrame:
    """Adds level: a gap over COLUMN_GAP starts a new column, one over LEVEL_GAP the next level within it."""
    at = F.round(F.col(x), 1)
    each = rows.select(key, at.alias("_at")).distinct()
    w = Window.partitionBy(key).orderBy("_at")
    gap = F.col("_at") - F.lag("_at").over(w)
    each = each.withColumn("_gap", F.coalesce(gap, F.lit(0.0))).withColumn("_column", F.sum((F.col("_gap") > COLUMN_GAP).cast("int")).over(w))
    inner = Window.partitionBy(key, "_column").orderBy("_at")
    each = each.withColumn("level", 1 + F.sum(F.col("_gap").between(LEVEL_GAP + 1e-9, COLUMN_GAP).cast("int")).over(inner))
    return rows.withColumn("_at", at).join(each.select(key, "_at", "level"), [key, "_at"]).drop("_at")


def page_offset(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_offset: the shift under which most of the first entries' titles occur on their page.

    The smallest of equal shifts wins, so a document without any hit gets the smallest of all.
    """
    first = entries.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry"))).filter(F.col("rn") <= PROBED_ENTRIES)
    tried = first.select("doc_id", T.page_key(F.col("title")).alias("want"), "printed_page", F.explode(F.sequence(F.lit(OFFSETS[0]), F.lit(OFFSETS[1]))).alias("page_offset"))
    tried = tried.withColumn("page", F.col("printed_page") + F.col("page_offset"))
    needed = pages.join(tried.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").select("doc_id", "page", T.page_key(F.col("plain_text")).alias("have"))
    hit = (F.col("want") != "") & F.contains("have", F.col("want"))
    counted = tried.join(needed, ["doc_id", "page"], "left").groupBy("doc_id", "page_offset").agg(F.count_if(hit).alias("hits"))
    return counted.groupBy("doc_id").agg(F.max_by("page_offset", F.struct("hits", -F.col("page_offset"))).alias("page_offset"))


def outline_entries(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, entry, title, printed_page, physical_page, level, toc_page, x of every entry of the contents pages."""
    found = contents_pages(contents_scores(pages, lines))
    first = found.groupBy("doc_id").agg(F.min("page").alias("toc_page"))
    total = pages.groupBy("doc_id").agg(F.max("page").alias("total"))
    rows = lines.join(found.select("doc_id", "page"), ["doc_id", "page"], "left_semi").join(first, "doc_id").join(total, "doc_id")
    rows = rows.withColumn("c", contents_line(F.col("text"))).filter(F.col("c").isNotNull() & plausible_page(F.col("c.page"), F.col("total")) & (F.col("c.title") != "目录"))
    same = Window.partitionBy("doc_id", T.page_key(F.col("c.title")), "c.page").orderBy("page", "line")
    rows = rows.withColumn("rn", F.row_number().over(same)).filter("rn = 1")
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    rows = rows.select("doc_id", (F.row_number().over(order) - 1).alias("entry"), F.col("c.title").alias("title"), F.col("c.page").alias("printed_page"), "toc_page", "total", "x")
    rows = indent_levels(rows).join(page_offset(rows, pages), "doc_id")
    at = F.col("printed_page") + F.col("page_offset")
    return rows.select("doc_id", "entry", "title", "printed_page", F.when(at.between(1, F.col("total")), at).alias("physical_page"), "level", "toc_page", "x")


def outline_confidence(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Per document with contents pages: the signals that its outline can be trusted, and high, low or none."""
    ratio = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), F.count("*").cast("double")), F.lit(0.0))
    of = entries.groupBy("doc_id").agg(
        F.count("*").alias("n_entries"), ratio(F.col("physical_page").isNotNull()).alias("mapped"), F.count_distinct(F.greatest(F.lit(1), "level")).alias("n_levels"),
        ratio(F.trim("title").rlike(STRUCTURE_NUMBER)).alias("numbered"), (F.max("physical_page") - F.min("physical_page")).alias("page_span"),
    )
    by = found.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.bool_or("titled").alias("titled"))
    rows = by.join(of, "doc_id", "left").fillna({"n_entries": 0, "mapped": 0.0, "n_levels": 0, "numbered": 0.0, "page_span": 0})
    signals = [F.col("titled") | (F.col("n_pages") >= 2), F.col("n_entries") >= 5, F.col("mapped") >= 0.6, (F.col("n_levels") >= 2) | (F.col("numbered") >= 0.4), F.col("page_span") >= 3]
    rows = rows.withColumn("signals", sum((s.cast("long") for s in signals), F.lit(0).cast("long")))
    sure = F.when(F.col("signals") >= 4, "high").when(F.col("signals") >= 2, "low").otherwise("none")
    return rows.withColumn("confidence", sure).withColumn("score", F.round(F.col("signals") / 5.0, 3)).withColumn("mapped", F.round("mapped", 3)).withColumn("numbered", F.round("numbered", 3))


def heading_candidates(spans: DataFrame, most: int = 10) -> DataFrame:
    """The first spans of each page, from the top, that are larger than its body text or bold: adds rank."""
    page = Window.partitionBy("doc_id", "page")
    body = F.coalesce(F.nullif(F.median(F.when(F.length("text") >= 2, F.col("size"))).over(page), F.lit(0.0)), F.lit(12.0))
    rows = spans.withColumn("body", body).filter((F.length("text") <= 80) & ((F.col("size") >= F.col("body") * 1.2) | (F.col("bold") & (F.col("size") >= F.col("body") * 0.95))))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "page", T.page_key(F.col("text"))).orderBy("y", "x", "span"))).filter("rn = 1")
    rows = rows.withColumn("rank", F.row_number().over(page.orderBy("y", "x", "span"))).filter(F.col("rank") <= most)
    return rows.select("doc_id", "page", "rank", F.col("text").alias("title"), F.round("size", 2).alias("size"), "bold", "x", "y")


def heading_matches(nodes: DataFrame, headings: DataFrame, key: str = "node") -> DataFrame:
    """doc_id and key of nodes whose title agrees with one of the first five headings of their page."""
    bare = lambda t: T.page_key(T.without_number(t))
    h = headings.filter("rank <= 5").select("doc_id", F.col("page").alias("page_index"), bare(F.col("title")).alias("h_key")).filter("h_key <> ''")
    n = nodes.select("doc_id", key, "page_index", bare(F.col("title")).alias("n_key")).filter("n_key <> ''")
    return n.join(h, ["doc_id", "page_index"]).filter(T.titles_overlap(F.col("n_key"), F.col("h_key"))).select("doc_id", key).distinct()


def nearby_entries(entries: DataFrame, wanted: DataFrame, radius: int = 2, fallback: int = 6) -> DataFrame:
    """Entries for each (doc_id, page) in wanted: those within radius pages, else the document's first mapped ones."""
    mapped = entries.filter("physical_page is not null").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")))
    by_page = mapped.select("*", F.explode(F.sequence(F.col("physical_page") - radius, F.col("physical_page") + radius)).alias("page"))
    near = wanted.select("doc_id", "page").distinct().join(by_page, ["doc_id", "page"])
    none = wanted.select("doc_id", "page").distinct().join(near, ["doc_id", "page"], "left_anti")
    return near.unionByName(none.join(mapped.filter(F.col("nth") <= fallback), "doc_id").select(near.columns)).drop("nth")


def best_candidate(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per key: the best score, unless the next is within 1 of it and deeper, with fewer roots or better aligned.

    candidates: key, name, score, max_depth, root_count, heading_alignment.
    """
    shape = F.struct(F.col("max_depth"), (-F.col("root_count")).alias("r"), F.col("heading_alignment"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("shape"), "name")
    rows = candidates.withColumn("shape", shape).withColumn("rn", F.row_number().over(w))
    ahead = F.lag(F.struct("score", "shape")).over(w)
    better = (F.col("rn") == 2) & (F.abs(ahead["score"] - F.col("score")) <= 1.0) & (F.col("shape") > ahead["shape"])
    rows = rows.withColumn("turn", F.when(F.coalesce(better, F.lit(False)), 0).otherwise(F.col("rn"))).filter("rn <= 2")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("turn"))).filter("rn = 1").drop("rn", "turn", "shape")


def match_entries(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, line, entry, level: each header in turn takes the best entry still free.

    Equal titles come before entries contained in the header, those before entries that contain it; the earliest of
    equals wins. Keys are made by the engine; the order-dependent choice runs through each document's titles in one task,
    document after document, and compares distinct keys, each pair once.
    entries: doc_id, entry, title, level; headers: doc_id, line, title.
    """
    e = entries.select("doc_id", F.lit(0).alias("kind"), F.col("entry").cast("long").alias("pos"), F.col("level").cast("int"), T.markdown_key(F.col("title")).alias("key"))
    h = headers.select("doc_id", F.lit(1).alias("kind"), F.col("line").cast("long").alias("pos"), F.lit(0).alias("level"), T.markdown_key(F.col("title")).alias("key"))
    rows = e.unionByName(h).filter("key is not null")

    def settled(doc, given: list[tuple]) -> list[tuple]:
        """given: (kind, pos, level, key) of a document, entries first, in order."""
        free: dict[str, deque] = {}
        fits: dict[str, list[list[str]]] = {}
        out = []
        for kind, pos, level, key in given:
            if not kind:
                free.setdefault(key, deque()).append((pos, level))
                continue
            if key not in fits:
                fits[key] = [[key] if key in free else [], [k for k in free if k and k != key and k in key], [k for k in free if key and k != key and key in k]]
            for keys in fits[key]:
                heads = [(free[k][0], k) for k in keys if free[k]]
                if heads:
                    (entry, own), first = min(heads)
                    free[first].popleft()
                    out.append((doc, pos, entry, own))
                    break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, given, kind_of = None, [], None
        for b in batches:
            kind_of = b.column(0).type
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != doc:
                    out += settled(doc, given)
                    doc, given = row[0], []
                given.append(row[1:])
            yield matched(out, kind_of)
        if given:
            yield matched(settled(doc, given), kind_of)

    def matched(out: list[tuple], kind_of: pa.DataType) -> pa.RecordBatch:
        kinds = (kind_of, pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "line", "entry", "level"])

    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.select("doc_id", "kind", "pos", "level", "key").repartition("doc_id").sortWithinPartitions("doc_id", "kind", "pos")
    return rows.mapInArrow(run, f"doc_id {kind}, line long, entry long, level int")


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Coordinates as doubles, 0 for null."""
    return F.struct(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (left, top, right, bottom), strict=True)])


def grown(b: Column, width: Column, height: Column, by: float = 8.0) -> Column:
    zero = F.lit(0.0)
    return box(F.greatest(zero, b["x0"] - by), F.greatest(zero, b["y0"] - by), F.least(width, b["x1"] + by), F.least(height, b["y1"] + by))


def joined(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def touching(a: Column, b: Column, gap: float = 24.0) -> Column:
    return (a["x0"] - b["x1"] <= gap) & (b["x0"] - a["x1"] <= gap) & (a["y0"] - b["y1"] <= gap) & (b["y0"] - a["y1"] <= gap)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def absorb(boxes: Iterable[list[float]], gap: float = 24.0) -> list[list[float]]:
    """One pass: every box joins the first earlier region it comes within gap of, or is a region of its own."""
    regions: list[list[float]] = []
    for b in boxes:
        x0, y0, x1, y1 = b
        for r in regions:
            if r[0] - x1 <= gap and x0 - r[2] <= gap and r[1] - y1 <= gap and y0 - r[3] <= gap:
                r[:] = min(r[0], x0), min(r[1], y0), max(r[2], x1), max(r[3], y1)
                break
        else:
            regions.append([x0, y0, x1, y1])
    return regions


def picture_regions(boxes: DataFrame, most: int = 4, gap: float = 24.0, least_share: float = 0.015) -> DataFrame:
    """doc_id, page, region, x0, y0, x1, y1: boxes of a page merged while any two come within gap, small ones dropped.

    boxes: doc_id, page, width, height, x0, y0, x1, y1. Merging depends on order (from the top, then from the left), so each
    page goes through absorb(); a task takes its pages one after the other, as their sorted boxes stream in.
    """
    rows = boxes.withColumn("b", grown(box(*map(F.col, ("x0", "y0", "x1", "y1"))), F.col("width"), F.col("height")))
    raw = rows.select("doc_id", "page", F.col("width").cast("double"), F.col("height").cast("double"), F.col("y0").cast("double").alias("top"), F.col("x0").cast("double").alias("left"), "b.*")
    raw = raw.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", F.asc_nulls_last("top"), F.asc_nulls_last("left"), "y1", "x1", "width", "height")
    names = ["doc_id", "page", "width", "height", "x0", "y0", "x1", "y1"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, out = [], []

        def typed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in given:
                types[:] = [b.column(n).type for n in names]
                yield b

        for page, group in groupby(pieces(typed(batches)), lambda r: r[:2]):
            first = next(group)
            now = absorb(chain([first[4:]], (r[4:] for r in group)), gap)
            while len(again := absorb(now, gap)) < len(now):
                now = again
            out += [(*page, first[2], first[3], *b) for b in now]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    merged = raw.mapInArrow(merge, raw.select(*names).schema)
    b = F.struct("x0", "y0", "x1", "y1")
    kept = merged.filter((area(b) >= F.col("width") * F.col("height") * least_share) & (F.col("y0") < F.col("height") * 0.95))
    kept = kept.withColumn("region", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "y1", "x1")))
    return kept.filter(F.col("region") <= most).select("doc_id", "page", "region", "x0", "y0", "x1", "y1")
