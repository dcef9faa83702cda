"""Output trees put in order: chapter markers, implied numbering, sibling duplicates, weak roots, ids and summaries.

Sections: doc_id, node, parent (null at the root), ord (place among siblings), title, page_index, text, summary,
node_id. What follows from a title alone is computed by the engine; a tree's shape depends on the order in which its
siblings are visited, so documents go through Python one after the other, each held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T

LEAST_ROOTS = 8
OUT = "node string, parent string, ord int, preorder int, depth int, title string, page_index int, text string, summary string"


def bare_key(title: Column) -> Column:
    """A title's comparison key without its number."""
    return T.page_key(T.without_number(T.output_title(title)))


@dataclass(eq=False)
class Section:
    title: str
    page: int | None
    text: str = ""
    summary: str = ""
    node_id: str = ""
    key: str = ""
    number: str | None = None
    marker: bool = False
    weak: bool = False
    below: list[Section] = field(default_factory=list)


def under_markers(group: list[Section]) -> list[Section]:
    """Siblings after a chapter marker move below it unless their page lies before it; one marker alone moves nothing."""
    if sum(s.marker for s in group) < 2:
        return group
    top, chapter = [], None
    for s in group:
        inside = not s.marker and chapter and None not in (chapter.page, s.page) and s.page >= chapter.page
        (chapter.below if inside else top).append(s)
        chapter = s if s.marker else chapter
    return top


def by_number(group: list[Section]) -> list[Section]:
    """2.1.3 moves below 2.1, which is made up if it is missing; a later section of the same number takes its place."""
    if sum(s.number is not None for s in group) < 2:
        return group
    top, known = [], {}

    def home(number: str, page: int | None) -> list[Section]:
        """The list that sections directly below number belong to."""
        if not number:
            return top
        if number not in known:
            known[number] = made = Section(number, page, key=number.lower(), number=number)
            home(number.rpartition(".")[0], page).append(made)
        return known[number].below

    for s in group:
        if s.number is None:
            top.append(s)
        else:
            home(s.number.rpartition(".")[0], s.page).append(s)
            known[s.number] = s
    return top


def without_copies(group: list[Section]) -> list[Section]:
    """The first of siblings with equal key and page takes the others' children, the longest text and a summary."""
    firsts: dict[tuple, Section] = {}
    for s in group:
        first = firsts.setdefault((s.key, s.page), s)
        if first is not s:
            first.below += s.below
            first.text = max(first.text, s.text, key=len)
            first.summary = first.summary or s.summary
    for s in firsts.values():
        s.below = without_copies(s.below)
    return list(firsts.values())


def in_order(group: list[Section]) -> list[Section]:
    for s in group:
        s.below = in_order(s.below)
    return without_copies(by_number(under_markers(group)))


def without_weak_roots(group: list[Section]) -> list[Section]:
    strong = [s for s in group if s.below or not s.weak]
    return strong if len(group) >= LEAST_ROOTS and strong else group


def fill_ids(group: list[Section], taken: set[str], path: tuple[int, ...] = ()) -> None:
    """Children before parents: an id that is missing or taken is made from page, place and title."""
    for i, s in enumerate(group, 1):
        here = (*path, i)
        dotted = ".".join(map(str, here))
        s.title = s.title or f"Section {dotted}"
        fill_ids(s.below, taken, here)
        if not s.node_id or s.node_id in taken:
            s.node_id = f"synthetic:{'na' if s.page is None else s.page}:{dotted}:{s.key or 'untitled'}"
            while s.node_id in taken:
                s.node_id += f":{len(taken) + 1}"
        taken.add(s.node_id)


def normalise_trees(sections: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """doc_id, node, parent, ord, preorder, depth (from 0), title, page_index, text, summary of the ordered trees.

    aligned (doc_id, node) names sections whose title agrees with a heading of their page; they are never weak.
    Null titles, texts and summaries count as empty. A section whose parent is missing becomes a root.
    """
    rows = sections
    if aligned is not None:
        rows = rows.join(aligned.select("doc_id", "node").distinct().withColumn("_good", F.lit(True)), ["doc_id", "node"], "left")
    rows = rows.withColumn("_good", F.coalesce("_good", F.lit(False)) if aligned is not None else F.lit(False))
    rows = rows.withColumn("title", T.output_title(F.coalesce("title", F.lit(""))))  # a column of its own, computed once
    t = F.col("title")
    rows = rows.select(
        "doc_id", F.col("node").cast("string"), F.col("parent").cast("string"), F.col("ord").cast("long"), "title", F.col("page_index").cast("double").alias("page"),
        F.coalesce("text", F.lit("")).alias("text"), F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), F.trim(F.coalesce("node_id", F.lit(""))).alias("node_id"), T.page_key(T.without_number(t)).alias("key"),
        T.section_number(t)["key"].alias("number"), T.chapter_marker(t).alias("marker"), ((T.sentence_like(t) | T.caption_like(t)) & ~F.col("_good")).alias("weak"),
    )
    kind = dict(rows.dtypes)["doc_id"]

    def tree(doc, given: list[tuple]) -> list[tuple]:
        """given: the columns of rows after doc_id, of one document, in sibling order."""
        made = {r[0]: Section(r[3], None if r[4] is None else int(r[4]), r[5], r[6], r[7], r[8] or "", r[9], bool(r[10]), bool(r[11])) for r in given}
        roots = []
        for node, parent, *_ in given:
            (made[parent].below if parent in made and parent != node else roots).append(made[node])
        roots = without_weak_roots(in_order(roots))
        fill_ids(roots, set())
        out = []
        todo = [(s, None, i, 0) for i, s in reversed(list(enumerate(roots)))]
        while todo:
            s, parent, i, depth = todo.pop()
            out.append((doc, s.node_id, parent, i, len(out), depth, s.title, s.page, s.text, s.summary))
            todo += [(c, s.node_id, j, depth + 1) for j, c in reversed(list(enumerate(s.below)))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, doc, doc_kind = [], None, None
        for b in batches:
            doc_kind, done = b.column(0).type, []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if given and row[0] != doc:
                    done += tree(doc, given)
                    given = []
                doc = row[0]
                given.append(row[1:])
            yield batch_of(done, doc_kind)
        if given:
            yield batch_of(tree(doc, given), doc_kind)

    def batch_of(rows: list[tuple], doc_kind: pa.DataType) -> pa.RecordBatch:
        word, number = pa.string(), pa.int32()
        kinds = {"doc_id": doc_kind, "node": word, "parent": word, "ord": number, "preorder": number, "depth": number, "title": word, "page_index": number, "text": word, "summary": word}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("ord").asc_nulls_last(), "node")
    return fill_summaries(rows.mapInArrow(run, f"doc_id {kind}, {OUT}"))


def fill_summaries(trees: DataFrame) -> DataFrame:
    """An empty summary comes from the text, else from the first two children's titles, else from the title."""
    kids = trees.filter("parent is not null and trim(title) <> ''").groupBy("doc_id", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("kids"))
    rows = trees.join(kids, ["doc_id", "node"], "left")
    preview = F.array_join(F.transform(F.slice("kids", 1, 2), lambda k: F.trim(k["title"])), "；")
    named = (F.col("title") != "") & ~F.contains(preview, F.col("title")) & ~T.chapter_marker(F.col("title"))
    preview = F.when(named, F.concat("title", F.lit("："), preview)).otherwise(preview)
    made = F.coalesce(F.nullif(T.squeeze(F.col("text")), F.lit("")), preview, F.nullif(F.col("title"), F.lit("")), F.lit("Section"))
    return rows.withColumn("summary", F.when(F.col("summary") != "", F.col("summary")).otherwise(T.truncate_summary(made))).drop("kids")
