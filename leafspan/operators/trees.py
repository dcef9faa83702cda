"""Tree measures and comparison over section rows (doc_id, section_id, parent_id, depth, title, page_index, preorder)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.operators.normalize import bare_key
from leafspan.operators.outline import heading_matches


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), 4), F.lit(0.0))


def tree_metrics(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    back = F.coalesce((F.col("page_index") < F.lag("page_index").over(Window.partitionBy(key).orderBy("preorder"))).cast("int"), F.lit(0))
    rows = sections.withColumn("back", back)
    return rows.groupBy(key).agg(
        F.count("*").alias("node_count"), F.count_if(F.col("parent_id").isNull()).alias("root_count"), F.max("depth").alias("max_depth"),
        F.count_distinct("page_index").alias("pages_covered"), (F.count("*") - F.count_distinct("title")).alias("duplicate_titles"), F.sum("back").cast("long").alias("page_backtracks"),
        ratio(F.count("page_index"), F.count("*")).alias("page_coverage"),
    )


def depth_histogram(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    return sections.groupBy(key, "depth").agg(F.count("*").alias("nodes"))


def _titles(tree: DataFrame, order: Column, name: str) -> DataFrame:
    rows = tree.withColumn("rn", F.row_number().over(Window.partitionBy("title").orderBy(order))).filter("rn = 1")
    length = F.length(F.coalesce("text", F.lit(""))) if "text" in tree.columns else F.lit(None).cast("int")
    return rows.select("title", F.col("page_index").alias(name), length.alias(f"{name}_length"), F.lit(1).alias(f"in_{name}"))


def comparison_report(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: matched titles, precision, recall, shares of matched titles on the same page and within one page, and
    examples: 30 missing and 30 unexpected titles, 20 pages over one apart, 15 lengths of matched titles' texts.

    Of repeated titles the first actual and the last expected one count. Both: title, page_index, preorder and text (which
    may be left out). Examples are the first in title order.
    """
    both = _titles(actual, F.asc("preorder"), "a").join(_titles(expected, F.desc("preorder"), "e"), "title", "full_outer")
    hit = F.col("in_a").isNotNull() & F.col("in_e").isNotNull()
    paged = hit & F.col("a").isNotNull() & F.col("e").isNotNull()
    apart = paged & (F.abs(F.col("a") - F.col("e")) > 1)
    examples = {
        "missing": (F.col("in_a").isNull(), F.col("title"), 30), "unexpected": (F.col("in_e").isNull(), F.col("title"), 30),
        "mismatches": (apart, F.struct("title", F.col("a").alias("actual"), F.col("e").alias("expected")), 20), "lengths": (hit, F.struct("title", F.col("a_length").alias("actual"), F.col("e_length").alias("expected")), 15),
    }
    # only rows that may be an example are gathered: a rank in title order within each kind
    for name, (which, _, most) in examples.items():
        first = both.filter(which).orderBy("title").limit(most).select("title", F.lit(True).alias(f"_{name}"))
        both = both.join(F.broadcast(first), "title", "left")
    lists = [F.array_sort(F.collect_list(F.when(F.col(f"_{name}"), value))).alias(name) for name, (_, value, _) in examples.items()]
    return both.agg(
        F.count_if(hit).alias("matched"), ratio(F.count_if(hit), F.count("in_a")).alias("title_precision"), ratio(F.count_if(hit), F.count("in_e")).alias("title_recall"),
        ratio(F.count_if(paged & ~apart), F.count_if(hit)).alias("within_one"), ratio(F.count_if(paged & (F.col("a") == F.col("e"))), F.count_if(hit)).alias("exact_page"), *lists,
    )


def compare_trees(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The measures of the comparison report without its examples."""
    return comparison_report(actual, expected).select("matched", "title_precision", "title_recall", "within_one", "exact_page")


def flatten_tree(tree: list[dict], doc_id: str) -> list[dict]:
    """Section rows of a tree given as nested nodes (title, node_id, page_index, text, summary, nodes), in preorder.

    Depth counts from 0; title_path joins the titles from the root; parents are named by node_id.
    """
    out: list[dict] = []
    todo = [(n, None, (), 0) for n in reversed(tree)]
    while todo:
        node, parent, above, depth = todo.pop()
        below = node.get("nodes") or []
        titles = (*above, node.get("title") or "")
        out.append({
            "doc_id": doc_id, "node_id": node.get("node_id"), "parent_id": parent, "preorder": len(out), "depth": depth, "title": titles[-1], "title_path": " > ".join(titles),
            "page_index": node.get("page_index"), "text": node.get("text") or "", "summary": node.get("summary") or "", "is_leaf": not below,
        })
        todo += [(n, node.get("node_id"), titles, depth + 1) for n in reversed(below)]
    return out


def section_records(sections: DataFrame) -> DataFrame:
    """The seven stored columns of sections."""
    return sections.select("section_id", "parent_id", "doc_id", "node_id", "title", "depth", "summary")


def nested_json(sections: DataFrame, levels: int = 6) -> DataFrame:
    """doc_id and result: each document's sections (node_id, parent_id, ord, title, page_index, text) as nested JSON.

    Levels are folded from the deepest up; nodes without children have no list of them.
    """
    rows = sections.withColumn("_own", F.struct("title", "node_id", "page_index", "text")).withColumn("_json", F.to_json("_own"))
    for _ in range(levels):
        kids = rows.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "_json"))), lambda x: x["_json"]), ",").alias("_kids"))
        own = F.to_json("_own")
        rows = rows.drop("_json", "_kids").join(kids, ["doc_id", "node_id"], "left")
        rows = rows.withColumn("_json", F.when(F.col("_kids").isNull(), own).otherwise(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"nodes":['), "_kids", F.lit("]}"))))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "_json"))), lambda x: x["_json"]), ",")
    return rows.filter("parent_id is null").groupBy("doc_id").agg(F.concat(F.lit("["), top, F.lit("]")).alias("result"))


def dedupe_siblings(sections: DataFrame) -> DataFrame:
    """Siblings with one title key and page become one: longest text, first summary that is not empty."""
    first = F.col("preorder")
    return sections.groupBy("doc_id", "parent_id", "title_key", "page_index").agg(
        F.min_by("title", first).alias("title"), F.min("preorder").alias("preorder"), F.max_by("text", F.struct(F.length("text"), -first)).alias("text"),
        F.min_by("summary", F.when(F.col("summary") != "", first)).alias("summary"), F.count("*").alias("merged"),
    )


def islands(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive integers per key: first, last, size."""
    w = Window.partitionBy(key).orderBy(value)
    runs = rows.select(key, value).distinct().withColumn("grp", F.col(value) - F.row_number().over(w))
    return runs.groupBy(key, "grp").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size")).drop("grp")


def tree_quality(trees: DataFrame, total_pages: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """Per document: measures of a normalised tree (see normalize.py) for comparing candidates. total_pages: doc_id, total.

    Depth counts from 1 here. headings are those of outline.heading_candidates; without them nothing is aligned.
    """
    rows = trees.withColumn("depth", F.col("depth") + 1)
    hit = heading_matches(rows, headings) if headings is not None else rows.select("doc_id", "node").limit(0)
    parents = rows.filter("parent is not null").select("doc_id", F.col("parent").alias("node")).distinct()
    rows = rows.join(hit.withColumn("hit", F.lit(True)), ["doc_id", "node"], "left").join(parents.withColumn("inner", F.lit(True)), ["doc_id", "node"], "left")
    title, level = F.col("title"), T.section_number(F.col("title"))["level"]
    back = F.last("page_index", True).over(Window.partitionBy("doc_id").orderBy("preorder").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("back", F.coalesce(F.col("page_index") < back, F.lit(False))).withColumn("level", level).withColumn("key", bare_key(title))
    weak = F.col("parent").isNull() & F.col("inner").isNull() & F.col("hit").isNull() & (T.sentence_like(title) | T.caption_like(title))
    n = F.count("*")
    out = rows.groupBy("doc_id").agg(
        F.count_if(F.col("parent").isNull()).alias("root_count"), n.alias("node_count"), F.max("depth").cast("long").alias("max_depth"), F.count_distinct("page_index").alias("unique_page_count"),
        (n - F.count_distinct("key")).alias("duplicate_title_count"), ratio(F.count("hit"), n).alias("heading_alignment"), ratio(F.count_if(F.abs(F.col("level") - F.col("depth")) <= 1), F.count("level")).alias("numbering"),
        F.count_if("back").alias("page_backtrack_count"), F.count_if(weak).alias("bad_root_count"), F.count("inner").alias("internal_node_count"),
    )
    out = out.join(total_pages.select("doc_id", "total"), "doc_id", "left").withColumn("page_coverage", ratio(F.col("unique_page_count"), F.greatest(F.lit(1), F.coalesce("total", F.lit(1))))).drop("total")
    return out.withColumn("title_uniqueness", F.round(1.0 - F.col("duplicate_title_count") / F.col("node_count"), 4))


def tree_score(quality: DataFrame) -> DataFrame:
    """Adds breakdown, a struct of rounded terms, and score, their sum."""
    c = F.col
    cap = lambda limit, value: F.least(F.lit(limit), value)
    over = F.greatest(F.lit(0), c("root_count") - F.greatest(F.lit(8), c("max_depth") * 4))
    many = c("node_count") >= 10
    terms = {
        "non_empty": F.when(c("node_count") > 0, 30.0).otherwise(-1000.0), "page_coverage": c("page_coverage") * 20.0, "depth": cap(18.0, F.greatest(F.lit(0), c("max_depth") - 1) * 8.0),
        "internal_nodes": cap(12.0, c("internal_node_count") * 2.0), "root_shape": F.greatest(F.lit(0.0), 12.0 - 12.0 * F.coalesce(F.try_divide(c("root_count").cast("double"), c("node_count").cast("double")), F.lit(1.0))),
        "heading_alignment": c("heading_alignment") * 16.0, "numbering": c("numbering") * 12.0, "title_uniqueness": c("title_uniqueness") * 10.0,
        "flat": F.when(many & (c("root_count") == c("node_count")), -10.0).otherwise(0.0), "shallow": F.when(many & (c("max_depth") <= 1), -8.0).otherwise(0.0),
        "root_explosion": -2.0 * over, "bad_roots": -4.0 * c("bad_root_count"), "duplicates": -0.75 * c("duplicate_title_count"), "backtracks": -2.5 * c("page_backtrack_count"),
    }
    out = quality.withColumn("breakdown", F.struct(*[F.round(v.cast("double"), 3).alias(k) for k, v in terms.items()]))
    return out.withColumn("score", F.round(sum((c(f"breakdown.{k}") for k in terms), F.lit(0.0)), 3))
