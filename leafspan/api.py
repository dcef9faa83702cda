"""Index Markdown documents into section and chunk tables, and answer queries from them.

Model calls are injected: embed takes texts and gives vectors, rank takes localized sections and gives a ranking
(doc_id, section_id, rank), label takes evidence and gives labels (evidence_id, relation). Each may be left out.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan import models
from leafspan.config import Settings
from leafspan.functions import score as S
from leafspan.functions import text as T
from leafspan.operators import chunk as C
from leafspan.operators import fallback as FB
from leafspan.operators import markdown as M
from leafspan.operators import normalize as N
from leafspan.operators import outline as O
from leafspan.operators import retrieval as R
from leafspan.operators import trees as TR
from leafspan.sources import tables

Embed = Callable[[list[str]], list[list[float]]]
Profile = dict[str, dict[str, list[str]]]


@dataclasses.dataclass(frozen=True)
class Query:
    """A parsed query. terms are those to search for; times are years and quarters as they must stand in a text."""

    text: str
    language: str
    intent: str
    terms: list[str]
    times: list[str]
    years: list[int] = dataclasses.field(default_factory=list)
    quarters: list[str] = dataclasses.field(default_factory=list)
    names: dict[str, list[str]] = dataclasses.field(default_factory=dict)
    enriched: bool = False


def parse_query(spark: SparkSession, text: str, profile: Profile | None = None, model: models.Model | None = None) -> Query:
    """A query by rules; with a model, enriched where the rules found little. A model that fails changes nothing."""
    if not (text or "").strip():
        raise ValueError("the query is empty")
    names = profile or {}
    rows = spark.createDataFrame([(text,)], "raw string").select(T.squeeze(F.col("raw")).alias("q"))
    q = F.col("q")
    matched = F.struct(*[T.matched_names(q, names.get(f, {})).alias(f) for f in tables.PROFILE_FIELDS])
    row = rows.select("q", T.language(q).alias("language"), T.intent(q).alias("intent"), T.derived_terms(q).alias("terms"), T.time_scope(q).alias("scope"), matched.alias("names"), T.enrichment_reason(q).alias("reason")).first()
    scope = row["scope"]
    out = Query(row["q"], row["language"], row["intent"], row["terms"], [*map(str, scope["years"]), *scope["quarters"]], scope["years"], scope["quarters"], row["names"].asDict())
    if model is None or row["reason"] is None:
        return out
    try:
        return merge_query(out, models.payload(model(models.query_prompt(dataclasses.asdict(out)))), names)
    except Exception:  # noqa: BLE001
        return out


def merge_query(base: Query, more: dict, profile: Profile | None = None) -> Query:
    """base with what a model added: lists are united, language and intent replaced only where the rules knew none."""
    profile = profile or {}
    years, quarters = models.time_lists(more.get("time_scope"))
    years, quarters = sorted({*base.years, *years}), list(dict.fromkeys([*base.quarters, *quarters]))
    known = {f: {a.casefold(): n for n, aliases in profile.get(f, {}).items() for a in (n, *aliases)} for f in tables.PROFILE_FIELDS}
    names = {f: list(dict.fromkeys([*base.names.get(f, []), *(known[f].get(v.casefold(), v) for v in models.string_list(more.get(f)))])) for f in tables.PROFILE_FIELDS}
    terms = list(dict.fromkeys([*base.terms, *(t.lower() for t in models.string_list(more.get("terms")) if len(t) >= 2), *map(str, years), *(q.lower() for q in quarters)]))
    language = str(more.get("language") or base.language) if base.language == "unknown" else base.language
    intent = str(more.get("intent") or base.intent) if base.intent == "general" else base.intent
    new = Query(base.text, language, intent, terms, [*map(str, years), *quarters], years, quarters, names)
    return dataclasses.replace(new, enriched=new != base)


def section_table(docs: DataFrame, layout: str = "auto", outline: DataFrame | None = None, normalise: bool = True, strict: bool = False) -> DataFrame:
    """Sections of documents (doc_id, text), with ids, paths, pages and summaries.

    layout h1_forest gives a row per header from the first one of level 1 on; page_per_page a root and a row per page;
    auto takes pages where a text has page comments. outline (entry, title, level) overrides the levels of headers it
    names. strict fails on a forest without a header of level 1.
    """
    if layout not in ("auto", "h1_forest", "page_per_page"):
        raise ValueError(f"unknown layout: {layout}")
    found = M.layout(F.col("text")) if layout == "auto" else F.lit(layout)
    by_page = None if layout == "h1_forest" else _page_sections(docs.filter(found == "page_per_page"), outline, normalise)
    forest = None if layout == "page_per_page" else _forest_sections(docs.filter(found == "h1_forest"), outline, normalise, strict)
    return by_page if forest is None else forest if by_page is None else forest.unionByName(by_page)


def _levels(lines: DataFrame, outline: DataFrame | None, normalise: bool) -> DataFrame:
    found = M.headers(lines)
    if outline is not None:
        found = M.override_levels(found, lines.select("doc_id").distinct().join(F.broadcast(outline)))
    return M.clamp_levels(found) if normalise else found


def _section_id(node: Column) -> Column:
    return T.section_id(F.col("doc_id").cast("string"), node)


def _forest_sections(docs: DataFrame, outline: DataFrame | None, normalise: bool, strict: bool) -> DataFrame:
    lines = M.page_of_lines(M.to_lines(docs))
    rows = M.section_rows(lines, M.after_first_top(_levels(lines, outline, normalise), strict))
    above = rows.select("doc_id", F.col("line").alias("parent_line"), F.col("preorder").alias("above"))
    rows = rows.join(above, ["doc_id", "parent_line"], "left").withColumn("line", F.col("preorder")).withColumn("parent_line", F.col("above")).drop("above")
    of = lambda n: _section_id(F.format_string("%04d", n))
    rows = M.with_paths(rows)
    return rows.select(
        "doc_id", of(F.col("preorder")).alias("section_id"), F.when(F.col("parent_line").isNotNull(), of(F.col("parent_line"))).alias("parent_id"), F.transform("ancestors", of).alias("ancestor_ids"),
        "node_id", "title", "title_path", "depth", "is_leaf", F.col("page").alias("page_index"), "text", T.node_summary(F.col("text"), F.col("title")).alias("summary"),
    )


def _page_sections(docs: DataFrame, outline: DataFrame | None, normalise: bool) -> DataFrame:
    lines = M.page_of_lines(M.to_lines(docs))
    nodes = M.title_pages(M.page_forest(lines, _levels(lines, outline, normalise)))
    top = nodes.filter("parent_id is null").select("doc_id", F.col("title").alias("top"))
    rows = nodes.join(top, "doc_id")
    root = F.col("parent_id").isNull()
    up = F.when(~root, _section_id(F.col("parent_id")))
    return rows.select(
        "doc_id", _section_id(F.col("node_id")).alias("section_id"), up.alias("parent_id"), F.array_compact(F.array(up)).alias("ancestor_ids"), "node_id", "title",
        F.when(root, F.col("title")).otherwise(F.concat_ws(" > ", "top", "title")).alias("title_path"), F.when(root, 0).otherwise(1).alias("depth"), (~root).alias("is_leaf"), "page_index", "text",
        T.node_summary(F.col("text"), F.col("title")).alias("summary"),
    )


def embedded(chunks: DataFrame, embed: Embed, text: str = "search_text", batch: int = 10) -> DataFrame:
    """Adds embedding; embed sees batch texts at a time."""
    small = models.embedder(embed, batch)

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(small(s.fillna("").tolist()), index=s.index)

    return chunks.withColumn("embedding", vectors(F.col(text)))


def build_index(spark: SparkSession, source: str, target: str, embed: Embed | None = None, options: Settings | None = None, count: Callable[[str], int] = C.four_chars, layout: str = "h1_forest", outline: str | None = None) -> None:
    """Replaces the sections, chunks and trigram postings of the documents below source in the tables below target.

    count gives the tokens of a text; layout is that of section_table, auto to choose by page comments; outline is a
    file that overrides the levels of headers.
    """
    options = options or Settings()
    entries = tables.read_outline(spark, outline) if outline else None
    docs = tables.read_markdown(spark, tables.existing(spark, source))
    index_documents(docs, target, embed, options, count, layout, entries)


def index_documents(docs: DataFrame, target: str, embed: Embed | None = None, options: Settings | None = None, count: Callable[[str], int] = C.four_chars, layout: str = "h1_forest", outline: DataFrame | None = None) -> None:
    """The same for documents (doc_id, text) in a table."""
    options, spark = options or Settings(), docs.sparkSession
    sections = tables.without_nuls(section_table(docs, layout, outline), tables.SECTION_TEXTS).drop("nul_count")
    tables.write_by_document(sections, f"{target}/sections")
    written = spark.read.parquet(f"{target}/sections").join(docs.select("doc_id"), "doc_id", "left_semi")
    chunks = C.build_chunks(written, count, options.chunk_tokens, options.chunk_overlap)
    chunks = tables.without_nuls(chunks, tables.CHUNK_TEXTS, "chunk_text").drop("nul_count")
    if embed is not None:
        chunks = embedded(chunks, embed)
        chunks = tables.checked_vectors(chunks, options.dimensions) if options.dimensions else chunks
    tables.write_by_document(chunks, f"{target}/chunks")
    fresh = spark.read.parquet(f"{target}/chunks").join(docs.select("doc_id"), "doc_id", "left_semi")
    tables.write_by_document(R.gram_postings(fresh), f"{target}/grams", order="gram")


def build_paged(pages: DataFrame, lines: DataFrame, spans: DataFrame, builders: dict[str, Callable] | None = None, strategy: str = "auto") -> tuple[DataFrame, list[tuple[str, str]]]:
    """The best tree of each paged document, with name and score, and the builders that failed, with their errors.

    builders make section rows (see normalize.py) from (pages, lines, headings), by the names in fallback.candidate_plan;
    a document's own plan names those tried for it. The tree of its pages' titles, which needs no model, always competes.
    """
    headings = O.heading_candidates(spans)
    found = O.contents_pages(O.contents_scores(pages, lines))
    entries = tables.settled(O.outline_entries(pages, lines))
    sure = O.outline_confidence(found, entries).select("doc_id", "confidence", "n_entries")
    plan = pages.select("doc_id").distinct().join(sure, "doc_id", "left").fillna({"confidence": "none", "n_entries": 0})
    plan = tables.settled(plan.select("doc_id", FB.candidate_plan(F.col("confidence"), F.col("n_entries"), strategy).alias("names")))
    enough = FB.documents_with_text(pages).filter("enough").select("doc_id")
    total = pages.groupBy("doc_id").agg(F.max("page").alias("total"))
    trees, errors = None, []
    made = {"pages": lambda p, ln, h: FB.page_tree(p.join(enough, "doc_id", "left_semi"), ln, h)} | (builders or {})
    for name, build in made.items():
        try:
            asked = plan.filter(F.array_contains("names", name)).select("doc_id") if name != "pages" else plan.select("doc_id")
            raw = FB.out_of_cover(build(pages.join(asked, "doc_id", "left_semi"), lines, headings))
            tree = N.normalise_trees(raw, O.heading_matches(raw, headings))
            tree = tables.settled(tree.withColumn("name", F.lit(name)))
        except Exception as e:  # noqa: BLE001
            errors.append((name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
            continue
        scored = TR.tree_score(TR.tree_quality(tree.drop("name"), total, headings)).select("doc_id", "score", "max_depth", "root_count", "heading_alignment")
        tree = tree.join(scored, "doc_id")
        trees = tree if trees is None else trees.unionByName(tree)
    candidates = trees.select("doc_id", "name", "score", "max_depth", "root_count", "heading_alignment").distinct()
    best = O.best_candidate(candidates).select("doc_id", "name")
    return trees.join(best, ["doc_id", "name"]).drop("max_depth", "root_count", "heading_alignment"), errors


def benchmark(pages: DataFrame, lines: DataFrame, spans: DataFrame, strategies: dict[str, dict[str, Callable]], expected: dict[object, DataFrame]) -> list[dict]:
    """A row for each strategy and document: tree measures and, where a tree is expected, its comparison; or an error."""
    out = []
    for name, builders in strategies.items():
        try:
            tree, errors = build_paged(pages, lines, spans, builders, name if name in builders else "auto")
            tree = tables.settled(tree)
            kids = tree.filter("parent is not null").select("doc_id", "parent").distinct().count()
            for r in tree.groupBy("doc_id").agg(F.count_if(F.col("parent").isNull()).alias("roots"), F.count("*").alias("nodes"), (F.max("depth") + 1).alias("max_depth")).orderBy("doc_id").collect():
                row = {"strategy": name, "status": "success", **r.asDict(), "inner": kids, "errors": errors}
                if r["doc_id"] in expected:
                    row["comparison"] = TR.compare_trees(tree.filter(F.col("doc_id") == F.lit(r["doc_id"])), expected[r["doc_id"]]).first().asDict()
                out.append(row)
        except Exception as e:  # noqa: BLE001
            out.append({"strategy": name, "status": "error", "error_type": type(e).__name__, "error_message": str(e)})
    return out


def retrieve_candidates(sections: DataFrame, chunks: DataFrame, query: Query, vector: list[float] | None = None, options: Settings | None = None, grams: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fused chunks, best documents and their best sections. With trigram postings only chunks that may count are read."""
    o = options or Settings()
    near = R.posted_candidates(grams, query.text, query.terms, o.lexical_threshold) if grams is not None else None
    lexical = R.lexical_recall(chunks if near is None else chunks.join(near, ["doc_id", "chunk_id"], "left_semi"), query.text, query.terms, o.top_lexical, o.lexical_threshold)
    if vector is None:
        dense = lexical.select("chunk_id", "doc_id", "section_id", F.lit(None).cast("int").alias("dense_rank"), F.lit(None).cast("double").alias("dense_score")).limit(0)
    else:
        dense = R.dense_recall(chunks, vector, o.top_dense)
    fused = tables.settled(R.fuse(dense, lexical, o.top_fused, rrf_k=o.rrf_k))
    docs = tables.settled(R.aggregate_docs(fused, o.top_docs, o.doc_score_limit))
    best = R.top_sections(R.aggregate_sections(fused, o.section_score_limit, o.chunks_per_section), docs, o.sections_per_doc)
    return fused, docs, tables.settled(best)


def localize_sections(sections: DataFrame, docs: DataFrame, best: DataFrame, query: Query, rank: Callable[[DataFrame], DataFrame] | None = None, options: Settings | None = None) -> DataFrame:
    o = options or Settings()
    tree = sections.join(docs.select("doc_id"), "doc_id", "left_semi")
    pool = R.candidate_pool(tree, best.filter(F.col("section_rank") <= o.anchors))
    pool = tables.settled(pool)
    pool = R.with_fallback(pool, tree, docs, o.tree_sections) if o.whole_doc_fallback else pool
    words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    if rank is None:
        return tables.settled(R.localize(pool, tree, words(query.terms), words(query.times), o.tree_sections))
    short = tables.settled(R.localize(pool, tree, words(query.terms), words(query.times), o.shortlist))
    return tables.settled(R.rerank(short, rank(short), o.tree_sections))


def expand_sections(sections: DataFrame, chunks: DataFrame, fused: DataFrame, local: DataFrame, query: Query, options: Settings | None = None) -> DataFrame:
    """A context per focus section: relatives, supporting and neighbouring chunks, text within the budget, score."""
    o = options or Settings()
    focus = local.filter(F.col("local_rank") <= o.focus_sections)
    node = sections.select("doc_id", "section_id", "parent_id", "ancestor_ids", "depth", "title", "title_path", F.coalesce("summary", F.lit("")).alias("summary"))
    me = focus.select("doc_id", "section_id", "anchor_id", "localization_score", "local_rank").join(node, ["doc_id", "section_id"])
    me = tables.settled(me)
    key = ["doc_id", "section_id"]
    rel = lambda df, name, *order: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("r_path").alias("title_path"), F.col("r_summary").alias("summary")))), lambda x: F.struct(x["title_path"], x["summary"])).alias(name))
    near = R.relatives(me, node, o.ancestor_hops, o.descendant_depth)
    up, down = near.filter("role = 'ancestor'"), near.filter("role = 'descendant'")
    words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    hits = lambda c: T.term_hits(F.col(c), words(query.terms))
    side = R.ranked_siblings(me, node, words(query.terms), words(query.times), o.siblings)
    found = fused.join(chunks.select("doc_id", "section_id", "chunk_id", "chunk_index"), ["doc_id", "section_id", "chunk_id"]).select(F.col("doc_id"), F.col("section_id").alias("c_section"), "chunk_index")
    found = tables.settled(found)
    has = found.select("doc_id", F.col("c_section").alias("section_id"), F.lit(True).alias("own")).distinct()
    place = me.select(*key, "anchor_id").join(has, key, "left").select(*key, F.when(F.col("own"), F.col("section_id")).otherwise(F.col("anchor_id")).alias("c_section"))
    at = place.join(found, ["doc_id", "c_section"]).select("doc_id", F.col("c_section").alias("section_id"), "chunk_index").distinct()
    near = R.neighbours(chunks, at, o.neighbour_window, o.evidence_chunks)
    near = place.join(near.select("doc_id", F.col("section_id").alias("c_section"), "role", "evidence_rank", "page_index", F.col("search_text").alias("text")), ["doc_id", "c_section"])
    part = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("evidence_rank", "page_index", "text")))), lambda x: F.struct(x["page_index"], x["text"]))
    near = near.groupBy(*key).agg(part("supporting").alias("supporting"), part("neighbor").alias("neighbours"))
    rows = me
    for df in (rel(up, "ancestors", "r_depth"), rel(down, "descendants", "r_depth", "r_path", "r_id"), rel(side, "siblings", "nth"), near):
        rows = rows.join(df, key, "left")
    none = {n: F.coalesce(n, F.array().cast("array<struct<title_path:string,summary:string>>")) for n in ("ancestors", "descendants", "siblings")}
    none |= {n: F.coalesce(n, F.array().cast("array<struct<page_index:int,text:string>>")) for n in ("supporting", "neighbours")}
    rows = rows.withColumns(none).withColumn("focus_summary", F.coalesce(F.nullif("summary", F.lit("")), "title"))
    rows = rows.withColumn("evidence_score", S.evidence_score(F.col("localization_score"), F.size("supporting"), hits("title"), hits("title_path"), hits("summary")))
    return R.assemble_context(rows, o.context_budget).withColumn("seq", F.col("local_rank"))


def _index(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    read = lambda name: spark.read.parquet(f"{index}/{name}")
    return read("sections"), read("chunks"), read("grams") if tables.exists(spark, f"{index}/grams") else None


def retrieve_tree(spark: SparkSession, index: str, text: str, embed: Embed | None = None, rank: Callable[[DataFrame], DataFrame] | None = None, options: Settings | None = None, profile: Profile | None = None) -> DataFrame:
    """The localized sections of the best documents for one query, before contexts are put together."""
    o, query = options or Settings(), parse_query(spark, text, profile)
    sections, chunks, grams = _index(spark, index)
    _, docs, best = retrieve_candidates(sections, chunks, query, embed([query.text])[0] if embed else None, o, grams)
    local = localize_sections(sections, docs, best, query, rank, o)
    return local.join(docs.select("doc_id", "doc_rank", "doc_score"), "doc_id").select("doc_rank", "doc_id", "doc_score", "local_rank", "section_id", "title_path", "relation", "localization_score", "reason_codes")


def retrieve_evidence(spark: SparkSession, index: str, text: str, embed: Embed | None = None, rank: Callable[[DataFrame], DataFrame] | None = None, label: Callable[[DataFrame], DataFrame] | None = None, options: Settings | None = None, profile: Profile | None = None, model: models.Model | None = None) -> DataFrame:
    """Ranked evidence with its context text for one query over the tables that build_index wrote."""
    o, query = options or Settings(), parse_query(spark, text, profile, model)
    sections, chunks, grams = _index(spark, index)
    fused, docs, best = retrieve_candidates(sections, chunks, query, embed([query.text])[0] if embed else None, o, grams)
    contexts = expand_sections(sections, chunks, fused, localize_sections(sections, docs, best, query, rank, o), query, o)
    out = R.package(contexts, docs, o.evidence_per_doc, o.evidence_total)
    out = out.select("evidence_rank", "evidence_id", "doc_id", "section_id", "title_path", "evidence_score", "doc_score", "context_text")
    return R.apply_labels(out, label(out)) if label else out
