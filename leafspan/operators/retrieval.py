"""The five retrieval stages over chunk and section tables. Every stage is lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import score as S
from leafspan.functions import text as T

# Priors and precedence of a section's relation to its anchor.
PRIORS = {"anchor": 4.0, "descendant": 2.75, "ancestor": 2.1, "sibling": 1.45, "doc_fallback": 0.55}
ORDER = {"anchor": 5, "descendant": 4, "ancestor": 3, "sibling": 2, "doc_fallback": 1}


def _rank(df: DataFrame, name: str, k: int, *order) -> DataFrame:
    """The first k rows, numbered. The window sees the k rows only."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def dense_recall(chunks: DataFrame, query: list[float], k: int = 60, vector: str = "embedding", id_col: str = "chunk_id") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.withColumn("cos", S.cosine(F.col(vector), q)).filter("cos is not null").withColumn("dense_score", F.greatest(F.lit(0.0), F.col("cos")))
    return _rank(scored, "dense_rank", k, F.desc("cos"), id_col).drop("cos", vector)


FIELDS = {"title": "title", "path": "title_path", "body": "search_text"}


def lexical_scored(chunks: DataFrame, query: str, terms: list[str], threshold: float = 0.18) -> DataFrame:
    """The chunks (doc_id, chunk_id, title, title_path, search_text) that hold a term or are similar enough, with lexical_score."""
    listed = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    rows = chunks.withColumn("_s", S.similarities({f: F.col(c) for f, c in FIELDS.items()}, query))
    for f, c in FIELDS.items():
        rows = rows.withColumn(f"{f}_hits", T.term_hits(F.col(c), listed)).withColumn(f"{f}_sim", F.col(f"_s.{f}_sim")).withColumn(f"{f}_word", F.col(f"_s.{f}_word"))
    by = lambda kind: {f: F.col(f"{f}_{kind}") for f in FIELDS}
    rows = rows.withColumn("lexical_score", S.lexical_score(by("hits"), by("word"), by("sim")))
    some = F.greatest(*by("sim").values(), *by("word").values()) >= threshold
    rows = rows.filter((F.greatest(*by("hits").values()) > 0) | some)
    return rows.drop("_s", *[f"{f}_{kind}" for f in FIELDS for kind in ("hits", "sim", "word")])


def lexical_recall(chunks: DataFrame, query: str, terms: list[str], k: int = 60, threshold: float = 0.18) -> DataFrame:
    """The k best of the scored chunks, with lexical_rank."""
    return _rank(lexical_scored(chunks, query, terms, threshold), "lexical_rank", k, F.desc(F.round("lexical_score", 9)), "doc_id", "chunk_id")


def gram_postings(chunks: DataFrame) -> DataFrame:
    """The trigram index of chunks: doc_id, chunk_id, field, gram and size (the field's number of trigrams)."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), S.trigrams(F.coalesce(F.col(c), F.lit(""))).alias("grams")) for f, c in FIELDS.items()]))
    rows = chunks.select("doc_id", "chunk_id", fields.alias("f")).select("doc_id", "chunk_id", "f.field", F.size("f.grams").alias("size"), F.explode("f.grams").alias("gram"))
    return rows


def posted_candidates(postings: DataFrame, query: str, terms: list[str], threshold: float = 0.18) -> DataFrame | None:
    """(doc_id, chunk_id) of all chunks that lexical_recall may keep, from the postings of the query's trigrams alone.

    The share of a field's trigrams that the query has bounds both similarities; a field that holds a term holds the
    term's inner trigrams. None if a term has no inner trigram, so that any chunk may hold it.
    """
    asked = list(dict.fromkeys(S._ordered_trigrams(query)))
    inner = [[g for g in S._ordered_trigrams(t) if " " not in g] for t in terms]
    if any(not g for g in inner):
        return None
    wanted = list(dict.fromkeys([*asked, *(g for gs in inner for g in gs)]))
    found = postings.filter(F.col("gram").isin(wanted)).groupBy("doc_id", "chunk_id", "field").agg(F.collect_set("gram").alias("grams"), F.first("size").alias("size"))
    both = F.size(F.array_intersect("grams", F.array(*map(F.lit, asked)).cast("array<string>")))
    keep = both / F.col("size") >= threshold
    for gs in inner:
        keep = keep | (F.size(F.array_intersect("grams", F.array(*map(F.lit, gs)))) == len(set(gs)))
    return found.filter(keep).select("doc_id", "chunk_id").distinct()


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 80, carry: tuple[str, ...] = ("doc_id", "section_id"), rrf_k: int = S.RRF_K) -> DataFrame:
    d = dense.select("chunk_id", *[F.col(c).alias(f"d_{c}") for c in carry], "dense_rank", "dense_score")
    x = lexical.select("chunk_id", *[F.col(c).alias(f"x_{c}") for c in carry], "lexical_rank", "lexical_score")
    both = d.join(x, "chunk_id", "full_outer")
    both = both.select("chunk_id", *[F.coalesce(f"d_{c}", f"x_{c}").alias(c) for c in carry], "dense_rank", "dense_score", "lexical_rank", "lexical_score", S.rrf(F.col("dense_rank"), F.col("lexical_rank"), k=rrf_k).alias("rrf_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _rank(both, "fused_rank", k, F.desc("rrf_score"), zero("dense_rank"), zero("lexical_rank"), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank"))


def aggregate_sections(fused: DataFrame, score_limit: int = 3, chunks_each: int = 2) -> DataFrame:
    w = Window.partitionBy("doc_id", "section_id").orderBy("fused_rank")
    rows = fused.withColumn("rn", F.row_number().over(w))
    kept = F.collect_list(F.when(F.col("rn") <= chunks_each, F.struct("rn", "chunk_id", "rrf_score")))
    return rows.groupBy("doc_id", "section_id").agg(
        F.round(F.sum(F.when(F.col("rn") <= score_limit, F.col("rrf_score"))), 8).alias("section_score"), F.count("*").alias("matched_chunk_count"),
        F.min("fused_rank").alias("first_rank"), F.array_sort(kept).alias("supporting_chunks"),
    )


def aggregate_docs(fused: DataFrame, docs: int = 10, score_limit: int = 5) -> DataFrame:
    rows = fused.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("fused_rank")))
    out = rows.groupBy("doc_id").agg(
        F.round(F.sum(F.when(F.col("rn") <= score_limit, F.col("rrf_score"))), 8).alias("doc_score"), F.count_distinct("section_id").alias("matched_section_count"),
        F.count("*").alias("matched_chunk_count"), F.min("fused_rank").alias("first_rank"),
    )
    return _rank(out, "doc_rank", docs, F.desc("doc_score"), "first_rank")


def top_sections(sections: DataFrame, docs: DataFrame, each: int = 3) -> DataFrame:
    """The best sections of the chosen documents, in document order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("section_score"), "first_rank")
    rows = sections.join(docs.select("doc_id", "doc_score", "doc_rank"), "doc_id").withColumn("section_rank", F.row_number().over(w))
    return rows.filter(F.col("section_rank") <= each)


def candidate_pool(tree: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sections around anchors. tree: doc_id, section_id, parent_id, ancestor_ids (root first), depth, title, title_path,
    summary; anchors: doc_id, section_id, section_score, section_rank. One row per section: its strongest relation."""
    node = tree.select("doc_id", "section_id", "parent_id", "ancestor_ids")
    a = anchors.select("doc_id", F.col("section_id").alias("anchor_id"), "section_score", "section_rank")
    here = a.join(node.withColumnRenamed("section_id", "anchor_id"), ["doc_id", "anchor_id"])
    own = here.select("doc_id", F.col("anchor_id").alias("section_id"), "anchor_id", "section_score", "section_rank", F.lit("anchor").alias("relation"))
    up = here.select("doc_id", F.explode("ancestor_ids").alias("section_id"), "anchor_id", "section_score", "section_rank", F.lit("ancestor").alias("relation"))
    line = node.select("doc_id", "section_id", F.explode("ancestor_ids").alias("anchor_id"))
    down = line.join(a, ["doc_id", "anchor_id"]).select("doc_id", "section_id", "anchor_id", "section_score", "section_rank", F.lit("descendant").alias("relation"))
    path = here.select("doc_id", "anchor_id", "section_score", "section_rank", F.explode(F.concat("ancestor_ids", F.array("anchor_id"))).alias("on_path"))
    parents = path.join(node.select("doc_id", F.col("section_id").alias("on_path"), "parent_id"), ["doc_id", "on_path"]).filter("parent_id is not null")
    side = parents.join(node.select("doc_id", "parent_id", "section_id"), ["doc_id", "parent_id"])
    side = side.join(path.select("doc_id", "anchor_id", F.col("on_path").alias("section_id")), ["doc_id", "anchor_id", "section_id"], "left_anti")
    side = side.select("doc_id", "section_id", "anchor_id", "section_score", "section_rank", F.lit("sibling").alias("relation"))
    every = own.unionByName(down).unionByName(up).unionByName(side)
    strength = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("relation")]
    every = every.withColumn("strength", strength)
    w = Window.partitionBy("doc_id", "section_id").orderBy(F.desc("strength"), "section_rank")
    best = every.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    codes = every.groupBy("doc_id", "section_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("section_rank", -F.col("strength"), F.col("relation")))), lambda x: x["relation"])).alias("reason_codes"))
    return best.join(codes, ["doc_id", "section_id"]).drop("section_rank")


def with_fallback(pool: DataFrame, tree: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Adds the other sections of documents with fewer than least candidates."""
    few = docs.select("doc_id").join(pool.groupBy("doc_id").count(), "doc_id", "left").filter(F.coalesce("count", F.lit(0)) < least).select("doc_id")
    rest = tree.select("doc_id", "section_id").join(few, "doc_id", "left_semi").join(pool, ["doc_id", "section_id"], "left_anti")
    rest = rest.select("doc_id", "section_id", F.lit(None).cast(dict(pool.dtypes)["anchor_id"]).alias("anchor_id"), F.lit(0.0).alias("section_score"), F.lit("doc_fallback").alias("relation"), F.lit(1).alias("strength"), F.array(F.lit("doc_fallback")).alias("reason_codes"))
    return pool.unionByName(rest)


def localize(pool: DataFrame, tree: DataFrame, terms: Column, times: Column, each: int = 5) -> DataFrame:
    """The best sections of each document, with localization_score and local_rank; the smallest id wins a tie of all else."""
    rows = pool.join(tree.select("doc_id", "section_id", "title", "title_path", "depth", "summary"), ["doc_id", "section_id"])
    prior = F.create_map(*[F.lit(x) for kv in PRIORS.items() for x in kv])[F.col("relation")]
    hits = lambda c: T.term_hits(F.col(c), terms)
    when = T.time_hits(F.concat_ws("\n", "title", "title_path", "summary"), times)
    rows = rows.withColumn("localization_score", S.localization_score(prior, F.col("section_score"), hits("title"), hits("title_path"), hits("summary"), when))
    w = Window.partitionBy("doc_id").orderBy(F.desc("localization_score"), F.desc("strength"), "depth", F.desc("title_path"), "section_id")
    return rows.withColumn("local_rank", F.row_number().over(w)).filter(F.col("local_rank") <= each)


def ranked_siblings(focus: DataFrame, sections: DataFrame, terms: Column, times: Column, most: int = 2) -> DataFrame:
    """The siblings of each focus section (doc_id, section_id, parent_id) that the query overlaps most: adds nth.

    sections: doc_id, section_id, parent_id, title, title_path, summary. Ties go to the last path.
    """
    other = sections.select("doc_id", "parent_id", F.col("section_id").alias("r_id"), F.col("title").alias("r_title"), F.col("title_path").alias("r_path"), F.coalesce("summary", F.lit("")).alias("r_summary"))
    rows = focus.filter("parent_id is not null").select("doc_id", "section_id", "parent_id").join(other, ["doc_id", "parent_id"]).filter("r_id <> section_id")
    rows = rows.withColumn("overlap", S.sibling_overlap(*[T.term_hits(F.col(c), terms) for c in ("r_title", "r_path", "r_summary")], T.time_hits(F.concat_ws("\n", "r_title", "r_path", "r_summary"), times)))
    w = Window.partitionBy("doc_id", "section_id").orderBy(F.desc("overlap"), F.desc("r_path"), "r_id")
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("parent_id")


def relatives(focus: DataFrame, sections: DataFrame, hops: int = 2, depth: int = 1) -> DataFrame:
    """Ancestors within hops, from the root, and descendants within depth, in path order: doc_id, section_id, role, r_id,
    r_depth, r_path, r_summary. focus: doc_id, section_id, ancestor_ids, depth; sections also title_path and summary."""
    other = sections.select("doc_id", F.col("section_id").alias("r_id"), F.col("ancestor_ids").alias("r_up"), F.col("depth").alias("r_depth"), F.col("title_path").alias("r_path"), F.coalesce("summary", F.lit("")).alias("r_summary"))
    me = focus.select("doc_id", "section_id", "depth")
    up = focus.select("doc_id", "section_id", "depth", F.explode("ancestor_ids").alias("r_id")).join(other.drop("r_up"), ["doc_id", "r_id"]).filter(F.col("depth") - F.col("r_depth") <= hops)
    down = me.join(other.withColumn("section_id", F.explode("r_up")), ["doc_id", "section_id"]).filter(F.col("r_depth") - F.col("depth") <= depth)
    columns = ["doc_id", "section_id", "r_id", "r_depth", "r_path", "r_summary"]
    return up.select(*columns, F.lit("ancestor").alias("role")).unionByName(down.select(*columns, F.lit("descendant").alias("role")))


def neighbours(chunks: DataFrame, supporting: DataFrame, window: int = 1, most: int = 6) -> DataFrame:
    """Supporting chunks and those within window places in the same section. Both: doc_id, section_id, chunk_index."""
    around = supporting.select("doc_id", "section_id", F.col("chunk_index").alias("at"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("off"))
    around = around.withColumn("chunk_index", F.col("at") + F.col("off")).groupBy("doc_id", "section_id", "chunk_index").agg(F.min(F.abs("off")).alias("distance"))
    rows = chunks.join(around, ["doc_id", "section_id", "chunk_index"]).withColumn("role", F.when(F.col("distance") == 0, "supporting").otherwise("neighbor"))
    w = Window.partitionBy("doc_id", "section_id").orderBy("distance", "chunk_index", "chunk_id")
    return rows.withColumn("evidence_rank", F.row_number().over(w)).filter(F.col("evidence_rank") <= most)


def package(contexts: DataFrame, doc_scores: DataFrame, each: int = 3, total: int = 8) -> DataFrame:
    """contexts: doc_id, section_id, seq, title_path, evidence_score. Best context per section, then per document, then all."""
    one = contexts.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy(F.desc("evidence_score"), "seq"))).filter("rn = 1")
    w = Window.partitionBy("doc_id").orderBy(F.desc("evidence_score"), F.desc("title_path"))
    few = one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each).drop("rn")
    few = few.withColumn("evidence_id", T.section_id(F.col("doc_id").cast("string"), F.col("section_id").cast("string")))
    top = _rank(few, "evidence_rank", total, F.desc("evidence_score"), F.desc("title_path"))
    return top.join(doc_scores.select("doc_id", "doc_score"), "doc_id", "left").withColumn("doc_score", F.coalesce("doc_score", F.lit(0.0)))


def evidence_documents(evidence: DataFrame) -> DataFrame:
    """Evidence by document: doc_id, doc_score, items (in evidence order) and doc_order, best documents first."""
    item = F.struct("evidence_rank", "evidence_id", "section_id", "evidence_score")
    rows = evidence.groupBy("doc_id").agg(F.coalesce(F.max("doc_score"), F.lit(0.0)).alias("doc_score"), F.array_sort(F.collect_list(item)).alias("items"))
    return rows.withColumn("doc_order", F.row_number().over(Window.orderBy(F.desc("doc_score"), F.desc(F.size("items")), F.col("items")[0]["evidence_rank"])))


def page_set(rows: DataFrame, key: list[str], page: str = "page_index") -> DataFrame:
    """The distinct pages of each key, ascending."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(page)).alias("page_indexes"))


def _blocks_cost(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda a, b: a + F.length(b) + 2)


def _fitting(blocks: Column, others: Column, budget: int, from_front: bool = True) -> Column:
    """The most blocks that fit beside others, cut from the end (or the front); none if none do."""
    n = F.size(blocks)
    part = (lambda k: F.slice(blocks, F.lit(1), k)) if from_front else (lambda k: F.slice(blocks, n - k + 1, k))
    fits = F.filter(F.sequence(F.lit(0), n), lambda k: others + _blocks_cost(part(k)) - 2 <= budget)
    return part(F.coalesce(F.array_max(fits), F.lit(0)))


def assemble_context(contexts: DataFrame, budget: int = 6000, excerpt: int = 700) -> DataFrame:
    """Adds context_text: path, ancestors, focus, descendants, siblings and chunks as blocks within budget characters.

    contexts: title_path, focus_summary, ancestors, descendants, siblings (arrays of struct title_path, summary),
    supporting, neighbours (arrays of struct page_index, text). Over budget, blocks go in this order: neighbours,
    siblings and descendants from the end, ancestors from the root; then the chunks are clipped, then the focus.
    """
    tidy = lambda a: F.filter(F.transform(a, F.trim), lambda b: b != "")
    near = lambda c, label: tidy(F.transform(F.filter(c, lambda s: F.coalesce(s["summary"], F.lit("")) != ""), lambda s: F.concat(F.lit(f"[{label}] "), s["title_path"], F.lit("\n"), s["summary"])))
    page = lambda s: F.coalesce(F.concat(F.lit(" p"), s["page_index"]), F.lit(""))
    chunk = lambda c, label: tidy(F.transform(c, lambda s: F.concat(F.lit(f"[{label} Chunk"), page(s), F.lit("] "), T.clip(F.coalesce(s["text"], F.lit("")), excerpt))))
    head, focus = F.concat(F.lit("Title Path: "), "title_path"), F.trim(F.concat(F.lit("[Focus] "), "title_path", F.lit("\n"), F.coalesce("focus_summary", F.lit(""))))
    rows = contexts.withColumn("_core", F.array(head, focus))
    rows = rows.withColumns({"_a": near(F.col("ancestors"), "Ancestor"), "_d": near(F.col("descendants"), "Descendant"), "_s": near(F.col("siblings"), "Sibling"), "_u": chunk(F.col("supporting"), "Supporting"), "_n": chunk(F.col("neighbours"), "Neighbor")})
    for name in ("_n", "_s", "_d", "_a"):
        others = sum((_blocks_cost(F.col(c)) for c in ("_core", "_a", "_d", "_s", "_u", "_n") if c != name), F.lit(0))
        rows = rows.withColumn(name, _fitting(F.col(name), others, budget, name != "_a"))
    focus = F.col("_core")[1]
    whole = F.array_join(F.concat("_a", F.array(focus), "_d", "_s", "_u", "_n"), "\n\n")
    head, core, rest = F.col("_core")[0], F.array_join("_core", "\n\n"), F.array_join(F.concat("_u", "_n"), "\n\n")
    whole = F.concat(head, F.lit("\n\n"), whole)
    cut = lambda t, room: F.when(F.length(t) <= room, t).when(room <= 3, F.substring(t, F.lit(1), F.greatest(F.lit(0), room))).otherwise(F.concat(F.rtrim(F.substring(t, F.lit(1), room - 3)), F.lit("...")))
    some = lambda a, b: F.when(F.trim(b) == "", a).otherwise(F.concat(a, F.lit("\n\n"), b))
    tight = F.when(F.length(core) >= budget, some(head, cut(focus, budget - F.length(head) - 2))).otherwise(some(core, cut(rest, budget - F.length(core) - 2)))
    text = F.when(F.length(whole) <= budget, whole).otherwise(tight)
    return rows.withColumn("context_text", text).drop("_core", "_a", "_d", "_s", "_u", "_n")


def rerank(localized: DataFrame, ranking: DataFrame, each: int = 5) -> DataFrame:
    """Localized sections with a bonus by their rank in a supplied ranking (doc_id, section_id, rank).

    The bonus is the larger of 1 and 0.6 of the document's best score, divided by the rank; the last rank of a
    repeated section counts, and sections that are not localized are ignored.
    """
    last = ranking.groupBy("doc_id", "section_id").agg(F.max("rank").alias("model_rank"))
    top = F.max("localization_score").over(Window.partitionBy("doc_id"))
    rows = localized.join(last, ["doc_id", "section_id"], "left").withColumn("scale", F.greatest(F.lit(1.0), 0.6 * F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))))
    rows = rows.withColumn("localization_score", F.round(F.col("localization_score") + F.coalesce(F.col("scale") / F.col("model_rank"), F.lit(0.0)), 8))
    rows = rows.withColumn("reason_codes", F.when(F.col("model_rank").isNotNull(), F.array_union("reason_codes", F.array(F.lit("rerank_selected")))).otherwise(F.col("reason_codes")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("localization_score"), F.desc("strength"), "depth", F.desc("title_path"), "section_id")
    return rows.withColumn("local_rank", F.row_number().over(w)).filter(F.col("local_rank") <= each).drop("scale")


def apply_labels(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds relation from labels (evidence_id, relation); unknown relations and ids are ignored, the rest stay null."""
    good = labels.filter(F.col("relation").isin("supports", "conflicts", "related")).groupBy("evidence_id").agg(F.max("relation").alias("relation"))
    return evidence.drop("relation").join(good, "evidence_id", "left")
