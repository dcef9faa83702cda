import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from leafspan.functions import score as S
from leafspan.functions import text as T
from leafspan.operators import chunk as C
from leafspan.operators import markdown as M
from leafspan.operators import retrieval as R
from leafspan.operators import trees as TR
from leafspan.plans import registry
from leafspan.sources import tables
from leafspan.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, data):
    names = sorted(range(len(cols)), key=cols.__getitem__)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str([cell(r[i]) for i in names]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.columns, got.collect()) == rows(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_uuid5(spark):
    assert value(spark, T.section_id(F.lit("d"), F.lit("0001"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "d:0001"))


@pytest.mark.parametrize(("text", "count"), [("", 1), ("a", 1), ("a\nb\n", 3)])
def test_line_count(spark, text, count):
    assert value(spark, T.line_count(F.lit(text))) == count


def test_titles(spark):
    assert value(spark, T.display_title(F.lit("前言：2025 年报"), F.lit(2))) == "2025年报"
    assert value(spark, T.display_title(F.lit("前言：概述"), F.lit(1))) == "前言：概述"
    assert value(spark, T.markdown_key(F.lit("Ａ “b”（c）…"))) == "Ａ\"b\"(c)...".lower()
    assert value(spark, T.collapse_cjk(F.lit("中 国 game 2 年"))) == "中国 game 2年"
    assert value(spark, T.section_number(F.lit("2.1.3 Growth"))).asDict() == {"key": "2.1.3", "level": 3, "rest": "Growth"}
    assert value(spark, T.section_number(F.lit("第三章 市场")))["key"] == "三"
    assert value(spark, T.section_number(F.lit("2025 report")))["key"] is None
    assert value(spark, T.parent_number(F.lit("2.1.3"))) == "2.1"


def test_query_text(spark):
    assert value(spark, T.language(F.lit("中国 game"))) == "mixed"
    assert value(spark, T.intent(F.lit("How do regions compare?"))) == "comparison"
    assert value(spark, T.years(F.lit("2025 vs 2024"))) == [2024, 2025]
    assert value(spark, T.quarter(F.lit("第一季度"))) == "Q1"
    assert value(spark, T.search_terms(F.lit("the 中国市场 SLG"))) == ["中国市场", "中国", "市场", "slg"]
    assert value(spark, T.alias_match(F.lit("in the USA now"), "usa")) and not value(spark, T.alias_match(F.lit("usage"), "usa"))
    assert value(spark, T.sentences(F.lit("一。 二！three. four"))) == ["一。", "二！three. four"]


def test_scores(spark):
    assert value(spark, S.similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert S.best_extent("word", S._ordered_trigrams("two words")) == pytest.approx(4 / 5)
    assert value(spark, S.rrf(F.lit(1), F.lit(1))) == round(2 / 61, 8)


def _brute_fusion(docs, vectors):
    """Lexical recall with all six similarities, dense recall and fusion as plain loops: (chunk, doc, section, rrf, rank)."""
    query, terms = registry.QUERY, registry.TERMS
    grams = S._ordered_trigrams(query)
    scored = []
    for chunk, text, doc, source in docs:
        total, most, hit = 0.0, 0.0, 0
        for field, (h, w, s) in ((source, (5.0, 2.0, 1.0)), (f"{doc} > {source}", (3.0, 1.25, 0.75)), (text, (1.5, 1.0, 0.5))):
            own, asked = set(S._ordered_trigrams(field)), set(grams)
            sim = len(own & asked) / len(own | asked)
            extents = [set(grams[i:j]) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)]
            word = max(len(own & x) / len(own | x) for x in extents)
            n = sum(t in field.lower() for t in terms)
            total, most, hit = total + h * n + w * word + s * sim, max(most, sim, word), hit + n
        if hit or most >= 0.18:
            scored.append((-round(total, 9), doc, chunk))
    lexical = {c: k for k, (_, _, c) in enumerate(sorted(scored)[:60], 1)}
    names = {c: (d, s) for c, _, d, s in docs}
    q = registry._VECTOR
    cos = sorted((-sum(x * y for x, y in zip(v, q, strict=True)) / sum(x * x for x in v) ** 0.5, c) for c, v in vectors)[:60]
    dense = {c: k for k, (_, c) in enumerate(cos, 1) if c in names}
    both = [(-round(sum(1 / (60 + d[c]) for d in (dense, lexical) if c in d), 8), dense.get(c, 0), lexical.get(c, 0), c) for c in dense.keys() | lexical.keys()]
    return [(c, *names[c], -r, k) for k, (r, _, _, c) in enumerate(sorted(both)[:80], 1)]


def test_similarities_hold_one_text_at_a_time(spark, monkeypatch):
    """Batches reach Python as Arrow arrays, not as pandas columns that hold every text of a batch once more."""
    made = []
    monkeypatch.setattr(S.F, "pandas_udf", lambda *a, **k: made.append(a) or F.udf(*a, **k))
    df = spark.createDataFrame([(0, "ab cd"), (1, ""), (2, None), (3, "x" * 300)], "i int, t string").select("i", S.similarities({"a": F.col("t")}, "ab ce").alias("s"))
    assert not made
    assert [(r.s.a_sim, r.s.a_word) for r in df.orderBy("i").collect()] == [(0.5, 4 / 6), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_fusion_and_evidence_use_word_similarity(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    want = _brute_fusion(docs, con.execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall())
    cols = ["chunk_id", "doc_id", "section_id", "rrf_score", "fused_rank"]
    got = registry.QUERIES["rank_fusion_with_word_similarity"](spark, SF)
    assert rows(got.columns, got.collect()) == rows(cols, want)
    sections = {}
    for _, doc, section, score, _ in want:
        sections.setdefault((doc, section), []).append(score)
    evidence = registry.QUERIES["evidence_for_query"](spark, SF).collect()
    assert evidence
    for r in evidence:
        own = sections[r.doc_id, r.section_id]
        hits = lambda t: sum(x in t.lower() for x in registry.TERMS)
        score = 100 * sum(own[:3]) + 0.5 * min(2, len(own)) + 2 * hits(r.section_id) + 1.5 * hits(f"{r.doc_id} > {r.section_id}")
        assert r.evidence_score == pytest.approx(score, abs=1e-5)


def test_pages_headers_levels_and_tree(spark):
    text = "intro\n<!-- page:3 -->\n## A\nx\n```\n# no\n```\n#### B\ny\n## C\n"
    lines = M.to_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [r.page for r in M.page_of_lines(lines).orderBy("line").collect()] == [1, 1] + [3] * 9
    found = M.clamp_levels(M.headers(lines))
    assert [(r.raw_title, r.level) for r in found.orderBy("line").collect()] == [("A", 1), ("B", 2), ("C", 1)]
    tree = M.with_paths(M.section_rows(lines, found)).orderBy("line").collect()
    assert [(r.title_path, r.depth, r.is_leaf, r.node_id, r.subtree_end) for r in tree] == [("A", 0, False, "0000", 1), ("A > B", 1, True, "0001", 1), ("C", 0, True, "0002", 2)]
    assert [r.page for r in M.page_runs(M.page_of_lines(lines)).orderBy("run").collect()] == [1, 3]


def test_chunks_overlap_and_fit():
    text = "\n\n".join(f"p{i} " + "x" * 90 for i in range(12))
    out = C.chunk_text(text, len, 300, 80)
    assert all(n == len(c) <= 300 for c, n in out) and out[1][0].startswith(out[0][0].split("\n\n")[-1])
    assert C.chunk_text("short", len, 300, 80) == [("short", 5)]
    assert "".join(c for c, _ in C.chunk_text("y" * 1000, len, 300, 0)) == "y" * 1000


def test_fusion_prefers_both_lists(spark):
    d = spark.createDataFrame([("c1", "d", "s", 1, 0.99), ("c2", "d", "s", 2, 0.85)], "chunk_id string, doc_id string, section_id string, dense_rank int, dense_score double")
    x = spark.createDataFrame([("c1", "d", "s", 1, 0.77), ("c3", "d", "s", 2, 0.55)], "chunk_id string, doc_id string, section_id string, lexical_rank int, lexical_score double")
    assert [r.chunk_id for r in R.fuse(d, x).orderBy("fused_rank").collect()] == ["c1", "c3", "c2"]


def test_year_within_a_longer_number_is_no_hit(spark):
    texts = ["Customer#000002024", "20240", "FY2024Q3", "2024年", "in 2024.", "32024 and 2024", "Q12 of 2023", None]
    times = F.array(F.lit("2024"), F.lit("Q1"), F.lit("Q3"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", T.time_hits(F.col("t"), times).alias("n")).orderBy("i").collect()] == [0, 0, 2, 1, 1, 1, 0, 0]


def test_localization_and_reranking_match_sql_with_customer_numbers_like_years(spark, tmp_path):
    """Customers 2024 and 20240, whose names hold 2024 within a number, beside the smallest tables."""
    for t in ("region", "nation"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    c = spark.read.parquet(f"{SF}/customer.parquet")
    more = c.filter("c_custkey < 2").withColumn("c_custkey", F.when(F.col("c_custkey") == 0, 2024).otherwise(20240).cast("long")).withColumn("c_name", F.format_string("Customer#%09d", "c_custkey"))
    c.unionByName(more).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("region", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("localization", "reranking"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.SQL[name])
        assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall()), name


def test_localization_ties_go_to_the_smallest_id(spark):
    tree = spark.createDataFrame([("d", f"s{i}", "t", "p", 1, "") for i in (3, 1, 2)], "doc_id string, section_id string, title string, title_path string, depth int, summary string").repartition(3)
    pool = tree.select("doc_id", "section_id", F.lit(0.1).alias("section_score"), F.lit("sibling").alias("relation"), F.lit(2).alias("strength"), F.array().cast("array<string>").alias("reason_codes"))
    none = F.array().cast("array<string>")
    local = R.localize(pool, tree, none, none)
    assert [r.section_id for r in local.orderBy("local_rank").collect()] == ["s1", "s2", "s3"]
    again = R.rerank(local, spark.createDataFrame([], "doc_id string, section_id string, rank int"))
    assert [r.section_id for r in again.orderBy("local_rank").collect()] == ["s1", "s2", "s3"]


def test_section_bodies_match_sql_on_odd_texts(spark, tmp_path):
    texts = ["src0\nbody", " SRC 0 \r\nbody", "src0", "", " \n  \n", None, "a\rb\n\tc ", "\u00a0\n x", "a\0b\n\n c"]
    data = [(i, t, s) for i, t in enumerate(texts) for s in ("src0", "A > src0", "", None)]
    spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES["section_bodies"](spark, str(tmp_path)), con.execute(registry.SQL["section_bodies"])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_section_body_and_context(spark):
    """What chunks are made of: a first line like the title goes, and neither a repeated title nor an empty part is put in."""
    data = [("src 0\r\n\n body ", "A > Src0", "Src0"), ("body", "A", "B"), (" \n", "A", "A"), ("x", "", "T")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, t string, path string, title string").withColumn("body", T.section_body(F.col("t"), F.col("title")))
    out = df.select("i", "body", T.contextual_text(F.col("path"), F.col("title"), F.col("body")).alias("c")).orderBy("i").collect()
    assert [(r.body, r.c) for r in out] == [("body", "A > Src0\nbody"), ("body", "A\nB\nbody"), ("", "A"), ("x", "T\nx")]


def test_fallback_fills_small_documents(spark):
    tree = spark.createDataFrame([("d", "r", None, [], 0), ("d", "s1", "r", ["r"], 1), ("d", "s2", "s1", ["r", "s1"], 2), ("d", "s3", "r", ["r"], 1), ("d", "z", None, [], 0)], "doc_id string, section_id string, parent_id string, ancestor_ids array<string>, depth int")
    anchors = spark.createDataFrame([("d", "s1", 0.03, 1)], "doc_id string, section_id string, section_score double, section_rank int")
    pool = R.candidate_pool(tree, anchors)
    got = {r.section_id: r.relation for r in R.with_fallback(pool, tree, anchors, 9).collect()}
    assert got == {"s1": "anchor", "s2": "descendant", "r": "ancestor", "s3": "sibling", "z": "doc_fallback"}


def test_dedupe_siblings(spark):
    data = [("d", "p", "k", 1, "A", "xx", "", 0), ("d", "p", "k", 1, "a", "xxx", "sum", 1), ("d", "p", "k", 2, "A", "x", "s", 2)]
    out = TR.dedupe_siblings(spark.createDataFrame(data, "doc_id string, parent_id string, title_key string, page_index int, title string, text string, summary string, preorder int")).orderBy("preorder").collect()
    assert [(r.title, r.text, r.summary, r.merged) for r in out] == [("A", "xxx", "sum", 2), ("A", "x", "s", 1)]


def test_sources_and_stream(spark, tmp_path):
    assert tables.outline_entries([{"title": "A", "children": [{"title": "B"}]}, {"title": "C"}]) == [("A", 1), ("B", 2), ("C", 1)]
    assert tables.read_profile('{"regions": {"中国": ["China", ""]}}')["regions"] == {"中国": ["中国", "China"]}
    one = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")
    path = str(tmp_path / "t")
    tables.write_by_document(one, path)
    tables.write_by_document(spark.createDataFrame([("b", 2)], "doc_id string, v int"), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("doc_id", "v").collect()} == {("a", 1), ("b", 2)}
    src = str(tmp_path / "src")
    one.write.parquet(src)
    ingest(spark.readStream.schema(one.schema).parquet(src), lambda b: b.withColumn("v", F.col("v") + 5), path, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(path).select("doc_id", "v").collect()} == {("a", 6), ("b", 6)}
