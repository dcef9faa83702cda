import json
import random

import pytest
from pyspark.sql import functions as F

import leafspan
from leafspan import api, models
from leafspan.__main__ import main
from leafspan.config import Settings
from leafspan.functions import text as T
from leafspan.operators import fallback as FB
from leafspan.operators import markdown as M
from leafspan.operators import retrieval as R
from leafspan.operators import trees as TR
from leafspan.sources import tables

PAGED = "# Report\nintro\n<!-- page: 1 -->\n## One\ntext one\n<!-- page: 2 -->\nonly prose here\n<!-- page: 3 -->\n### Deep\n# Late\n"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def levels_of(levels):
    """The level rule as a loop."""
    deepest, out = 1, []
    for x in levels:
        x = max(1, min(6, x, deepest + 1))
        out.append(x)
        deepest = max(deepest, x)
    return [x - 1 for x in out] if out and min(out) >= 2 else out


def test_clamped_levels_equal_a_loop(spark):
    rng = random.Random(1)
    given = [[1, 2, 3, 1, 3], [4, 4], [2, 4, 2], [6]] + [[rng.randint(1, 6) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(d, 2 * i, k, "t") for d, levels in enumerate(given) for i, k in enumerate(levels)]
    got = {}
    for r in M.clamp_levels(spark.createDataFrame(rows, "doc_id int, line int, level int, raw_title string")).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(r.level)
    assert got == {d: levels_of(x) for d, x in enumerate(given)}


def test_page_per_page(spark):
    lines = M.page_of_lines(M.to_lines(docs(spark, PAGED, "no heading\nat all")))
    nodes = M.page_forest(lines, M.headers(lines)).orderBy("doc_id", "node_id").collect()
    assert [(r.doc_id, r.title, r.page_index, r.untitled) for r in nodes] == [(0, "Report", 1, False), (0, "Report", 1, False), (0, "第 2 页", 2, True), (0, "Late", 3, False), (1, "Document", 1, False), (1, "第 1 页", 1, True)]
    assert nodes[0].text == "# Report\nintro\n<!-- page: 1 -->" and nodes[3].text == "### Deep\n# Late"
    titled = M.title_pages(M.page_forest(lines, M.headers(lines))).orderBy("doc_id", "node_id").collect()
    assert titled[2].title == "only prose here <!-- page: 3 …"[:29] + "…" or titled[2].title.startswith("only prose here")
    given = spark.createDataFrame([(0, "0002", '标题：" Prose "\nmore'), (1, "0001", "")], "doc_id int, node_id string, answer string")
    assert [r.title for r in M.title_pages(M.page_forest(lines, M.headers(lines)), titles=given).filter("untitled").orderBy("doc_id").collect()][1] == "no heading at all"
    assert M.untitled_pages(M.page_forest(lines, M.headers(lines))).count() == 2


def test_forest_starts_at_the_first_top_heading(spark):
    text = "## Early\n# Top\n## In\n"
    found = M.after_first_top(M.headers(M.to_lines(docs(spark, text))))
    assert [r.raw_title for r in found.orderBy("line").collect()] == ["Top", "In"]
    with pytest.raises(Exception, match="level 1"):
        M.after_first_top(M.headers(M.to_lines(docs(spark, "## Only"))), strict=True).collect()
    ranges = spark.createDataFrame([(0, 7, 0, 1)], "doc_id int, range int, first_line int, last_line int")
    assert [r.raw_title for r in M.headers_between(M.headers(M.to_lines(docs(spark, text))), ranges, 2).collect()] == ["Early"]
    assert M.top_headers(M.headers(M.to_lines(docs(spark, text)))).count() == 1


def test_layouts_outline_and_command_line(spark, tmp_path, capsys):
    auto = api.section_table(docs(spark, PAGED, "# A\n### B\n")).orderBy("doc_id", "node_id").collect()
    assert [(r.doc_id, r.title_path) for r in auto] == [(0, "Report"), (0, "Report > Report"), (0, auto[2].title_path), (0, "Report > Late"), (1, "A"), (1, "A > B")]
    (tmp_path / "toc.json").write_text(json.dumps([{"title": "A", "children": [{"title": "B", "children": [{"title": "C"}]}]}]), encoding="utf-8")
    outline = tables.read_outline(spark, str(tmp_path / "toc.json"))
    rows = api.section_table(docs(spark, "# A\n# B\n# C\n# D\n"), outline=outline).orderBy("node_id").collect()
    assert [r.title_path for r in rows] == ["A", "A > B", "A > B > C", "D"]
    with pytest.raises(ValueError, match="layout"):
        api.section_table(docs(spark, "x"), "other")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(PAGED, encoding="utf-8")
    assert main(["sections", str(tmp_path / "in")]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 4
    with pytest.raises(ValueError, match="no such input"):
        api.build_index(spark, str(tmp_path / "gone"), str(tmp_path / "out"))


def test_settings_reach_the_chunks_and_postings_lose_nothing(spark, tmp_path):
    rng = random.Random(3)
    words = ["market", "revenue", "bread", "oven", "cost", "growth", "Q3", "ab", "中国市场"]
    texts = ["# T%d\n" % i + "".join(f"## S{k} {rng.choice(words)}\n" + " ".join(rng.choices(words, k=40)) + "\n" for k in range(3)) for i in range(12)]
    api.index_documents(docs(spark, *texts).withColumn("doc_id", F.col("doc_id").cast("string")), str(tmp_path), options=Settings(chunk_tokens=20, chunk_overlap=0), count=lambda t: len(t.split()))
    chunks, grams = spark.read.parquet(f"{tmp_path}/chunks"), spark.read.parquet(f"{tmp_path}/grams")
    assert chunks.agg(F.max("token_count")).first()[0] <= 20 and chunks.filter("text_hash <> sha2(chunk_text, 256)").count() == 0
    for text in ("revenue growth", "oven zzz", "nothing at all", "中国 bread"):
        terms = api.parse_query(spark, text).terms
        near = R.posted_candidates(grams, text, terms)
        whole = [tuple(r) for r in R.lexical_recall(chunks, text, terms).select("chunk_id", "lexical_rank", "lexical_score").orderBy("lexical_rank").collect()]
        if near is None:
            assert any(len(t) < 3 for t in terms)
            continue
        part = R.lexical_recall(chunks.join(near, ["doc_id", "chunk_id"], "left_semi"), text, terms).select("chunk_id", "lexical_rank", "lexical_score").orderBy("lexical_rank").collect()
        assert [tuple(r) for r in part] == whole
    assert api.retrieve_tree(spark, str(tmp_path), "revenue growth").count() > 0


def test_query_understanding(spark):
    names = {"regions": {"China": ["China", "中国", "PRC"]}, "genres": {"SLG": ["SLG", "strategy game"]}}
    q = api.parse_query(spark, "  中国 slg revenue 2024 Q3 ", names)
    assert (q.text, q.names["regions"], q.names["genres"], q.years, q.quarters) == ("中国 slg revenue 2024 Q3", ["China"], ["SLG"], [2024], ["2024Q3"])
    assert q.times == ["2024", "2024Q3"] and {"slg", "revenue", "2024", "2024q3", "中国"} <= set(q.terms)
    calls = []

    def model(prompt):
        calls.append(prompt)
        return 'Sure: {"language": "en", "terms": ["market", " "], "regions": "prc", "intent": "trend", "time_scope": {"years": ["2023", "x"], "quarters": ["q1"]}} done'

    rich = api.parse_query(spark, "abc", names, model)
    assert rich.enriched and rich.intent == "trend" and rich.names["regions"] == ["China"] and rich.years == [2023] and rich.quarters == ["Q1"] and "market" in rich.terms
    assert not api.parse_query(spark, "trend of revenue growth 2024", names, model).enriched and len(calls) == 1
    assert api.parse_query(spark, "abc", names, lambda p: "no json").names["regions"] == []
    value = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert value(T.enrichment_reason(F.lit("??"))) == "unknown_language" and value(T.enrichment_reason(F.lit("abc"))) == "very_short_query"
    assert value(T.enrichment_reason(F.lit("revenue"))) == "insufficient_terms_and_time_scope" and value(T.enrichment_reason(F.lit("revenue growth"))) == "generic_intent_with_sparse_terms"
    assert value(T.canonical(F.array(F.lit("prc"), F.lit("x"), F.lit("中国")), names["regions"])) == ["China", "x"]
    assert value(T.derived_terms(F.lit("第3季度"))) == ["季度"]


def test_models():
    tries = []

    def flaky(prompt):
        tries.append(prompt)
        raise RuntimeError("down")

    waits = []
    assert models.steadfast(flaky, lambda p: p + "!", 3, waits.append)("a") == "a!" and len(tries) == 3 and waits == [1.5, 3.0]
    with pytest.raises(RuntimeError):
        models.steadfast(flaky, None, 2, waits.append)("a")
    assert models.lazily(lambda: 1 / 0) is None and models.payload('x {"a": {"b": 1}} y') == {"a": {"b": 1}}
    assert models.string_list([" a", "a", None, ""]) == ["a", "None"] and models.string_list("x") == ["x"] and models.string_list(None) == []
    assert models.embedder(lambda t: [[float(len(t))]] * len(t), 2)(list("abc")) == [[2.0], [2.0], [1.0]]


def test_model_hooks(spark):
    local = spark.createDataFrame([("d", f"s{k}", "p", "sum", k) for k in (1, 2)] + [("e", "s9", "p", "sum", 1)], "doc_id string, section_id string, title_path string, summary string, local_rank int")
    rank = models.ranker(lambda p: '{"ranked_sections": [{"section_id": "gone"}, {"section_id": "s2"}]}' if "s2" in p else "broken", "q")
    assert sorted(tuple(r) for r in rank(local).collect()) == [("d", "gone", 1), ("d", "s2", 2)]
    evidence = spark.createDataFrame([("x", 1, "p", "text")], "evidence_id string, evidence_rank int, title_path string, context_text string")
    label = models.labeller(lambda p: '{"labeled_evidence": [{"evidence_id": "x", "relationship_label": "supports"}]}', "q")
    assert [tuple(r) for r in label(evidence).collect()] == [("x", "supports")]
    assert models.labeller(lambda p: "no", "q")(evidence).count() == 0


def test_trees_given_as_json(spark):
    tree = [{"title": "A", "node_id": "0", "page_index": 1, "text": "a", "nodes": [{"title": "B", "node_id": "1", "nodes": [{"title": "C", "node_id": "2"}]}, {"title": "D", "node_id": "3"}]}, {"title": "E", "node_id": "4"}]
    rows = TR.flatten_tree(tree, "d")
    assert [(r["title_path"], r["depth"], r["parent_id"], r["is_leaf"]) for r in rows] == [("A", 0, None, False), ("A > B", 1, "0", False), ("A > B > C", 2, "1", True), ("A > D", 1, "0", True), ("E", 0, None, True)]
    df = spark.createDataFrame([(r["doc_id"], r["node_id"], r["parent_id"], r["preorder"], r["title"], r["page_index"], r["text"]) for r in rows], "doc_id string, node_id string, parent_id string, ord int, title string, page_index int, text string")
    back = json.loads(TR.nested_json(df).first()["result"])
    assert back[0]["nodes"][0]["nodes"][0]["title"] == "C" and [n["title"] for n in back] == ["A", "E"] and "nodes" not in back[1]
    sections = df.withColumn("section_id", F.col("node_id")).withColumn("depth", F.lit(0)).withColumn("summary", F.lit(""))
    assert len(TR.section_records(sections).columns) == 7 and tables.public_columns(sections.withColumn("preorder", F.lit(1))).columns == sections.columns


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.json")
    assert tables.read_json(spark, path) is None
    tables.write_json(spark, {"a": "中"}, path)
    assert tables.read_json(spark, path) == {"a": "中"} and "中" in (tmp_path / "x.json").read_text(encoding="utf-8")


def test_paged_documents_without_a_model(spark):
    text = "Revenue of the market grew by a tenth and costs stayed level over the whole year"
    pages = spark.createDataFrame([("d", p, f"Chapter {p} {text}", 3, 800.0) for p in range(1, 5)] + [("poor", 1, "x", 1, 800.0)], "doc_id string, page long, plain_text string, block_count long, page_height double")
    lines = spark.createDataFrame([("d", p, 1, f"Chapter {p} of it", 0.0, 10.0) for p in range(1, 5)], "doc_id string, page long, line int, text string, x double, y double")
    spans = spark.createDataFrame([("d", p, k, f"Chapter {p} of it" if not k else "body text", 30.0 if not k else 10.0, False, 0.0, 10.0 + 20 * k) for p in range(1, 5) for k in range(4)], "doc_id string, page long, span int, text string, size double, bold boolean, x double, y double")
    tree, errors = api.build_paged(pages, lines, spans, {"native": lambda *_: 1 / 0})
    rows = tree.orderBy("preorder").collect()
    assert [r.title for r in rows] == [f"Chapter {p} of it" for p in range(1, 5)] and {r.doc_id for r in rows} == {"d"} and {r.name for r in rows} == {"pages"}
    assert errors[0][0] == "native" and errors[0][1].startswith("ZeroDivisionError")
    report = api.benchmark(pages, lines, spans, {"pages": {}, "broken": None}, {"d": tree})
    assert [r["status"] for r in report] == ["success", "error"] and report[0]["comparison"]["title_recall"] == 1.0 and report[0]["nodes"] == 4
    plan = spark.createDataFrame([("high", 3), ("low", 0), ("low", 2), ("none", 0)], "c string, n int").select(FB.candidate_plan(F.col("c"), F.col("n")).alias("p"))
    assert [r.p[0] for r in plan.collect()] == ["outline", "native", "native", "native"]


def test_public_names():
    assert callable(leafspan.parse_query) and leafspan.Settings is Settings and set(leafspan.__all__) >= {"build_index", "compare_trees", "retrieve_evidence", "package"}
    with pytest.raises(AttributeError):
        leafspan.nothing  # noqa: B018
