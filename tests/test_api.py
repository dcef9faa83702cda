import json

import pytest
from pyspark.sql import functions as F

from leafspan import api
from leafspan.__main__ import main
from leafspan.config import Settings, read_env_file, settings
from leafspan.sources import tables

MARKET = "# Market\nall regions\n<!-- page:2 -->\n## Revenue growth\nRevenue in 2024 grew by a tenth.\n## Costs\nCosts stayed level.\n# Outlook\nMore revenue is expected.\n"
FOOD = "# Bread\nFlour, water and salt.\n## Oven\nBake at high heat.\n"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("index")
    (top / "in").mkdir()
    (top / "in" / "market.md").write_text(MARKET, encoding="utf-8")
    (top / "in" / "food.markdown").write_text(FOOD, encoding="utf-8")
    (top / "in" / "other.txt").write_text("# no", encoding="utf-8")
    api.build_index(spark, str(top / "in"), str(top / "out"), embed=lambda texts: [[float("evenue" in t), float("Bake" in t), 1.0] for t in texts], options=Settings(dimensions=3))
    return str(top / "out")


def test_sections(spark, index):
    rows = spark.read.parquet(f"{index}/sections").collect()
    assert {(r.title_path, r.depth, r.is_leaf, r.page_index) for r in rows if "Bread" not in r.title_path} == {("Market", 0, False, 1), ("Market > Revenue growth", 1, True, 2), ("Market > Costs", 1, True, 2), ("Outlook", 0, True, 2)}
    ids = {r.section_id: r for r in rows}
    assert all(r.parent_id is None or (r.parent_id == r.ancestor_ids[-1] and r.title_path.startswith(ids[r.parent_id].title_path)) for r in rows)
    assert spark.read.parquet(f"{index}/chunks").count() == 4


@pytest.mark.parametrize("dense", [False, True])
def test_evidence(spark, index, dense):
    embed = (lambda texts: [[1.0, 0.0, 0.1] for _ in texts]) if dense else None
    out = api.retrieve_evidence(spark, index, "revenue growth 2024", embed=embed, options=Settings(evidence_total=4)).orderBy("evidence_rank").collect()
    assert [r.evidence_rank for r in out] == list(range(1, len(out) + 1)) and len(out) <= 4
    assert out[0].title_path == "Market > Revenue growth"
    assert "[Focus] Market > Revenue growth" in out[0].context_text and "[Ancestor] Market" in out[0].context_text and "[Supporting Chunk p2]" in out[0].context_text


def test_hooks(spark, index):
    def rank(short):
        return short.filter("title = 'Costs'").select("doc_id", "section_id", F.lit(1).alias("rank"))

    out = api.retrieve_evidence(spark, index, "revenue costs", rank=rank, label=lambda e: e.select("evidence_id", F.lit("supports").alias("relation"))).orderBy("evidence_rank").collect()
    assert "Costs" in out[0].title_path and {r.relation for r in out} == {"supports"}


def test_empty_query_and_command_line(spark, index, capsys):
    with pytest.raises(ValueError, match="empty"):
        api.parse_query(spark, "  ")
    assert main(["parse", "compare 2024 games"]) == 0
    assert json.loads(capsys.readouterr().out)["intent"] == "comparison"
    assert main(["retrieve", index, "bake bread", "--evidence-total", "1"]) == 0
    assert "Bread" in json.loads(capsys.readouterr().out)["title_path"]


def test_settings(tmp_path):
    f = tmp_path / "env"
    f.write_text("# note\nLEAFSPAN_RRF_K='7'\nexport LEAFSPAN_TOP_DOCS=3\nLEAFSPAN_ANCHORS=9\n", encoding="utf-8")
    assert read_env_file(tmp_path / "none") == {}
    s = settings({"anchors": "2", "siblings": None}, {"LEAFSPAN_TOP_DOCS": "4", "LEAFSPAN_WHOLE_DOC_FALLBACK": "off", "LEAFSPAN_SIBLINGS": " "}, f)
    assert (s.rrf_k, s.top_docs, s.anchors, s.whole_doc_fallback, s.siblings) == (7, 4, 2, False, 2)
    for bad in ({"rrf_k": "x"}, {"whole_doc_fallback": "maybe"}, {"nothing": 1}):
        with pytest.raises(ValueError):
            settings(bad, {})


def test_documents_replaced_within_a_bucket(spark, tmp_path):
    path, frame = str(tmp_path / "t"), lambda *rows: spark.createDataFrame(list(rows), "doc_id string, v int")
    tables.write_by_document(frame(("a", 1), ("a", 2), ("b", 1), ("c", 1)), path, 1)
    tables.write_by_document(frame(("a", 9), ("d", 1)), path, 1)
    tables.write_by_document(frame(("a", 0)).limit(0), path, 1)
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 1), ("c", 1), ("d", 1)]
