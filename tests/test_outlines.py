import random

import pytest
from pyspark.sql import functions as F

from leafspan.operators import normalize as N
from leafspan.operators import outline as O
from leafspan.operators import retrieval as R
from leafspan.operators import trees as TR

SECTION = "doc_id string, node string, parent string, ord int, title string, page_index int, text string, summary string, node_id string"


def shape(df):
    return [(r.depth, r.title) for r in df.orderBy("doc_id", "preorder").collect()]


@pytest.mark.parametrize(
    ("line", "want"), [("Growth ..... 12", ("Growth", 12)), ("• 第一章 市场……3", ("第一章 市场", 3)), ("12", None), ("no page", None), ("", None), (None, None), ("a  b : 7 ", ("a b", 7))]
)
def test_contents_line(spark, line, want):
    got = spark.createDataFrame([(line,)], "t string").select(O.contents_line(F.col("t")).alias("c")).first()["c"]
    assert (tuple(got) if got else None) == want


def test_indent_levels_and_columns(spark):
    rows = spark.createDataFrame([("d", x) for x in (10.0, 20.0, 40.0, 300.0, 330.0)], "doc_id string, x double")
    assert [r.level for r in O.indent_levels(rows).orderBy("x").collect()] == [1, 1, 2, 1, 2]


def test_offset_without_a_hit_is_the_smallest(spark):
    pages = spark.createDataFrame([("d", p, f"page {p} Alpha" if p == 4 else "x") for p in range(1, 9)], "doc_id string, page int, plain_text string")
    entries = lambda t: spark.createDataFrame([("d", 0, t, 2)], "doc_id string, entry int, title string, printed_page int")
    assert O.page_offset(entries("Alpha"), pages).first()["page_offset"] == 2
    assert O.page_offset(entries("absent"), pages).first()["page_offset"] == -3


def test_greedy_match_equals_a_plain_loop(spark):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "b", "bc", "", "c d"]
    entries = [(f"d{d}", i, rng.choice(words), i % 3 + 1) for d in range(4) for i in range(8)]
    headers = [(f"d{d}", i, rng.choice(words)) for d in range(4) for i in range(10)]
    want = set()
    for d in range(4):
        free = [e for e in entries if e[0] == f"d{d}"]
        for h in [h for h in headers if h[0] == f"d{d}"]:
            x = h[2].replace(" ", "")
            rank = lambda y: 3 if x == y else 0 if not x or not y else 2 if y in x else 1 if x in y else 0  # noqa: B023, E731
            best = max(free, key=lambda e: (rank(e[2].replace(" ", "")), -e[1]), default=None)
            if best and rank(best[2].replace(" ", "")):
                free.remove(best)
                want.add((h[0], h[1], best[1]))
    got = O.match_entries(spark.createDataFrame(entries, "doc_id string, entry int, title string, level int"), spark.createDataFrame(headers, "doc_id string, line int, title string"))
    assert {(r.doc_id, r.line, r.entry) for r in got.collect()} == want


def test_picture_regions(spark):
    boxes = [(0, 0, 100, 100), (110, 0, 200, 100), (400, 700, 404, 704), (300, 300, 500, 400), (0, 990, 600, 1000)]
    rows = spark.createDataFrame([("d", 1, 600.0, 1000.0, *map(float, b)) for b in boxes], "doc_id string, page int, width double, height double, x0 double, y0 double, x1 double, y1 double")
    assert [(r.region, r.x0, r.y0, r.x1, r.y1) for r in O.picture_regions(rows).orderBy("region").collect()] == [(1, 0, 0, 208, 108), (2, 292, 292, 508, 408)]


def test_picture_regions_stream_pages_through_one_task(spark):
    """As many regions as a plain loop finds on random pages, null corners and keys too, without a Python group a page."""
    rng = random.Random(3)
    data = []
    for doc in ("a", "b", None):
        for page in (1, 2, None):
            for _ in range(rng.randrange(1, 25)):
                x, y = rng.choice([None, *range(0, 900, 90)]), rng.choice([None, *range(0, 1200, 90)])
                data.append((doc, page, 1000.0, 1200.0, x, y, (x or 0) + rng.randrange(10, 99), (y or 0) + rng.randrange(10, 99)))
    schema = "doc_id string, page int, width double, height double, x0 int, y0 int, x1 int, y1 int"
    out = O.picture_regions(spark.createDataFrame(data, schema), most=99, least_share=0.0)
    want = []
    for key in {d[:2] for d in data}:
        last = lambda v: (v is None, v or 0)
        page = sorted((d for d in data if d[:2] == key), key=lambda d: (last(d[5]), last(d[4]), d[7], d[6]))
        now = [[max(0.0, (d[4] or 0) - 8), max(0.0, (d[5] or 0) - 8), min(1000.0, d[6] + 8), min(1200.0, d[7] + 8)] for d in page]
        before = len(now) + 1
        while len(now) < before:
            before, again = len(now), []
            for b in now:
                near = [r for r in again if b[0] - r[2] <= 24 and r[0] - b[2] <= 24 and b[1] - r[3] <= 24 and r[1] - b[3] <= 24]
                if near:
                    near[0][:] = min(near[0][0], b[0]), min(near[0][1], b[1]), max(near[0][2], b[2]), max(near[0][3], b[3])
                else:
                    again.append(list(b))
            now = again
        want += [(*key, *map(float, b)) for b in now if b[1] < 1200 * 0.95]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.page, r.x0, r.y0, r.x1, r.y1)) for r in out.collect())
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_markers_and_numbers(spark):
    flat = lambda *t: spark.createDataFrame([("d", str(i), None, i, x, i + 1, "", "", "") for i, x in enumerate(t)], SECTION)
    assert shape(N.normalise_trees(flat("第一章", "A", "第二章", "B"))) == [(0, "第一章"), (1, "A"), (0, "第二章"), (1, "B")]
    assert shape(N.normalise_trees(flat("第一章", "A", "B"))) == [(0, "第一章"), (0, "A"), (0, "B")]
    assert shape(N.normalise_trees(flat("1 One", "1.1 x", "2.1.1 deep", "1.2 y"))) == [(0, "1 One"), (1, "1.1 x"), (1, "1.2 y"), (0, "2"), (1, "2.1"), (2, "2.1.1 deep")]


def test_copies_weak_roots_ids_and_summaries(spark):
    rows = [("d", "a", None, 0, "Same", 1, "x", "", "id"), ("d", "b", None, 1, " same", 1, "longer", "sum", "id"), ("d", "c", "b", 0, "Kid", None, None, None, None), ("e", "z", None, 0, None, None, None, None, None)]
    out = {(r.doc_id, r.title): r for r in N.normalise_trees(spark.createDataFrame(rows, SECTION)).collect()}
    assert set(out) == {("d", "Same"), ("d", "Kid"), ("e", "Section 1")}
    assert (out["d", "Same"].text, out["d", "Same"].summary, out["d", "Same"].node) == ("longer", "sum", "id")
    assert (out["d", "Kid"].node, out["d", "Kid"].parent, out["d", "Kid"].summary) == ("synthetic:na:1.1:kid", "id", "Kid")
    weak = [("d", str(i), None, i, "图 1 x" if i < 2 else f"T{i}", i, "", "", "") for i in range(8)]
    assert len(shape(N.normalise_trees(spark.createDataFrame(weak, SECTION)))) == 6
    assert len(shape(N.normalise_trees(spark.createDataFrame(weak[:7], SECTION)))) == 7
    kept = spark.createDataFrame([("d", "0")], "doc_id string, node string")
    assert len(shape(N.normalise_trees(spark.createDataFrame(weak, SECTION), kept))) == 7
    assert N.normalise_trees(spark.createDataFrame([], SECTION)).count() == 0


def test_quality_and_score(spark):
    rows = [("d", "a", None, 0, 0, "1 One", 1), ("d", "b", "a", 1, 1, "1.1 x", 2), ("d", "c", "a", 1, 2, "1.2 y", 1)]
    t = spark.createDataFrame(rows, "doc_id string, node string, parent string, depth int, preorder int, title string, page_index int")
    heads = spark.createDataFrame([("d", 1, 1, "One")], "doc_id string, page int, rank int, title string")
    r = TR.tree_score(TR.tree_quality(t, spark.createDataFrame([("d", 4)], "doc_id string, total int"), heads)).first()
    assert (r.root_count, r.max_depth, r.page_backtrack_count, r.internal_node_count) == (1, 2, 1, 1)
    assert (r.page_coverage, r.heading_alignment, r.numbering) == (0.5, 0.3333, 1.0)
    assert r.score == round(30 + 10 + 8 + 2 + 8 + 5.333 + 12 + 10 - 2.5, 3)


def plain_context(path, focus, anc, desc, sib, sup, nei, budget):
    """The budget rule as a loop."""
    compose = lambda bs: "\n\n".join(b.strip() for b in bs if b.strip())
    clip = lambda t, n: t if len(t) <= n else t[:n] if n <= 3 else t[: n - 3].rstrip(" ") + "..."
    near = lambda c, label: [f"[{label}] {p}\n{s}" for p, s in c if s]
    chunks = lambda c, label: [f"[{label} Chunk p{p}] {t}" for p, t in c]
    head, core = f"Title Path: {path}", f"[Focus] {path}\n{focus}"
    a, d, s, u, n = near(anc, "Ancestor"), near(desc, "Descendant"), near(sib, "Sibling"), chunks(sup, "Supporting"), chunks(nei, "Neighbor")
    full = lambda: compose([head, *a, core, *d, *s, *u, *n])
    for group, at in ((n, -1), (s, -1), (d, -1), (a, 0)):
        while len(full()) > budget and group:
            group.pop(at)
    if len(full()) <= budget:
        return full()
    must = compose([head, core])
    if len(must) >= budget:
        return compose([head, clip(core, max(budget - len(head) - 2, 0))])
    return compose([must, clip(compose([*u, *n]), max(budget - len(must) - 2, 0))])


def test_context_equals_a_plain_loop(spark):
    rng = random.Random(5)
    word = lambda: "w" * rng.randint(1, 30)
    some = lambda kind, n: [(kind(), rng.choice(["", word(), word()])) for _ in range(rng.randint(0, n))]
    chunk = lambda n: [(rng.randint(1, 9), word()) for _ in range(rng.randint(0, n))]
    data = [(i, word(), word(), some(word, 3), some(word, 2), some(word, 3), chunk(3), chunk(4)) for i in range(60)]
    near, parts = "array<struct<title_path:string,summary:string>>", "array<struct<page_index:int,text:string>>"
    df = spark.createDataFrame(data, f"id int, title_path string, focus_summary string, ancestors {near}, descendants {near}, siblings {near}, supporting {parts}, neighbours {parts}")
    for budget in (20, 60, 120, 200, 320):
        got = {r.id: r.context_text for r in R.assemble_context(df, budget).collect()}
        assert got == {x[0]: plain_context(*x[1:], budget) for x in data}


def test_rerank_and_labels(spark):
    local = spark.createDataFrame([("d", s, v, 3, 1, s, ["anchor"]) for s, v in (("a", 5.0), ("b", 4.0), ("c", 1.0))], "doc_id string, section_id string, localization_score double, strength int, depth int, title_path string, reason_codes array<string>")
    ranks = spark.createDataFrame([("d", "b", 1), ("d", "b", 2), ("d", "gone", 1), ("d", "c", 1)], "doc_id string, section_id string, rank int")
    out = R.rerank(local, ranks, 2).orderBy("local_rank").collect()
    assert [(r.section_id, r.localization_score) for r in out] == [("b", 5.5), ("a", 5.0)]
    e = spark.createDataFrame([("x",), ("y",)], "evidence_id string")
    labels = spark.createDataFrame([("x", "supports"), ("y", "maybe"), ("z", "related")], "evidence_id string, relation string")
    assert {r.evidence_id: r.relation for r in R.apply_labels(e, labels).collect()} == {"x": "supports", "y": None}
