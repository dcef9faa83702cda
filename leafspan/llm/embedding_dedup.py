"""Near-duplicate embeddings by a forest of random-projection trees.

Equal embeddings of a label are one vector with a multiplicity. Every tree splits unit vectors by random directions, level
by level, at the node's median in a bounded sample (0 below the depth that the sample supports). Vectors within SPILL of
a split go to both sides, so near pairs are seldom parted. All vectors are put into leaves; vectors of one leaf and label
are compared by matrix products in double precision. A pair is counted in the first leaf (tree, number) that holds both
its vectors and skipped in every later one, so counts need no table of pairs. Leaves travel in branches (the subtrees
below one node), a vector once for each branch. Each branch sends link counts and one edge per vector to a root of its
own; the edges of all branches are joined to components.

Leaves over BLOCK_ROWS vectors travel alone, cut into slices by a hash of the id, and every two slices meet in a task of
their own: no row is dropped, and no task holds more than two slices. Vectors of different lengths are never compared;
each length has trees of its own.

Vectors that are null, empty, zero or hold null or non-finite components, null labels or null ids link with nothing (0
links, their own component; null ids have no component and are not kept). Vectors are scaled by their largest component
before their norm is taken, so no finite one is lost. Rows that share an id and a label are one vector if their embeddings
are equal; an id with several embeddings links through any of them, and has the links of all. Texts
play no part. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import components, join_facts, materialise, table, tidy

TREES = 4
LEAF_ROWS = 256
SAMPLE_ROWS = 8192
SAMPLE_LEAST = 16
SPILL = 0.022
BLOCK_ROWS = 4000
BRANCH_LEVELS = 4
TILE_ROWS = 1000


class Forest:
    """Directions by (tree, level) and thresholds by (tree, node), nodes numbered as in a heap."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int, depth: int, spill: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.depth, self.spill, self.trees = depth, spill, trees
        self.directions = rng.standard_normal((trees, max(depth, 1), max(dim, 1)))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.thresholds: list[dict[int, float]] = []
        for t in range(trees):
            cuts: dict[int, float] = {}
            groups = {1: np.arange(len(sample))}
            for level in range(depth):
                below = {}
                for node, rows in groups.items():
                    if len(rows) < SAMPLE_LEAST:
                        continue
                    p = sample[rows] @ self.directions[t, level]
                    cuts[node] = cut = float(np.median(p))
                    below[2 * node], below[2 * node + 1] = rows[p < cut], rows[p >= cut]
                groups = below
            self.thresholds.append(cuts)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf) of every leaf that every row of x goes to."""
        out = []
        for t in range(self.trees):
            rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                p = x[rows] @ self.directions[t, level]
                names, inverse = np.unique(nodes, return_inverse=True)
                cut = np.array([self.thresholds[t].get(int(n), 0.0) for n in names])[inverse]
                low, high = p < cut + self.spill, p >= cut - self.spill
                rows, nodes = np.concatenate((rows[low], rows[high])), np.concatenate((2 * nodes[low], 2 * nodes[high] + 1))
            out.append((rows, np.full(len(rows), t), nodes))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def unit_rows(values: list[np.ndarray]) -> list[np.ndarray]:
    """Unit vectors of finite vectors that are not zero."""
    out = []
    for v in values:
        x = np.asarray(v, np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.linalg.norm(x))
    return out


def _linked(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of rows of x with that cosine or more, by tiles."""
    left, right = [], []
    for lo in range(0, len(x), TILE_ROWS):
        for at in range(lo, len(x), TILE_ROWS):
            a, b = np.nonzero(x[lo : lo + TILE_ROWS] @ x[at : at + TILE_ROWS].T >= cosine)
            up = a + lo < b + at
            left.append(a[up] + lo)
            right.append(b[up] + at)
    return np.concatenate(left), np.concatenate(right)


def _roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component under the edges (a, b)."""
    out = ids.copy()
    while True:
        before = out.copy()
        np.minimum.at(out, a, out[b])
        np.minimum.at(out, b, out[a])
        if (out == before).all():
            return out


def _shared_before(a: np.ndarray, b: np.ndarray, holds: np.ndarray, code: int) -> np.ndarray:
    """Whether rows a and b share a leaf with a smaller code. holds: the leaves of each row, -1 where there are fewer."""
    out = np.zeros(len(a), bool)
    step = max(1, (1 << 22) // holds.shape[1] ** 2)
    for lo in range(0, len(a), step):
        x, y = holds[a[lo : lo + step]], holds[b[lo : lo + step]]
        x = np.where((x >= 0) & (x < code), x, -2)
        out[lo : lo + step] = (x[:, :, None] == y[:, None, :]).any((1, 2))
    return out


def _branch_links(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links found in the leaves of a branch, or between two slices of one leaf: id, links counted here, a root.

    leaf 0 stands for the leaves of the branch that do not travel alone (those are in large).
    """
    whole, i, j = (int(pdf[c].iloc[0]) for c in ("leaf", "i", "j"))
    ids, own, mult = pdf["id"].to_numpy(), pdf["own"].to_numpy(), pdf["mult"].to_numpy()
    dim = int(pdf["dim"].iloc[0])
    x = np.array(unit_rows([np.frombuffer(v, np.float64 if len(v) == 8 * dim else np.float32) for v in pdf["v"]]))
    leaves = pdf["leaves"].tolist()
    holds = np.full((len(ids), max(map(len, leaves))), -1, np.int64)
    for k, h in enumerate(leaves):
        holds[k, : len(h)] = h
    branch = int(pdf["branch"].iloc[0])
    at, place = np.nonzero(holds == whole if whole else holds >> BRANCH_LEVELS == branch)
    codes = holds[at, place]
    large = set(pdf["large"].iloc[0])
    left, right, count = [], [], np.zeros(len(ids), np.int64)
    for code in np.unique(codes).tolist():
        if code in large:
            continue
        leaf = at[codes == code]
        a, b = (leaf[k] for k in _linked(x[leaf], cosine))
        keep = ids[a] != ids[b]
        if i != j:
            keep &= own[a] != own[b]
        a, b = a[keep], b[keep]
        left.append(a)
        right.append(b)
        new = ~_shared_before(a, b, holds, code)
        np.add.at(count, a[new], mult[b[new]])
        np.add.at(count, b[new], mult[a[new]])
    a, b = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (left, right))
    root = _roots(a, b, ids)
    some = (count > 0) | (root != ids)
    return pd.DataFrame({"id": ids[some], "links": count[some], "root": root[some]})


def _forests(merged: DataFrame, trees: int, spill: float) -> dict[int, Forest]:
    """A forest for each length of vectors, with thresholds from a sample of about SAMPLE_ROWS vectors in all."""
    most = {r["dim"]: r["most"] for r in merged.groupBy(F.size("v").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("most")).collect()}
    share = min(1.0, SAMPLE_ROWS / max(merged.count(), 1))
    chosen = merged.filter(F.xxhash64("rep", F.lit(5)).cast("double") <= F.lit(-(2.0**63) + share * 2.0**64))
    samples: dict[int, list[np.ndarray]] = {}
    for r in sorted(chosen.select("rep", "v").collect(), key=lambda r: (r["rep"], r["v"])) if max(most.values(), default=0) > LEAF_ROWS else ():
        samples.setdefault(len(r["v"]), []).extend(unit_rows([r["v"]]))
    out = {}
    for dim, n in most.items():
        depth = max(0, math.ceil(math.log2(n / LEAF_ROWS)))
        out[dim] = Forest(np.array(samples.get(dim, [])).reshape(-1, dim), dim, trees if depth else 1, depth, spill)
    return out


def near_embeddings(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """Per row: the id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    all_ids = vectors.select(F.col(id_col).alias("id"))
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    src = src.filter("id is not null and label is not null").filter(finite & F.exists("v", lambda c: c != 0))
    # an id with several embeddings keeps each of them to itself, so that their links are its own
    hashed = src.select("*", F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(7), "v", "label").alias("b")).alias("same"))
    several = hashed.groupBy("label", "id").agg(F.count_distinct("same").alias("n")).filter("n > 1").select("label", "id", F.col("id").alias("apart"))
    several = materialise(several)
    hashed = hashed.join(several, ["label", "id"], "left") if several.limit(1).count() else hashed.withColumn("apart", F.lit(None).cast("long"))
    hashed = hashed.withColumn("same", F.struct("same", "apart"))
    merged = hashed.groupBy("same").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("mult"), F.count("*").alias("held"), F.first("label").alias("label"), F.first("v").alias("v"))
    merged = materialise(merged)
    shared = spark.sparkContext.broadcast(_forests(merged, trees, spill))
    label_kind = dict(merged.dtypes)["label"]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.asarray(v, np.float64) for v in b.column(3).to_pylist()]
            units = unit_rows(values)
            leaves: list[np.ndarray] = [np.empty(0, np.int64)] * len(values)
            for dim in {len(u) for u in units}:
                own = [k for k, u in enumerate(units) if len(u) == dim]
                row, tree, leaf = shared.value[dim].leaves(np.array([units[k] for k in own]))
                code = (tree.astype(np.int64) << 48) | leaf
                order = np.lexsort((code, row))
                cuts = np.searchsorted(row[order], np.arange(len(own) + 1))
                for n, k in enumerate(own):
                    leaves[k] = code[order[cuts[n] : cuts[n + 1]]]
            with np.errstate(over="ignore"):
                halves = [v.astype(np.float32) for v in values]  # half the bytes where nothing is lost
            raw = [(h if (h == v).all() else v).tobytes() for h, v in zip(halves, values, strict=True)]
            more = [pa.array([len(v) for v in values], pa.int32()), pa.array(leaves, pa.list_(pa.int64())), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *more], names=["id", "label", "mult", "dim", "leaves", "v"])

    schema = f"id long, label {label_kind}, mult long, dim int, leaves array<long>, v binary"
    planted = materialise(merged.select(F.col("rep").alias("id"), "label", "mult", "v").mapInArrow(tidy(plant), schema))
    group = lambda code: F.struct("label", "dim", code.alias("code"))
    branch = lambda code: F.shiftright(code, BRANCH_LEVELS)
    sizes = planted.select("label", "dim", F.explode("leaves").alias("code")).groupBy("label", "dim", "code").agg(F.count("*").alias("size"))
    sizes = materialise(sizes)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    large = sizes.filter(F.col("size") > BLOCK_ROWS)
    some_large = large.limit(1).count() > 0
    none = F.array().cast("array<long>")
    # a row for each branch that holds leaves of the vector, without those that travel alone
    in_branch = large.groupBy(group(branch(F.col("code"))).alias("at")).agg(F.collect_list("code").alias("large"), F.sum("size").alias("held"))
    by_branch = planted.withColumn("branch", F.explode(F.array_distinct(F.transform("leaves", branch)))).withColumn("at", group(F.col("branch")))
    by_branch = join_facts(by_branch, in_branch, "at", "held", total, "left") if some_large else by_branch.withColumn("large", none)
    by_branch = by_branch.withColumn("large", F.coalesce("large", none)).filter(F.exists("leaves", lambda c: (branch(c) == F.col("branch")) & ~F.array_contains("large", c)))
    by_branch = by_branch.select("*", F.lit(0).cast("long").alias("leaf"), *[F.lit(0).alias(c) for c in ("i", "j", "own")])
    # a row for each two slices of a large leaf
    cut = large.select(group(F.col("code")).alias("at"), F.col("size").alias("held"), F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("slices"))
    alone = join_facts(planted.withColumn("leaf", F.explode("leaves")).withColumn("at", group(F.col("leaf"))), cut, "at", "held", total)
    alone = alone.withColumn("own", F.pmod(F.xxhash64("id", "v"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    alone = alone.select("*", F.lit(0).cast("long").alias("branch"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), none.alias("large"))
    key = ["label", "dim", "branch", "leaf", "i", "j"]
    columns = [*key, "own", "id", "mult", "v", "leaves", "large"]
    placed = by_branch.select(columns).unionByName(alone.select(columns)) if some_large else by_branch.select(columns)
    found = materialise(placed.groupBy(key).applyInPandas(lambda pdf: _branch_links(pdf, cosine), "id long, links long, root long"))
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = merged.select("same", "rep", "mult", "held").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialise(named.select("same", "held", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    of_id = join_facts(hashed.select("id", "same"), named, "same", "held", named.agg(F.sum("held")).first()[0] or 0).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    facts = materialise(all_ids.groupBy("id").agg(F.count("*").alias("held")).join(of_id, "id", "left"))
    out = join_facts(all_ids, facts, "id", "held", facts.agg(F.sum("held")).first()[0] or 0, "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", F.col("id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (WITH RECURSIVE r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x) SELECT * FROM r),
deg AS (SELECT x, count(*) AS n_links FROM links GROUP BY x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN deg ON vec_id = deg.x JOIN comp ON vec_id = comp.x
"""
