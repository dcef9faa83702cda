"""Mixing sources to target weights by entropy balancing.

Every word of the corpus starts with rate 1. Among all rates whose words meet each source's target, entropy balancing
takes those of least relative entropy; they have the form exp(lambda of the source). Each source has one constraint of
its own, so gradient and curvature of the convex dual are, for every lambda, the source's words (summed over all documents
once, where they lie) times exp(lambda); the Newton steps run on the table of sources as a fold. Rates become whole
copies: a document gets the rate's whole part, and further copies go in hash order of the id as long as the source's
remaining words allow. What is then left is filled greedily from the largest size that fits, as many documents of a
size as fit, down to the smallest: a source misses its target by less than its smallest document without that copy.

Targets: sources in code-point order, null last, weigh 5, 2, 1 in turn, and share all words; a target stops at CAP
times its source's words and the excess is shared again by weight. The table of sources, a row each, is ranked in one
task; documents never are. The place in hash order where a budget ends is found digit by digit: each step sums the words
of DIGIT bits of hash and looks further only into the digit that holds the place, until it has few documents. Rows that
agree in hash, id and size are interchangeable and counted by input partition first.

Nulls and empty texts have size 0 and take 0. A null source is a source. Repeated rows are documents of their own;
which of several equal rows gets a copy is arbitrary but the result's rows are the same. Very long texts are documents
like others. An empty table gives no rows. Only built-in column functions are used; columns other than those named are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.llm.common import BROADCAST_ROWS, join_facts, materialise, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
NEWTON_STEPS = 60
HASH_BITS, DIGIT = 60, 10
EDGE_ROWS = 1000


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source (key struct src): source_size, weight and target. sized has src and size."""
    by = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src.s").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1))
    fill = Window.orderBy("ratio", F.col("src.s").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumn("ratio", CAP * F.col("source_size") / F.col("weight"))
    left = F.sum("source_size").over(everything) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    by = by.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    by = by.withColumn("capped", F.col("level") > F.col("ratio"))
    by = by.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return by.select("src", "source_size", "weight", F.when(F.col("capped"), CAP * F.col("source_size")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def entropy_rates(targets: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """targets with the rate of each source: exp(lambda) after Newton steps on its term of the dual, from lambda 0."""
    words = lambda lam: F.col("source_size") * F.exp(lam)
    lam = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda lam, _: lam + (F.col("target") - words(lam)) / words(lam))
    return targets.withColumn("rate", F.when(F.col("target") > 0, F.exp(lam)).otherwise(0.0))


def _with(rows: DataFrame, facts: DataFrame, key: str, n_keys: int) -> DataFrame:
    """rows joined with facts by key (a struct); held counts the rows of a key, which may be very many."""
    if n_keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts.drop("held")), key)
    return join_facts(rows, facts, key, "held", facts.agg(F.sum("held")).first()[0] or 0)


def take_first(rows: DataFrame, key: str, budgets: DataFrame, weight: str) -> DataFrame:
    """rows with extra: true for the first rows of each key, in order of (h, id, size), whose weights fit its budget.

    rows: key (a struct), h, id, size, row (distinct, its upper bits the input partition) and weight; budgets: key,
    budget and held (the number of rows of the key).
    """
    n_keys, bits = budgets.count(), HASH_BITS
    edge = budgets.withColumn("low", F.lit(0).cast("long")).withColumn("base", F.lit(0.0))
    while bits:
        bits -= DIGIT
        inside = _with(rows, edge, key, n_keys).filter(F.col("h").between(F.col("low"), F.col("low") + (1 << bits + DIGIT) - 1))
        digit = F.shiftright(F.col("h") - F.col("low"), bits)
        first = [F.first(c).alias(c) for c in ("budget", "low", "base")]
        sums = inside.groupBy(key, digit.alias("digit")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"), *first)
        upto = F.col("base") + F.sum("w").over(Window.partitionBy(key).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("upto", upto).filter("upto > budget")
        place = F.struct("digit", "budget", (F.col("upto") - F.col("w")).alias("base"), (F.col("low") + F.shiftleft("digit", bits)).alias("low"), "n")
        edge = over.groupBy(key).agg(F.min(place).alias("e")).select(key, "e.budget", "e.low", "e.base", "e.n")
        edge = materialise(edge.join(budgets.select(key, "held"), key))
        if (edge.agg(F.max("n")).first()[0] or 0) <= EDGE_ROWS:
            break
    # in the last digit: documents that agree in all that decides are counted, and the first ones not wholly taken found
    order = F.struct("h", F.col("id").alias("id"), "size")
    inside = _with(rows, edge, key, n_keys).filter(F.col("h").between(F.col("low"), F.col("low") + (1 << bits) - 1)).withColumn("order", order)
    alike = inside.groupBy(key, "order").agg(F.count("*").alias("n"), F.first(weight).alias("w"), F.first("budget").alias("budget"), F.first("base").alias("base"))
    upto = F.col("base") + F.sum(F.col("n") * F.col("w")).over(Window.partitionBy(key).orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    last = alike.withColumn("upto", upto).filter("upto > budget").withColumn("quota", F.floor((F.col("budget") - F.col("upto")) / F.col("w")) + F.col("n"))
    last = last.groupBy(key).agg(F.min(F.struct("order", "quota")).alias("l")).select(key, F.col("l.order").alias("last"), F.col("l.quota").alias("quota"))
    edge = materialise(edge.select(key, "held", "low").join(last, key))
    at = _with(rows, edge, key, n_keys).filter((order == F.col("last")) & (F.col("quota") > 0)).select(key, "quota", "row", F.shiftright("row", 33).alias("part"))
    parts = at.groupBy(key, "part").agg(F.count("*").alias("c"))
    before = parts.withColumn("before", F.sum("c").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    nth = F.row_number().over(Window.partitionBy(key, "part").orderBy("row"))
    picks = at.withColumn("nth", nth).join(before, [key, "part"]).filter(F.col("before") + F.col("nth") <= F.col("quota")).select("row", F.lit(True).alias("picked"))
    facts = budgets.select(key, "held").join(edge.drop("held"), key, "left")
    extra = F.col("last").isNull() | (order < F.col("last")) | F.col("picked").isNotNull()
    out = _with(rows, facts, key, n_keys).join(materialise(picks), "row", "left").withColumn("extra", extra)
    return out.drop("last", "quota", "low", "picked")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: the id, size, source_size, target, rate, copies and taken."""
    digest = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"), F.struct(F.col(source_col).alias("s")).alias("src"), word_count(text_col).alias("size"),
            F.conv(digest, 16, 10).cast("long").alias("h"), F.monotonically_increasing_id().alias("row"),
        )
    )
    sources = rows.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("held"))
    sources = materialise(sources)
    rates = entropy_rates(source_targets(sources)).join(sources.select("src", "held"), "src")
    rates = rates.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    rates = materialise(rates)
    n_sources = rates.count()
    rows = materialise(take_first(rows, "src", rates.select("src", "budget", "held"), "size"))
    used = rows.groupBy("src").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("used"))
    left = rates.select("src", "budget", "held").join(used, "src").withColumn("left", F.col("budget") - F.col("used"))
    free = _with(rows.filter(~F.col("extra") & (F.col("size") > 0)), left.select("src", "left", "held"), "src", n_sources).filter(F.col("size") <= F.col("left"))
    sizes = free.groupBy("src", "size").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    each = sizes.groupBy("src").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("sizes"))
    none = F.slice(F.transform("sizes", lambda x: F.struct(x["size"].alias("size"), x["n"].alias("k"))), 1, 0)

    def fill(state, x):
        k = F.least(x["n"], F.floor(state["left"] / x["size"]))
        took = F.when(k > 0, F.array(F.struct(x["size"].alias("size"), k.alias("k")))).otherwise(none)
        return F.struct((state["left"] - k * x["size"]).alias("left"), F.concat(state["took"], took).alias("took"))

    filled = each.select("src", F.explode(F.aggregate("sizes", F.struct(F.col("left").cast("double").alias("left"), none.alias("took")), fill, lambda s: s["took"])).alias("t"))
    # a key of source and size, whose first k documents get a copy
    kind = F.struct("src", "size")
    quotas = materialise(filled.select(F.struct("src", F.col("t.size").alias("size")).alias("kind"), F.col("t.k").cast("double").alias("budget")).join(sizes.select(kind.alias("kind"), F.col("n").alias("held")), "kind"))
    candidates = free.withColumn("kind", kind).withColumn("one", F.lit(1)).select("kind", "h", "id", "size", "row", "one")
    picks = take_first(candidates, "kind", quotas, "one").filter("extra").select("row", F.lit(True).alias("picked"))
    out = _with(rows, rates.drop("budget"), "src", n_sources).join(materialise(picks), "row", "left")
    copies = F.col("whole") + (F.col("extra") | F.coalesce(F.col("picked"), F.lit(False))).cast("long")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s0),
s2 AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s2 WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT source, source_size, CASE WHEN level > ratio THEN 3.0::DOUBLE * source_size ELSE max(CASE WHEN level > ratio THEN NULL ELSE level END) OVER () * weight END AS target FROM s3),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS whole FROM s4),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size, rn ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT *, cum <= budget AS extra FROM c),
l0 AS (SELECT source, max(budget) - sum(CASE WHEN extra THEN size ELSE 0 END) AS left_over FROM e GROUP BY source),
z AS (SELECT e.source, size, count(*) AS n, row_number() OVER (PARTITION BY e.source ORDER BY size DESC) AS i FROM e JOIN l0 ON e.source IS NOT DISTINCT FROM l0.source WHERE NOT extra AND size > 0 AND size <= left_over GROUP BY e.source, size),
f AS (WITH RECURSIVE r AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(left_over AS DOUBLE) AS left_over, CAST(0 AS BIGINT) AS size, CAST(0 AS DOUBLE) AS k FROM l0
  UNION ALL SELECT r.source, z.i, r.left_over - least(n, floor(r.left_over / z.size)) * z.size, z.size, CAST(least(n, floor(r.left_over / z.size)) AS DOUBLE) FROM r JOIN z ON r.source IS NOT DISTINCT FROM z.source AND z.i = r.i + 1) SELECT * FROM r WHERE k > 0),
p AS (SELECT rn FROM (SELECT e.rn, k, row_number() OVER (PARTITION BY e.source, e.size ORDER BY h, doc_id, rn) AS nth FROM e JOIN f ON e.source IS NOT DISTINCT FROM f.source AND e.size = f.size WHERE NOT extra) WHERE nth <= k)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN whole + CASE WHEN extra OR rn IN (SELECT rn FROM p) THEN 1 ELSE 0 END ELSE 0 END * size AS BIGINT) AS taken
FROM e
"""
