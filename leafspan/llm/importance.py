"""Importance resampling of documents towards a target by hashed n-gram models.

Words and word pairs are hashed to features, whose number grows with the square root of the corpus's bytes (as distinct
words do): the next power of two above BUCKETS_PER_ROOT times the root, LEAST_BUCKETS at least. Two bag-of-features
models, one of the raw corpus (counts over all documents) and one of the target (a bounded, hash-chosen sample of the
documents marked as good), give each document the log importance weight sum(log p_target - log p_raw). Adding Gumbel
noise, a fixed function of the id, and keeping the largest keys samples without replacement in proportion to the weights.

Tasks send their counts by range of features, compressed; each range is summed in a task of its own, and the driver gets
the log ratios only. The cut is found exactly by narrowing a histogram of the keys; keys never go to the driver except
the last few thousand candidates. Rows tied at the cut are all kept.

Null and empty texts have weight 0. Repeated rows have the same noise and are kept or dropped together. Very long texts
are counted and weighed whole, in batches of bounded bytes. With no target document all weights are 0 and the sample is
uniform; an empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, materialise, small, table, tidy
from leafspan.llm.texthash import mix, word_hashes

BUCKETS_PER_ROOT = 2
LEAST_BUCKETS = 1 << 13
RANGE = 1 << 13
TARGET_ROWS = 5000
KEEP = 0.5
SMOOTH = 1.0
CHUNK_BYTES = 1 << 20


def features(texts: list[bytes | None], buckets: int) -> Iterator[np.ndarray]:
    """The hashed words and word pairs of each text (A-Z lower-cased), with repeats."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < CHUNK_BYTES):
            size += len(texts[end] or b"")
            end += 1
        part = [(t or b"").lower() for t in texts[at:end]]
        starts, h = word_hashes(b"\n".join(part))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        one = (h % np.uint64(buckets)).astype(np.int64)
        two = (mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(buckets)).astype(np.int64)
        for i in range(len(part)):
            lo, hi = bounds[i], bounds[i + 1]
            yield np.concatenate((one[lo:hi], two[lo : max(lo, hi - 1)]))
        at = end


def bucket_count(n_bytes: int) -> int:
    """The number of features for a corpus of n_bytes bytes, a power of two."""
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1.0, BUCKETS_PER_ROOT * math.sqrt(n_bytes)))))


def log_ratios(docs: DataFrame, chosen: DataFrame, n_chosen: int, id_col: str, text_col: str, buckets: int) -> np.ndarray:
    """log p_target - log p_raw of every feature, from the counts of the chosen and of all documents; 0 with none chosen."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).join(small(chosen.withColumn("own", F.lit(True)), n_chosen), "id", "left").select("t", "own")
    ranges = -(-buckets // RANGE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, ranges * RANGE), np.uint32)
        for b in byte_slices(batches, 0):
            for own, f in zip(b.column(1).to_pylist(), features(b.column(0).to_pylist(), buckets), strict=True):
                seen, n = np.unique(f, return_counts=True)
                total[0, seen] += n.astype(np.uint32)
                if own:
                    total[1, seen] += n.astype(np.uint32)
        full = [r for r in range(ranges) if total[0, r * RANGE : (r + 1) * RANGE].any()]
        part = [np.ascontiguousarray(total[:, r * RANGE : (r + 1) * RANGE]) for r in full]
        names = ["range", "raw", "own", "counts"]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array([int(p[k].sum(dtype=np.int64)) for p in part], pa.int64()) for k in (0, 1)], pa.array([zlib.compress(p.tobytes(), 1) for p in part], pa.binary())], names=names)

    counted = materialise(src.mapInArrow(tidy(count), "range int, raw long, own long, counts binary"))
    sums = counted.agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).first()
    if not sums["own"]:
        return np.zeros(buckets)

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[r] = found.get(r, 0) + np.frombuffer(zlib.decompress(c), np.uint32).reshape(2, RANGE).astype(np.int64)
        logs = {r: [np.log((x[k] + SMOOTH) / (sums[n] + SMOOTH * buckets)) for k, n in ((1, "own"), (0, "raw"))] for r, x in found.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(logs), pa.int32()), pa.array([(x[0] - x[1]).tobytes() for x in logs.values()], pa.binary())], names=["range", "logs"])

    out = np.full(ranges * RANGE, math.log((sums["raw"] + SMOOTH * buckets) / (sums["own"] + SMOOTH * buckets)))
    for r in counted.select("range", "counts").repartition("range").mapInArrow(ratio, "range int, logs binary").collect():
        out[r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(bytes(r["logs"]), np.float64)
    return out[:buckets]


def kth_largest(keys: DataFrame, k: int, few: int = 5000) -> float:
    """The k-th largest of column key, by narrowing a histogram to the bin that holds it."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above, bins = 0, 1024
    while True:
        inside = keys.filter(F.col("key").between(lo, hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width <= lo:
            return lo
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).cast("int")
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in found:
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if n <= few:
            last = sorted((r[0] for r in keys.filter(F.col("key").between(lo, hi)).select("key").collect()), reverse=True)
            return last[k - above - 1]


def resample(docs: DataFrame, good: DataFrame, keep: float = KEEP, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Per row: the id, log_weight, key and kept. good holds the ids of target documents; keep is the share kept."""
    spark = docs.sparkSession
    good = materialise(good.select(F.col(id_col).alias("id")).filter("id is not null").distinct())
    share = min(1.0, target_rows / max(good.count(), 1))
    chosen = good.filter(F.xxhash64(F.col("id").cast("string"), F.lit(41)).cast("double") <= F.lit(-(2.0**63) + share * 2.0**64))
    buckets = bucket_count(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    ratio = spark.sparkContext.broadcast(log_ratios(docs, chosen, chosen.count(), id_col, text_col, buckets))
    kind = dict(docs.dtypes)[id_col]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            w = [float(ratio.value[f].sum()) for f in features(b.column(1).to_pylist(), buckets)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64())], names=[id_col, "log_weight"])

    weighed = docs.select(id_col, F.col(text_col).cast("binary").alias("_t")).mapInArrow(tidy(weigh), f"`{id_col}` {kind}, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(2.0**53)
    keyed = materialise(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(u))))
    n = keyed.count()
    k = min(n, math.ceil(keep * n))
    cut = kth_largest(keyed, k) if k else math.inf
    return keyed.withColumn("kept", F.col("key") >= F.lit(cut))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return resample(table(spark, sf_dir, "documents"), good)
