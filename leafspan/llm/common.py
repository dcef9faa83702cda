"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder. Only a session of one process, as in tests, may have none set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/leafspan-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, batch_rows: int | None = None, instead_of: DataFrame | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Write df below the checkpoint folder and read it back: cuts lineage and survives lost executors.

    instead_of is an earlier such table that only df is made of: it is deleted once df is written.

    With batch_rows, Python receives at most so many rows at once meanwhile (for rows that hold large arrays); with
    batch_bytes, about so many bytes, or one row.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()  # the cleaner then drops shuffle files of tables written before
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    held = {k: v for k, v in ((ARROW_ROWS, batch_rows), (ARROW_BYTES, batch_bytes)) if v}
    before = {k: conf.get(k) for k in held}
    try:
        for k, v in held.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    if instead_of is not None:
        drop_table(instead_of)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what materialise wrote, once nothing that is still to run reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, rows: float = 0, rows_each: float = 1) -> int:
    """The session's shuffle partitions, or more when rows need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_each))


def held_out(id_col: str, mod: int, rest: int):
    """True where crc32 of the id as text leaves rest on division by mod."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def span_text(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(spans: str, base: tuple[str, ...]) -> list:
    """The digest columns of a span array: a count per base kind, the base spans' sha256, all spans as text."""
    col = F.col(spans)
    own = F.filter(col, lambda s: s["kind"].isin(*base))
    of = lambda k: F.size(F.filter(col, lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in base]
    return [*counts, F.sha2(span_text(own).cast("binary"), 256).alias("base_sha256"), span_text(col).alias("spans")]


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


#: A key held by more than this share of the rows is hot.
HOT = 1000
BROADCAST_ROWS = 20_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, held: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts, which has one row per key and in column held the number of rows with it.

    Keys that hold more than 1 / HOT of the total rows, fewer than HOT in number, are broadcast; the others are dealt
    by key. So no key's rows meet in one task.
    """
    rare = F.col(held) * HOT <= total
    hot, cold = facts.filter(~rare).drop(held), facts.filter(rare).drop(held)
    near = rows.join(F.broadcast(hot), key)
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has most rows or fewer; rows is its counted size."""
    return F.broadcast(df) if rows <= most else df


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column of texts holds about most bytes, or one text, at most; empty batches vanish."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def release() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task: Callable) -> Callable:
    """A task function that hands its freed memory back when its partition ends; workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


#: Bits of a filter in its segments, bits for each id, and the most bits of a whole filter (16 MB).
SEGMENT, BITS_PER_ID, MOST_BITS = 15, 16, 27


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A bit set over the hashes of ids, sized by their number, up to 2 ** MOST_BITS bits.

    Beyond that size it lets more and more other ids pass; nothing else depends on it than how many rows are dealt out.
    """
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(BITS_PER_ID * max(1, ids.count())))))
    h = F.pmod(F.xxhash64(col), F.lit(1 << bits))
    places = ids.select(F.shiftright(h, SEGMENT).cast("int").alias("seg"), (h % (1 << SEGMENT)).cast("int").alias("off")).groupBy("seg").agg(F.collect_set("off").alias("off"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for off in b.column(1).to_pylist():
                one = np.zeros(1 << SEGMENT, bool)
                one[off] = True
                out.append(np.packbits(one, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["seg", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in places.mapInArrow(packed, "seg int, bits binary").collect():
        out[r["seg"] << (SEGMENT - 3) : (r["seg"] + 1) << (SEGMENT - 3)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def filter_place(col: str, bits: np.ndarray):
    """A value's place in an id_filter, -1 for null."""
    return F.when(F.col(col).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(col), F.lit(8 * len(bits)))).alias("__h")


def in_filter(bits: np.ndarray, places: pa.Array) -> np.ndarray:
    h = np.asarray(places).astype(np.int64)
    return (h >= 0) & ((bits[np.maximum(h, 0) >> 3] >> (h & 7)) & 1 == 1)


def sift(df: DataFrame, bits, col: str, inside: bool) -> DataFrame:
    """Rows of df whose value in col a broadcast id_filter has, or has not (as nulls). It may have others as well."""
    schema, names = df.schema, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = in_filter(bits.value, b.column(b.num_columns - 1))
            yield b.filter(pa.array(hit if inside else ~hit)).select(list(range(len(names))))

    return df.select(*[F.col(f"`{c}`") for c in names], filter_place(col, bits.value)).mapInArrow(run, schema)


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids in gone. Only rows that a filter of bounded size cannot rule out are shuffled for the join."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(gone, id_col))
    return sift(docs, bits, id_col, False).unionByName(sift(docs, bits, id_col, True).join(gone, id_col, "left_anti").select(docs.columns))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of undirected edges over long ids: (node, root), root the smallest id reachable.

    Roots themselves have no row. Alternates large-star and small-star steps until the edge set stops changing. Each is
    an aggregate by node and a join back to the edges in which nodes with very many edges are broadcast, so a hub is
    never gathered in one task. Every round is written to the checkpoint folder and replaces the one before.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held"))

    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    e = materialise(e)
    before = state(e)
    while before["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).withColumn("m", F.least("u", "m"))
        large = join_facts(both, low, "u", "held", before["n"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        low = lowest(large)
        short = join_facts(large, low, "u", "held", before["n"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialise(short.filter("u <> v").distinct(), instead_of=e)
        e, old = new, large
        now = state(e)
        drop_table(old)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
