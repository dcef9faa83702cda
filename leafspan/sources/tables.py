"""Reading documents, outlines and profiles; writing section and chunk tables by document."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.functions import text as T

PROFILE_FIELDS = ("metrics", "regions", "platforms", "genres")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (from the content's hash), path, text of every file below path that ends in .md or .markdown."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = files.filter(F.lower("path").rlike(r"\.(md|markdown)$"))
    return files.select(T.uuid5(T.text_hash(F.col("text"))).alias("doc_id"), "path", "text")


def input_kind(path: Column) -> Column:
    low = F.lower(path)
    known = F.when(low.endswith(".pdf"), "pdf").when(low.rlike(r"\.(md|markdown)$"), "markdown")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unsupported input: "), path)).cast("string"))


def outline_entries(entries: list[dict], level: int = 1) -> list[tuple[str, int]]:
    """(title, level) of a nested outline (level is depth) or a flat one (level is given, 1 to 6)."""
    if not entries:
        raise ValueError("an outline needs entries")
    if not any("children" in e for e in entries) and level == 1:
        return [(t, max(1, min(6, int(e.get("level", 1))))) for e in entries if (t := str(e.get("title", "")).strip())]
    out = []
    for e in entries:
        if title := str(e.get("title", "")).strip():
            out.append((title, min(6, level)))
        if e.get("children"):
            out += outline_entries(e["children"], level + 1) if any("children" in c for c in e["children"]) else [(t, min(6, level + 1)) for c in e["children"] if (t := str(c.get("title", "")).strip())]
    return out


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """entry, title and level of an outline file: a nested or flat JSON list."""
    raw = spark.read.text(path, wholetext=True).first()
    found = outline_entries(json.loads(raw["value"]) if raw else [])
    return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(found)], "entry int, title string, level int")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """value as indented JSON in one file, non-ASCII kept, on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(json.dumps(value, ensure_ascii=False, indent=2).encode())
    out.close()


def read_json(spark: SparkSession, path: str) -> object | None:
    """What write_json wrote; None where there is no such file."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def public_columns(sections: DataFrame, internal: tuple[str, ...] = ("line", "level", "raw_title", "next_line", "parent_line", "preorder", "subtree_end", "untitled")) -> DataFrame:
    """Sections without the columns that only building them needs."""
    return sections.drop(*internal)


def without_nuls(rows: DataFrame, columns: tuple[str, ...], hash_of: str | None = None) -> DataFrame:
    """Rows without NUL characters in columns; adds nul_count, and hashes column hash_of anew as text_hash."""
    have = [c for c in columns if c in rows.columns]
    count = sum((F.coalesce(T.nul_count(F.col(c).cast("string")), F.lit(0)) for c in have), F.lit(0))
    out = rows.withColumn("nul_count", count.cast("long")).withColumns({c: T.strip_nul(F.col(c)) for c in have if dict(rows.dtypes)[c] == "string"})
    return out.withColumn("text_hash", T.text_hash(F.col(hash_of))) if hash_of else out


SECTION_TEXTS = ("doc_id", "node_id", "title", "summary")
CHUNK_TEXTS = ("doc_id", "node_id", "title", "title_path", "chunk_text", "search_text")


def read_profile(text: str) -> dict[str, dict[str, list[str]]]:
    """field -> canonical name -> aliases, the name itself first; blanks dropped, other fields ignored."""
    raw, out = json.loads(text), {}
    for field in PROFILE_FIELDS:
        names = raw.get(field) or {}
        out[field] = {k.strip(): list(dict.fromkeys([k.strip(), *(a.strip() for a in v if a and a.strip())])) for k, v in names.items() if k.strip()}
    return out


def write_by_document(df: DataFrame, path: str, buckets: int = 64, order: str | None = None) -> None:
    """Replaces the rows of the documents in df and leaves those of other documents.

    Rows lie in folders by a hash of doc_id (column doc_bucket), so their number does not grow with the documents; a
    write replaces the folders it touches, with the rows of their other documents carried over. One writer at a time.
    df is checkpointed, as it is read for its ids and for its rows. Files are sorted by column order, if given, so that
    a filter on it skips most of them. An empty df changes nothing.
    """
    spark = df.sparkSession
    new = settled(df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")))
    touched = [r["doc_bucket"] for r in new.select("doc_bucket").distinct().collect()]
    if not touched:
        return
    rows = new
    if exists(spark, path):
        old = spark.read.parquet(path).filter(F.col("doc_bucket").isin(touched)).join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = new.unionByName(old, allowMissingColumns=True)
    rows = rows.repartition("doc_bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)))
    rows = rows.sortWithinPartitions("doc_bucket", order) if order else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def existing(spark: SparkSession, path: str | None) -> str:
    """path, if something is there."""
    if not path or not exists(spark, path):
        raise ValueError(f"no such input: {path}")
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scan(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a table whose key is in ids: a semi join, pruned to partitions where key is the partition column."""
    return spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_semi")


def checked_vectors(chunks: DataFrame, dim: int) -> DataFrame:
    """Fails where an embedding has another length than dim."""
    ok = F.size("embedding") == dim
    return chunks.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding's length is not {dim}")).cast("array<float>")))


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, for small tables that several later steps read.

    The folder is the session's spark.checkpoint.dir; only a session of one process, as in tests, may have none set.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint()
