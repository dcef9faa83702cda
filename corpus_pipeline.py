"""From raw documents to a mixture: language ID, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages 1 to 4 return the columns
of documents (extra columns pass through); the last returns the mixture: a row for each document that is in it.
Nulls and empty texts: stage 1 rejects texts without a letter; the other stages let null and empty texts pass as they
are. Empty tables pass through as empty tables. Very long texts are worked on whole, in batches of bounded bytes, in every
stage. Repeated rows get the same language, spans and replacements; of near duplicates see the second stage, of copies
the last. Ties: of equal language scores the first language in code-point order counts; of equal texts under several ids
the smallest id stays; documents that meet the end of a budget with one id and size are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import drop_ids, materialise, table
from leafspan.llm.decontaminate import decontaminate
from leafspan.llm.language_id import UNKNOWN, fit_language_model, identify
from leafspan.llm.mixing import mix
from leafspan.llm.ngram_join import ngram_join
from leafspan.llm.secret_scan import find_secrets

LEAST_LANGUAGE_SCORE = 0.35
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
MOST_COVERED = 0.5


def _whole(docs: DataFrame) -> DataFrame:
    """The other columns as one, doc, beside the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.col("text"))


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs from column doc, text replaced and n_chars counted again."""
    new = {"text": F.col(text)} | ({} if text == "text" else {"n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))})
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language no class explains."""
    model = fit_language_model(docs, F.lit(True))
    named = identify(_whole(docs), model, keep=("doc", "text"))
    return _with_text(named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest id of each group of near duplicates; ties go by text hash. Rows are told apart by id
    and text, so ids may be repeated. Rows with a null id have no name and stay; of rows that share id and text one
    stays."""
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"))
    keyed = docs.withColumn("_key", key)
    groups = materialise(ngram_join(keyed.select("_key", "text"), SHINGLE_WORDS, SIMILARITY_PERCENT, "_key"))
    kept = drop_ids(keyed, groups.filter((F.col("_key") != F.col("component_id")) & ~F.col("_key.unnamed")).select("_key").distinct(), "_key")
    again = groups.filter("not _key.unnamed").groupBy("_key").count().filter("count > 1").select("_key")
    again = materialise(again)
    if not again.limit(1).count():
        return kept.select(docs.columns)
    once = kept.join(again, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.join(again, "_key", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts spans that occur in test items; drops documents of which more than MOST_COVERED is such text."""
    found = decontaminate(_whole(docs), table(spark, sf_dir, "benchmark"), id_col="doc", cut=True)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return _with_text(found.filter(hit <= F.col("n_words") * MOST_COVERED), docs, "kept_text")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind in brackets."""
    return _with_text(find_secrets(_whole(docs), id_col="doc", redact=True), docs, "redacted")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: id, size, source_size, target, rate, copies and taken of the documents with a copy in it."""
    return mix(docs).filter("copies > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: Neither the language model nor its sample can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else materialise(docs)
    return docs
