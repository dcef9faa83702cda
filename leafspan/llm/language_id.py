"""Language identification with a blended-spectrum string kernel.

A text's features are the distinct character n-grams (1 to 4 UTF-8 bytes, A-Z lower-cased, runs of non-letters folded
into one space). The kernel of two texts is the number of n-grams both have, divided by the square root of the product
of their numbers. Landmarks are a bounded, hash-ordered choice of training texts per language; the Nyström map sends a
text to its kernel values against the landmarks, whitened by the landmark kernel. One ridge regression per language
(one versus the rest, by the normal equations on the bounded training sample) gives the scores.

Because the kernel is a dot product of presence vectors, map and regressions fold into one n-gram by language matrix.
Whole batches are then scored as one product of a presence matrix with it. Where that matrix would have more than
FOLD_CELLS cells (hundreds of languages), kernel values and regressions stay two steps; the scores are the same.

Training reads about TRAIN_PER_LANG texts of each language (TRAIN_ROWS in all, but 8 for every language at least), chosen
by a hash of the id; every text is scored.
Very long texts are scored whole, in batches of bounded bytes. Of equal scores the first language in code-point order
counts. Texts that are null or have no letter are "und" with score 0. Repeated rows give repeated results; without any labelled
row every text is "und"; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, held_out, release, table, tidy

TRAIN_ROWS = 1600
TRAIN_PER_LANG = 400
LANDMARKS = 240
FOLD_CELLS = 1 << 24
RIDGE = 1e-2
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"

_SPACE = np.array([32 if i < 65 or 91 <= i <= 96 or 123 <= i <= 127 else i + 32 if i <= 90 else i for i in range(256)], np.uint8)


def grams_of(text: bytes | None) -> np.ndarray:
    """Distinct n-grams of the folded text as numbers: the bytes, after a leading 1 that keeps lengths apart."""
    if not text:
        return np.empty(0, np.int64)
    b = _SPACE[np.frombuffer(text, np.uint8)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = np.concatenate(([32], b[keep], [32])).astype(np.int64)
    out, code = [], np.ones(len(b), np.int64)
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(b) - n + 1] * 256 + b[n - 1 :]
        if n in GRAMS:
            out.append(_distinct(code) if n < 4 else np.unique(code))
    return np.concatenate(out)


def _distinct(code: np.ndarray) -> np.ndarray:
    return np.unique(code.astype(np.int32)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Landmarks:
    """Landmark gram sets by gram: the landmarks of grams[i] are owner[first[i] : first[i + 1]]."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order].astype(np.int32)
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.scale = np.array([len(g) for g in sets], float) ** -0.5

    def kernel(self, g: np.ndarray) -> np.ndarray:
        """The kernel of a gram set with every landmark."""
        if not len(g):
            return np.zeros(len(self.scale))
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        at = at[self.grams[at] == g]
        size = self.first[at + 1] - self.first[at]
        rows = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[rows], minlength=len(self.scale)) * self.scale / len(g) ** 0.5


class KernelModel:
    """Weights of every n-gram that some landmark has, by language, after the fold; or landmarks and their weights."""

    def __init__(self, langs: list[str], grams: np.ndarray, weights: np.ndarray, marks: Landmarks | None = None) -> None:
        self.langs, self.grams, self.weights, self.marks = langs, grams, weights, marks

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
        langs = sorted({lang for lang, _ in rows})
        seen: dict[str, int] = dict.fromkeys(langs, 0)
        chosen = []
        for k, (lang, g) in enumerate(rows):
            if len(g) and seen[lang] < max(2, landmarks // len(langs)):
                seen[lang] += 1
                chosen.append(k)
        if not chosen:
            return cls(langs, np.empty(0, np.int64), np.zeros((0, len(langs))))
        marks = Landmarks([rows[k][1] for k in chosen])
        values, vectors = np.linalg.eigh(np.array([marks.kernel(rows[k][1]) for k in chosen]))
        good = values > 1e-8 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        z = np.vstack([marks.kernel(g) @ whiten for _, g in rows])
        place = {lang: c for c, lang in enumerate(langs)}
        own = np.array([place[lang] for lang, _ in rows])
        y = np.where(own[:, None] == np.arange(len(langs)), 1.0, -1.0)
        w = (1 / np.maximum(1, np.bincount(own, minlength=len(langs))))[own][:, None]  # languages weigh alike
        beta = np.linalg.solve(z.T @ (w * z) + ridge / len(langs) * np.eye(z.shape[1]), z.T @ (w * y))
        each = whiten @ beta
        if len(marks.grams) * len(langs) > FOLD_CELLS:
            return cls(langs, marks.grams, each, marks)
        each = each * marks.scale[:, None]
        return cls(langs, marks.grams, np.column_stack([np.add.reduceat(each[marks.owner, c], marks.first[:-1]) for c in range(len(langs))]))

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        """A row per gram set, a column per language: one product of the presence rows with the weights."""
        if self.marks is not None:
            return np.array([self.marks.kernel(g) for g in batch]) @ self.weights
        sizes = np.array([len(g) for g in batch])
        flat = np.concatenate(batch) if len(batch) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(batch)), sizes)
        if not len(self.grams) or not len(flat):
            return np.zeros((len(batch), len(self.langs)))
        at = np.minimum(np.searchsorted(self.grams, flat), len(self.grams) - 1)
        hit = self.grams[at] == flat
        at, owner = at[hit], owner[hit]
        out = np.zeros((len(batch), len(self.langs)))
        for c in range(len(self.langs)):  # presence is sparse: the product's sums by row
            out[:, c] = np.bincount(owner, self.weights[at, c], len(batch))
        return out / np.sqrt(np.maximum(sizes, 1))[:, None]


def training_sample(docs: DataFrame, train, text_col: str, lang_col: str, id_col: str, per_lang: int) -> list[tuple[str, bytes]]:
    """At most about per_lang rows for every language, in hash order of the id."""
    spark = docs.sparkSession
    own = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rank = F.xxhash64(F.col(id_col).cast("string"), F.lit(17))
    counts = own.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()
    if not counts:
        return []
    share = spark.createDataFrame([(r[0], min(1.0, max(8, min(per_lang, TRAIN_ROWS // len(counts))) / r[1])) for r in counts], "lang string, share double")
    cut = (F.lit(-(2.0**63)) + F.col("share") * F.lit(2.0**64)).cast("double")
    chosen = own.select(F.col(lang_col).alias("lang"), rank.alias("rank"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(share), "lang").filter(F.col("rank").cast("double") <= cut)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([grams_of(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["lang", "rank", "grams"])

    rows = chosen.select("lang", "rank", "text").mapInArrow(features, "lang string, rank long, grams binary").collect()
    return [(r["lang"], np.frombuffer(bytes(r["grams"]), np.int64)) for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], bytes(r["grams"])))]


def fit_language_model(docs: DataFrame, train, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = TRAIN_PER_LANG) -> KernelModel:
    model = KernelModel.fit(training_sample(docs, train, text_col, lang_col, id_col, per_lang))
    release()
    return model


def identify(docs: DataFrame, model: KernelModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns in keep, lang_pred and score (a softmax of the regressions' values, 0 for und)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string", "score double"])
    at = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in byte_slices(batches, at):
            lang, score = [], []
            texts = b.column(at).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                s = m.scores([grams_of(t.encode()) if t else np.empty(0, np.int64) for t in part])
                if not s.shape[1]:
                    lang += [UNKNOWN] * len(part)
                    score += [0.0] * len(part)
                    continue
                e = np.exp(4 * (s - s.max(1, keepdims=True)))
                best = s.argmax(1)
                p = e[np.arange(len(part)), best] / e.sum(1)
                for t, k, x in zip(part, best, p, strict=True):
                    ok = has_letter(t)
                    lang.append(m.langs[k] if ok else UNKNOWN)
                    score.append(float(x) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("_text")])).mapInArrow(tidy(run), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs, ~held_out("doc_id", 4, 2))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
