"""Toxicity by maximum-scoring segments of token log-odds.

Training counts the tokens of a bounded, hash-chosen sample of labelled documents and gives every token (and, for tokens
without enough counts, every stem) the difference of its log-odds in toxic and other documents under an informative
Dirichlet prior (the pooled counts), if its likelihood ratio beats chance among all tokens tested. A text's tokens
become a row of these scores less a drift, so that unsuspicious prose has a negative mean; one linear scan finds every
maximal scoring segment. A segment of score s in n tokens is significant by the extreme-value law
1 - exp(-K n exp(-lambda s)), lambda the positive root of the mean of exp(lambda x) = 1 over the background and K
fitted on the background's maxima. A document's evidence is the sum of its significant segments' normalised scores;
a logistic curve fitted on the training sample turns it into a score between 0 and 1.

Null and empty texts have no segment and get the curve's value at none. Repeated rows give repeated results. Without
labels, or with one class only, every score is the share of toxic rows (0 without rows). Equal scores are ties and stay
so; of texts with one checksum the order in which they are learned is that of their bytes. Very long texts are scanned
whole, in batches of bounded bytes. An empty table gives no rows. Columns other than those named are ignored.

The sample holds at most about TRAIN_TOXIC and TRAIN_OTHER documents and TRAIN_BYTES bytes of tokens; every token that
stands out in it gets a weight.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, held_out, materialise, small, table, tidy

TRAIN_TOXIC = 2000
TRAIN_OTHER = 6000
TRAIN_BYTES = 96 << 20
ALIKE = 0.8
PRIOR = 10.0
LEAST_DOCS = 3
STEM = 4
SURE = 3.0
MAX_WEIGHT = 6.0
DRIFT = 0.5
SIGNIFICANT = 0.05

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i == 39 or i >= 128 else 32 for i in range(256))


def tokens_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def stem(word: bytes) -> bytes:
    """A token's first bytes, marked: what a token without a weight of its own falls back on."""
    return word[:STEM] + b"*"


class Lookup(dict):
    """Weight of a token: its own, else its stem's, else 0. Answers are kept up to a fixed number."""

    def __init__(self, weights: dict[bytes, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        x = self.weights.get(word) or self.weights.get(stem(word), 0.0)
        self[word] = x
        return x

    def __reduce__(self):
        return Lookup, (self.weights,)


def maximal_segments(x: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a row of scores, left to right, in linear time.

    Candidates are kept with the running totals at their left and right ends. A new one absorbs the candidates from
    the nearest earlier one whose left total is smaller, if that one's right total is smaller as well. Each candidate
    remembers that nearest one, so the search leaps over the rest.
    """
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    near: list[int] = []
    total = 0.0
    for i, v in enumerate(x):
        before, total = total, total + v
        if v <= 0:
            continue
        lo, start = before, i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = near[j]
            if j < 0 or right[j] >= total:
                break
            lo, start = left[j], span[j][0]
            del left[j:], right[j:], span[j:], near[j:]
        near.append(j)
        left.append(lo)
        right.append(total)
        span.append((start, i + 1))
    return [(a, b, r - s) for (a, b), s, r in zip(span, left, right, strict=True)]


class ToxicityModel:
    def __init__(self, weights: dict[bytes, float], lam: float, k: float, slope: float, base: float) -> None:
        self.weights, self.lam, self.k, self.slope, self.base = Lookup(weights), lam, k, slope, base

    def segments(self, words: list[bytes], significant: float = SIGNIFICANT, tail: bool = True) -> list[tuple]:
        """Significant segments (start, end, score, p-value) in words; rows of equal negative scores count as one.

        Without tail, all maximal segments (start, end, score).
        """
        weights = self.weights
        at = [i for i, w in enumerate(words) if weights[w]]
        if not at:
            return []
        x, place, last = [], [], -1
        for i in at:
            if i - last > 1:
                x.append(-DRIFT * (i - last - 1))
                place.append((last + 1, i))
            x.append(weights[words[i]] - DRIFT)
            place.append((i, i + 1))
            last = i
        out, n = [], len(words)
        for a, b, s in maximal_segments(x):
            if not tail:
                out.append((place[a][0], place[b - 1][1], s))
                continue
            p = -math.expm1(-self.k * n * math.exp(-self.lam * s))
            if p <= significant:
                out.append((place[a][0], place[b - 1][1], s, p))
        return out

    def evidence(self, n_words: int, segments: list[tuple[int, int, float, float]]) -> float:
        return sum(max(0.0, self.lam * s - math.log(self.k * max(n_words, 1))) for *_, s, _ in segments)

    def score(self, n_words: int, segments: list[tuple[int, int, float, float]]) -> float:
        z = self.base + self.slope * math.log1p(self.evidence(n_words, segments))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def log_odds(samples: list[tuple[int, bytes]]) -> tuple[dict[bytes, float], Counter, int]:
    """Weights of the tokens that stand out in toxic documents, the other documents' token counts and their total.

    Odds count documents, not tokens, so that one long text or one repeated word does not make a weight; copies and
    near copies (documents whose sets of tokens have the same three smallest hashes and a similarity of ALIKE) count as one.
    """
    docs = {0: Counter(), 1: Counter()}
    back: Counter[bytes] = Counter()
    n = [0, 0]
    firsts: dict[tuple, list[set[bytes]]] = {}
    for y, words in samples:
        tokens = words.split()
        own = {f for w in set(tokens) for f in (w, stem(w))}
        if not y:
            back.update(tokens)
        others = firsts.setdefault((y, *sorted(map(zlib.crc32, own))[:3]), [])
        alike = (x for x in others if ALIKE * len(own) <= len(x) <= len(own) / ALIKE)
        if not any(len(own & x) >= ALIKE * len(own | x) for x in alike):
            others.append(own)
            docs[y].update(own)
            n[y] += 1
    total = n[0] + n[1]
    share = n[1] / total
    tested = {w: c for w, c in docs[1].items() if c >= LEAST_DOCS}
    need = math.log(len(tested) + 1) + SURE  # chance hits among all tested tokens are rare
    scored = []
    for w, c in tested.items():
        both = c + docs[0][w]
        if c <= share * both:
            continue
        rest = docs[0][w]
        gain = c * math.log(c / both / share) + (rest * math.log(rest / both / (1 - share)) if rest else 0.0)
        prior = PRIOR * both / total
        a, b = c + prior * share, rest + prior * (1 - share)
        d = math.log(a / (n[1] + PRIOR - a)) - math.log(b / (n[0] + PRIOR - b))
        if gain > need and d > DRIFT:
            scored.append((gain, w, min(d, MAX_WEIGHT)))
    return {w: d for _, w, d in sorted(scored, reverse=True)}, back, sum(back.values())


def calibrated(samples: list[tuple[int, bytes]]) -> ToxicityModel:
    """Weights with lambda and K of the extreme-value law of background prose."""
    weights, back, total = log_odds(samples)
    model = ToxicityModel(weights, 1.0, 1.0, 0.0, 0.0)
    steps: Counter[float] = Counter({-DRIFT: 1})
    for w, c in back.items():
        steps[round(model.weights[w] - DRIFT, 3)] += c
    mean = lambda lam: sum(c * math.exp(lam * x) for x, c in steps.items()) / (total + 1)
    lo, hi = 1e-3, 4.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    model.lam = max(lo, 0.05)
    tops = []
    for y, text in samples:
        if not y and text:
            words = text.split()
            best = max((s for *_, s in model.segments(words, 1.0, False)), default=0.0)
            tops.append(math.exp(-model.lam * best) * len(words))
    if tops:  # P(max <= s) = exp(-K n exp(-lambda s)), so K n exp(-lambda s) of the maxima has mean 1
        model.k = min(1.0, max(1e-6, 1 / float(np.mean(tops))))
    return model


def fit(samples: list[tuple[int, bytes]]) -> ToxicityModel:
    """samples: class and space-joined tokens of the training documents, in an order that does not depend on class.

    The curve is fitted on evidence from weights of the other half of the samples, so that it is not too steep.
    """
    n_toxic, n = sum(y for y, _ in samples), len(samples)
    share = n_toxic / n if n else 0.0
    if not n_toxic or n_toxic == n:
        return ToxicityModel({}, 1.0, 1.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    halves = samples[::2], samples[1::2]
    x, y = [], []
    for own, other in (halves, halves[::-1]):
        m = calibrated(other)
        for t, text in own:
            w = text.split()
            x.append(math.log1p(m.evidence(len(w), m.segments(w))))
            y.append(t)
    target = np.where(np.array(y) > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n - n_toxic + 2))
    design = np.column_stack([x, np.ones(n)])
    weight = np.where(np.array(y) > 0, math.sqrt(n / n_toxic), math.sqrt(n / (n - n_toxic)))  # between even classes and even documents
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (weight * (p - target)) + 1e-3 * w
        h = design.T @ ((weight * p * (1 - p))[:, None] * design) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    model = calibrated(samples)
    model.slope, model.base = max(float(w[0]), 1e-6), float(w[1])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = (TRAIN_OTHER, TRAIN_TOXIC)) -> ToxicityModel:
    """Fit on about most[y] documents of class y at most, chosen by a hash of the id; train limits the labels used."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.filter(train) if train is not None else own
    own = own.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    rank = F.xxhash64(F.col(id_col).cast("string"), F.lit(29)).cast("double")
    cut = lambda y: F.lit(-(2.0**63) + min(1.0, most[y] / max(counts.get(y, 0), 1)) * 2.0**64)
    chosen = materialise(own.filter(rank <= F.when(F.col("y") == 1, cut(1)).otherwise(cut(0))))
    texts = docs.select(id_col, F.col(text_col).cast("binary").alias("_t")).filter(F.col(text_col).isNotNull()).join(small(chosen, chosen.count()), id_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            words = [b" ".join(tokens_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["y", "words"])

    rows = materialise(texts.select("y", "_t").mapInArrow(tidy(counted), "y int, words binary"))
    # the driver gets TRAIN_BYTES bytes at most: of more, a share by a hash of the text, halved until it fits
    place = (F.xxhash64("words", F.lit(3)) / F.lit(2.0**64) + 0.5).alias("place")
    share = 1.0
    while (rows.filter(place < share).agg(F.sum(F.length("words"))).first()[0] or 0) > TRAIN_BYTES:
        share /= 2
    return fit(sorted(((r["y"], bytes(r["words"])) for r in rows.filter(place < share).collect()), key=lambda r: (zlib.crc32(r[1]), r[1])))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns in keep, score and passages array<struct<start,end,score,p_value>> in words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["score double", "passages array<struct<start:int,end:int,score:double,p_value:double>>"])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in byte_slices(batches, len(keep)):
            score, passages = [], []
            for t in b.column(len(keep)).to_pylist():
                w = tokens_of(t)
                found = m.segments(w)
                score.append(m.score(len(w), found))
                passages.append([{"start": s, "end": e, "score": x, "p_value": p} for s, e, x, p in found])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score, pa.float64()), pa.array(passages, kind)], names=[*keep, "score", "passages"])

    return docs.select(*keep, F.col(text_col).cast("binary").alias("_text")).mapInArrow(tidy(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, ~held_out("doc_id", 5, 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
