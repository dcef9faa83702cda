"""PII by information-theoretic sanitisation.

Direct identifiers (e-mail and IP addresses, card and telephone numbers) are found by expression and check. Each
distinct identifier is a protected entity. A term of a document that holds an entity reveals it as far as their
pointwise mutual information over the corpus, log p(e,t) / (p(e) p(t)), comes near the entity's own information,
-log p(e). Probabilities are shares of all documents; a term counts wherever it stands in the text. Where the ratio
reaches disclose_at and min_support documents hold both, every place of the term in the documents that hold the entity
becomes a span, unless an identifier covers it: "remove" from remove_at on, else "general" (replaced by a placeholder).

One pass over the texts finds the base spans and each batch's document frequencies; the texts that hold an identifier
are kept beside them. Pairs are made only of entities and terms frequent enough for min_support and of terms rare
enough to reach the ratio with the entity (n_both <= n_entity bounds n_term), which leaves out no pair that counts.

Terms, entities and pairs that very many rows hold are never dealt to one task. Very long texts are scanned whole, in
batches of bounded bytes. Nulls and empty texts have no spans but count as documents. Repeated rows count each time. Rows are told apart by
their place in the input, so null or repeated ids are kept as they are; columns other than the id and the text are
ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, id_filter, join_facts, materialise, redact_text, sift, span_digest, table, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "remove", "general")
FLUSH_TERMS = 300_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the part before an @ is all of its characters since the last match."""
    last = seen = 0
    at = text.find("@")
    while at >= 0:
        lo = max(last, seen)
        start = lo + len(text[lo:at].rstrip(_LOCAL))
        if start < at and (m := _EMAIL_TAIL.match(text, at)):
            last = m.end()
            yield start, last
        seen = at + 1
        at = text.find("@", seen)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by kind as listed, then start."""
    if not text:
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m.groups())]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def entity_of(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def terms_of(text: str) -> set[bytes]:
    return set(text.encode().translate(_FOLD).split())


def places(text: str, spans: list[tuple[int, int]], kinds: dict[str, str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every word in kinds that no span covers, "remove" first, then by start."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for m in _WORD.finditer(text):
        kind = kinds.get(m[0].encode().translate(_FOLD).decode())
        if kind:
            k = bisect_right(ends, m.start())
            if k == len(starts) or starts[k] >= m.end():
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[0] != "remove", s[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    row = ctx.partitionId() << 40
    counts: Counter[bytes] = Counter()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ["row", "id", "spans", "entities", "text", "term", "n"]

    def terms(id_type: pa.DataType) -> pa.RecordBatch:
        k = len(counts)
        cols = [pa.nulls(k, pa.int64()), pa.nulls(k, id_type), pa.nulls(k, span), pa.nulls(k, pa.list_(pa.string())), pa.nulls(k, pa.string()), pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(cols, names=names)

    id_type = None
    for b in byte_slices(batches, 1):
        id_type = b.column(0).type
        texts = b.column(1).to_pylist()
        spans, entities = [], []
        for t in texts:
            s = base_spans(t)
            spans.append([{"kind": k, "start": x, "end": y} for k, x, y in s])
            entities.append(sorted({entity_of(k, t[x:y]) for k, x, y in s}))
            if t:
                counts.update(terms_of(t))
                if len(counts) > FLUSH_TERMS:
                    yield terms(id_type)
        k = len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(range(row, row + k), pa.int64()), b.column(0), pa.array(spans, span), pa.array(entities, pa.list_(pa.string())), pa.array([t if e else None for t, e in zip(texts, entities, strict=True)], pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=names)
        row += k
    if counts:
        yield terms(id_type)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, most, term) of each distinct term."""
    for b in byte_slices(batches, 2):
        for row, most, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = [w.decode() for w in terms_of(text)]
            k = len(words)
            yield pa.RecordBatch.from_arrays([pa.array([row] * k, pa.int64()), pa.array([most] * k, pa.int64()), pa.array(words, pa.string())], names=["row", "most", "term"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in byte_slices(batches, 1):
        rows, texts, spans, terms = (c.to_pylist() for c in b.columns)
        found = [places(t, [(s["start"], s["end"]) for s in own], {x["term"]: x["kind"] for x in w}) for t, own, w in zip(texts, spans, terms, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in f] for f in found], span)], names=["row", "more"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclose_at: float = 0.6, remove_at: float = 0.9, min_support: int = 2) -> DataFrame:
    """Per row: the id and found array<struct<kind,start,end>> by kind as listed, then start."""
    kind = dict(docs.dtypes)[id_col]
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = f"row long, id {kind}, spans {span}, entities array<string>, text string, term string, n long"
    scanned = materialise(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_scan, schema))
    rows = scanned.filter("row is not null")
    total = rows.count()
    n = F.lit(float(max(total, 1)))
    most = lambda n_entity: n * F.pow(n_entity / n, F.lit(disclose_at)) * (1 + 1e-9)
    holds = rows.select("row", F.explode("entities").alias("entity"))
    of_entity = holds.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= min_support)
    held = materialise(join_facts(holds, of_entity.withColumn("held", F.col("n_entity")), "entity", "held", holds.count()))
    of_term = materialise(scanned.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n_term")).filter(F.col("n_term") >= min_support))
    top = held.agg(F.max("n_entity")).first()[0] or 0
    usable = of_term.filter(F.col("n_term") <= most(F.lit(float(top))))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(usable, "term"))
    texts = rows.filter("text is not null").select("row", "text").join(held.groupBy("row").agg(F.max("n_entity").alias("most")), "row")
    words = sift(texts.select("row", "most", "text").mapInArrow(_terms, "row long, most long, term string"), bits, "term", True)
    n_words = usable.agg(F.sum("n_term")).first()[0] or 0
    words = join_facts(words, usable.withColumn("held", F.col("n_term")), "term", "held", n_words).filter(F.col("n_term") <= most(F.col("most"))).select("row", "term", "n_term")
    both = materialise(words.join(held, "row").filter(F.col("n_term") <= most(F.col("n_entity"))))
    pair = F.struct("entity", "term").alias("pair")
    joint = both.groupBy(pair).agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")).filter(F.col("n_both") >= min_support)
    pmi = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    own = F.log(n / F.col("n_entity"))
    ratio = F.when(own > 0, pmi / own).otherwise(0.0)
    revealing = joint.select("pair", "n_both", ratio.alias("ratio")).filter(F.col("ratio") >= disclose_at)
    chosen = join_facts(both.select("row", "term", pair), revealing, "pair", "n_both", both.count()).groupBy("row", "term").agg(F.max("ratio").alias("ratio"))
    chosen = chosen.groupBy("row").agg(F.collect_list(F.struct("term", F.when(F.col("ratio") >= remove_at, "remove").otherwise("general").alias("kind"))).alias("terms"))
    added = rows.select("row", "text", "spans").join(chosen, "row").mapInArrow(_place, f"row long, more {span}")
    found = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more"))
    return rows.select("row", "id", "spans").join(added, "row", "left").select(F.col("id").alias(id_col), found.alias("found"))


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs, whose ids are unique: the id and the text with every span replaced by its kind in brackets."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            texts = [redact_text(t, [(s["kind"], s["start"], s["end"]) for s in f]) if t and f else t for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "sanitised"])

    both = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(found.select(F.col(id_col).alias("_of"), "found"), F.col("_id").eqNullSafe(F.col("_of")), "left")
    return both.select("_id", "_text", "found").mapInArrow(tidy(run), f"`{id_col}` {kind}, sanitised string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_digest("found", BASE))
