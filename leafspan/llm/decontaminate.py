"""Benchmark decontamination with a generalised suffix automaton over test-item words.

Test items are normalised to words (A-Z lower-cased; digits, letters and all non-ASCII characters are word
characters). The automaton of all items is built once on the driver, block by block of a bounded number of item words,
and sent to the executors. Training words are streamed through it; the state always stands for the longest suffix of
the words read that occurs in some item. Where that length reaches the window, the window's words are hit.

Streaming starts only where it can matter: any window covers an anchor, a short word sequence at a fixed stride, so
words away from anchors that occur in some item are passed over without losing a match.

With several blocks one pass over the documents finds, by hashes of all items' anchors (8 bytes an item word, sent to the
executors), the few that can hold a window of any item. Only these are written and streamed through each block's
automaton, one block after the other, and only rows with hits are sent on.

Very long texts are streamed whole, in batches of bounded bytes. Nulls and empty texts have no words, and items without words have no window. Items sharing text are all reported;
repeated rows give repeated results; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, materialise, table, tidy
from leafspan.llm.texthash import sequence_hashes, word_hashes

WINDOW = 10
BLOCK_WORDS = 100_000

_FOLD = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of every window-length state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ids = [i for i, _ in items]
        own: list[set[int]] = [set()]
        whole: dict[int, list[int]] = {}  # states of items shorter than the window
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w, own)
                own[last].add(k)
            if 0 < len(words) < window:
                whole.setdefault(last, []).append(k)
        self.whole = whole  # an item is the longest string of its state, so later splits leave it there
        self.items = self._spread(own)
        #: For each state the nearest state, itself included, on its suffix path that is a short item.
        self.short = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.link[s]] if s else -1
        least = min([window, *(len(w) for _, w in items if w)])
        self.gram = min(3, least)
        self.stride = least - self.gram + 1
        self.reach = window
        self.anchors = {tuple(w[i : i + self.gram]) for _, w in items for i in range(len(w) - self.gram + 1)}

    def _extend(self, last: int, w: bytes, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q, own)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, w, q, own)
        return cur

    def _clone(self, p: int, w: bytes, q: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        own.append(set())
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def _spread(self, own: list[set[int]]) -> list[frozenset[int] | None]:
        """Items of the states that hold a string of window length, gathered from the longer strings that end alike."""
        out: list[frozenset[int] | None] = [None] * len(own)
        for s in sorted(range(1, len(own)), key=self.len.__getitem__, reverse=True):
            if self.len[s] >= self.window:
                out[s] = frozenset(own[s])
            up = self.link[s]
            if up > 0 and self.len[up] >= self.window:
                own[up] |= own[s]
        return out

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (start, end), ascending and disjoint, and the items whose windows occur."""
        n, gram, stride = len(words), self.gram, self.stride
        anchors = self.anchors
        grams = zip(*(words[j::stride] for j in range(gram)), strict=False)
        near = [k * stride for k, g in enumerate(grams) if g in anchors]
        if not near:
            return [], set()
        hits: list[list[int]] = []
        items: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.len, self.window
        groups: list[list[int]] = []
        for at in near:
            lo, hi = max(0, at - self.reach), min(n, at + gram + self.reach)
            if groups and lo <= groups[-1][1]:
                groups[-1][1] = hi
            else:
                groups.append([lo, hi])
        for lo, end in groups:
            s = got = 0
            for i in range(lo, end):
                w = words[i]
                while s and w not in nxt[s]:
                    s = link[s]
                    got = length[s]
                if w in nxt[s]:
                    s = nxt[s][w]
                    got += 1
                found = 0
                if got >= window:
                    t = s
                    while length[link[t]] >= window:
                        t = link[t]
                    items |= self.items[t]
                    found = window
                t = self.short[s] if got == length[s] else self._short_below(s, got)
                while t > 0:
                    items.update(self.whole[t])
                    found = max(found, length[t])
                    t = self.short[link[t]]
                if found:
                    a = i + 1 - found
                    while hits and a <= hits[-1][1]:
                        a = min(a, hits.pop()[0])
                    hits.append([a, i + 1])
        return [(a, b) for a, b in hits], items

    def _short_below(self, s: int, got: int) -> int:
        t = self.short[s]
        while t > 0 and self.len[t] > got:
            t = self.short[self.link[t]]
        return t


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in id order, in blocks of at most block_words words (or one item)."""
    block, n = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        w = words_of(bytes(r["t"])) if r["t"] is not None else []
        if not w:
            continue
        if block and n + len(w) > block_words:
            yield block
            block, n = [], 0
        block.append((r["i"], w))
        n += len(w)
    yield block


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each range."""
    raw = text.encode()
    flags = raw.translate(_FOLD)
    at, starts = 0, []
    for w in flags.split():
        at = flags.index(w, at)
        starts.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : starts[a][0]])
        at = starts[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, cut: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: the id, n_words, hits array<struct<start,end>> in words, items array<string>, and with cut the text left.

    Items are read in blocks of at most block_words words, each with an automaton of its own. Cutting removes every hit
    span, from its first to its last word.
    """
    spark = docs.sparkSession
    blocks = item_blocks(items, item_id, item_text, block_words)
    first = next(blocks)
    second = next(blocks, None)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if second is None:
        return _pass(spark, src, first, window, cut, id_col)
    near = materialise(_near(src, item_blocks(items, item_id, item_text, block_words), window, cut))
    found = None
    for block in (b for part in ([first, second], blocks) for b in part):
        one = materialise(_hits(near.filter("near").select("row", "text"), block, window))
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kind = dict(src.dtypes)["id"]
    schema = f"`{id_col}` {kind}, n_words long, hits array<struct<start:int,end:int>>, items array<string>" + ", kept_text string" * cut

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 4):
            hits = []
            for spans in b.column(2).to_pylist():
                out: list[list[int]] = []
                for lo, hi in sorted((s["start"], s["end"]) for s in spans or ()):
                    if out and lo <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], hi)
                    else:
                        out.append([lo, hi])
                hits.append(out)
            cols = [b.column(0), b.column(1), pa.array([[{"start": x, "end": y} for x, y in h] for h in hits], SPANS), pa.array([x or [] for x in b.column(3).to_pylist()], pa.list_(pa.string()))]
            if cut:
                cols.append(pa.array([_cut(t.decode(), h) if h else t if t is None else t.decode() for t, h in zip(b.column(4).to_pylist(), hits, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "hits", "items", "kept_text"][: len(cols)])

    text = F.col("text") if cut else F.lit(None).cast("binary").alias("text")
    return near.join(found, "row", "left").select("id", "n_words", "hits", "items", text).mapInArrow(tidy(unite), schema)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _near(src: DataFrame, blocks: Iterator[list[tuple[str, list[bytes]]]], window: int, all_texts: bool) -> DataFrame:
    """row, id, n_words, near (may hold a window of some item) and text (of the near ones, or of all)."""
    grams: dict[int, list[np.ndarray]] = {}
    for block in blocks:
        least = min([window, *(len(w) for _, w in block)])
        gram = min(3, least)
        hashes = [sequence_hashes(word_hashes(b" ".join(w))[1], gram) for _, w in block if w]
        grams.setdefault(gram, []).append(np.unique(np.concatenate(hashes)))
    shared = src.sparkSession.sparkContext.broadcast({g: np.unique(np.concatenate(h)) for g, h in grams.items()})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 2):
            n, near = [], []
            for t in b.column(2).to_pylist():
                h = word_hashes(t.translate(_FOLD))[1] if t else np.empty(0, np.uint64)
                n.append(len(h))
                near.append(any(len(h) >= g and np.isin(sequence_hashes(h, g), own, kind="sort").any() for g, own in shared.value.items()))
            texts = b.column(2) if all_texts else pa.array([t if x else None for t, x in zip(b.column(2).to_pylist(), near, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(near, pa.bool_()), texts], names=["row", "id", "n_words", "near", "text"])

    kind = dict(src.dtypes)["id"]
    rows = src.select(F.monotonically_increasing_id().alias("row"), "id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(look), f"row long, id {kind}, n_words long, near boolean, text binary")


def _hits(near: DataFrame, block: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """row, hits and items of the rows that hold windows of the block's items."""
    model = near.sparkSession.sparkContext.broadcast(ItemAutomaton(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.value
        for b in byte_slices(batches, 1):
            rows, spans, ids = [], [], []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hit, found = auto.match(words_of(t))
                if hit:
                    rows.append(row)
                    spans.append([{"start": x, "end": y} for x, y in hit])
                    ids.append([auto.ids[k] for k in found])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, SPANS), pa.array(ids, pa.list_(pa.string()))], names=["row", "hits", "items"])

    return near.mapInArrow(tidy(run), "row long, hits array<struct<start:int,end:int>>, items array<string>")


def _pass(spark: SparkSession, src: DataFrame, block: list[tuple[str, list[bytes]]], window: int, cut: bool, id_col: str) -> DataFrame:
    """The whole job with one automaton."""
    model = spark.sparkContext.broadcast(ItemAutomaton(block, window))
    kind = dict(src.dtypes)["id"]
    schema = f"`{id_col}` {kind}, n_words long, hits array<struct<start:int,end:int>>, items array<string>" + ", kept_text string" * cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.value
        for b in byte_slices(batches, 1):
            n, hits, ids, left = [], [], [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                h, found = auto.match(w) if w else ([], set())
                n.append(len(w))
                hits.append([{"start": x, "end": y} for x, y in h])
                ids.append(sorted({auto.ids[k] for k in found}))
                if cut:
                    text = None if t is None else t.decode()
                    left.append(_cut(text, h) if h else text)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(hits, SPANS), pa.array(ids, pa.list_(pa.string()))]
            cols += [pa.array(left, pa.string())] * cut
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "hits", "items", "kept_text"][: len(cols)])

    return src.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item, unnest(list_transform(range(1, greatest(1, len(w) - 8)), lambda i: w[i:i + 9])) AS g FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, p, dg.n, item FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
