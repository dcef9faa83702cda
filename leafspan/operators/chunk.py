"""Leaf sections to overlapping chunks, in an Arrow UDF; the token counter is exchangeable."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T

TARGET, OVERLAP = 400, 80
_SENTENCE = re.compile(r".+?(?:[。！？!?；;](?=\s|$)|$)", re.S)
_BLANK = re.compile(r"\n\s*\n")


def four_chars(text: str) -> int:
    """The default count: a token per four characters, one at least."""
    return max(1, -(-len(text) // 4))


def _by_size(text: str, count: Callable[[str], int], target: int) -> Iterator[str]:
    text = text.strip()
    while text:
        end = max(1, bisect_right(range(1, len(text) + 1), target, key=lambda n: count(text[:n].strip()) if text[:n].strip() else 0))
        if piece := text[:end].strip():
            yield piece
        text = text[end:].lstrip()


def _fit(paragraph: str, count: Callable[[str], int], target: int) -> Iterator[str]:
    """A paragraph whole if it fits, else sentences packed up to the target, else cut by size."""
    if count(paragraph) <= target:
        yield paragraph
        return
    parts = [s for m in _SENTENCE.finditer(paragraph) if (s := m[0].strip())]
    if len(parts) < 2:
        yield from _by_size(paragraph, count, target)
        return
    held = ""
    for part in parts:
        joined = f"{held} {part}" if held else part
        if count(part) > target:
            if held:
                yield held
            yield from _by_size(part, count, target)
            held = ""
        elif held and count(joined) > target:
            yield held
            held = part
        else:
            held = joined
    if held:
        yield held


def chunk_text(text: str, count: Callable[[str], int] = four_chars, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(chunk, tokens): blocks packed up to the target; a chunk starts again with the last blocks of overlap tokens."""
    if (whole := count(text)) <= target:
        return [(text, whole)]
    paragraphs = [p for x in _BLANK.split(text) if (p := x.strip())] or [text.strip()]
    blocks = [b for p in paragraphs for b in _fit(p, count, target) if b]
    sizes = [count(b) for b in blocks]
    out, first = [], 0
    while first < len(blocks):
        after = first + 1
        while after < len(blocks) and count("\n\n".join(blocks[first:after])) < target and count("\n\n".join(blocks[first : after + 1])) <= target:
            after += 1
        piece = "\n\n".join(blocks[first:after])
        out.append((piece, count(piece)))
        if after == len(blocks):
            break
        back, seen = after, 0
        while back > first and seen < overlap:
            back -= 1
            seen += sizes[back]
        first = max(first + 1, back)
    return out


def build_chunks(sections: DataFrame, count: Callable[[str], int] = four_chars, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Leaf sections (doc_id, section_id, node_id, title, title_path, page_index, text, is_leaf) to chunk rows."""

    @F.pandas_udf("array<struct<chunk_text:string,token_count:int>>")
    def cut(body: pd.Series) -> pd.Series:
        return body.map(lambda t: [{"chunk_text": c, "token_count": n} for c, n in chunk_text(t, count, target, overlap)] if t else [])

    leaves = sections.filter("is_leaf").withColumn("body", T.section_body(F.col("text"), F.col("title"))).filter("body <> ''")
    rows = leaves.select("doc_id", "section_id", "node_id", "title", "title_path", "page_index", F.posexplode(cut("body")).alias("chunk_index", "c"))
    rows = rows.select("*", F.col("c.chunk_text").alias("chunk_text"), F.col("c.token_count").alias("token_count")).drop("c")
    rows = rows.withColumn("search_text", T.contextual_text(F.col("title_path"), F.col("title"), F.col("chunk_text")))
    return rows.withColumn("chunk_id", T.chunk_id(F.col("doc_id").cast("string"), F.col("section_id"), F.col("chunk_index"))).withColumn("text_hash", T.text_hash(F.col("chunk_text")))
