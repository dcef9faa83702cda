"""Retrieval scores as column expressions, and word similarity as an Arrow UDF."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafspan.functions.text import term_hits

RRF_K = 60


def cosine(vector: Column, query: Column) -> Column:
    dot = F.aggregate(F.zip_with(vector, query, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.try_divide(dot, norm(vector) * norm(query))


def trigrams(t: Column) -> Column:
    words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets; 0 where both are empty."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def _ordered_trigrams(t: str) -> list[str]:
    out = []
    letter = _letters()
    for w in "".join(c if letter[ord(c)] else " " for c in t.lower()).split():
        p = f"  {w} "
        out += [p[i : i + 3] for i in range(len(p) - 2)]
    return out


def _letters() -> np.ndarray:
    """By code point: whether it is a letter or a decimal digit."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() or chr(i).isdecimal() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


_LETTERS: list[np.ndarray] = []


def gram_codes(t: str) -> np.ndarray:
    """The distinct trigrams of a text's words (two spaces before, one after each) as sorted numbers."""
    c = np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)
    ok = np.zeros(len(c) + 2, bool)
    ok[1:-1] = _letters()[c]
    c = np.concatenate(([32], c, [32, 32])).astype(np.uint64)
    c[: len(ok)][~ok] = 32
    edge = np.diff(ok.astype(np.int8))
    start, last = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1)
    code = lambda x, y, z: (x << np.uint64(42)) | (y << np.uint64(21)) | z
    space = np.full(len(start), 32, np.uint64)
    inner = np.flatnonzero(ok[:-2] & ok[1:-1] & ok[2:])
    long = last[ok[last - 1]]
    out = [code(space, space, c[start]), code(space, c[start], c[start + 1]), code(c[inner], c[inner + 1], c[inner + 2]), code(c[long - 1], c[long], np.full(len(long), 32, np.uint64))]
    return np.unique(np.concatenate(out))


def similarities(fields: dict[str, Column], query: str) -> Column:
    """struct of <field>_sim and <field>_word: Jaccard similarity of the trigram sets of field and query, and the greatest
    similarity of the field's set and that of any run of the query's trigrams. Texts pass through Arrow once."""
    order = _ordered_trigrams(query)
    asked = {g: k for k, g in enumerate(dict.fromkeys(order))}
    run, names = [asked[g] for g in order], list(fields)
    codes = np.array([(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in asked], np.uint64)

    def word(size: int, hits: tuple[int, ...]) -> float:
        own, best = set(hits), 0.0
        if len(own) / max(size, 1) <= 0:
            return 0.0
        for i, first in enumerate(run):
            if first not in own:
                continue
            seen, both = set(), 0
            for g in run[i:]:
                if g not in seen:
                    seen.add(g)
                    if g in own:
                        both += 1
                        best = max(best, both / (size + len(seen) - both))
        return best

    @F.arrow_udf(", ".join(f"{f}_sim double, {f}_word double" for f in fields))
    def score(*texts: pa.Array) -> pa.Array:
        out, known, words = {}, {}, {}
        for f, column in zip(names, texts, strict=True):
            sims, extents = [], []
            for held in column:  # a batch stays in Arrow: one text at a time becomes a string
                t = held.as_py()
                found = known.get(t) if t and len(t) < 200 else None
                if found is None:
                    own = gram_codes(t) if t else np.empty(0, np.uint64)
                    hits = tuple(np.flatnonzero(np.isin(codes, own)).tolist())
                    key = (len(own), hits)
                    if key not in words:
                        words[key] = word(*key)
                    union = len(own) + len(codes) - len(hits)
                    found = (len(hits) / union if union else 0.0, words[key])
                    if t and len(t) < 200:
                        known[t] = found
                sims.append(found[0])
                extents.append(found[1])
            out[f"{f}_sim"], out[f"{f}_word"] = pa.array(sims, pa.float64()), pa.array(extents, pa.float64())
        return pa.StructArray.from_arrays(list(out.values()), names=list(out))

    # nondeterministic in name only: a filter on the result is not moved below it, which would compute it twice
    return score.asNondeterministic()(*fields.values())


def best_extent(field: str, query: list[str]) -> float:
    """The greatest trigram similarity of a field and any run of the query's trigrams."""
    own = set(_ordered_trigrams(field))
    if not own or not query:
        return 0.0
    best = 0.0
    for i, first in enumerate(query):
        if first not in own:
            continue
        seen, both = set(), 0
        for g in query[i:]:
            if g not in seen:
                seen.add(g)
                both += g in own
                best = max(best, both / (len(own) + len(seen) - both)) if g in own else best
    return best


def word_similarity(field: Column, query: str) -> Column:
    grams = _ordered_trigrams(query)

    @F.pandas_udf("double")
    def extent(s: pd.Series) -> pd.Series:
        return s.map(lambda t: best_extent(t, grams) if t else 0.0)

    return extent(field)


def lexical_score(hits: dict[str, Column], words: dict[str, Column], sims: dict[str, Column]) -> Column:
    """Weights by field (title, path, body): hits 5, 3, 1.5; word similarity 2, 1.25, 1; similarity 1, 0.75, 0.5."""
    weights = {"title": (5.0, 2.0, 1.0), "path": (3.0, 1.25, 0.75), "body": (1.5, 1.0, 0.5)}
    return sum((w[0] * hits[f] + w[1] * words[f] + w[2] * sims[f] for f, w in weights.items()), F.lit(0.0))


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    return F.round(sum((F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0)), 8)


def localization_score(prior: Column, section_score: Column, title_hits: Column, path_hits: Column, summary_hits: Column, time_hits: Column) -> Column:
    return F.round(prior + 100 * section_score + 3 * title_hits + 2 * path_hits + summary_hits + 1.5 * time_hits, 8)


def sibling_overlap(title_hits: Column, path_hits: Column, summary_hits: Column, time_hits: Column) -> Column:
    return 3.0 * title_hits + 2.0 * path_hits + summary_hits + 1.5 * time_hits


def evidence_score(localization: Column, supporting: Column, title_hits: Column, path_hits: Column, summary_hits: Column) -> Column:
    return F.round(localization + 0.5 * supporting + 2 * title_hits + 1.5 * path_hits + summary_hits, 8)


__all__ = ["cosine", "trigrams", "similarity", "word_similarity", "lexical_score", "rrf", "localization_score", "sibling_overlap", "evidence_score", "term_hits"]
