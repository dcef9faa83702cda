"""Model calls as hooks: retries with a second model, several prompts at once, and what answers turn into.

A model is any callable from a prompt to an answer. Nothing here calls a service; without a model the rules stand alone.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T

Model = Callable[[str], str]
RELATIONS = ("supports", "conflicts", "related")


def steadfast(first: Model, second: Model | None = None, attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> Model:
    """A model that is asked up to attempts times, then the second one; waits grow to eight seconds."""

    def ask(prompt: str) -> str:
        error: Exception | None = None
        for model in (first, second):
            for k in range(attempts if model else 0):
                try:
                    return model(prompt)
                except Exception as e:  # noqa: BLE001
                    error = e
                    if k + 1 < attempts:
                        wait(min(8.0, 1.5 * (k + 1)))
        raise error or ValueError("no model")

    return ask


def lazily(factory: Callable[[], Model]) -> Model | None:
    """The model that a factory makes, or None where it fails."""
    try:
        return factory()
    except Exception:  # noqa: BLE001
        return None


def payload(answer: str) -> dict:
    """The JSON object in an answer, from its first to its last brace."""
    found = re.search(r"\{.*\}", answer or "", re.S)
    value = json.loads(found[0]) if found else None
    if not isinstance(value, dict):
        raise ValueError("the answer holds no JSON object")
    return value


def string_list(value: object) -> list[str]:
    """A scalar or a list as trimmed strings, each once, blanks dropped."""
    values = value if isinstance(value, list) else [] if value is None else [value]
    return list(dict.fromkeys(t for v in values if (t := str(v).strip())))


def time_lists(value: object) -> tuple[list[int], list[str]]:
    """Years and quarters of a time scope given as JSON; what is no year is passed over."""
    if not isinstance(value, dict):
        return [], []
    years = set()
    for y in value.get("years") if isinstance(value.get("years"), list) else []:
        try:
            years.add(int(y))
        except (TypeError, ValueError):
            continue
    names = {k: v for k, v in T.QUARTERS.items()} | {f"q{i}": f"Q{i}" for i in range(1, 5)}
    quarters = [names.get(q.casefold().replace(" ", ""), q.upper()) for q in string_list(value.get("quarters"))]
    return sorted(years), list(dict.fromkeys(quarters))


def query_prompt(query: dict) -> str:
    return f"Complete what rules found in a search query. Answer with one JSON object of these fields and nothing else.\n{json.dumps(query, ensure_ascii=False, default=list)}"


def ranking_prompts(sections: DataFrame, query: str) -> DataFrame:
    """doc_id and prompt: a document's localized sections (section_id, title_path, summary, local_rank) and the query."""
    item = F.struct("local_rank", "section_id", "title_path", "summary")
    rows = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    told = F.concat(F.lit(f"Order these sections by how well they answer the query. Answer as {{\"ranked_sections\": [{{\"section_id\": \"...\"}}]}}.\nQuery: {query}\nSections: "), F.to_json("items"))
    return rows.select("doc_id", told.alias("prompt"))


def label_prompt(evidence: DataFrame, query: str, most: int = 8, excerpt: int = 1800) -> str:
    item = F.to_json(F.struct("evidence_id", "title_path", T.clip(F.col("context_text"), excerpt).alias("text")))
    told = [r[0] for r in evidence.orderBy("evidence_rank").limit(most).select(item).collect()]
    return f"Say of each passage whether it supports, conflicts with or is related to the query. Answer as {{\"labeled_evidence\": [{{\"evidence_id\": \"...\", \"relationship_label\": \"...\"}}]}}.\nQuery: {query}\n[{', '.join(told)}]"


def ranker(model: Model, query: str, at_once: int = 4) -> Callable[[DataFrame], DataFrame]:
    """A rank hook: one prompt a document, at_once at a time; a document whose answer is unusable keeps its order.

    A section's rank is its place in the answer, unknown ids included.
    """

    def rank(sections: DataFrame) -> DataFrame:
        asked = ranking_prompts(sections, query).collect()  # a row for each of the few best documents

        def one(row) -> list[tuple]:
            try:
                return [(row["doc_id"], str(x["section_id"]), k) for k, x in enumerate(payload(model(row["prompt"]))["ranked_sections"], 1)]
            except Exception:  # noqa: BLE001
                return []

        with ThreadPoolExecutor(at_once) as pool:
            found = [x for rows in pool.map(one, asked) for x in rows]
        kinds = dict(sections.dtypes)
        return sections.sparkSession.createDataFrame(found, f"doc_id {kinds['doc_id']}, section_id string, rank int")

    return rank


def labeller(model: Model, query: str, most: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A label hook: one prompt for the first pieces of evidence; an unusable answer gives no labels."""

    def label(evidence: DataFrame) -> DataFrame:
        try:
            found = [(str(x["evidence_id"]), str(x["relationship_label"])) for x in payload(model(label_prompt(evidence, query, most)))["labeled_evidence"]]
        except Exception:  # noqa: BLE001
            found = []
        return evidence.sparkSession.createDataFrame(found, "evidence_id string, relation string")

    return label


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 10) -> Callable[[list[str]], list[list[float]]]:
    """embed called with batch texts at most."""
    return lambda texts: [v for k in range(0, len(texts), batch) for v in embed(texts[k : k + batch])]
