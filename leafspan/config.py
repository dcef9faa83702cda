"""Settings: an explicit value comes before the environment, that before a settings file, that before the default."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from pathlib import Path

PREFIX = "LEAFSPAN_"


@dataclasses.dataclass(frozen=True)
class Settings:
    top_dense: int = 60
    top_lexical: int = 60
    top_fused: int = 80
    top_docs: int = 10
    sections_per_doc: int = 3
    chunks_per_section: int = 2
    rrf_k: int = 60
    lexical_threshold: float = 0.18
    doc_score_limit: int = 5
    section_score_limit: int = 3
    tree_sections: int = 5
    anchors: int = 3
    whole_doc_fallback: bool = True
    shortlist: int = 8
    focus_sections: int = 3
    ancestor_hops: int = 2
    descendant_depth: int = 1
    siblings: int = 2
    neighbour_window: int = 1
    evidence_chunks: int = 6
    context_budget: int = 6000
    evidence_per_doc: int = 3
    evidence_total: int = 8
    chunk_tokens: int = 400
    chunk_overlap: int = 80
    dimensions: int = 0


def _parsed(name: str, kind: str, raw: object):
    text = str(raw).strip()
    if kind == "bool":
        if text.lower() not in {"1", "0", "true", "false", "yes", "no", "on", "off"}:
            raise ValueError(f"{name} is not a truth value: {text}")
        return text.lower() in {"1", "true", "yes", "on"}
    try:
        return int(text) if kind == "int" else float(text)
    except ValueError:
        raise ValueError(f"{name} is not a number: {text}") from None


def read_env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and quotes around values are passed over. No file, no settings."""
    path, out = Path(path), {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        name, found, value = line.strip().removeprefix("export ").partition("=")
        if found and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("'\"")
    return out


def settings(given: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, env_file: str | Path | None = None) -> Settings:
    """given may hold None for what is not given; blank environment values count as absent."""
    given = {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := set(given) - {f.name for f in dataclasses.fields(Settings)}:
        raise ValueError(f"unknown settings: {json.dumps(sorted(unknown))}")
    env = (read_env_file(env_file) if env_file else {}) | dict(os.environ if env is None else env)
    out = {}
    for f in dataclasses.fields(Settings):
        raw = given.get(f.name, env.get(PREFIX + f.name.upper(), ""))
        if str(raw).strip():
            out[f.name] = _parsed(f.name, f.type, raw)
    return Settings(**out)
