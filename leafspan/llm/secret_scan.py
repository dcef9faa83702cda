"""Secret scans: keyword prefilter, anchored expressions near hits, checksum validation.

An Aho-Corasick automaton reads each text once and reports where keywords start. Only there is an expression tried,
anchored at the hit. Every expression is linear in the text: hits inside a match, or inside a run of characters in which
one hit has failed for what follows the run, are passed over. Kinds with an embedded checksum or a decodable structure are kept only if that holds. Runs of
hexadecimal digits have no keyword; they are found as runs of one byte after a table lookup.

Very long texts are scanned whole, in batches of bounded bytes. Nulls and empty texts give no spans. Positions are code points of the whole text, ends exclusive. Repeated rows give
repeated results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, redact_text, span_digest, table, tidy

BASE = ("assign", "access", "hex")
#: In the order in which spans with one start are listed.
KINDS = (*BASE, "github", "npm", "jwt", "pem", "slack", "google", "stripe")

# Keywords (lower case) and anchored expressions of each kind.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "google": ("aiza",),
    "stripe": ("sk_live_", "rk_live_"),
}
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "github": r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])",
    "npm": r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])",
    "jwt": r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+",
    "pem": r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "stripe": r"[rs]k_live_[A-Za-z0-9]{16,}",
}
#: Where a hit of these kinds fails, every later one in the same run of characters fails for the same reason.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]+")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LEAST = 24

_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))


def base62_crc32(payload: str) -> str:
    """The six base-62 digits of the CRC-32 that tokens of this family end with."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _is_json(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _is_base64(body: str) -> bool:
    try:
        return len(base64.b64decode("".join(body.split()), validate=True)) > 0
    except (ValueError, binascii.Error):
        return False


CHECKS = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: base62_crc32(m[1]) == m[2],
    "npm": lambda m: base62_crc32(m[1]) == m[2],
    "jwt": lambda m: _is_json(m[1]) and _is_json(m[2]),
    "pem": lambda m: _is_base64(m[2]),
}


class SecretScanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                self.automaton.add_word(w, (kind, len(w)))
        self.automaton.make_automaton()
        self.patterns = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """Spans (kind, start, end) by start, then kind as listed."""
        if not text:
            return []
        raw = text.encode("latin-1", "replace")  # a byte for each code point
        found, starts = [], {}
        for end, (kind, n) in self.automaton.iter(raw.lower().decode("latin-1")):
            starts.setdefault(kind, []).append(end + 1 - n)
        for kind, at in starts.items():
            match, check, last = self.patterns[kind].match, CHECKS.get(kind), 0
            run = RUNS.get(kind)
            for s in sorted(at):
                if s < last:
                    continue
                if m := match(text, s):
                    last = m.end()
                    if check is None or check(m):
                        found.append((kind, s, last))
                elif run and (m := run.match(text, s)):
                    last = m.end()
        runs, need = raw.translate(_HEX), b"h" * HEX_LEAST
        s = runs.find(need)
        while s >= 0:
            end = runs.find(b".", s + HEX_LEAST)
            end = len(runs) if end < 0 else end
            found.append(("hex", s, end))
            s = runs.find(need, end)
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """Per row: the id, found array<struct<kind,start,end>>, and with redact the text with spans replaced.

    A null text stays null in the redacted column and has no spans.
    """
    kind_of_id = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind_of_id}, found array<struct<kind:string,start:int,end:int>>" + ", redacted string" * redact
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner()
        for b in byte_slices(batches, 1):
            texts = b.column(1).to_pylist()
            found = [scanner.scan(t) for t in texts]
            cols = [b.column(0), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], span)]
            if redact:
                cols.append(pa.array([redact_text(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "found", "redacted"][: len(cols)])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_digest("found", BASE))
