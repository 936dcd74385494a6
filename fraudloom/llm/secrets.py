"""Secret scan (operator 9).

An Aho-Corasick automaton of lower-case keywords runs once over the text; only
at its hits an anchored regular expression is tried, and kinds that embed a
checksum are kept only if it holds. Runs of hexadecimal digits have no keyword
and are found by one scan of their own. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Kinds in order, their keywords (lower case) and patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "google", "slack", "jwt", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "google": ("aiza",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
}
#: A JWT's head, whatever follows; its pattern above is what has to.
HEAD = re.compile(r"eyJ[A-Za-z0-9_-]+")
#: Brackets in a JWT's head, beyond which it isn't taken for one.
BRACKETS = 64
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE = KINDS[:3]


def crc_base62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return crc_base62(m[1]) == m[2]
    return True


def _head(part: str) -> bool:
    """Whether a part is the head of a JWT: base64 of a JSON object with an algorithm. Deeply nested ones aren't parsed."""
    try:
        raw = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
        return raw.count(b"{") + raw.count(b"[") <= BRACKETS and "alg" in json.loads(raw)
    except (ValueError, TypeError):
        return False


def _jwt(text: str, start: int) -> tuple[int, int | None]:
    """(where the next one may start, end of the JWT that starts here or None).

    Whether one starts inside a run of its characters depends on what follows
    the run alone, so a run that fails is passed over as a whole.
    """
    h = HEAD.match(text, start)
    if not h:
        return start + 1, None
    m = PATTERNS["jwt"].match(text, h.end())
    if not m:
        return h.end(), None
    return m.end(), m.end() if _head(h[0]) else None


_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automaton = a
    return _automaton


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and then kind; leftmost and non-overlapping within a kind."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton().iter(low))
    out, after = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < after[kind]:
            continue
        if kind == "jwt":
            after[kind], end = _jwt(text, start)
            if end is not None:
                out.append((start, kind, end))
        elif m := PATTERNS[kind].match(text, start):
            after[kind] = m.end()
            if _valid(kind, m):
                out.append((start, kind, m.end()))
    out += [(m.start(), "hex", m.end()) for m in PATTERNS["hex"].finditer(text)]
    out.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None) -> str | None:
    """The text with every secret replaced by [kind]; overlapping spans become one, named by the first. Null stays null, the empty text empty."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in scan(text):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.column("text").to_pylist():
            s = scan(t)
            base = [x for x in s if x[1] in BASE]
            n = [sum(x[1] == k for x in base) for k in BASE]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(s)))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [x.split()[0] for x in _FOUND.split(", ")])


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> a row each: counts, base_sha256 and spans.

    Null and empty texts hold nothing (base_sha256 is that of the empty
    string). Long texts are scanned whole, in time in proportion to their
    length. Repeated rows and null doc_ids come back as they are; an empty
    table gives no rows; further columns are ignored.
    """
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
