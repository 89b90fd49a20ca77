"""Secrets in texts: stated patterns, and stretches of high entropy inside long tokens.

Patterns find assignments, access keys and long hexadecimal runs. Beside them, candidate
strings (``CANDIDATE``) are read with a window of fixed width for each character class;
the window's Shannon entropy is kept by incremental counts, so a character costs the same
at any width. Windows above the class's threshold merge into spans, which an allow list
of ordinary strings suppresses. A span inside one that a pattern found is not said again.

Defined results: null and empty texts have no spans; repeated rows give equal rows; texts
are read whole however long; an empty table gives no rows. Columns other than doc_id and
text, whatever their names, are not read. Spans are half-open, in code points, of the
whole match; equal starts are ordered by kind, as listed in ``KINDS``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stated patterns, and least lengths (of the secret, or of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Runs of the characters that keys are written in, at least as long as the shortest window.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: By character class: its members, the window's width, and the bits a character from which a window counts.
CLASSES = {
    "entropy_hex": (frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    "entropy_base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 4.0),
}
#: Ordinary strings, matched against a whole found span: one kind of letter or digits only, words joined by
#: hyphens, underscores or slashes, identifiers of fixed form, and what says that it is an example.
ALLOW = (
    r"[a-z]+|[A-Z]+|[0-9]+",
    r"[-_/=+]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/=+]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[-_/=+]*",
    r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,4}",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i:.*(?:example|sample|placeholder|dummy|changeme).*)",
    r"(?i:.*(?:0123456789|abcdefghijkl).*)",
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the stated patterns, failing matches dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=_place)


def _place(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def dense_stretches(text: str, members: frozenset, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Merged windows of ``width`` characters of one class whose Shannon entropy is at least ``bits``.

    A window's entropy is log2(width) - sum(c log2 c) / width over the counts c of its
    characters; the sum changes by two terms when the window moves.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    most = (math.log2(width) - bits) * width + 1e-9
    counts, total, run, start, end = {}, 0.0, 0, -1, -1
    for i, c in enumerate(text):
        if c not in members:
            counts, total, run = {}, 0.0, 0
            continue
        if run == width:
            old = text[i - width]
            k = counts[old]
            counts[old] = k - 1
            total += term[k - 1] - term[k]
        else:
            run += 1
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += term[k + 1] - term[k]
        if run == width and total <= most:
            if i + 1 - width > end:
                if end >= 0:
                    yield start, end
                start = i + 1 - width
            end = i + 1
    if end >= 0:
        yield start, end


def entropy_spans(text: str, allow: re.Pattern, classes: dict = CLASSES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the stretches of high entropy in the text's candidates, those allowed left out.

    The allow list is asked about the stretch and about its whole candidate. A stretch
    inside that of another class is not said again.
    """
    found, order = [], list(classes)
    for m in CANDIDATE.finditer(text):
        if allow.fullmatch(m[0]):
            continue
        here = [(a, b, kind) for kind, rule in classes.items() for a, b in dense_stretches(m[0], *rule) if not allow.fullmatch(m[0], a, b)]
        reach = 0
        for a, b, kind in sorted(here, key=lambda s: (s[0], -s[1], order.index(s[2]))):
            if b > reach:
                found.append((m.start() + a, m.start() + b, kind))
                reach = b
    return found


def all_spans(text: str, allow: re.Pattern) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and these with those of high entropy that none of them holds."""
    base = base_spans(text)
    added, at, reach = [], 0, 0
    for span in sorted(entropy_spans(text, allow), key=_place):
        while at < len(base) and base[at][0] <= span[0]:
            reach = max(reach, base[at][1])
            at += 1
        if span[1] > reach:
            added.append(span)
    return base, sorted(base + added, key=_place)


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(documents: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row per row of ``documents``; no shuffle.

    ``allow`` are patterns of strings that high entropy does not make a secret.
    """
    allowed = re.compile("|".join(f"(?:{p})" for p in allow) or r"(?!)", re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = all_spans(text.as_py() or "", allowed)
                kinds = [s[2] for s in base]
                rows.append((*(kinds.count(k) for k in LEAST), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    given = documents.select("doc_id", "text")
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def spans_table(scanned: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end), a row per span of ``scan_secrets``' result."""
    one = scanned.select("doc_id", F.explode(F.split("spans", ",")).alias("span")).where("span <> ''").select("doc_id", F.split("span", ":").alias("p"))
    return one.select("doc_id", F.get("p", F.lit(0)).alias("kind"), F.get("p", F.lit(1)).cast("int").alias("start"), F.get("p", F.lit(2)).cast("int").alias("end"))
