"""Secret scans: pattern rules and sliding-window entropy.

Rules (kinds ``assign``, ``access``, ``hex``) are matched leftmost without overlaps over whole texts;
matches that fail a rule's length are dropped after they have consumed their text. The entropy rule
(kind ``entropy``) looks at candidate strings, maximal runs of ``[A-Za-z0-9+/_=-]`` of at least
``WINDOW`` characters: a window of that length slides over each with incremental counts, and for
each character class (hex digits, digits and lower case, base64) that covers the window, Shannon
entropy is compared with the class's threshold. Overlapping hot windows join to one span. A
span is suppressed if it overlaps a rule's span (already reported) or its candidate is on the
allow list: UUIDs, the same character or short block repeated, plain words of fewer than
``WINDOW`` letters joined by + - _ / =, or runs in alphabetical order.

Null texts count as empty; every row gives one row, without spans if there are none. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows, texts

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits a character that a window of WINDOW characters must have, by class.
CLASSES = (("hex", frozenset("0123456789abcdefABCDEF"), 3.0), ("lower", frozenset("0123456789abcdefghijklmnopqrstuvwxyz"), 3.7), ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 3.9))
#: Letters that fill a window are no plain word: their entropy is looked at.
WORD = r"(?=[A-Za-z]{1,%d}(?![A-Za-z])|[0-9])([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})" % (WINDOW - 1)
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(.{1,6}?)\1+"),
    re.compile(r"[+/_=-]*%s([+/_=-]+%s)*[+/_=-]*" % (WORD, WORD)),
)
ORDER = "0123456789abcdefghijklmnopqrstuvwxyz0123456789"
#: n * log2(n) for the counts of a window.
PART = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def allowed(candidate: str) -> bool:
    """Whether the allow list has the candidate."""
    return candidate.lower() in ORDER or any(p.fullmatch(candidate) for p in ALLOWED)


def hot_windows(candidate: str) -> list[tuple[int, int]]:
    """Joined spans of the windows whose entropy reaches the threshold of a class that covers them."""
    spans: list[tuple[int, int]] = []
    for _, letters, least in CLASSES:
        counts: dict[str, int] = {}
        total = run = 0.0
        for i, ch in enumerate(candidate):
            if ch not in letters:
                counts.clear()
                total = run = 0
                continue
            n = counts.get(ch, 0)
            total += PART[min(n + 1, WINDOW)] - PART[n]
            counts[ch] = n + 1
            run += 1
            if run >= WINDOW:
                if math.log2(WINDOW) - total / WINDOW >= least:
                    spans.append((i + 1 - WINDOW, i + 1))
                old = candidate[i + 1 - WINDOW]
                n = counts[old]
                total += PART[n - 1] - PART[n]
                counts[old] = n - 1
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern rules, by start and then kind as listed."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The rules' spans, and all spans with those that entropy adds."""
    base = base_spans(text)
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, b, _ in base), max))
    more = []
    for m in CANDIDATE.finditer(text):
        if not allowed(m[0]):
            for a, b in hot_windows(m[0]):
                span = (m.start() + a, m.start() + b, "entropy")
                before = bisect_left(starts, span[1])  # rules' spans that begin before its end
                if not before or reach[before - 1] <= span[0]:
                    more.append(span)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        out = []
        for text in texts(batch.column("text")):
            base, spans = scan(text)
            kinds = [s[2] for s in base]
            out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), len(spans) - len(base)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
