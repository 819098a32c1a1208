"""Secret scans: fixed patterns plus sliding-window Shannon entropy per character class.

Candidates are maximal runs of key-like characters. Over each slides a window of the class the run
belongs to (hex or base64-like); the entropy of a window follows from counts that change by one
character in and one out. Windows above the class's threshold join to spans, unless an allow-list
pattern fits the candidate. Spans of the fixed patterns stay whatever the entropy says.

Scale: one map over the documents; a text is scanned where it lies and nothing is shuffled.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, in
order of start, then kind as in KINDS, then end; a found entropy span that a fixed span covers is not
repeated; repeated rows are scanned alike; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: class: (what its runs are made of, window length, bits per character that make a window suspicious)
CLASSES = {
    "hex": (re.compile(r"[0-9a-fA-F]+"), 20, 3.0),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.9),
}
#: Candidates that are no secrets: UUIDs, paths and identifiers of plain words, rulers, one-case words.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    # A word follows each run of separators but the last: one way to match, so time is linear.
    re.compile(r"[A-Za-z][a-z]*(?:[/_=-]+(?:[A-Z][a-z]*|[a-z]+))*[/_=-]*"),
    re.compile(r"[A-Z]+(?:[/_=-]+[A-Z]+)*[/_=-]*"),
    re.compile(r"[0-9/_=+-]+"),
)


def hot_windows(text: str, size: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of `size` characters whose entropy reaches `bits`."""
    if len(text) < size:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c); entropy is log2(size) - total / size
    limit = (math.log2(size) - bits) * size + 1e-9
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(text):
        if i >= size:
            old = text[i - size]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= size - 1 and total <= limit:
            start = i - size + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    for m in _CANDIDATE.finditer(text):
        run = m.group()
        if any(a.fullmatch(run) for a in ALLOW):
            continue
        for kind, size, bits in CLASSES.values():
            if kind.fullmatch(run):
                found += [(m.start() + s, 3, m.start() + e) for s, e in hot_windows(run, size, bits)]
                break
    return found


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    extra, k, reach = [], 0, 0
    for s, kind, e in entropy_spans(text):
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][2])
            k += 1
        if e > reach:
            extra.append((s, kind, e))
    return base, sorted(base + extra)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts per fixed kind, digest of the fixed spans and all spans: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, all_spans = [], []
            for value in batch.column("text"):
                base, both = scan(value.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                counts[3].append(len(both) - len(base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(both))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                pa.array(all_spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
