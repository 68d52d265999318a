"""Secret scans with multipart credential linking.

Every text is scanned whole for access identifiers, secrets and endpoints. Strong parts are
reported as they are. Weak candidates - short identifiers, bare 40-character keys, endpoints -
say nothing alone; an interval join within a scope of `scope` characters around each of them
looks for the parts that complement it, and only then they are reported and linked.

| candidate | reported with |
|-|-|
| weak_access: AKIA and 12 to 15 more of `[A-Z0-9]` | a secret of any kind |
| weak_secret: 40 or more of `[A-Za-z0-9+/]`, not within another part | an identifier of any kind, or an endpoint |
| endpoint: `https?://...` | both an identifier and a strong secret |

A null text counts as empty. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textcore as T
from .store import documents

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BARE = re.compile(r"[A-Za-z0-9+/]{40,}")
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]+""")
_WORDS = ("passw", "secret", "token", "api")
_HEX_BYTES, _BARE_BYTES = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTES[[*b"0123456789abcdef"]] = True
_BARE_BYTES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]] = True


def _rows_with_run(member: np.ndarray, off: np.ndarray, length: int) -> set[int]:
    """Rows that hold a run of `length` member bytes (or seem to, across a row's end)."""
    done = 1
    while done * 2 <= length and len(member) > done:
        member = member[:-done] & member[done:]
        done *= 2
    rest = length - done
    if rest and len(member) > rest:
        member = member[:-rest] & member[rest:]
    return set((np.searchsorted(off, np.flatnonzero(member), "right") - 1).tolist())


def find_parts(text: str, hexes: bool = True, bare: bool = True) -> list[tuple[int, int, int]]:
    """All parts as (start, kind number, end)."""
    lower = text.lower()
    parts = []
    if any(w in lower for w in _WORDS):
        parts += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                parts.append((m.start(), 1 if m.end() - m.start() >= 20 else 3, m.end()))
    if hexes:
        parts += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "://" in text:
        parts += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if bare:
        taken = sorted(parts)
        last = -1
        i = 0
        for m in _BARE.finditer(text):
            while i < len(taken) and taken[i][0] < m.end():
                last = max(last, taken[i][2])
                i += 1
            if last <= m.start():
                parts.append((m.start(), 4, m.end()))
    return sorted(parts)


def _reach(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """For each prefix of spans in order of their starts: the furthest end, its start, and the furthest end of the others."""
    out, far, at, other = [], -1, -1, -1
    for s, e in spans:
        if e > far:
            far, at, other = e, s, far
        else:
            other = max(other, e)
        out.append((far, at, other))
    return out


def link_parts(parts: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """The weak parts that have their complement within `scope` characters.

    A span lies near if it starts no later than `scope` after the part's end and ends no earlier than `scope` before its start: of those
    that start in time the one that reaches furthest decides, so each part costs one search.
    """
    if not any(k > 2 for _, k, _ in parts):
        return []
    spans = {k: [(s, e) for s, kind, e in parts if kind == k] for k in range(len(KINDS))}
    starts = {k: [s for s, _ in v] for k, v in spans.items()}
    reach = {k: _reach(v) for k, v in spans.items()}

    def near(start: int, end: int, kinds: tuple[int, ...]) -> bool:
        for k in kinds:
            i = bisect_right(starts[k], end + scope)
            if i:
                far, at, other = reach[k][i - 1]
                if (other if k > 2 and (at, far) == (start, end) else far) >= start - scope:
                    return True
        return False

    wanted = {3: ((0, 2, 4),), 4: ((1, 3, 5),), 5: ((1, 3), (0, 2))}
    return [(s, k, e) for s, k, e in parts if k > 2 and all(near(s, e, kinds) for kinds in wanted[k])]


def _join(parts) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(parts))


def _scan(scope: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in T.text_chunks(batches):
            hexes, bare = _rows_with_run(_HEX_BYTES[data], off, 24), _rows_with_run(_BARE_BYTES[data], off, 40)
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            counts, digests, spans, linked = [], [], [], []
            for i, text in enumerate(texts):
                parts = find_parts(text or "", i in hexes, i in bare)
                base = [p for p in parts if p[1] < 3]
                more = link_parts(parts, scope)
                counts.append([sum(p[1] == k for p in base) for k in range(3)])
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(base + more))
                linked.append(len(more))
            count = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [T.take_row(rows, "doc_id", np.arange(rows.num_rows)), *(pa.array(count[:, k]) for k in range(3)), pa.array(digests), pa.array(spans, pa.string()), pa.array(linked, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    return scan


def secret_scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_linked for every row of docs.

    Only doc_id and text are read; a null text is empty, repeated rows are scanned alike, an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(scope), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
