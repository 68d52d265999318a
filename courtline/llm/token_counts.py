"""Token counts by offset-mapped attribution.

A document is rendered once, its fields one to a line, and encoded whole, so tokens are those
a trainer would see. Token lengths give byte spans, which are joined with the spans of the
sections by sorted search. A token that crosses a boundary is allocated by an explicit rule:

* first: to the section that holds its first byte (default);
* last: to the section that holds its last byte;
* most: to the section with most of its bytes, the first of equals.

A separator belongs to the section before it. Null fields count as empty. Counts of a document
always add up to the tokens of the whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as T
from .store import documents

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_loaded: dict[str, tuple] = {}


def encoding(path: str):
    """The encoder and the byte length of every token, once for each worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(k) for k in ranks]
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def allocate(ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section (by its first byte), and how many tokens cross a boundary; ends are the tokens' end bytes."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    a, b = np.searchsorted(sections, starts, "right") - 1, np.searchsorted(sections, ends - 1, "right") - 1
    crossing = np.flatnonzero(a != b)
    owner = b if rule == "last" else a
    if rule == "most":
        owner = a.copy()
        for t in crossing.tolist():
            cuts = np.concatenate(([starts[t]], sections[a[t] + 1 : b[t] + 1], [ends[t]]))
            owner[t] = a[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(sections)), len(crossing)


def _count(path: str, fields: list[str], rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = encoding(path)
        for rows, _, _ in T.text_chunks(batches, fields[-1]):
            columns = [rows.column(rows.schema.get_field_index(f)).to_pylist() for f in fields]
            total, crossed, per_field, per_line = [], [], [], []
            for values in zip(*columns, strict=True):
                values = [v or "" for v in values]
                ids = np.array(encoder.encode_ordinary("\n".join(values)), np.int64)
                heads = np.cumsum([0] + [len(v.encode()) + 1 for v in values])
                body = np.frombuffer(values[-1].encode(), np.uint8)
                lines = np.flatnonzero(body == 10) + 1 + heads[-2]
                got, crossing = allocate(np.cumsum(lengths[ids]), np.concatenate((heads[:-1], lines)), rule)
                total.append(len(ids))
                crossed.append(crossing)
                per_field.append([*got[: len(fields) - 1].tolist(), int(got[len(fields) - 1 :].sum())])
                per_line.append(got[len(fields) - 1 :].tolist())
            yield pa.RecordBatch.from_arrays(
                [T.take_row(rows, "doc_id", np.arange(rows.num_rows)), pa.array(total, pa.int64()), *(pa.array([p[k] for p in per_field], pa.int64()) for k in range(len(fields))), pa.array(crossed, pa.int64()), pa.array(per_line, pa.list_(pa.int64()))],
                names=["doc_id", "n_tokens", *(f"{f}_tokens" for f in fields), "n_crossing", "line_tokens"],
            )

    return count


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "first", ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, <field>_tokens..., n_crossing and line_tokens (tokens of each line of the last field)."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")
    schema = ", ".join(["doc_id long", "n_tokens long", *(f"{f}_tokens long" for f in fields), "n_crossing long", "line_tokens array<bigint>"])
    return docs.select("doc_id", *(F.col(f).cast("string").alias(f) for f in fields)).mapInArrow(_count(ranks, list(fields), rule), schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(documents(spark, sf_dir))
    return counted.withColumn("n_lines", F.size("line_tokens").cast("long")).withColumn("longest_line", F.array_max("line_tokens"))
