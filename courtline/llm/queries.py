"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .feistel_shards import op4_feistel_shards
from .filter_audit import OP11_SQL, op11_filter_audit
from .line_dedup import op10_line_dedup
from .mixing import op5_mixing
from .ngram_join import op9_ngram_join
from .phrase_automata import op3_phrase_automata
from .prefix_trie import op13_prefix_trie
from .quality import op8_quality_rules
from .secrets import op1_secret_scan
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op7_token_counts
from .warc import OP12_SQL, op12_warc
from .winnow import op2_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_secret_scan, op2_winnowing, op3_phrase_automata, op4_feistel_shards, op5_mixing, op6_suffix_dedup, op7_token_counts, op8_quality_rules, op9_ngram_join, op10_line_dedup, op11_filter_audit, op12_warc, op13_prefix_trie)
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11_SQL, "op12_warc": OP12_SQL}
