"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document if a measure exceeds a cutoff. Cutoffs come from labelled documents
that pass the base rules: within each stratum (the language) and rule, cutoffs are tried from
the most lenient on, and a cutoff holds if the exact binomial test rejects "more than `limit`
of good documents are rejected" - equivalently, if the exact upper confidence bound of the
false rejection rate is at most `limit`. Trying stops at the first cutoff that fails, which
needs no correction along a rule; the level is divided by rules times strata (Bonferroni). A
stratum with too few labels to prove any cutoff gets none, and keeps what passes the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import checkpoint, documents, let

WINDOW = 8
#: Cutoffs tried, the most lenient first; measures are per word or per line of the text.
CUTOFFS = {
    "symbols_per_word": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "repeats_per_word": (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05),
    "repeats_per_line": (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "chars_per_word": (40.0, 30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0),
}
#: Strata up to which their cutoffs are broadcast, after counting them.
BROADCAST_STRATA = 10_000
_SPACE = r"[ \t-\r]+"


def _repeated_words(hashes: Column) -> Column:
    """Words inside a WINDOW-word window that the text holds twice or more."""
    count = F.size(hashes) - WINDOW
    windows = F.when(count > 0, F.transform(F.sequence(F.lit(0), count), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def spread(ordered: Column) -> Column:
        twin = lambda x, k: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
        at = F.array_sort(F.transform(F.filter(ordered, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["at"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, zero, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"), (p + WINDOW).alias("end")))["n"]

    def total(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at")))), spread))

    return let(windows, total).cast("long")


def signals(docs: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, keep..., n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    measured = docs.select(
        "doc_id",
        *keep,
        (F.length(text) - F.regexp_count(text, F.lit(r"[ \t-\r]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n"), _repeated_words(h).alias("repeat"))).alias("_words"),
    )
    kept = measured.columns[1 : 1 + len(keep)]
    out = measured.select("doc_id", *kept, F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.dup").alias("n_dup_lines"), F.col("_lines.n").alias("n_lines"), F.col("_words.repeat").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def _measures() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / words, "repeats_per_word": F.col("n_repeat_words") / words, "repeats_per_line": F.col("n_dup_lines") / lines, "chars_per_word": F.col("word_chars") / words}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at rate p, exact, from k + 1 terms in logarithms; 1 where k >= n * p."""
    step = math.log(p / (1 - p))
    first = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + step
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, first, add)["sum"]))


def select_cutoffs(labelled: DataFrame, limit: float, level: float) -> DataFrame:
    """One row a stratum with an array of cutoffs in the order of CUTOFFS, null where none holds."""
    good = labelled.where(F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("quality") == 1))  # one condition: a part of it would be measured anew at the scan
    measures = _measures()
    tries = [(r, i, c) for r, cuts in enumerate(CUTOFFS.items()) for i, c in enumerate(cuts[1])]
    name = list(CUTOFFS)
    counted = good.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum(F.when(measures[name[r]] > c, 1).otherwise(0)).alias(f"k{r}_{i}") for r, i, c in tries))
    tested = counted.select("stratum", "n", F.count("*").over(Window.partitionBy()).alias("strata"), F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"k{r}_{i}").alias("k")) for r, i, c in tries))))
    holds = binomial_tail(F.col("k"), F.col("n"), limit) <= F.lit(level / len(CUTOFFS)) / F.col("strata")
    order = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    proven = tested.withColumn("holds", F.min(holds).over(order))
    return proven.groupBy("stratum").agg(*(F.min(F.when((F.col("rule") == r) & F.col("holds"), F.col("cutoff"))).alias(f"cut{r}") for r in range(len(name))))


def _cutoffs(rows: DataFrame, labels: DataFrame, limit: float, level: float) -> DataFrame:
    """select_cutoffs over the labelled rows, marked for broadcast if a count proves it small."""
    by_doc = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    cutoffs = checkpoint(select_cutoffs(rows.join(by_doc, "doc_id"), limit, level))
    return F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs


def _kept() -> Column:
    rejected = F.lit(False)
    for r, measure in enumerate(_measures().values()):
        rejected = rejected | F.coalesce(measure > F.col(f"cut{r}"), F.lit(False))
    return F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected)  # one condition: a part of it would be measured anew at the scan


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias("stratum")


def quality_verdicts(docs: DataFrame, labels: DataFrame, limit: float = 0.005, level: float = 0.05) -> DataFrame:
    """Signals of every row with base_failed and kept.

    docs (doc_id, text, lang, ...), labels (doc_id, quality). A null language is a stratum of
    its own; without labels every row that passes the base rules is kept. `limit` bounds the
    false rejections of each rule in each stratum, all bounds holding together with
    probability 1 - level. Repeated rows get one verdict each; rows with a null doc_id meet no
    label; a document with several labels counts as its best one. Null texts fail the base rules.
    """
    rows = checkpoint(signals(docs, keep=(_stratum(),)))
    judged = rows.join(_cutoffs(rows, labels, limit, level), "stratum", "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _kept().alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, limit: float = 0.005, level: float = 0.05) -> DataFrame:
    """The rows and columns of docs that quality_verdicts keeps; texts are measured in place and not shuffled."""
    cutoffs = _cutoffs(checkpoint(signals(docs, keep=(_stratum(),))), labels, limit, level)
    rows = signals(docs, keep=(_stratum(), F.struct(*docs.columns).alias("_doc")))
    return rows.join(cutoffs, "stratum", "left").where(_kept()).select("_doc.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir).select("doc_id", "text", "lang"), documents(spark, sf_dir, "labels"))
