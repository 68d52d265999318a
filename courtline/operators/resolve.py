"""Messy names to ids: exact, by longest prefix, and by similarity of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R


def name_lookup(teams: DataFrame, spellings: DataFrame) -> DataFrame:
    """(alias, id) of team names and spellings, already normalised; a spelling overrides a name, the smallest id wins a tie."""
    both = teams.select("alias", "id", F.lit(0).alias("_p")).unionByName(spellings.select("alias", "id", F.lit(1).alias("_p"))).where("alias <> ''")
    return R.keep_last(both, ["alias"], F.desc("_p"), F.col("id")).drop("_p")


def resolve_exact_prefix(names: DataFrame, name: str, lookup: DataFrame) -> DataFrame:
    """Every distinct name with its exact id, else that of the longest alias that begins it, else null."""
    every = names.select(name).where(F.col(name).isNotNull()).distinct()
    exact = every.join(lookup.withColumnRenamed("alias", name), name, "left")
    rest = exact.where("id is null").select(name)
    prefix = R.join_longest_prefix(rest, name, lookup, "alias").select(name, F.col("id").alias("_pid"))
    return exact.join(prefix, name, "left").select(name, F.coalesce("id", "_pid").alias("id"), F.when(F.col("id").isNotNull(), "exact").when(F.col("_pid").isNotNull(), "prefix").otherwise("unmatched").alias("status"))


def token_set_score(a: Column, b: Column) -> Column:
    """0 to 100: the best likeness of the common tokens, and of each name's, as sorted text."""
    ta, tb = F.array_sort(F.array_distinct(F.split(a, " "))), F.array_sort(F.array_distinct(F.split(b, " ")))
    both = F.array_sort(F.array_intersect(ta, tb))
    text = lambda *parts: F.array_join(F.concat(*parts), " ")
    base, with_a, with_b = text(both), text(both, F.array_except(ta, tb)), text(both, F.array_except(tb, ta))
    like = lambda x, y: F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.greatest(like(base, with_a), like(base, with_b), like(with_a, with_b)) * 100


def resolve_fuzzy(names: DataFrame, name: str, lookup: DataFrame, threshold: float = 85.0, common: int = 1000) -> DataFrame:
    """For each distinct name the most similar alias that shares a token, if it scores enough.

    Candidates meet on their tokens, each pair on its least common one only. The aliases of a
    token of more than `common` are dealt by salt, so no join group holds many more than that.
    """
    every = names.select(name).where(F.col(name).isNotNull()).distinct()
    tokens = lambda df, c: df.withColumn("_all", F.array_remove(F.array_distinct(F.split(c, " ")), "")).withColumn("_t", F.explode("_all"))
    alias_tokens = tokens(lookup, "alias").withColumnRenamed("_all", "_theirs")
    salts = alias_tokens.groupBy("_t").agg(F.ceil(F.count("*") / common).cast("int").alias("_n"))
    dealt = alias_tokens.join(salts, "_t").withColumn("_salt", F.pmod(F.xxhash64("alias"), F.col("_n")).cast("int")).drop("_n")
    asked = tokens(every, name).join(salts, "_t").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    met = asked.join(dealt, ["_t", "_salt"]).where(F.col("_t") == F.array_min(F.array_intersect("_all", "_theirs"))).withColumn("score", token_set_score(F.col(name), F.col("alias")))
    top = met.groupBy(name).agg(F.min(F.struct((-F.round("score", 6)).alias("_o"), "alias", "id", "score")).alias("_b")).select(name, "_b.alias", "_b.id", "_b.score")
    return every.join(top, name, "left").select(name, F.when(F.col("score") >= threshold, F.col("id")).alias("id"), F.when(F.col("score") >= threshold, F.col("alias")).alias("alias"), "score")


def resolution_audit(names: DataFrame, name: str, lookup: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Each distinct name's status: exact, prefix, fuzzy or unmatched, with id and score."""
    known = resolve_exact_prefix(names, name, lookup)
    rest = resolve_fuzzy(known.where("id is null"), name, lookup, threshold).select(name, F.col("id").alias("_fid"), "score")
    out = known.join(rest, name, "left")
    status = F.when(F.col("id").isNotNull(), F.col("status")).when(F.col("_fid").isNotNull(), "fuzzy").otherwise("unmatched")
    return out.select(name, F.coalesce("id", "_fid").alias("id"), status.alias("status"), "score")


def pair_sides(title: Column) -> tuple[Column, Column]:
    """Both sides of "A at B" or "A vs. B"; null if the title is neither."""
    parts = F.split(title, r"\s+(?:at|vs\.?|v)\s+", 2)
    return F.nullif(F.trim(F.get(parts, F.lit(0))), title), F.trim(F.get(parts, F.lit(1)))


def candidate_matchups(sources: list[DataFrame], field: DataFrame) -> DataFrame:
    """Distinct pairs over many sources with the longest names, teams of the field only; sources: Season, T1, T2, Name1, Name2."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    for t in ("T1", "T2"):
        rows = rows.join(field.withColumnRenamed("TeamID", t), ["Season", t], "left_semi")
    longest = lambda c: F.max_by(c, F.struct(F.length(c), F.col(c)))
    return rows.groupBy("Season", "T1", "T2").agg(longest("Name1").alias("Name1"), longest("Name2").alias("Name2"))
