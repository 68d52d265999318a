"""Queries of entity resolution over part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as X
from .inputs import table, view, with_views
from .q_features import rounded
from .q_relational import FIELD, field
from .registry import query


def lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    teams = part.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("id"))
    spellings = part.where("p_size > 25").groupBy(F.split("p_name", " ")[1].alias("alias")).agg(F.min("p_partkey").alias("id"))
    return X.name_lookup(teams, spellings)


LOOKUP = "WITH lk AS (SELECT alias, id FROM (SELECT p_name AS alias, min(p_partkey) AS id, 0 AS p FROM part GROUP BY 1 UNION ALL SELECT string_split(p_name, ' ')[2], min(p_partkey), 1 FROM part WHERE p_size > 25 GROUP BY 1) t WHERE alias <> '' QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p DESC, id) = 1)"


@query("name_lookup", LOOKUP + " SELECT alias, id FROM lk")
def name_lookup(spark, sf_dir):
    return lookup(spark, sf_dir)


#: Names to resolve: type and name, a name with a tail, a misspelt name.
RAW = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || lower(p_type) WHEN 2 THEN substr(p_name, 1, length(p_name) - 1) || 'x' ELSE lower(p_brand) END"


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.expr(RAW).alias("name"))


@query("resolve_exact_prefix", LOOKUP + f", n AS (SELECT DISTINCT {RAW} AS name FROM part) SELECT name, coalesce(lk.id, p.id) AS id, CASE WHEN lk.id IS NOT NULL THEN 'exact' WHEN p.id IS NOT NULL THEN 'prefix' ELSE 'unmatched' END AS status FROM n LEFT JOIN lk ON lk.alias = name LEFT JOIN (SELECT n.name AS pn, a.id FROM n JOIN lk a ON starts_with(n.name, a.alias || ' ') QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY length(a.alias) DESC, a.alias) = 1) p ON p.pn = name")
def resolve_exact_prefix(spark, sf_dir):
    return X.resolve_exact_prefix(names(spark, sf_dir), "name", lookup(spark, sf_dir))


@query("resolve_fuzzy")
def resolve_fuzzy(spark, sf_dir):
    return rounded(X.resolve_fuzzy(names(spark, sf_dir), "name", lookup(spark, sf_dir), 75.0))


@query("resolution_audit")
def resolution_audit(spark, sf_dir):
    return rounded(X.resolution_audit(names(spark, sf_dir), "name", lookup(spark, sf_dir), 75.0))


@query("name_pair_match", with_views("tourney", "SELECT GameID, 'Team ' || WTeamID AS a, CASE WHEN GameID % 3 < 2 THEN 'Team ' || LTeamID END AS b FROM tourney WHERE GameID % 3 < 2 UNION ALL SELECT GameID, NULL, NULL FROM tourney WHERE GameID % 3 = 2"))
def name_pair_match(spark, sf_dir):
    word = F.when(F.col("GameID") % 3 == 0, " at ").when(F.col("GameID") % 3 == 1, " vs. ").otherwise(" and ")
    a, b = X.pair_sides(F.concat(F.lit("Team "), "WTeamID", word, F.lit("Team "), "LTeamID"))
    return view(spark, sf_dir, "tourney").select("GameID", a.alias("a"), b.alias("b"))


@query("candidate_matchups", with_views("contest tourney", f", {FIELD}, src AS (SELECT Season, least(WTeamID, LTeamID) AS T1, greatest(WTeamID, LTeamID) AS T2, CASE WHEN GameID % 2 = 0 THEN 'Team ' ELSE 'T' END || least(WTeamID, LTeamID) AS Name1, 'Team ' || greatest(WTeamID, LTeamID) || CASE WHEN DayNum > 300 THEN ' W' ELSE '' END AS Name2 FROM contest) SELECT Season, T1, T2, arg_max(Name1, (length(Name1), Name1)) AS Name1, arg_max(Name2, (length(Name2), Name2)) AS Name2 FROM src s WHERE EXISTS (SELECT 1 FROM field f WHERE f.Season = s.Season AND f.TeamID = T1) AND EXISTS (SELECT 1 FROM field f WHERE f.Season = s.Season AND f.TeamID = T2) GROUP BY 1, 2, 3"))
def candidate_matchups(spark, sf_dir):
    t1, t2 = F.least("WTeamID", "LTeamID"), F.greatest("WTeamID", "LTeamID")
    rows = view(spark, sf_dir, "contest").select("Season", t1.alias("T1"), t2.alias("T2"), F.concat(F.when(F.col("GameID") % 2 == 0, "Team ").otherwise("T"), t1).alias("Name1"), F.concat(F.lit("Team "), t2, F.when(F.col("DayNum") > 300, " W").otherwise("")).alias("Name2"))
    return X.candidate_matchups([rows.where("T1 % 3 = 0"), rows.where("T1 % 3 <> 0")], field(spark, sf_dir))
