"""K1 to K6: sources, filters and scorers that users register by name, and functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.scores import STACK_ROLES
from rowloom.operators.evaluate import steps
from rowloom.operators.graph import written
from rowloom.plans.views import TERMINAL

SCORERS: dict[str, Callable[[DataFrame], Column]] = {}
FILTERS: dict[str, Callable[[DataFrame], Column]] = {}
ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def scorer(name: str):
    """K3: registers a function of a DataFrame to a column of results (a native expression or a pandas UDF)."""
    return lambda f: SCORERS.setdefault(name, f)


def posting_filter(name: str):
    """K4: registers a function of a DataFrame to a column of reasons, null to keep."""
    return lambda f: FILTERS.setdefault(name, f)


def enricher(source: str):
    """K2: registers a transform for the postings of a source."""
    return lambda f: ENRICHERS.setdefault(source, f)


def register_source(spark: SparkSession, source: type) -> None:
    """K1: makes a pyspark.sql.datasource.DataSource readable by its name, in batch and as a stream."""
    spark.dataSource.register(source)


def enrich(postings: DataFrame) -> DataFrame:
    """K2: each source's rows through its transform, other rows as they are. Postings are written once, then read by source."""
    if not ENRICHERS:
        return postings
    own = written(postings)
    out = own.where(~F.coalesce(F.col("source").isin(list(ENRICHERS)), F.lit(False)))
    for name, f in ENRICHERS.items():
        out = out.unionByName(f(own.where(F.col("source") == name)), allowMissingColumns=True)
    return out


def run_filters(postings: DataFrame, names: list[str]) -> DataFrame:
    """Postings with filter_reason, "name: reason" of the first filter with one."""
    return postings.withColumn("filter_reason", F.coalesce(*[F.concat(F.lit(f"{n}: "), FILTERS[n](postings)) for n in names]))


def run_scorers(postings: DataFrame, names: list[str]) -> DataFrame:
    """Q1: result of the first scorer with an answer, and its name; a later scorer sees only the rows that earlier ones left.
    What a scorer gave is written, so that each runs once on its rows."""
    out = None
    left = postings
    for n in names:
        scored = written(left.withColumn("result", SCORERS[n](left)))
        part = scored.where("result IS NOT NULL").withColumn("scorer", F.lit(n))
        out = part if out is None else out.unionByName(part)
        left = scored.where("result IS NULL").drop("result")
    if out is None:
        return postings.withColumn("scorer", F.lit(None).cast("string"))
    return out.unionByName(left, allowMissingColumns=True)


#: K6: scalar rules as SQL functions: arguments, type of the result, and the expression.
SQL_FUNCTIONS = {
    "floor2": ("x DOUBLE", "DOUBLE", "floor(x * 100 + 1e-9) / 100"),
    "floor4": ("x DOUBLE", "DOUBLE", "floor(round(x * 1e4, 6)) / 1e4"),
    "decide": ("score DOUBLE, notify_at DOUBLE, log_at DOUBLE", "STRING", "CASE WHEN score >= notify_at THEN 'notify' WHEN score >= log_at THEN 'log' ELSE 'skip' END"),
    "decide_gated": ("gated BOOLEAN, s DOUBLE, alert_at DOUBLE, save_at DOUBLE", "STRING", "CASE WHEN gated AND s >= alert_at THEN 'notify' WHEN gated AND s >= save_at THEN 'log' ELSE 'skip' END"),
    "decision_score": ("decision STRING", "INT", "CASE decision WHEN 'notify' THEN 8 WHEN 'log' THEN 6 WHEN 'skip' THEN 3 END"),
    "scaled": ("raw DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN least(10D, greatest(0D, (raw - low) / (high - low) * 10)) END"),
    "fit_band": ("score DOUBLE", "STRING", "CASE WHEN score < 5 THEN '<5' WHEN score < 7 THEN '5–7' WHEN score >= 7 THEN '≥7' END"),
    "role_target": ("role STRING", "STRING", f"CASE WHEN lower(trim(role)) IN ({', '.join(repr(r) for r in STACK_ROLES)}) THEN lower(trim(role)) ELSE 'other' END"),
    "outcome_state": ("status STRING", "STRING", f"CASE WHEN status IN ({', '.join(repr(s) for s in TERMINAL)}) THEN 'done' ELSE 'open' END"),
}
#: K5: table functions: arguments, columns, and the query over built-ins.
TABLE_FUNCTIONS = {
    "sentences_of": ("text STRING", "n INT, sentence STRING", r"SELECT pos, col FROM posexplode(filter(split(coalesce(text, ''), '(?<=[.!?])\\s+|\n'), x -> trim(x) <> ''))"),
    "lines_of": ("text STRING", "n INT, line STRING", r"SELECT pos, col FROM posexplode(filter(split(coalesce(text, ''), '\r\n|[\n\r]'), x -> trim(x) <> ''))"),
}


def register_functions(spark: SparkSession) -> None:
    """K5, K6: rules for SQL, as functions over built-ins that are planned with the query: no Python in their path."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, (arguments, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")


def precision_steps(labelled: DataFrame) -> DataFrame:
    """K6: labelled (score, good: 0 or 1) to each distinct score as a cut-off: rows at or above it, precision and recall."""
    up = steps(labelled.select("score", F.col("good").alias("y")), "score")
    good = labelled.agg(F.sum("good").alias("_all"))
    at = F.col("good_at")
    return up.join(F.broadcast(good)).select("score", "n_at", F.round(at / F.col("n_at"), 9).alias("precision"), F.round(at / F.col("_all"), 9).alias("recall"))
