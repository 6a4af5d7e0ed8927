"""Portfolio listings routed to the sources that read them, and the cache of listings kept fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import urls

from rowloom.functions.text import is_fresh, parse_time
from rowloom.functions.urls import ats_of, same_url

from .outcomes import dedupe_first


def route_listings(listings: DataFrame, sources: list[str]) -> DataFrame:
    """Listings (key, url, ord) once for each key and each link, the first wins, with handed: the source that reads the
    link itself, null for those kept."""
    once = dedupe_first(dedupe_first(listings, "key").withColumn("_u", same_url(F.col("url"))), "_u").drop("_u")
    ats = ats_of(F.col("url"))
    return once.withColumn("handed", F.when(ats.isin(sources), ats))


def merge_listings(cache: DataFrame, new: DataFrame, cutoff: Column, now: Column) -> DataFrame:
    """Fresh listings of cache (with first_seen) and new, by key; the cached row wins. Undated listings age from
    when they were first seen."""
    old = cache.withColumn("_rank", F.lit(0))
    both = old.unionByName(new.withColumn("first_seen", now).withColumn("_rank", F.lit(1)))
    first = F.coalesce("first_seen", now)
    fresh = F.when(parse_time(F.col("posted_at")).isNull(), first >= cutoff).otherwise(is_fresh(F.col("posted_at"), cutoff))
    rest = [c for c in cache.columns if c not in ("key", "first_seen")]
    merged = both.where(fresh).groupBy("key").agg(F.min(first).alias("first_seen"), F.min_by(F.struct(*rest), F.struct("_rank", *rest)).alias("_r"))
    return merged.select(*[F.col(c) if c in ("key", "first_seen") else F.col(f"_r.{c}").alias(c) for c in cache.columns])


def discovery_counts(routed: DataFrame) -> DataFrame:
    """Listings handed to each source, and kept."""
    return routed.groupBy(F.coalesce("handed", F.lit("kept")).alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("links"))


def unique_links(*found: DataFrame) -> DataFrame:
    """Links (link) of any number of searches, parsed and united: one row (ats, slug, job_id, url) for each job."""
    rows = found[0].select("link")
    for df in found[1:]:
        rows = rows.unionByName(df.select("link"))
    parsed = rows.select(urls.parse_link(F.col("link")).alias("p")).where("p IS NOT NULL").select("p.*")
    return parsed.groupBy("ats", F.lower("slug").alias("slug"), "job_id").agg(F.min("url").alias("url"))
