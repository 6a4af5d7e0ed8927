"""Mixing by soft membership, with DataFrame functions only.

A classifier fitted on the labelled table gives every document a posterior over domains. A document's rate is how often
it is taken; the expected tokens of a domain are the sum over documents of rate, tokens and posterior. Rates are the
nonnegative ones that bring these totals nearest to the target weights, by projected-gradient least squares: the driver
sees one number a domain and step, documents stay where they are, and no rows are shuffled.

The squares are measured in the domains' own covariance, and steps are taken per token; then a step of length one is
right, and without an active bound the first already hits the targets.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, written

#: Target share of tokens for each domain.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
#: Labelled rows that the fit uses at most (those of the smallest hashes), and features that it keeps.
FIT_ROWS, FEATURES, SUPPORT = 6_000, 256, 8
#: Least chi-square of a feature against the domains, and the rows of the overall share that smooth a domain's share.
SIGNIFICANCE, SMOOTHING = 30.0, 20
#: Steps at most, and the part of the tokens by which totals may miss their targets.
STEPS, TOLERANCE = 25, 1e-4


def domain_of_labels() -> F.Column:
    """The domain of a labelled row."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")


def features(text: F.Column) -> F.Column:
    """Features of a text: the first five characters of its words, its share of signs in tenths, and its size. They may
    repeat."""
    words = F.transform(F.split(F.lower(text), f"{SPACE}+"), lambda w: F.left(w, F.lit(5)))
    signs = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>!]+", ""))
    share = F.least(F.lit(9), F.floor(10 * signs / F.greatest(F.length(text), F.lit(1))))
    return F.concat(words, F.array(F.concat(F.lit("#sign"), share.cast("string")), F.concat(F.lit("#size"), F.floor(F.log2(F.greatest(F.length(text), F.lit(1)).cast("double"))).cast("string"))))


def n_tokens(text: F.Column) -> F.Column:
    """Words of a text: its tokens for mixing."""
    return F.size(F.array_remove(F.split(text, f"{SPACE}+"), "")).cast("long")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], domain: F.Column | None = None) -> dict:
    """Bernoulli naive Bayes: for each domain the log prior of a text without any of up to FEATURES features, and what
    each feature that it has adds.

    The labelled rows (doc_id and domain, at most FIT_ROWS) are broadcast; counts are reduced in Spark; the driver gets
    the features that it keeps. Rows of other domains are left out; without labels all domains are alike.
    """
    own = labels.select("doc_id", (domain_of_labels() if domain is None else domain).alias("_d")).where(F.col("_d").isin(domains)).distinct()
    own = written(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = written(docs.select("doc_id", text_of().alias("_t")).join(F.broadcast(own), "doc_id").select("_d", F.array_distinct(features(F.col("_t"))).alias("_f")))
    n = {r["_d"]: r["n"] for r in rows.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    prior = [math.log((n.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    counts = rows.select("_d", F.explode("_f").alias("feature")).groupBy("feature").agg(*[F.count_if(F.col("_d") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    every = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))
    odd = sum((F.pow(F.col(f"n{k}") - every * F.lit(n.get(d, 0) / max(1, total)), 2) / (every * F.lit(n.get(d, 0) / max(1, total)) + 1) for k, d in enumerate(domains)), F.lit(0.0))
    best = counts.withColumn("odd", odd).where((every >= SUPPORT) & (F.col("odd") >= SIGNIFICANCE)).orderBy(F.desc("odd"), "feature").limit(FEATURES).collect()
    overall = [sum(r[f"n{k}"] for k in range(len(domains))) / total for r in best]
    shares = [[min((r[f"n{k}"] + SMOOTHING * p + 0.5) / (n.get(d, 0) + SMOOTHING + 1), 0.999) for k, d in enumerate(domains)] for r, p in zip(best, overall, strict=True)]
    prior = [a + sum(math.log1p(-row[k]) for row in shares) for k, a in enumerate(prior)]
    weights = [[math.log(q / (1 - q)) for q in row] for row in shares]
    return {"domains": domains, "prior": prior, "features": [r["feature"] for r in best], "weights": weights}


def with_posterior(df: DataFrame, text: str, model: dict, into: str = "p") -> DataFrame:
    """df with the posteriors of its texts, an array in the order of the domains. Each step is a column of its own, so
    that none is computed twice."""
    known = F.array(*[F.lit(f) for f in model["features"]] or [F.lit("")])
    weights = model["weights"] or [[0.0] * len(model["domains"])]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    prior = F.array(*[F.lit(float(x)) for x in model["prior"]])
    df = df.withColumn("_at", F.transform(F.array_intersect(features(F.col(text)), known), lambda f: F.array_position(known, f).cast("int")))
    df = df.withColumn("_logits", F.aggregate("_at", prior, lambda s, i: F.zip_with(s, F.element_at(table, i), lambda a, b: a + b)))
    df = df.withColumn("_odds", F.transform("_logits", lambda x: F.exp(x - F.array_max("_logits"))))
    # the largest is exp(0), so the sum is at least 1
    return df.withColumn(into, F.transform("_odds", lambda x: x / F.aggregate("_odds", F.lit(0.0), lambda s, y: s + y))).drop("_at", "_logits", "_odds")


def rate(p: F.Column, steps: list[list[float]]) -> F.Column:
    """The rate of a document with posteriors p after the given steps, from 1."""
    if not steps:
        return F.lit(1.0)
    path = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in steps])
    dot = lambda e: sum((F.element_at(p, k + 1) * F.element_at(e, k + 1) for k in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(path, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - dot(e)))


def fit_rates(memberships: DataFrame, targets: dict[str, float]) -> tuple[list[list[float]], dict]:
    """Steps for rate(), and a report, for memberships (n_tokens, p); the whole of the tokens is the budget.

    Each step is one aggregate: the totals, and the covariance of the domains over documents whose rate isn't zero, which
    scales the next gradient. A step that brings the totals no nearer is followed by one in the covariance of all
    documents, which is always safe. The end: totals within TOLERANCE of the budget, or moving by less than that.
    """
    k = len(targets)
    share = np.array(list(targets.values())) / sum(targets.values())
    p = [F.element_at("p", i + 1) for i in range(k)]
    t = F.col("n_tokens").cast("double")
    gram = [F.sum(F.when(F.col("_r") > 0, t * p[i] * p[j])) for i in range(k) for j in range(i, k)]
    totals_of = [F.sum(t * F.col("_r") * p[i]) for i in range(k)]

    def measure(steps: list[list[float]]) -> tuple[float, np.ndarray, np.ndarray]:
        row = [x or 0.0 for x in memberships.withColumn("_r", rate(F.col("p"), steps)).agg(F.sum(t), *totals_of, *gram).first()]
        full, at = np.zeros((k, k)), 1 + k
        for i in range(k):
            for j in range(i, k):
                full[i, j] = full[j, i] = row[at]
                at += 1
        return row[0], np.array(row[1 : 1 + k]), full

    steps: list[list[float]] = []
    budget, totals, all_gram = measure(steps)
    wanted, now, off = share * budget, all_gram, np.inf
    while budget and len(steps) < STEPS:
        gap = totals - wanted
        safe = np.abs(gap).sum() >= off
        off = np.abs(gap).sum()
        if np.abs(gap).max() <= TOLERANCE * budget:
            break
        steps.append((np.linalg.pinv(all_gram if safe else now, rcond=1e-9, hermitian=True) @ gap).tolist())
        before = totals
        _, totals, now = measure(steps)
        if np.abs(totals - before).max() <= TOLERANCE * budget:
            break
    return steps, {"budget": budget, "wanted": wanted.tolist(), "totals": totals.tolist(), "steps": len(steps)}


def copies(r: F.Column, key: F.Column, seed: int = 2) -> F.Column:
    """How many times a document is taken: the whole part of its rate, and once more for the rest as its key's hash decides."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(r) + (u < r - F.floor(r)).cast("int")).cast("int")


def _prepared(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: F.Column | None, keep: list[str], report: dict | None) -> tuple[DataFrame, list[list[float]]]:
    """Written: kept (a struct of the columns keep), key, n_tokens and p of every row; and the steps of its rates.

    Texts are judged once. Targets that aren't met give a warning, and what was met is put into report.
    """
    model = fit_domains(docs, labels, list(targets), domain)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("doc_id").alias("key"), text_of().alias("_t"))
    members = written(with_posterior(own.withColumn("n_tokens", n_tokens(F.col("_t"))), "_t", model).select("kept", "key", "n_tokens", "p"))
    steps, found = fit_rates(members, targets)
    found["met"] = all(abs(a - b) <= 10 * TOLERANCE * found["budget"] for a, b in zip(found["totals"], found["wanted"], strict=True))
    if not found["met"]:
        warnings.warn(f"target weights are out of reach: tokens {found['totals']} for {found['wanted']}", stacklevel=3)
    if report is not None:
        report.update(found)
    return members, steps


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: F.Column | None = None, report: dict | None = None) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_tokens, p_<domain> for each domain of targets, rate and copies.

    Null texts count as empty: no tokens, and the rate of their posterior. Repeated rows have the same rate and the same
    draw. Extra columns are ignored; an empty table gives an empty result. Targets out of reach (a domain without
    documents) give the nearest totals and a warning; report, if given, receives budget, wanted, totals, steps and met.
    """
    targets = targets or TARGETS
    members, steps = _prepared(docs, labels, targets, domain, ["doc_id"], report)
    out = members.select("kept.doc_id", "n_tokens", *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(targets)], rate(F.col("p"), steps).alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: F.Column | None = None, report: dict | None = None) -> DataFrame:
    """docs with every row as often as its copies, columns unchanged, whatever their names; nothing is shuffled.

    Rows are written once with their posteriors, so that texts are judged once. Null and empty texts, repeated rows, an
    empty table and targets out of reach are treated as mixing_rates() does.
    """
    targets = targets or TARGETS
    members, steps = _prepared(docs, labels, targets, domain, docs.columns, report)
    taken = members.select("kept", copies(rate(F.col("p"), steps), F.col("key")).alias("n"))
    return taken.select("kept", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("each")).select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
