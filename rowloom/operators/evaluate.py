"""Evaluation of scores against labels: cut-offs, precision and recall, calibration. Rows stay distributed; what meets in
one place are counts for each distinct score, or sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scores import STACK_ROLES, answers, gates_pass, softmax, summarise, wilson

from .graph import written


def steps(df: DataFrame, score: str = "s") -> DataFrame:
    """For each distinct score its rows (n, good) and those at or above it (n_at, good_at).

    The running sums go by range partitions: each partition sums its own scores, the sums of partitions above it are
    added, so no task sees all distinct scores. The order of partitions is that of the ranges; the counts are written with
    them, so that sums and scores agree on the ranges also where a lost executor's part is computed again.
    """
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("good"))
    per = written(counts.repartitionByRange(F.desc(score)).withColumn("_p", F.spark_partition_id()))
    up = Window.partitionBy("_p").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    sums = per.groupBy("_p").agg(F.sum("n").alias("_n"), F.sum("good").alias("_g"))
    above = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_nb"), F.coalesce(F.sum("_g").over(above), F.lit(0)).alias("_gb"))
    return per.join(before, "_p").select(score, "n", "good", (F.sum("n").over(up) + F.col("_nb")).alias("n_at"), (F.sum("good").over(up) + F.col("_gb")).alias("good_at"))


def precision_recall(n_at: Column, good_at: Column, good: Column) -> tuple[Column, Column]:
    """A15"""
    return F.coalesce(F.try_divide(good_at, n_at), F.lit(0.0)), good_at / F.greatest(good, F.lit(1))


def precision_recall_at(df: DataFrame, t: float, score: str = "s") -> DataFrame:
    """At one cut-off, among gated rows; recall counts good rows outside the gates as missed."""
    alert = F.col("gated") & (F.col(score) >= t)
    sums = df.agg(F.count_if(alert).alias("alerts"), F.count_if(alert & (F.col("y") == 1)).alias("caught"), F.count_if(F.col("y") == 1).alias("good"))
    p, r = precision_recall(F.col("alerts"), F.col("caught"), F.col("good"))
    return sums.withColumn("precision", p).withColumn("recall", r)


def alert_cutoff(df: DataFrame, min_recall: float, score: str = "s") -> DataFrame:
    """The cut-off of the best precision among those with enough recall, the higher on a tie; else the lowest score
    of a gated good row (else the largest), flagged; without gated rows the largest score and no alerts."""
    good = df.agg(F.count_if(F.col("y") == 1).alias("all_good"), F.max(score).alias("top"))
    at = steps(df.where("gated"), score).join(good)
    p, r = precision_recall(F.col("n_at"), F.col("good_at"), F.col("all_good"))
    at = at.withColumn("precision", p).withColumn("recall", r)
    row = F.struct(F.col(score).alias("t"), "precision", "recall", F.col("n_at").alias("alerts"))
    best = at.agg(
        F.max_by(F.when(F.col("recall") >= min_recall, row), F.when(F.col("recall") >= min_recall, F.struct("precision", score))).alias("met"),
        F.min_by(F.when(F.col("good") > 0, row), F.when(F.col("good") > 0, F.col(score))).alias("low"),
        F.max_by(row, F.col(score)).alias("high"),
    )
    none = F.struct(F.col("top").alias("t"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0).cast("long").alias("alerts"))
    return best.join(good).select(F.coalesce("met", "low", "high", none).alias("c"), F.col("met").isNotNull().alias("met")).select("c.*", "met")


def save_cutoff(df: DataFrame, alert_at: float, score: str = "s") -> DataFrame:
    """Below the alert cut-off, the score that best tells log from skip by F1, the lowest on a tie."""
    below = df.where((F.col(score) < alert_at) & F.col("label").isin("log", "skip")).select(score, (F.col("label") == "log").cast("int").alias("y"))
    at = steps(below, score).join(below.agg(F.sum("y").alias("all_good")))
    f1 = 2 * F.col("good_at") / F.greatest(F.lit(1), F.col("n_at") + F.col("all_good"))
    return at.agg(F.coalesce(F.max_by(score, F.struct(f1, -F.col(score))), F.lit(alert_at / 2)).alias("save_at"))


def cutoff_table(df: DataFrame, around: float, step: float, score: str = "s") -> DataFrame:
    """Precision, recall and alerts at seven cut-offs; one scan."""
    cuts = [round(around + d * step, 4) for d in range(-3, 4)]
    alert = lambda t: F.col("gated") & (F.col(score) >= t)
    one = df.agg(F.count_if(F.col("y") == 1).alias("good"), *[F.count_if(alert(t)).alias(f"n{i}") for i, t in enumerate(cuts)], *[F.count_if(alert(t) & (F.col("y") == 1)).alias(f"g{i}") for i, t in enumerate(cuts)])
    rows = one.select("good", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{i}").alias("alerts"), F.col(f"g{i}").alias("caught")) for i, t in enumerate(cuts)])).alias("r")).select("good", "r.*")
    p, r = precision_recall(F.col("alerts"), F.col("caught"), F.col("good"))
    return rows.select("t", p.alias("precision"), r.alias("recall"), "alerts")


def average_precision(df: DataFrame, score: str = "s") -> DataFrame:
    """Among gated rows; tied scores are one step; 0 without a good row."""
    gated = df.where("gated")
    at = steps(gated, score).join(gated.agg(F.count_if(F.col("y") == 1).alias("all_good")))
    return at.agg(F.coalesce(F.sum(F.when(F.col("all_good") > 0, F.col("good") / F.col("all_good") * F.col("good_at") / F.col("n_at"))), F.lit(0.0)).alias("average_precision"))


def choose_summary(df: DataFrame, scores: tuple[str, str] = ("expected", "p_good")) -> DataFrame:
    """The score of the higher average precision, the first on a tie."""
    a, b = (average_precision(df, s).select(F.col("average_precision").alias(s)) for s in scores)
    return a.join(b).withColumn("chosen", F.when(F.col(scores[1]) > F.col(scores[0]), scores[1]).otherwise(scores[0]))


def confusion(df: DataFrame, gold: str, predicted: str, values: list[str]) -> DataFrame:
    """Label by decision, zeros kept."""
    return df.groupBy(gold).pivot(predicted, values).agg(F.count(F.lit(1))).fillna(0)


def calibration_error(df: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error of the top answer (conf, correct), in equal-width bins."""
    cell = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    per = df.groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def question_metrics(df: DataFrame) -> DataFrame:
    """Of rows (role, role_true, deal_p, deal_true, deal_known, expected, score) accuracy and majority share of roles,
    accuracy, precision and recall of dealbreakers (unknown ones left out), mean absolute error and rank correlation."""
    hit, known = F.col("deal_p") >= 0.5, F.col("deal_known")
    true = F.col("deal_true") == 1
    top = df.groupBy("role_true").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_top"))
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("role") == F.col("role_true")).cast("double")).alias("role_accuracy"),
        F.avg(F.when(known, (hit == true).cast("double"))).alias("deal_accuracy"),
        F.when(F.count_if(known) > 0, F.count_if(known & hit & true) / F.greatest(F.lit(1), F.count_if(known & hit))).alias("deal_precision"),
        F.when(F.count_if(known) > 0, F.count_if(known & hit & true) / F.greatest(F.lit(1), F.count_if(known & true))).alias("deal_recall"),
        F.avg(F.abs(F.col("expected") - F.col("score"))).alias("fit_mae"),
    )
    return sums.join(top).withColumn("role_majority", F.col("_top") / F.col("n")).drop("_top").join(spearman(df, "expected", "score"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties; 0 when either is constant. Ranks come from counts of distinct values."""
    def ranks(c: str) -> DataFrame:
        up = steps(df.select(F.col(c).alias("s"), F.lit(1).alias("y")))
        return up.select(F.col("s").alias(c), (F.col("n_at") - (F.col("n") - 1) / 2).alias(f"_r{c}"))  # ranks from the top

    both = df.select(a, b).join(ranks(a), a).join(ranks(b), b)
    return both.agg(F.coalesce(F.nanvl(F.corr(f"_r{a}", f"_r{b}"), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def alert_summary(df: DataFrame, good: str = "notify") -> DataFrame:
    """Of labelled rows (label, decision, keep) alerts, per 100, worth with its range, caught and good."""
    alert = F.col("keep") & F.coalesce(F.col("decision") == "notify", F.lit(False))
    sums = df.agg(F.count(F.lit(1)).alias("labelled"), F.count_if(alert).alias("alerts"), F.count_if(alert & (F.col("label") == good)).alias("caught"), F.count_if(F.col("label") == good).alias("good"))
    low, high = wilson(F.col("caught"), F.col("alerts"))
    return sums.select("alerts", F.round(100 * F.col("alerts") / F.greatest(F.lit(1), F.col("labelled")), 1).alias("per100"), F.coalesce(F.try_divide("caught", "alerts"), F.lit(0.0)).alias("worth"), F.round(low, 3).alias("low"), F.round(high, 3).alias("high"), "caught", "good")


def go_no_go(summary: DataFrame, alerts: int, caught: int) -> DataFrame:
    """alert_summary() with go: more of its alerts are worth opening than of a baseline's, and no fewer are caught."""
    return summary.withColumn("go", (F.col("worth") > F.lit(caught / alerts)) & (F.col("caught") >= caught))


def percentiles(df: DataFrame, group: list[str], value: Column, shares: list[float]) -> DataFrame:
    """group, n (values that aren't null) and q: for each share the exact percentile, between neighbours by their distance, as
    percentile() gives it. Groups without a value have none.

    Values are counted, and the counts go by range partitions of group and value: each partition sums its own, the sums of
    partitions before it are added, and only the values at the wanted ranks go on. So no task holds all values of a
    group, nor all distinct ones. The order of partitions is written with them (as in steps).
    """
    key = F.to_json(F.struct(*[F.col(c) for c in group])) if group else F.lit("")
    counts = df.select(key.alias("_k"), *group, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy("_k", *group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    per = written(counts.repartitionByRange("_k", "_v").withColumn("_p", F.spark_partition_id()))
    ahead = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.groupBy("_k", "_p").agg(F.sum("_n").alias("_s"))
    before = sums.select("_k", "_p", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy("_k")).alias("n"))
    inside = Window.partitionBy("_k", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = per.join(before, ["_k", "_p"]).withColumn("_to", F.sum("_n").over(inside) + F.col("_b"))
    keys = ["_k", *group]
    at = F.array(*[F.lit(float(x)) for x in shares])
    rank = F.explode(F.transform(at, lambda x, i: F.struct(i.alias("i"), ((F.col("n") - 1) * x).alias("r"))))
    ends = placed.select(*keys, "_v", "n", "_n", "_to", rank.alias("_r")).select("*", (F.col("_to") - F.col("_n")).alias("_from"))
    holds = lambda r: (r >= F.col("_from")) & (r < F.col("_to"))
    low, high = F.floor("_r.r"), F.ceil("_r.r")
    near = ends.where(holds(low) | holds(high)).groupBy(*keys, "n", "_r").agg(F.max(F.when(holds(low), F.col("_v"))).alias("_l"), F.max(F.when(holds(high), F.col("_v"))).alias("_h"))
    mixed = F.when(low == high, F.col("_l")).otherwise((high - F.col("_r.r")) * F.col("_l") + (F.col("_r.r") - low) * F.col("_h"))
    out = near.select(*keys, "n", F.struct(F.col("_r.i").alias("i"), mixed.alias("v")).alias("_q")).groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list("_q")), lambda x: x["v"]).alias("q"))
    return out.select(*group, "n", "q")


def calibrate_fit(outcomes: DataFrame, fit: Column, least: int = 30, spread: float = 0.5) -> DataFrame:
    """For each model with enough real fits the 1st and 99th percentile, if they are far enough apart."""
    per = percentiles(outcomes, ["source_model"], fit, [0.01, 0.99]).where(F.col("n") >= least)
    return per.where(F.col("q")[1] - F.col("q")[0] >= spread).select("source_model", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"), "n")


def fit_temperature(df: DataFrame, logits: str = "logits", y: str = "y", rounds: int = 40) -> float:
    """The temperature of least cross-entropy, within 0.5 to 5, to 4 places.

    Newton on the inverse temperature, in which the loss is convex; each round is one aggregate of two sums. df should be
    cached or written by the caller.
    """
    x = F.transform(F.col(logits), lambda v: v.cast("double"))
    low, high, b = 0.2, 2.0, 1.0
    for _ in range(rounds):
        p = softmax(x, 1 / b)
        mean = F.aggregate(F.zip_with(p, x, lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v)
        square = F.aggregate(F.zip_with(p, x, lambda a, v: a * v * v), F.lit(0.0), lambda s, v: s + v)
        g, h = df.select((mean - F.element_at(x, F.col(y) + 1)).alias("g"), (square - mean * mean).alias("h")).agg(F.avg("g"), F.avg("h")).first()
        if not h or h <= 0:
            break
        new = min(high, max(low, b - g / h))
        if abs(math.log(new / b)) < 1e-7:
            b = new
            break
        b = new
    return round(1 / b, 4)


def evaluate_questions(select: DataFrame, calibrate: DataFrame, min_recall: float = 0.3) -> DataFrame:
    """One report row over labelled answers: temperatures fitted on calibrate, everything else measured on select.

    Rows have logits (role, deal, fit: arrays), role_true, deal_true (0 or 1), deal_known, score (1 to 10), y and label. The
    report has the temperatures, the average precision of both summaries of fit and the one chosen, its cut-offs for
    alerts and saved postings (floored to 4 places), what alerts are worth there with the range, counts, question_metrics()
    and the calibration error of the fit answer before and after. The driver holds a few numbers only.
    """
    c = F.col
    floored = lambda x: math.floor(round(x * 1e4, 6)) / 1e4
    select, calibrate = written(select), written(calibrate)
    index = {"role": F.array_position(F.array(*map(F.lit, STACK_ROLES)), c("role_true")) - 1, "deal": c("deal_true"), "fit": c("score") - 1}
    t = {q: fit_temperature(calibrate.where("deal_known" if q == "deal" else "true").select(c(q).alias("logits"), y.cast("int").alias("y"))) for q, y in index.items()}
    a = answers(c("role"), c("deal"), c("fit"), (t["role"], t["deal"], t["fit"]))
    rows = select.select("role_true", "deal_true", "deal_known", "score", "y", "label", c("fit").alias("_fit"), *[v.alias(k) for k, v in a.items()])
    rows = written(rows.select("*", gates_pass(c("role"), c("deal_p")).alias("gated"), *[summarise(c("fit_p"), k).alias(k) for k in ("expected", "p_good")]))
    best = choose_summary(rows).first()
    scored = rows.withColumn("s", c(best["chosen"]))
    cut = alert_cutoff(scored, min_recall)
    at = cut.first()["t"]
    save_at = save_cutoff(scored.where("gated"), at).first()["save_at"]
    top = lambda p: calibration_error(rows.select(p.alias("_p"), "score").select(F.array_max("_p").alias("conf"), (F.array_position("_p", F.array_max("_p")) == c("score")).alias("correct")))
    low, high = wilson(F.round(c("precision") * c("alerts")), c("alerts"))
    counts = rows.agg(F.count(F.lit(1)).alias("select_jobs"), F.count_if(c("y") == 1).alias("good_jobs"), F.count_if("gated").alias("gated_jobs"), F.coalesce(F.avg(F.when(c("gated"), c("y"))), F.lit(0.0)).alias("base_rate"))
    fixed = {f"t_{q}": v for q, v in t.items()} | {"summary": best["chosen"], "ap_expected": best["expected"], "ap_p_good": best["p_good"], "alert_at": floored(at), "save_at": floored(save_at)}
    report = cut.select("met", "precision", "recall", "alerts", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))
    for part in (counts, question_metrics(rows), top(softmax(c("_fit"))).withColumnRenamed("ece", "ece_before"), top(c("fit_p")).withColumnRenamed("ece", "ece_after")):
        report = report.join(part.drop("n"))  # one row each
    return report.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "*")


def report_warnings(report: DataFrame) -> DataFrame:
    """Messages on a report row (alerts, met, precision, base_rate, spread, least_spread, accuracy, majority)."""
    c = F.col
    said = F.array_compact(F.array(
        F.when(c("alerts") == 0, "nothing passes the gates"),
        F.when(~c("met"), "no cut-off catches enough"),
        F.when(c("precision") <= c("base_rate"), "alerts are no better than chance"),
        F.when(c("spread") < c("least_spread"), "scores are close together"),
        F.when(c("accuracy") - c("majority") < 0.05, "answers are no better than the usual one"),
    ))
    return report.withColumn("warnings", F.array_join(said, "; "))
