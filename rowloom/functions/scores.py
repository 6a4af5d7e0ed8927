"""Scores, labels and model answers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stack roles in model order, and the roles and cut that a posting has to pass.
STACK_ROLES = ["backend", "frontend", "fullstack", "ai", "data", "infra", "other"]
GATE_ROLES, GATE_DEALBREAKER = ["backend", "fullstack", "ai", "data"], 0.5


def decide(score: Column, notify_at: float, log_at: float, confidence: Column | None = None, least: float | None = None) -> Column:
    """Notify, log or skip; with a least confidence, one step down for surer answers wanted than given."""
    out = F.when(score >= notify_at, "notify").when(score >= log_at, "log").otherwise("skip")
    if confidence is None or least is None:
        return out
    return F.when(F.coalesce(confidence < least, F.lit(False)) & (out == "notify"), "log").otherwise(out)


def floor2(x: Column) -> Column:
    """X4"""
    return F.floor(x * 100 + 1e-9) / 100


def floor4(x: Column) -> Column:
    """X4"""
    return F.floor(F.round(x * 1e4, 6)) / 1e4


def scaled(raw: Column, low: Column, high: Column) -> Column:
    """0 to 10 between the bounds; null without bounds."""
    return F.when(low.isNotNull() & high.isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(0.0), (raw - low) / (high - low) * 10)))


def is_expected_label(label: Column) -> Column:
    """F18"""
    return F.coalesce(label, F.lit("")).rlike(r"^fit [0-9]+(?:\.[0-9]+)?/10$")


def fit_of(score: Column, label: Column, model: Column, prefix: str = "local") -> Column:
    """the score, unless it is the local model's placeholder: a whole number without a label."""
    holder = F.coalesce(model, F.lit("")).startswith(prefix) & (F.coalesce(label, F.lit("")) == "") & (score == F.floor(score))
    return F.when(~holder, score)


def score_label(score: Column, probability: Column, label: Column, model: Column, low: Column, high: Column) -> Column:
    """How a result reads in alerts."""
    show = lambda s: F.format_string("fit %.1f/10 (raw %.2f)", scaled(s, low, high), floor2(s))
    some, bounds, fit = F.coalesce(label, F.lit("")) != "", low.isNotNull(), fit_of(score, label, model)
    return (
        F.when(some & bounds & score.isNotNull() & is_expected_label(label), show(score))
        .when(some, label)
        .when(score.isNull() & probability.isNull(), "n/a")
        .when(score.isNull(), F.format_string("fit %.0f%%", probability * 100))
        .when(bounds & fit.isNotNull(), show(fit))
        .otherwise(F.concat(F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string")), F.lit("/10")))
    )


def fit_fields(score: Column, label: Column, model: Column, low: Column, high: Column) -> Column:
    """Struct of text, raw, score and scaled for a stored outcome."""
    fit = fit_of(score, label, model)
    up = F.when(is_expected_label(label) | (F.coalesce(label, F.lit("")) == ""), scaled(fit, low, high))
    return F.struct(F.coalesce(F.nullif(label, F.lit("")), F.format_string("%s/10", score)).alias("text"), floor2(fit).alias("raw"), fit.alias("score"), up.alias("scaled"))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """X6"""
    t = F.lit(temperature) if isinstance(temperature, int | float) else temperature
    top = F.array_max(logits)
    odds = F.transform(logits, lambda x: F.exp((x - top) / t))
    total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
    return F.transform(odds, lambda x: x / total)


def summarise(p: Column, kind: str) -> Column:
    """Expected score 1 to 10, or the probability of 7 to 10."""
    if kind == "expected":
        return F.lit(1.0) + F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.slice(p, 7, 4), F.lit(0.0), lambda s, x: s + x)


def top_index(p: Column) -> Column:
    """The first of the largest, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def answers(role: Column, deal: Column, fit: Column, temperatures: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> dict[str, Column]:
    """Role, probability of a dealbreaker, and fit distribution of logits."""
    roles = F.array(*[F.lit(r) for r in STACK_ROLES])
    return {"role": F.element_at(roles, top_index(softmax(role, temperatures[0])) + 1), "deal_p": F.element_at(softmax(deal, temperatures[1]), 2), "fit_p": softmax(fit, temperatures[2])}


def gates_pass(role: Column, deal_p: Column) -> Column:
    """F17"""
    return role.isin(GATE_ROLES) & (deal_p < GATE_DEALBREAKER)


def failed_gates(role: Column, deal_p: Column) -> Column:
    """why, empty if both pass."""
    return F.concat_ws(", ", F.when(~role.isin(GATE_ROLES), F.concat(F.lit("stack role "), role)), F.when(deal_p >= GATE_DEALBREAKER, F.format_string("likely dealbreaker (%.0f%%)", deal_p * 100)))


def decide_gated(gated: Column, s: Column, alert_at: float, save_at: float) -> Column:
    """X9"""
    return F.when(gated & (s >= alert_at), "notify").when(gated & (s >= save_at), "log").otherwise("skip")


def decide_alert(p: Column, alert_at: float, save_at: float) -> Column:
    """X10"""
    return F.when(p >= alert_at, "notify").when(p >= save_at, "log").otherwise("skip")


def decision_score(decision: Column) -> Column:
    """The whole number that stands for a decision."""
    return F.when(decision == "notify", 8).when(decision == "log", 6).when(decision == "skip", 3)


def smoothed_target(index: Column, k: int, sigma: float) -> Column:
    """X11: k probabilities that fall off from index as a bell curve."""
    w = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.exp(-F.pow(i - index, F.lit(2.0)) / (2 * sigma * sigma)))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    return F.transform(w, lambda x: x / total)


def one_hot(index: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == index).cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The range of a share k of n; (0, 0) when n is 0."""
    p = F.try_divide(k, n)
    d, c = 1 + F.try_divide(F.lit(z * z), n), p + F.try_divide(F.lit(z * z / 2), n)
    r = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    return F.coalesce((c - r) / d, F.lit(0.0)), F.coalesce((c + r) / d, F.lit(0.0))


def role_target(value: Column) -> Column:
    """X13"""
    role = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(role.isin(STACK_ROLES), role).otherwise("other")


def band_score(p: Column, notify_at: int, log_at: int) -> Column:
    """The likeliest score in the heaviest of the bands notify, log and skip; the first wins ties."""
    def band(low: int, high: int) -> Column:
        part = F.slice(p, low, max(0, high - low))
        return F.struct(F.aggregate(part, F.lit(0.0), lambda s, x: s + x).alias("sum"), (F.array_position(part, F.array_max(part)) + low - 1).cast("int").alias("score"))

    bands = [band(a, b) for a, b in ((notify_at, 11), (log_at, notify_at), (1, log_at)) if b > a]
    best = bands[0]
    for b in bands[1:]:
        best = F.when(b["sum"] > best["sum"], b).otherwise(best)
    return best["score"]


#: The first rule that a part of the text matches names its category; whether that is a dealbreaker.
DEALBREAKER_RULES = [
    ("clearance", True, r"clearance|\bsecret\b|polygraph|ts/sci"),
    ("citizenship", True, r"citizen|\bus person\b|green card"),
    ("seniority", True, r"\b(?:senior|staff|principal|lead|seniority)\b"),
    ("role_family", True, r"embedded|firmware|hardware|front-?end|mobile-only|\betl\b|\bbi\b|role family"),
    ("years", False, r"\byears?\b|\byrs\b|\d\s*\+"),
    (
        "location",
        False,
        r"outside|us-only|location|onsite in|relocation|\b(?:canada|mexico|india|china|uk|united kingdom|germany|france|ireland|poland|brazil|philippines|singapore|japan|israel|australia)\b",
    ),
]


def dealbreaker(text: Column) -> Column:
    """Struct of category and target of a labeller's text; a text is a dealbreaker when any part of it is."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ";"), lambda x: F.trim(x)), lambda x: x != "")

    def rule(p: Column) -> Column:
        made = lambda name, target: F.struct(F.lit(name).alias("category"), F.lit(target).alias("target"))
        out = F
        for name, target, pattern in DEALBREAKER_RULES:
            out = out.when(p.rlike(pattern), made(name, target))
        return out.otherwise(made("other", True))

    mapped = F.transform(parts, rule)
    none = F.struct(F.lit("none").alias("category"), F.lit(False).alias("target"))
    return F.coalesce(F.get(F.filter(mapped, lambda m: m["target"]), F.lit(0)), F.get(mapped, F.lit(0)), none)


def fit_band(score: Column) -> Column:
    """A5"""
    return F.when(score < 5, "<5").when(score < 7, "5–7").when(score >= 7, "≥7")


def iso_week(day: Column) -> Column:
    """A5: YYYY-Www."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def is_quiet(ts: Column, zone: str, start: str, end: str) -> Column:
    """Whether a time lies in a daily window of a zone, which may pass midnight."""
    minute = lambda s: int(s[:2]) * 60 + int(s[3:])
    local = F.from_utc_timestamp(ts, zone)
    now, a, b = F.hour(local) * 60 + F.minute(local), minute(start), minute(end)
    return (now >= a) & (now < b) if a <= b else (now >= a) | (now < b)
