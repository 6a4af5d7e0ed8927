"""Filters by words, levels and model answers, their order, and which postings need a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import text, urls

#: The words of titles that name a level.
LEVELS = {
    "intern": ["intern", "internship", "co-op", "coop"],
    "entry": ["new grad", "new graduate", "entry level", "junior", "jr", "associate", "graduate", "engineer i", "developer i"],
    "mid": ["mid level", "intermediate", "engineer ii", "developer ii"],
    "senior": ["senior", "sr", "lead", "engineer iii", "developer iii"],
    "staff": ["staff", "principal", "distinguished", "architect", "fellow"],
}


def keyword_reason(df_title: Column, company: Column, description: Column, cfg: dict) -> Column:
    """F8: why a posting is skipped by its words, null if it isn't; the first rule that applies.
    cfg: companies, title and phrases (lists of terms), roles (name: terms and how many of them it takes)."""
    first = lambda words, terms, say: F.concat(F.lit(say), F.get(text.terms_in(words, terms), F.lit(0)))

    def reason(k: Column) -> Column:
        def group(name: str, terms: list[str], least: int) -> Column:
            return text.let(text.terms_in(k["x"], terms), lambda hits: F.when(F.size(hits) >= least, F.concat(F.lit(f"excluded role '{name}': "), F.array_join(hits, ", "))))

        groups = [group(name, terms, least) for name, (terms, least) in cfg["roles"].items()]
        return F.coalesce(first(k["c"], cfg["companies"], "excluded company: "), first(k["t"], cfg["title"], "excluded title word: "), first(k["x"], cfg["phrases"], "excluded phrase: "), *groups)

    words = F.struct(text.word_text(df_title).alias("t"), text.word_text(company).alias("c"), text.word_text(F.concat(df_title, F.lit(" "), description)).alias("x"))
    return text.let(words, reason)


def title_levels(title: Column) -> Column:
    """the levels that a title names, in order."""
    levels = lambda words: F.array_compact(F.array(*[F.when(F.size(text.terms_in(words, terms)) > 0, F.lit(level)) for level, terms in LEVELS.items()]))
    return text.let(text.word_text(title), levels)


def seniority_reason(title: Column, allowed: list[str]) -> Column:
    """skipped only if a level is named and none of those is allowed."""
    found = title_levels(title)
    return F.when((F.size(found) > 0) & ~F.arrays_overlap(found, F.array(*map(F.lit, allowed))), F.concat(F.lit("title level "), F.array_join(found, "/"), F.lit(f" not in {', '.join(sorted(allowed))}: "), title))


def apply_filters(reasons: dict[str, Column]) -> Column:
    """"name: reason" of the first filter with a reason, null to keep the row."""
    return F.coalesce(*[F.concat(F.lit(f"{name}: "), reason) for name, reason in reasons.items()])


#: The probability from which an answer counts, and the questions by which a requirement rules a posting out.
LIKELY = 0.5
REQUIREMENTS = {"citizenship": ("requires_citizenship", "requires citizenship"), "clearance": ("requires_clearance", "requires a security clearance")}
#: Hosts whose pages aren't read, with all below them, and the characters that a description needs.
UNREADABLE_HOSTS = ["indeed.com"]
LEAST_CHARS = 200


def model_check_verdict(postings: DataFrame, answers: DataFrame, ask_students: bool, skip_if: list[str] = ()) -> DataFrame:
    """postings (id) with reason, why a model's answers (id, question, p) rule a posting out, null if they don't.

    Questions in order: no software role, for students only (if asked), then the requirements of skip_if. A missing
    answer, or one without a probability, never rules out. Of repeated answers to a question the highest counts.
    """
    asked = ["software_role", *["students_only"] * ask_students, *[REQUIREMENTS[k][0] for k in skip_if]]
    p = answers.where(F.col("question").isin(asked)).groupBy("id").agg(*[F.max(F.when(F.col("question") == q, F.col("p"))).alias(f"_{q}") for q in asked])
    said = lambda why, q: F.format_string(f"{why} (model: %.2f)", F.col(f"_{q}"))
    reason = F.when(F.col("_software_role") < LIKELY, said("not a software engineering role", "software_role"))
    if ask_students:
        reason = reason.when(F.col("_students_only") >= LIKELY, said("only for current students", "students_only"))
    for k in skip_if:
        q, why = REQUIREMENTS[k]
        reason = reason.when(F.col(f"_{q}") >= LIKELY, said(why, q))
    return postings.join(p, "id", "left").select(*postings.columns, reason.alias("reason"))


def unreadable_host(url: Column) -> Column:
    """the host of UNREADABLE_HOSTS that an address is on, null if none."""
    name = F.trim(F.lower(urls.host(url)), F.lit("."))
    return F.coalesce(*[F.when((name == h) | name.endswith(f".{h}"), F.lit(h)) for h in UNREADABLE_HOSTS])


def needs_description(description: Column, is_snippet: Column) -> Column:
    """whether a posting's page has to be read: its text is a snippet, or short."""
    return F.coalesce(is_snippet, F.lit(False)) | (F.length(F.trim(F.coalesce(description, F.lit("")))) < LEAST_CHARS)
