"""the years of experience that a posting requires, by expressions over its sentences.

A sentence is brought into one form, its words, numbers and signs in lower case with a space between and at both ends;
so each rule is a pattern over the text before or after a number of years. Sections (optional qualifications,
requirements, others) are those of the last heading before a sentence.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.text import let

#: Numbers in words, and the words by which years are told to be required, optional, or something else.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20}
YEARS = "years|year|yrs|yr"
EXPERIENCE = [
    "experience", "experienced", "professional", "hands", "industry", "work", "working", "developing", "development", "building",
    "designing", "engineering", "programming", "coding", "exp", "software",
]
LEADS = ["minimum", "min", "least", "requires", "required", "require", "need", "needs", "must"]
COMPANY = [
    "we", "we're", "we've", "we'd", "we'll", "our", "us", "founded", "since", "celebrated", "established", "history", "legacy", "helping",
    "serving",
]
COMPANY_NOUNS = ["our", "company", "firm", "team", "organization", "organisation", "agency", "business"]
CANDIDATE = [
    "you", "your", "you'll", "you've", "candidate", "candidates", "required", "requires", "require", "requirement", "requirements",
    "qualification", "qualifications", "minimum", "must", "least", "looking", "seeking", "ideal", "need", "needs", "targeting", "hiring",
    "engineer", "developer",
]
OPTIONAL_AFTER = ["preferred", "plus", "bonus", "desired", "desirable"]
OPTIONAL_BEFORE = ["preferred", "bonus", "desired", "desirable", "preferably", "ideally", "nice", "typically"]
OPTIONAL_HEADING = ["preferred", "bonus", "desired", "desirable", "plus", "typical"]
HEADING = ["qualifications", "requirements", "required", "basic", "minimum", "preferred", "bonus", "nice", "desired", "responsibilities", "benefits"]
DEGREES = ["degree", "bachelor", "bachelor's", "bachelors", "associate", "associate's", "diploma"]
BOTH = ["with", "and", "plus"]
NOT_EXPERIENCE = ["old", "older", "age", "ago", "vest", "vests", "vesting", "warranty", "contract", "term"]
REQUIRED_AFTER = ["required", "minimum", "mandatory", "must"]
REQUIRED_HEADING = ["qualifications", "requirements", "requirement", "required", "minimum", "basic", "skills", "experience", "need", "bring", "must"]
SKILL_LEADS = ["minimum", "min", "at", "least", "requires", "required", "require", "need", "needs", "must", "have", "a", "of"]
OPTIONAL_LINE = ["preferred", "preferably", "ideally", "bonus", "desired", "desirable", "a plus", "nice to have"]
OTHER_SECTIONS = ["benefits", "perks", "why", "about", "compensation", "culture", "what's", "whats", "our"]
NOT_NAMES = ["inc", "llc", "ltd", "the", "corp"]
MAX_YEARS, MAX_HEADING, MAX_LABEL = 20, 8, 5

_TOKEN = r"[0-9](?:[0-9]|\.(?=[0-9]))*|[a-z]+(?:'[a-z]+)*|\S"
_NUM = r"(?:[0-9]+(?:\.[0-9]+)?|" + "|".join(NUMBERS) + r")(?= )"
#: A number or range of years; a range may have lost its dash.
MENTION = rf"(?<= )({_NUM})(?: ({_NUM})(?= (?:\+|{YEARS}) ))?(?:(?: (?:to|and|[^a-z0-9 ]+)){{1,3}}? {_NUM})?(?: [+)])* (?:{YEARS})(?= )"
_LABEL = rf"(?<= )(?:{YEARS})(?: (?!experience )\S+){{0,3}} experience [:\-] ({_NUM})"
_LINE_HEADING = r"^ ((?:[a-z']+ ){1,5})[:\-–—] "
#: What lines have that _kind() may name: a colon or bracket at the end, capitals alone, or a first word of these (k may be the
#: Kelvin sign, which is k in lower case).
_SHAPED = r"[:)] *$|^[^\p{Ll}\p{Lo}\p{Lt}\p{Lm}]*?\p{Lu}[^\p{Ll}\p{Lo}\p{Lt}\p{Lm}]*+$|(?i)^\P{L}*+(?:" + "|".join([*HEADING, *(w.split("'")[0] for w in OTHER_SECTIONS), "who", "or"]).replace("k", r"[kK]") + ")"
REJECTED, WEAK, REQUIRED = 0, 1, 2


def _has(text: Column, words: list[str]) -> Column:
    """Whether any of the words (or runs of them) stands in a text of tokens with spaces at both ends."""
    return text.rlike(" (?:" + "|".join(map(re.escape, words)) + ")(?= )")


def _tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.translate(text, "’", "'")), F.lit(_TOKEN), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def _last(text: Column, n: int) -> Column:
    return F.concat(F.lit(" "), F.regexp_extract(text, rf"((?:\S+ ){{0,{n}}})$", 1))


def _first(text: Column, n: int) -> Column:
    return F.concat(F.lit(" "), F.regexp_extract(text, rf"^ ((?:\S+ ){{0,{n}}})", 1))


def _number(token: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.coalesce(F.regexp_extract(token, "^([0-9]{1,9})(?:[.]|$)", 1).try_cast("int"), F.element_at(words, token))


def _verdict(m: Column, line: Column, names: Column, listed: Column) -> Column:
    """REJECTED, WEAK (counts only beside a requirement) or REQUIRED for a mention with what stands before and after."""
    parts = {"near": _last(m["before"], 4), "clause_before": F.regexp_extract(m["before"], "([^,;:()]*)$", 1), "clause_after": F.regexp_extract(m["after"], "^([^,;:()]*)", 1)}
    return let(F.struct(*[c.alias(n) for n, c in parts.items()]), lambda p: _judged(m, p, line, names, listed))


def _judged(m: Column, p: Column, line: Column, names: Column, listed: Column) -> Column:
    before, after, near, clause_before, clause_after = m["before"], m["after"], p["near"], p["clause_before"], p["clause_after"]
    next3 = _first(after, 3)
    typically = near.rlike(" typically ") & ~_has(near, [w for w in OPTIONAL_BEFORE if w != "typically"]) & _has(near, LEADS)
    last_or = F.regexp_extract(before, "^.* (equivalent|if|lieu|or)(?= )", 1)
    between = F.regexp_extract(before, "^.* (?:equivalent|if|lieu|or)( .*)$", 1)
    stands_in = (last_or != "") & ~_has(between, BOTH) & F.when(last_or == "or", between.rlike(r"^ (?:[^ ,;]+ ){0,3}$")).otherwise(True)
    clause = F.concat(clause_before, m["text"], clause_after, F.lit(" "))
    company = _has(line, COMPANY) | _has(F.concat(F.lit(" "), clause_before), COMPANY_NOUNS)
    rejected = [
        m["low"] > MAX_YEARS,
        _has(next3, NOT_EXPERIENCE),
        after.rlike("^ in a row "),
        after.rlike("^ in (?:business|operation|existence) (?![a-z]+ )"),
        _has(near, OPTIONAL_BEFORE) & ~typically,
        _has(F.concat(clause_after, F.lit(" ")), OPTIONAL_AFTER),
        _has(before, DEGREES) & stands_in,
        _has(near, COMPANY_NOUNS) | F.arrays_overlap(F.split(near, " "), names),
        company & ~_has(F.concat(F.lit(" "), clause), CANDIDATE),
    ]
    around = _last(before, 6)
    own = F.when(line.rlike(_LINE_HEADING) & before.rlike(r"[:\-–—]"), F.regexp_replace(before, r"^[^:\-–—]*[:\-–—]", "")).otherwise(before)
    opens = F.regexp_extract(own, "([^,;:()]*)$", 1).rlike(r"^(?: |[^a-z0-9 ]+ |(?:" + "|".join(SKILL_LEADS) + r")(?= ))*$")
    skill = after.rlike("^ (?:with [a-z]+|in [a-z]+|of (?!(?:a|an|the) )[a-z]+) ") & opens & ~_has(line, OPTIONAL_LINE)
    required = [
        _has(around, EXPERIENCE + LEADS),
        _has(_first(after, 16), EXPERIENCE),
        _has(_first(after, 2), REQUIRED_AFTER),
        skill & (m["text"].contains(" + ") | listed),
    ]
    return F.when(reduce(or_, rejected), REJECTED).when(reduce(or_, required), REQUIRED).otherwise(WEAK)


def _found(line: Column, names: Column, listed: Column) -> Column:
    """The years that a line asks for: of mentions joined by "or" the least, if any of them is required."""
    pieces, texts = F.split(line, MENTION), F.regexp_extract_all(line, F.lit(MENTION), F.lit(0))

    def mention(both: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.zip_with(F.slice(both["pieces"], F.lit(1), i), F.slice(both["texts"], F.lit(1), i), lambda p, t: F.concat(p, t)), ""), F.get(both["pieces"], i))
        text = F.get(both["texts"], i)
        one, two = _number(F.regexp_extract(text, rf"^({_NUM})".replace("(?= )", ""), 1)), _number(F.regexp_extract(F.concat(F.lit(" "), text, F.lit(" ")), MENTION, 2))
        return F.struct(before.alias("before"), text.alias("text"), F.substring(line, F.length(before) + F.length(text) + 1, F.length(line)).alias("after"), F.when(two <= one, two).otherwise(one).alias("low"), F.get(both["pieces"], i).rlike(" or ").alias("or"))

    def judged(both: Column) -> Column:
        found = F.transform(both["texts"], lambda _, i: mention(both, i))
        return F.transform(found, lambda m: F.struct(m["low"].alias("low"), _verdict(m, line, names, listed).alias("v"), m["or"].alias("or")))

    labels = F.filter(F.transform(F.regexp_extract_all(line, F.lit(_LABEL), F.lit(1)), _number), lambda n: n <= MAX_YEARS)
    none = F.lit(None).cast("int")
    start = F.struct(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))).alias("out"), F.try_element_at(labels, F.lit(-1)).alias("low"), F.lit(True).alias("req"), F.lit(False).alias("or"))

    def step(s: Column, m: Column) -> Column:
        joined = (s["or"] | m["or"]) & s["low"].isNotNull()
        out = F.when(~joined & s["req"] & s["low"].isNotNull(), F.concat(s["out"], F.array(s["low"]))).otherwise(s["out"])
        taken = F.struct(out.alias("out"), F.when(joined, F.least(s["low"], m["low"])).otherwise(m["low"]).alias("low"), ((m["v"] == REQUIRED) | joined & s["req"]).alias("req"), F.lit(False).alias("or"))
        passed = F.struct(s["out"].alias("out"), s["low"].alias("low"), s["req"].alias("req"), (s["or"] | m["or"]).alias("or"))
        return F.when(m["v"] == REJECTED, passed).otherwise(taken)

    end = lambda s: F.when(s["req"] & s["low"].isNotNull(), F.concat(s["out"], F.array(s["low"]))).otherwise(s["out"])
    groups = let(F.struct(pieces.alias("pieces"), texts.alias("texts")), lambda both: F.aggregate(judged(both), start, step, end))
    return F.when(line.rlike(rf" (?:{YEARS}) "), groups).otherwise(F.array(none).cast("array<int>"))


def _kind(raw: Column, line: Column) -> Column:
    """or, other, optional, required or heading for a line that isn't text; null for one that is."""
    words = F.regexp_extract_all(line, F.lit(r"(?<= )(?:[a-z']+|\p{L})(?= )"), F.lit(0))

    def kind(w: Column) -> Column:
        n, digits = F.size(w), line.rlike("(?<= )[0-9]")
        first, second = F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
        other = (n > 0) & (n <= MAX_LABEL) & ~digits & ((F.array_join(F.slice(w, 1, 3), " ") == "who we are") | first.isin(OTHER_SECTIONS) & (second != "you") & ((n > 1) | (first != "our")))
        bare = F.trim(F.regexp_replace(F.trim(raw), "^[-*• ]+", ""))
        capitals = bare.rlike(r"\p{L}") & ~bare.rlike(r"\p{Ll}|\p{Lo}|\p{Lt}|\p{Lm}")
        shaped = bare.endswith(":") | capitals | first.isin(HEADING) & (n <= MAX_LABEL) | bare.endswith(")") & (n <= 3) & F.element_at(w, -1).isin(HEADING)
        optional = _has(line, OPTIONAL_HEADING) | _has(line, ["nice"]) & _has(line, ["have"])
        heading = F.when(optional, "optional").when(_has(line, REQUIRED_HEADING), "required").otherwise("heading")
        return F.when((n == 1) & (first == "or"), "or").when(other, "other").when((n > 0) & (n <= MAX_HEADING) & ~digits & shaped, heading)

    return let(words, kind)


def required_years(text: Column, company: Column) -> Column:
    """the years of experience that a posting requires, null if it states none. Of alternatives the least counts, of
    requirements the most; years of the company, of age, and optional ones don't."""
    text = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(text, r"(?i)<\s*(?:br|/?p|/?li|/?ul|/?ol|/?div|/?h[1-6]|/?tr)\b[^>]*>", "\n")
    bare = F.regexp_replace(bare, "<[a-zA-Z/!][^>]*>", " ")
    decoded = bare = F.when(text.contains("<"), bare).otherwise(text)
    for code, char in {"&nbsp;": " ", "&#160;": " ", "&#39;": "'", "&rsquo;": "'", "&quot;": '"', "&ndash;": "–", "&lt;": "<", "&gt;": ">", "&amp;": "&"}.items():
        decoded = F.replace(decoded, F.lit(code), F.lit(char))
    plain = F.replace(F.when(text.contains("&"), decoded).otherwise(bare), F.lit("\xa0"), F.lit(" "))
    names = F.filter(F.split(_tokens(F.coalesce(company, F.lit(""))), " "), lambda t: t.rlike("^[a-z]{3,}$") & ~t.isin(NOT_NAMES))

    def marked(r: Column) -> Column:
        return let(_tokens(r), lambda t: F.struct(t.alias("line"), _kind(r, t).alias("kind"), F.ltrim(r).rlike("^[-*–•]").alias("bullet")))

    none = F.lit(None).cast("int")
    start = F.struct(F.lit("").alias("section"), none.alias("best"), none.alias("last"), F.lit(False).alias("or"))

    def taken(s: Column, found: Column) -> Column:
        joined = F.struct(s["section"].alias("section"), s["best"].alias("best"), F.least(s["last"], F.array_min(found)).alias("last"), F.lit(False).alias("or"))
        best = F.greatest(s["best"], s["last"], F.array_max(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))))
        more = F.struct(s["section"].alias("section"), best.alias("best"), F.try_element_at(found, F.lit(-1)).alias("last"), F.lit(False).alias("or"))
        return F.when(F.size(found) == 0, s).when(s["or"] & s["last"].isNotNull(), joined).otherwise(more)

    def years(both: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            section = s["section"]
            inline = x["line"].rlike(_LINE_HEADING) & _has(F.regexp_extract(x["line"], _LINE_HEADING, 0), REQUIRED_HEADING) & ~_has(F.regexp_extract(x["line"], _LINE_HEADING, 0), OPTIONAL_HEADING)
            listed = (section == "required") | inline | x["bullet"] & ~section.isin("other", "heading")
            waits = F.struct(section.alias("section"), s["best"].alias("best"), s["last"].alias("last"), F.lit(True).alias("or"))
            headed = F.struct(x["kind"].alias("section"), s["best"].alias("best"), s["last"].alias("last"), s["or"].alias("or"))
            asks = x["kind"].isNull() & x["line"].rlike(rf" (?:{YEARS}) ") & (section != "optional")
            return F.when(x["kind"] == "or", waits).when(x["kind"].isNotNull(), headed).when(asks, let(_found(x["line"], both["names"], listed), lambda found: taken(s, found))).otherwise(s)

        return F.aggregate(F.transform(both["raws"], marked), start, step, lambda s: F.greatest(s["best"], s["last"]))

    def asked(plain: Column) -> Column:
        # other lines are no headings and ask for nothing
        raws = F.filter(F.split(plain, r"(?=[\n!?;.•])(?:[\n!?;]|\.(?=\s|$)|(?=•))"), lambda r: r.rlike("(?i)y(?:ea)?r") | r.rlike(_SHAPED))
        # a posting without a word for years needs no closer look
        return F.when(plain.rlike(rf"(?i)(?=y)\b(?:{YEARS})\b"), let(F.struct(raws.alias("raws"), names.alias("names")), years))

    return let(plain, asked)


def years_reason(title: Column, description: Column, company: Column, most: int) -> Column:
    """why a posting is skipped by the years it requires, null if it isn't."""
    years = required_years(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))), company)
    return let(years, lambda y: F.when(y > most, F.concat(F.lit("requires "), y.cast("string"), F.lit(f"+ years (max {most})"))))
