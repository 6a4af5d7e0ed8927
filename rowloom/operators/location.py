"""Places in a location field, region codes, and the verdict on a posting's location."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.text import has_term, let, word_text

#: Places outside the built-in countries, spellings of codes, and cities that mean the country of Georgia.
OTHER_PLACES = ["france", "spain", "italy", "netherlands", "poland", "ireland", "singapore", "australia", "new zealand", "japan", "china", "hong kong", "mexico", "brazil", "emea", "europe", "apac", "latam", "international", "worldwide"]
CODE_ALIASES = {"UK": "GB"}
GEORGIA_CITIES = ["tbilisi", "batumi", "kutaisi"]

#: A country: its names, and the codes of its regions.
Countries = dict[str, dict[str, list[str]]]
#: The built-in countries, with the names, large cities and region codes by which postings mean them.
US_REGIONS = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware", "FL": "florida", "GA": "georgia", "HI": "hawaii",
    "ID": "idaho", "IL": "illinois", "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland", "MA": "massachusetts", "MI": "michigan",
    "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NY": "new york",
    "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island", "SC": "south carolina", "SD": "south dakota",
    "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming", "DC": "district of columbia",
}
US_CITIES = [
    "new york city", "nyc", "san francisco", "sf bay area", "bay area", "silicon valley", "los angeles", "seattle", "boston", "chicago", "austin", "denver", "atlanta", "san jose", "san diego",
    "palo alto", "mountain view", "menlo park", "sunnyvale", "santa clara", "redmond", "cambridge, ma", "pittsburgh", "philadelphia", "dallas", "houston", "miami", "portland", "salt lake city",
    "raleigh", "washington dc", "washington d.c.", "minneapolis", "detroit", "phoenix", "nashville", "cincinnati", "columbus",
]
BUILTIN: Countries = {
    "US": {"names": ["united states", "united states of america", "usa", "u.s.", "u.s.a.", "us", *US_REGIONS.values(), *US_CITIES], "region_codes": list(US_REGIONS)},
    "CA": {"names": ["canada", "toronto", "vancouver", "montreal", "montréal", "ottawa", "calgary", "edmonton", "waterloo", "mississauga"], "region_codes": ["AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT"]},
    "GB": {"names": ["united kingdom", "uk", "england", "scotland", "wales", "northern ireland", "great britain"], "region_codes": []},
    "IN": {"names": ["india", "bengaluru", "bangalore", "hyderabad", "chennai", "pune", "mumbai", "delhi", "new delhi", "gurgaon", "gurugram", "noida", "kolkata", "ahmedabad"], "region_codes": ["AP", "DL", "GJ", "HR", "KA", "KL", "MH", "RJ", "TG", "TN", "TS", "UP", "WB"]},
    "DE": {"names": ["germany", "deutschland", "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart", "düsseldorf", "dusseldorf", "muenchen"], "region_codes": ["BE", "BW", "BY", "HB", "HE", "HH", "NI", "NW", "RP", "SH", "SN", "TH"]},
}


def countries(allowed: list[str], own: Countries | None = None) -> tuple[Countries, Countries]:
    """the allowed countries and the other known ones, by code, of the built-in ones and the caller's own."""
    known = BUILTIN | (own or {})
    if missing := [c for c in allowed if c not in known]:
        raise ValueError(f"no names are known of {', '.join(missing)}")
    return {c: known[c] for c in allowed}, {c: v for c, v in known.items() if c not in allowed}


def _code(part: Column) -> Column:
    """A two-letter code in capitals, brackets taken off; null for anything else."""
    bare = F.trim(F.trim(part), F.lit("()"))
    return F.when(bare.rlike(r"^\p{Lu}{2}$"), bare)


def split_places(location: Column) -> Column:
    """the places that a location field lists, an array."""
    chunks = F.split(location, r";|\||\s/\s|\n")
    chunks = F.flatten(F.transform(chunks, lambda c: F.when(F.forall(F.split(c, "/"), lambda p: p.contains(",")), F.split(c, "/")).otherwise(F.array(c))))

    def regroup(c: Column) -> Column:
        parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
        n = F.size(parts)

        def every(k: int) -> Column:
            return F.forall(F.transform(parts, lambda p, i: (i % k == 0) | _code(p).isNotNull()), lambda ok: ok)

        group = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)), F.lit(k)), lambda i: F.array_join(F.slice(parts, i, F.lit(k)), ", "))
        return F.when((n >= 4) & (n % 2 == 0) & every(2), group(2)).when((n >= 6) & (n % 3 == 0) & every(3), group(3)).otherwise(F.array(c))

    places = F.flatten(F.transform(F.filter(F.transform(chunks, lambda c: F.trim(c)), lambda c: c != ""), regroup))
    return F.when(F.size(places) > 0, places).otherwise(F.array(location))


def region_codes(text: Column) -> Column:
    """codes after a comma, and before the first or after the last dash of a line."""
    first = lambda s: F.get(F.filter(F.split(s, r"\s+"), lambda x: x != ""), F.lit(0))
    segments = F.split(text, ",")
    after = F.transform(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: _code(F.trim(first(s), F.lit(".;:()"))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("-"))
    dashed = F.flatten(F.transform(lines, lambda x: F.array(_code(F.substring_index(x, "-", 1)), _code(F.substring_index(x, "-", -1)))))
    return F.array_distinct(F.array_compact(F.concat(after, dashed)))


def city_code_pairs(text: Column) -> Column:
    """codes in prose, only after a capitalised word and not before one."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![^\s])(\p{Lu}[^\s,]*)\s*,\s*(\p{Lu}{2})(?=[.;:)]+(?:\s|,|$)|\s*(?:,|$)|\s+[^\p{Lu}\s])"), F.lit(2))
    return F.array_distinct(found)


def _named(words: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | has_term(words, n)
    return out


def location_verdict(location: Column, title: Column, description: Column, allowed: Countries, others: Countries) -> Column:
    """why a posting's location rules it out, null if it is kept. allowed and others are countries with their names
    and region codes; others are those known and not allowed."""
    strip = lambda s: F.trim(F.coalesce(s, F.lit("")))
    location = strip(location)
    all_names = [n for c in allowed.values() for n in c["names"]]
    long_names = [n for n in all_names if len(n.replace(".", "")) > 2]
    codes = [r for c in allowed.values() for r in c["region_codes"]]
    other_codes = [r for c in others.values() for r in c["region_codes"]]
    elsewhere = [p for p in OTHER_PLACES if p not in all_names] + [n for c in others.values() for n in c["names"]]
    overlap = lambda found, some: F.arrays_overlap(found, F.array(*map(F.lit, some))) if some else F.lit(False)
    opening = word_text(F.concat(title, F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, 1200)))

    def place(p: Column) -> Column:
        """keep, out, unknown or none."""
        words = word_text(p)
        parts = F.filter(F.transform(F.split(p, ","), lambda x: F.trim(x)), lambda x: x != "")
        last = _code(F.try_element_at(parts, F.lit(-1)))
        code = F.coalesce(*[F.when(last == a, F.lit(b)) for a, b in CODE_ALIASES.items()], last)
        before = F.try_element_at(parts, F.lit(-2))
        coded = (F.size(parts) >= 3) & code.isNotNull()
        in_region = F.upper(before).isin(codes) | _named(word_text(before), long_names)
        city = F.coalesce(F.nullif(F.regexp_extract(p, r"^([^,/(]+),\s*[.,;:()/]*\p{L}{2}(?:[.,;:()/\s]|$)", 1), F.lit("")), F.regexp_extract(p, r"^\s*\p{L}{2}\s*-\s*([^,/(]+)", 1))
        beside = F.upper(F.coalesce(F.nullif(F.regexp_extract(p, r"^[^,/(]+,\s*[.,;:()/]*(\p{L}{2})(?:[.,;:()/\s]|$)", 1), F.lit("")), F.regexp_extract(p, r"^\s*(\p{L}{2})\s*-", 1)))
        shared = F.lit(False)
        for name, c in others.items():
            shared = shared | (beside.isin(name, *c["region_codes"]) & _named(word_text(city), c["names"]))
        shared = shared & beside.isin(codes)
        georgia = has_term(words, "georgia") & _named(words, GEORGIA_CITIES) & ~_named(words, [n for n in all_names if n != "georgia"])
        found = region_codes(p)
        remote = has_term(words, "remote") | has_term(words, "anywhere")
        return (
            F.when(coded & code.isin(list(allowed)), "keep")
            .when(coded & code.isin(list(others)) & ~in_region, "out")
            .when(shared | (georgia if "GE" not in allowed else F.lit(False)), "out")
            .when(_named(words, all_names) | overlap(found, codes), "keep")
            .when(_named(words, elsewhere) | overlap(found, other_codes), "out")
            .when(remote & _named(opening, long_names), "keep")
            .when(remote, "remote")
            .when(p.contains(","), "unknown")
            .otherwise("none")
        )

    def in_text(t: Column) -> Column:
        words = word_text(t)
        return F.when(_named(words, long_names) | overlap(city_code_pairs(t), codes), "keep").when(_named(words, elsewhere), "out")

    body = F.substring(F.coalesce(description, F.lit("")), 1, 2000)
    told = F.struct(in_text(F.coalesce(title, F.lit(""))).alias("title"), in_text(body).alias("body"))
    outside = F.concat(F.lit("location outside allowed countries: "), location)
    named = lambda t: F.concat(F.lit("location outside allowed countries: "), F.coalesce(F.nullif(location, F.lit("")), F.lit("none given")), F.lit(" ("), F.left(t, F.lit(60)), F.lit(")"))
    by_text = let(
        told,
        lambda k: F.when(k["title"] == "keep", None)
        .when(k["title"] == "out", named(F.coalesce(title, F.lit(""))))
        .when(k["body"] == "keep", None)
        .when(k["body"] == "out", named(body))
        .when(location == "", "no location given, and no place named in the title or description")
        .otherwise(F.concat(F.lit("no place named in the location ("), location, F.lit("), title or description"))),
    )

    def judge(verdicts: Column) -> Column:
        has = lambda v: F.array_contains(verdicts, v)
        return (
            F.when(has("keep"), None)
            .when(F.forall(verdicts, lambda v: v == "none"), by_text)
            .when((F.size(verdicts) == 1) & has("remote"), F.concat(F.lit("remote role without an allowed country named: "), location))
            .when(has("unknown"), F.concat(F.lit("location not recognised: "), location))
            .otherwise(outside)
        )

    return F.when(location == "", by_text).otherwise(let(F.transform(split_places(location), place), judge))
