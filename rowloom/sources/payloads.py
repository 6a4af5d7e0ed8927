"""Landed answers of job sites to posting rows. Each takes a DataFrame with a column raw (JSON text) and, where
the site needs it, slug; unreadable rows come out with a null id, which collect_postings() counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.text import html_to_text, is_fresh, posted_iso
from rowloom.functions.urls import safe_url, without_tracking

COLUMNS = ["id", "title", "company", "location", "url", "description", "posted_at", "source", "ats", "description_is_snippet", "extra"]


def _text(path: Column) -> Column:
    return F.coalesce(path, F.lit(""))


def _first(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def stripped(text: Column) -> Column:
    """text without white space at its ends, as the SQL twins strip it."""
    return F.regexp_replace(text, r"\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")


def _posting(df: DataFrame, source: str, ats: str, snippet: bool = False, **columns: Column) -> DataFrame:
    fixed = {"source": F.lit(source), "ats": F.lit(ats), "description_is_snippet": F.lit(snippet), "extra": F.create_map().cast("map<string,string>"), "posted_at": F.lit(""), "location": F.lit("")}
    return df.select(*[(fixed | columns)[c].alias(c) for c in COLUMNS])


def _parsed(raw: DataFrame, schema: str, also: tuple[str, ...] = ()) -> DataFrame:
    return raw.select(F.from_json("raw", schema).alias("r"), *also)


def from_greenhouse(raw: DataFrame) -> DataFrame:
    """S1"""
    r = _parsed(raw, "id string, title string, company_name string, location struct<name:string>, absolute_url string, content string, first_published string, created_at string, posted_at string, updated_at string", ("slug",))
    once = _text(F.col("r.content"))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        once = F.replace(once, F.lit(a), F.lit(b))
    twice = F.replace(F.replace(once, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    content = F.when(~once.rlike("<[a-zA-Z/!]") & once.contains("&lt;"), twice).otherwise(once)
    return _posting(
        r, "greenhouse", "greenhouse",
        id=F.concat(F.lit("greenhouse_"), F.col("r.id")), title=_text(F.col("r.title")), company=_first(F.col("r.company_name"), F.col("slug")), location=_text(F.col("r.location.name")),
        url=_text(F.col("r.absolute_url")), description=html_to_text(content), posted_at=_first(F.col("r.first_published"), F.col("r.created_at"), F.col("r.posted_at"), F.col("r.updated_at")),
    )


def from_lever(raw: DataFrame) -> DataFrame:
    """S2"""
    r = _parsed(raw, "id string, text string, categories struct<location:string>, hostedUrl string, createdAt string, description string, descriptionPlain string, lists array<struct<text:string,content:string>>, additionalPlain string", ("slug",))
    intro = _first(F.col("r.descriptionPlain"), html_to_text(F.col("r.description")))
    lists = F.transform(F.coalesce("r.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda s: F.concat(_text(s["text"]), F.lit("\n"), _markup(s["content"])))
    parts = F.filter(F.transform(F.concat(F.array(intro), lists, F.array(_text(F.col("r.additionalPlain")))), stripped), lambda x: x != "")
    return _posting(
        r, "lever", "lever",
        id=F.concat(F.lit("lever_"), F.col("r.id")), title=_text(F.col("r.text")), company=F.col("slug"), location=_text(F.col("r.categories.location")), url=_text(F.col("r.hostedUrl")),
        description=F.array_join(parts, "\n\n"), posted_at=posted_iso(F.col("r.createdAt")),
    )


def _markup(markup: Column) -> Column:
    """html_to_text() inside arrays, where no Python function can run: the five references of XML are decoded."""
    text = F.regexp_replace(_text(markup), r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|tr|table|h[1-6])\s*>", "\n")
    text = F.regexp_replace(text, "(?s)<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != ""), "\n")


def from_ashby(raw: DataFrame) -> DataFrame:
    """S3: both shapes of an answer."""
    r = _parsed(raw, "id string, title string, location string, locationName string, jobUrl string, publishedAt string, publishedDate string, descriptionHtml string, descriptionPlain string", ("slug",))
    return _posting(
        r, "ashby", "ashby",
        id=F.concat(F.lit("ashby_"), F.col("r.id")), title=_text(F.col("r.title")), company=F.col("slug"), location=_first(F.col("r.location"), F.col("r.locationName")),
        url=_first(F.col("r.jobUrl"), F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("slug"), F.lit("/"), F.col("r.id"))), posted_at=_first(F.col("r.publishedAt"), F.col("r.publishedDate")),
        description=_first(html_to_text(F.col("r.descriptionHtml")), F.col("r.descriptionPlain")),
    )


def from_dice(raw: DataFrame) -> DataFrame:
    """S4"""
    r = _parsed(raw, "id string, guid string, detailsPageUrl string, title string, companyName string, jobLocation struct<displayName:string>, isRemote boolean, workplaceTypes array<string>, postedDate string, summary string, employmentType string, salary string")
    remote = F.coalesce(F.col("r.isRemote"), F.lit(False)) | F.coalesce(F.array_contains("r.workplaceTypes", "Remote"), F.lit(False))
    extra = F.map_filter(F.create_map(F.lit("guid"), F.col("r.guid"), F.lit("employment_type"), F.nullif(F.col("r.employmentType"), F.lit("")), F.lit("pay"), F.nullif(F.col("r.salary"), F.lit(""))), lambda k, v: v.isNotNull())
    return _posting(
        r, "dice", "dice", True,
        id=F.when(F.col("r").isNotNull(), F.concat(F.lit("dice_"), _first(F.col("r.id"), F.col("r.guid"), F.col("r.detailsPageUrl")))), title=_text(F.col("r.title")), company=_text(F.col("r.companyName")),
        location=_first(F.col("r.jobLocation.displayName"), F.when(remote, "Remote - US")), url=without_tracking(F.col("r.detailsPageUrl")), posted_at=_text(F.col("r.postedDate")), description=_text(F.col("r.summary")), extra=extra,
    )


def with_disposition(postings: DataFrame, gone: Column, cutoff: Column) -> DataFrame:
    """Rows with what becomes of them: gone, empty (no title), stale or new."""
    return postings.withColumn("disposition", F.when(gone, "gone").when(F.col("title") == "", "empty").when(~is_fresh(F.nullif(F.col("posted_at"), F.lit("")), cutoff), "stale").otherwise("new")).drop("_gone")


def from_dover(raw: DataFrame, cutoff: Column) -> DataFrame:
    """S5, with disposition"""
    r = _parsed(raw, "id string, title string, client_name string, active boolean, is_private boolean, created string, locations array<struct<name:string>>, user_provided_description string", ("slug",))
    places = F.array_join(F.filter(F.transform("r.locations", lambda x: x["name"]), lambda x: _text(x) != ""), "; ")
    company = F.trim(_first(F.col("r.client_name"), F.col("slug")))
    id_ = F.lower("r.id")
    out = _posting(
        r.withColumn("_gone", ~F.coalesce("r.active", F.lit(True)) | F.coalesce("r.is_private", F.lit(False))), "dover", "dover",
        id=F.concat(F.lit("dover_"), id_), title=F.trim(_text(F.col("r.title"))), company=company, location=_text(places), url=F.concat(F.lit("https://app.dover.com/apply/"), F.replace(F.url_encode(company), F.lit("+"), F.lit("%20")), F.lit("/"), id_),
        posted_at=_text(F.col("r.created")), description=html_to_text(F.col("r.user_provided_description")), extra=F.create_map(F.lit("gone"), F.col("_gone").cast("string")),
    )
    return with_disposition(out, F.col("extra")["gone"] == "true", cutoff).withColumn("extra", F.create_map().cast("map<string,string>"))


def from_gem(raw: DataFrame, cutoff: Column) -> DataFrame:
    """S6, with disposition"""
    r = _parsed(raw, "extId string, title string, firstPublishedTsSec string, job struct<teamDisplayName:string>, locations array<struct<name:string>>, descriptionHtml string", ("slug",))
    places = F.array_join(F.filter(F.transform("r.locations", lambda x: x["name"]), lambda x: _text(x) != ""), "; ")
    out = _posting(
        r, "gem", "gem",
        id=F.concat(F.lit("gem_"), F.col("r.extId")), title=F.trim(_text(F.col("r.title"))), company=F.trim(_first(F.col("r.job.teamDisplayName"), F.col("slug"))), location=_text(places),
        url=F.concat(F.lit("https://jobs.gem.com/"), F.col("slug"), F.lit("/"), F.col("r.extId")), posted_at=posted_iso(F.col("r.firstPublishedTsSec")), description=html_to_text(F.col("r.descriptionHtml")),
    )
    return with_disposition(out, F.lit(False), cutoff)


def from_adp(raw: DataFrame, names: dict[str, str], cutoff: Column) -> DataFrame:
    """S7, with disposition; raw has cid. names: company names by cid, lower-case."""
    r = _parsed(raw, "itemID string, requisitionTitle string, postDate string, requisitionDescription string, customFieldGroup struct<stringFields:array<struct<nameCode:struct<codeValue:string>,stringValue:string>>>, requisitionLocations array<struct<nameCode:struct<shortName:string>>>", ("cid",))
    own = F.get(F.filter("r.customFieldGroup.stringFields", lambda f: (f["nameCode"]["codeValue"] == "ExternalJobID") & (_text(f["stringValue"]) != "")), F.lit(0))["stringValue"]
    places = F.array_join(F.filter(F.transform("r.requisitionLocations", lambda x: F.trim(x["nameCode"]["shortName"])), lambda x: _text(x) != ""), "; ")
    cid = F.lower("cid")
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    job = _first(own, F.col("r.itemID"))
    out = _posting(
        r, "adp", "adp",
        id=F.when(job != "", F.concat(F.lit("adp_"), cid, F.lit("_"), job)), title=F.trim(_text(F.col("r.requisitionTitle"))), company=_first(F.try_element_at(known, cid), cid), location=_text(places),
        url=F.concat(F.lit("https://myjobs.adp.com/?cid="), cid, F.lit("&jobId="), job), posted_at=_text(F.col("r.postDate")), description=html_to_text(F.col("r.requisitionDescription")),
    )
    return with_disposition(out, F.lit(False), cutoff)


def from_amazon(raw: DataFrame) -> DataFrame:
    """S8"""
    r = _parsed(raw, "id string, job_path string, title string, posted_date string, normalized_location string, city string, state string, country_code string, location string, description string, basic_qualifications string, preferred_qualifications string")
    path = F.trim(_text(F.col("r.job_path")))
    parts = F.array_join(F.filter(F.array(*[F.trim(_text(F.col(f"r.{c}"))) for c in ("city", "state", "country_code")]), lambda x: x != ""), ", ")
    text = F.array_join(F.array(*[_text(F.col(f"r.{c}")) for c in ("description", "basic_qualifications", "preferred_qualifications")]), "\n")
    return _posting(
        r, "top_companies", "amazon",
        id=F.when(path != "", F.concat(F.lit("top_amazon_"), _first(F.regexp_extract(path, r"\d+", 0), F.col("r.id"), path))), title=_text(F.col("r.title")), company=F.lit("Amazon"),
        location=_first(F.trim(_text(F.col("r.normalized_location"))), parts, F.trim(_text(F.col("r.location")))), url=F.when(path.startswith("http"), path).otherwise(F.concat(F.lit("https://www.amazon.jobs/"), F.ltrim(path, F.lit("/")))),
        posted_at=_text(F.col("r.posted_date")), description=html_to_text(text),
    )


def from_getro(raw: DataFrame, cutoff: Column, name: str = "getro") -> DataFrame:
    """Listings (key, source, title, company, location, url, posted_at), one a key; those without id, web link or in time go."""
    r = raw.select(F.explode(F.from_json("raw", "results struct<jobs:array<struct<id:string,url:string,title:string,created_at:string,organization:struct<name:string>,locations:array<string>>>>")["results"]["jobs"]).alias("j"))
    rows = r.select(
        F.concat(F.lit("getro_"), F.col("j.id")).alias("key"), F.lit(name).alias("source"), F.trim(_text(F.col("j.title"))).alias("title"), F.trim(_text(F.col("j.organization.name"))).alias("company"),
        _text(F.array_join("j.locations", "; ")).alias("location"), safe_url(F.col("j.url")).alias("url"), posted_iso(F.col("j.created_at")).alias("posted_at"), is_fresh(F.col("j.created_at"), cutoff).alias("_fresh"),
    )
    return rows.where((F.col("key").isNotNull()) & (F.col("url") != "") & F.col("_fresh")).drop("_fresh").dropDuplicates(["key"])


def from_linkedin(raw: DataFrame, hours: int, cutoff: Column) -> DataFrame:
    """Raw JSON of a listing (url, title, company, location, age, date); old ones go."""
    r = _parsed(raw, "url string, title string, company string, location string, age string, date string")
    age = F.lower(_text(F.col("r.age")))
    in_hours = F.regexp_extract(age, r"(\d+)\s*hour", 1).try_cast("int")
    old = age.rlike(r"\b(?:day|week|month|year)s?\b") | F.coalesce(in_hours > hours, F.lit(False))
    fresh = F.when(age != "", ~old).otherwise(is_fresh(F.nullif(F.col("r.date"), F.lit("")), cutoff))
    company = F.coalesce(F.get(F.filter(F.transform(F.split(_text(F.col("r.company")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    url = _text(F.col("r.url"))
    key = _first(F.regexp_extract(url, r"(?:-|/view/|currentJobId=)(\d{6,})", 1), url)
    return _posting(r.where((url != "") & fresh), "linkedin", "linkedin", True, id=F.concat(F.lit("linkedin_"), key), title=_text(F.col("r.title")), company=company, location=_text(F.col("r.location")), url=url, posted_at=_text(F.col("r.date")), description=F.lit(""))


def from_jsonld(pages: DataFrame) -> DataFrame:
    """Pages (url, html) to title, company, location, description, posted_at and has_job, from the first JSON-LD posting,
    else from the heading and the page's title."""
    html = _text(F.col("html"))
    bodies = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    top = F.transform(bodies, lambda b: F.try_parse_json(b))
    nested = F.flatten(F.transform(top, lambda v: F.concat(F.array(v), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))))
    kind = lambda v: (F.try_variant_get(v, "$['@type']", "string") == "JobPosting") | F.coalesce(F.array_contains(F.try_variant_get(v, "$['@type']", "array<string>"), "JobPosting"), F.lit(False))
    rows = pages.select("url", "html", F.get(F.filter(nested, lambda v: F.coalesce(kind(v), F.lit(False))), F.lit(0)).alias("_v"))
    get = lambda path: F.try_variant_get("_v", path, "string")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    h1 = clean(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = F.substring_index(clean(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), " | ", 1)
    place = lambda p: F.concat_ws(", ", *[F.nullif(get(f"{p}.address.{c}"), F.lit("")) for c in ("addressLocality", "addressRegion", "addressCountry")])
    return rows.select(
        "url", _first(get("$.title"), h1, title).alias("title"), _text(get("$.hiringOrganization.name")).alias("company"), _first(place("$.jobLocation"), place("$.jobLocation[0]")).alias("location"),
        html_to_text(get("$.description")).alias("description"), _text(get("$.datePosted")).alias("posted_at"), (F.col("_v").isNotNull() | (h1 != "")).alias("has_job"),
    )


def collect_postings(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of all sources under their names, and for each source how many rows couldn't be read."""
    if not sources:
        spark = SparkSession.active()
        return spark.createDataFrame([], "id string, source string"), spark.createDataFrame([], "source string, unreadable long")
    rows = None
    for name, df in sources.items():
        own = df.withColumn("source", F.lit(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    bad = rows.groupBy("source").agg(F.count_if(F.col("id").isNull()).alias("unreadable"))
    return rows.where("id IS NOT NULL"), bad
