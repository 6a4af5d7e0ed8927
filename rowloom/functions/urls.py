"""Links: tracking, comparison keys, hosts and what they link to. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The applicant tracking systems by their hosts, in order.
ATS_HOSTS = {
    "greenhouse.io": "greenhouse",
    "lever.co": "lever",
    "ashbyhq.com": "ashby",
    "adp.com": "adp",
    "myworkdayjobs.com": "workday",
    "myworkdaysite.com": "workday",
    "dover.io": "dover",
    "dover.com": "dover",
    "gem.com": "gem",
    "teamtailor.com": "teamtailor",
    "bamboohr.com": "bamboohr",
    "workable.com": "workable",
}
_SHAPE = r"^(?i:([a-z][a-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty when absent."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, k)


def host(url: Column) -> Column:
    """The host, lower-case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def without_tracking(url: Column) -> Column:
    """The link without utm_ parameters; links without any stay as they are."""
    kept = F.array_join(F.filter(F.split(part(url, 4), "&"), lambda x: ~F.lower(x).startswith("utm_")), "&")
    base, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(part(url, 4).contains("utm_"), F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), rest)).otherwise(F.coalesce(url, F.lit("")))


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, path without a slash at its end; no query, no fragment."""
    return F.when(part(url, 2) == "", F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")).otherwise(F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.rtrim(part(url, 3), F.lit("/"))))


def same_url(url: Column) -> Column:
    """Host in lower case, path without a slash at its end, and query."""
    return F.concat(F.lower(part(url, 2)), F.rtrim(part(url, 3), F.lit("/")), F.lit("?"), part(url, 4))


def safe_url(url: Column) -> Column:
    """C11: the link if it is of the web, else empty."""
    return F.when(url.rlike("(?i)^https?://"), url).otherwise("")


def ats_of(url: Column) -> Column:
    """C14: the tracking system that really serves the link, by host or subdomain; empty for none."""
    h = host(url)
    found = F.coalesce(*[F.when((h == d) | h.endswith("." + d), F.lit(name)) for d, name in ATS_HOSTS.items()])
    return F.coalesce(found, F.lit(""))


def _query(url: Column, key: str) -> Column:
    return F.coalesce(F.try_url_decode(F.translate(F.regexp_extract(part(url, 4), rf"(?:^|&){key}=([^&]*)", 1), "+", " ")), F.lit(""))


#: The shape of a posting's link at each system, with company and posting id.
LINK_SHAPES = {
    "greenhouse": r"^https?://(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/([^/?#]+)/jobs/(\d+)",
    "lever": r"^https?://jobs(?:\.eu)?\.lever\.co/([^/?#]+)/([^/?#]+)",
    "ashby": r"^https?://jobs\.ashbyhq\.com/([^/?#]+)/([^/?#]+)",
    "dover": r"^https?://(?:jobs\.dover\.io|app\.dover\.(?:io|com))/(?:apply/)?([^/?#]+)/([^/?#]+)",
    "gem": r"^https?://jobs\.gem\.com/([^/?#]+)/([^/?#]+)",
}


def parse_link(url: Column) -> Column:
    """Struct of ats, slug, job_id and url of a posting's link, null for any other link."""
    ats = ats_of(url)
    made = lambda slug, job: F.when((slug != "") & (job != ""), F.struct(ats.alias("ats"), slug.alias("slug"), job.alias("job_id"), url.alias("url")))
    out = F.lit(None)
    embed = url.rlike(r"^https?://(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/embed/job_app\?")
    token = _query(url, "token")
    out = F.when((ats == "greenhouse") & embed, F.when(token.rlike("^[0-9]+$"), made(_query(url, "for"), token)))
    for name, shape in LINK_SHAPES.items():
        out = out.when(ats == name, made(F.regexp_extract(url, shape, 1), F.regexp_extract(url, shape, 2)))
    tenant_host = F.regexp_extract(url, r"^https?://([^./]+)(?:\.[^./]+)?\.myworkdayjobs\.com/", 1)
    tenant_path = F.regexp_extract(url, r"^https?://[^./]+\.myworkdaysite\.com/recruiting/([^/?#]+)/", 1)
    path = F.when(tenant_host != "", part(url, 3)).otherwise(F.regexp_replace(part(url, 3), r"^/recruiting/[^/]+", ""))
    path = F.regexp_replace(path, r"(?i)(?:/+(?:apply|applymanually|autofillwithresume|login))*/*$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    inside = F.exists(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: F.lower(s).isin("job", "details"))
    out = out.when((ats == "workday") & inside, made(F.when(tenant_host != "", tenant_host).otherwise(tenant_path), F.try_element_at(segments, F.lit(-1))))
    out = out.when((ats == "adp") & host(url).isin("myjobs.adp.com", "workforcenow.adp.com"), made(_query(url, "cid"), _query(url, "jobId")))
    return out


def links_in(text: Column) -> Column:
    """The links in a text, with &amp; decoded and signs at their ends taken off."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""(https?://[^\s"'<>()\]]+)"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(F.replace(u, F.lit("&amp;"), F.lit("&")), F.lit(".,;:!"))))
