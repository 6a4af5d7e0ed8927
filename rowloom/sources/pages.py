"""Postings from pages and feeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import has_term, html_to_text, is_fresh, let, terms_in, word_text
from rowloom.functions.urls import safe_url

#: What an opening says, its roles, and words of articles about jobs.
OPENING_SIGNALS = ["we are hiring", "we're hiring", "job opening", "open position", "apply now", "join our team", "now hiring", "hiring now", "position available"]
ROLE_WORDS = ["engineer", "engineers", "engineering", "developer", "developers", "backend", "frontend", "full stack", "fullstack", "software", "sde"]
ARTICLE_WORDS = ["background jobs", "job queue", "cron job", "job offer", "offer negotiation", "how to", "tutorial", "guide", "top", "best", "nobody is", "why", "api", "firebase", "supabase", "bullmq", "trigger.dev"]
CATEGORIES = ["jobs", "job", "hiring", "career"]


def is_likely_opening(title: Column, description: Column, categories: Column) -> Column:
    """whether a post reads like an opening; words of articles count in the title only."""
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    article = let(word_text(title), lambda w: F.size(terms_in(w, ARTICLE_WORDS)) > 0)
    tagged = F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)).isin(CATEGORIES))

    def judge(w: Column) -> Column:
        role = F.size(terms_in(w, ROLE_WORDS)) > 0
        opening = F.lower(F.trim(title)).startswith("[hiring]") | (F.size(terms_in(w, OPENING_SIGNALS)) > 0)
        return role & (opening | tagged & (has_term(w, "apply") | has_term(w, "position")))

    return ~article & let(word_text(F.concat(title, F.lit(" "), description)), judge)


def from_devto(items: DataFrame, cutoff: Column) -> DataFrame:
    """Items of a feed (title, link, description, pubDate, category: array), as read with format("xml") and rowTag
    "item"; likely openings only, one a link."""
    when = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    text, url = html_to_text(F.col("description")), F.trim("link")
    rows = items.withColumn("_text", text).withColumn("_when", when).where((url != "") & (F.col("_when").isNull() | (F.col("_when") >= cutoff)))
    rows = rows.where(is_likely_opening(F.col("title"), F.col("_text"), F.col("category")))
    out = rows.select(
        F.concat(F.lit("devto_"), F.substring_index(url, "/", -1)).alias("id"), F.trim("title").alias("title"), F.lit("Dev.to Community").alias("company"), F.lit("Remote").alias("location"), url.alias("url"),
        F.col("_text").alias("description"), F.coalesce(F.date_format("_when", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("")).alias("posted_at"), F.lit("industry_jobs").alias("source"), F.lit("devto").alias("ats"),
    )
    return out.dropDuplicates(["url"])


def from_consider(pages: DataFrame, cutoff: Column, name: str = "consider") -> tuple[DataFrame, DataFrame]:
    """Listings of pages (host, html) that hold their jobs as JSON text in script pushes, and the hosts of pages
    without such a list."""
    chunks = F.regexp_extract_all("html", F.lit(r'self\.__next_f\.push\(\[1,\s*("(?:[^"\\]|\\.)*")\]\)'), F.lit(1))
    decoded = F.transform(chunks, lambda c: F.try_variant_get(F.try_parse_json(c), "$", "string"))
    flight = F.array_join(F.filter(decoded, lambda c: c.isNotNull()), "")
    # the array ends at its own bracket: objects in it hold strings, numbers and one more level
    body = F.regexp_extract(flight, r'(?s)"initialData"\s*:\s*\{.*?"jobs"\s*:\s*(\[(?:[^\[\]"]|"(?:[^"\\]|\\.)*"|\[(?:[^\[\]"]|"(?:[^"\\]|\\.)*")*\])*\])', 1)
    jobs = F.from_json(F.nullif(body, F.lit("")), "array<struct<id:string,title:string,company_name:string,location:string,apply_url:string,posted_at:string>>")
    rows = pages.select("host", jobs.alias("jobs"))
    each = rows.select(F.explode("jobs").alias("j")).where((safe_url(F.col("j.apply_url")) != "") & (F.coalesce("j.id", F.lit("")) != "") & is_fresh(F.nullif(F.col("j.posted_at"), F.lit("")), cutoff))
    none = lambda c: F.trim(F.coalesce(c, F.lit("")))
    listings = each.select(F.concat(F.lit("consider_"), "j.id").alias("key"), F.lit(name).alias("source"), none(F.col("j.title")).alias("title"), none(F.col("j.company_name")).alias("company"), none(F.col("j.location")).alias("location"), F.col("j.apply_url").alias("url"), none(F.col("j.posted_at")).alias("posted_at"))
    return listings, rows.where("jobs IS NULL").select("host").distinct()


def from_linkedin_page(pages: DataFrame) -> DataFrame:
    """Url and description of guest pages: the text block, then the criteria as lines."""
    block = html_to_text(F.regexp_extract("html", r'(?is)<div[^>]*class="[^"]*show-more-less-html__markup[^"]*"[^>]*>(.*?)</div>', 1))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    pair = r'(?is)<h3[^>]*class="[^"]*description__job-criteria-subheader[^"]*"[^>]*>(.*?)</h3>\s*<span[^>]*>(.*?)</span>'
    lines = F.transform(F.arrays_zip(F.regexp_extract_all("html", F.lit(pair), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(pair), F.lit(2)).alias("v")), lambda p: F.when(clean(p["v"]) != "", F.concat(clean(p["h"]), F.lit(": "), clean(p["v"]))))
    return pages.select("url", F.array_join(F.filter(F.array(block, F.array_join(F.array_compact(lines), "\n")), lambda x: x != ""), "\n\n").alias("description"))


def description_blocks(pages: DataFrame, names: str = r"description|job-details|posting|content") -> DataFrame:
    """C7, first half: url and text of each block of a page whose class or id matches names; furniture is left out."""
    import re
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        SKIP, BREAK, VOID = {"script", "style", "noscript", "nav", "footer", "header"}, {"p", "div", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6"}, {"br", "img", "input", "hr", "meta", "link"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.open, self.found, self.skipped = [], [], [], 0

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.handle_data("\n")
            if tag in self.VOID:
                return
            mine = [] if any(n in ("class", "id") and v and re.search(names, v) for n, v in attrs) else None
            self.stack.append((tag, mine))
            self.skipped += tag in self.SKIP
            if mine is not None:
                self.open.append(mine)

        def handle_endtag(self, tag):
            if tag not in [t for t, _ in self.stack]:
                return
            while self.stack:
                t, mine = self.stack.pop()
                self.skipped -= t in self.SKIP
                if t in self.BREAK:
                    self.handle_data("\n")
                if mine is not None:
                    self.found.append(mine)
                    self.open.remove(mine)
                if t == tag:
                    break

        def handle_data(self, data):
            if not self.skipped:
                for parts in self.open:
                    parts.append(data)

    def run(frames):
        for frame in frames:
            out = []
            for url, page in zip(frame["url"], frame["html"], strict=True):
                p = Blocks()
                p.feed(page or "")
                p.close()
                for parts in [*p.found, *p.open]:
                    text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).splitlines()) if x)
                    if text:
                        out.append((url, text))
            yield pd.DataFrame(out, columns=["url", "text"])

    return pages.select("url", "html").mapInPandas(run, "url string, text string")


def best_description(pages: DataFrame, hints: list[str], placeholders: list[str], most: int = 8000) -> DataFrame:
    """Url and the most job-like block of each page (its length and 150 for each hint), else the page's whole text."""
    low = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    held = lambda c: F.exists(F.array(*map(F.lit, placeholders)), lambda p: F.contains(low(c), p)) if placeholders else F.lit(False)
    blocks = description_blocks(pages).where(~held(F.col("text")))
    score = F.length("text") + 150 * let(word_text(F.col("text")), lambda w: F.size(terms_in(w, hints)))
    best = blocks.groupBy("url").agg(F.max_by("text", F.struct(score, "text")).alias("_best"))
    body = html_to_text(F.regexp_replace("html", r"(?is)<(noscript|nav|footer|header)\b.*?</\1\s*>|<head\b.*?</head\s*>", ""))
    out = pages.join(best, "url", "left").withColumn("_body", body)
    return out.select("url", F.substring(F.coalesce("_best", F.when(~held(F.col("_body")), F.col("_body")), F.lit("")), 1, most).alias("description"))
