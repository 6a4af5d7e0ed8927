"""Terms of a lexicon in texts, and profiles chosen by them."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import has_term, let, word_text

from .graph import join_one, written

#: Skills and their spellings, in the order shown.
SKILLS = {
    "python": ["python", "python3"],
    "javascript": ["javascript", "js"],
    "typescript": ["typescript", "ts"],
    "react": ["react", "reactjs"],
    "nextjs": ["next.js", "nextjs"],
    "nodejs": ["node.js", "nodejs", "node"],
    "java": ["java"],
    "spring boot": ["spring boot", "springboot", "spring"],
    "sql": ["sql"],
    "postgresql": ["postgresql", "postgres"],
    "redis": ["redis"],
    "aws": ["aws", "amazon web services"],
    "docker": ["docker"],
    "kubernetes": ["kubernetes", "k8s"],
    "fastapi": ["fastapi"],
    "flask": ["flask"],
    "rest api": ["rest api", "restapis", "api design"],
    "machine learning": ["machine learning", "ml"],
    "ai": ["ai", "artificial intelligence"],
    "pytorch": ["pytorch", "torch"],
    "tensorflow": ["tensorflow"],
    "llm": ["llm", "large language model", "language model"],
    "rag": ["rag", "retrieval augmented generation"],
    "data engineering": ["data engineering", "data pipeline"],
    "backend": ["backend"],
    "frontend": ["frontend"],
    "fullstack": ["fullstack", "full-stack"],
    "microservices": ["microservices"],
}


def lexicon_table(spark, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """rows (ord, key, term) of a lexicon, terms as whole words."""
    lexicon = SKILLS if lexicon is None else lexicon
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit(t).alias("term")) for i, (k, terms) in enumerate(lexicon.items()) for t in terms])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.ord", "r.key", F.trim(word_text(F.col("r.term"))).alias("term"), F.size(F.split(F.trim(word_text(F.col("r.term"))), " ")).alias("n"))


#: A lexicon of up to so many characters is sent to every worker as one automaton (some 50 bytes a character there).
AUTOMATON_CHARS = 2_000_000
#: What a worker process keeps from task to task: the automaton of the lexicon that it met last.
WORKER: dict = {}


def term_hits(texts: DataFrame, lexicon: DataFrame, longest: int = 4, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Texts (id, text) and a lexicon (ord, key, term: whole words) of any size to rows (id, ord, key), each once.

    The size of the lexicon is measured first. Up to most_chars it goes to every worker as one automaton (Aho-Corasick), by
    which a text is read once however many terms there are, without a shuffle. Beyond that it stays partitioned: the word
    sequences of up to longest words of each text are joined to the terms, with those that many texts have dealt to several
    tasks. Null texts have no terms; a repeated id has the terms of all its rows; an empty lexicon gives no rows.
    """
    terms = written(lexicon.where("term <> ''").groupBy("term").agg(F.collect_set(F.struct("ord", "key")).alias("keys")))
    size = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("n")).first().n
    words = texts.select("id", word_text(F.col("text")).alias("words"))
    found = _by_automaton(words, terms) if size <= most_chars else _by_join(words, terms, longest)
    return found.select("id", F.explode("keys").alias("k")).select("id", "k.ord", "k.key").distinct()


def _by_automaton(words: DataFrame, terms: DataFrame) -> DataFrame:
    spark = words.sparkSession
    known = sorted(r.term for r in terms.select("term").collect())
    shared = spark.sparkContext.broadcast(known)
    name = hashlib.sha256("\n".join(known).encode()).hexdigest()
    shape = T.StructType([words.schema["id"], T.StructField("terms", T.ArrayType(T.StringType()))])

    def run(batches):
        import ahocorasick

        if name not in WORKER:
            WORKER.clear()
            trie = ahocorasick.Automaton()
            for t in shared.value:
                trie.add_word(f" {t} ", t)
            if shared.value:
                trie.make_automaton()
            WORKER[name] = trie
        trie = WORKER[name]
        for batch in batches:
            own = [sorted({t for _, t in trie.iter(x)}) if len(trie) else [] for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.list_(pa.string()))], names=["id", "terms"])

    each = words.mapInArrow(run, shape).select("id", F.explode("terms").alias("term"))
    return each.join(F.broadcast(terms), "term")


def _by_join(words: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    def grams(w: Column) -> Column:
        parts = []
        for n in range(1, longest + 1):
            k = F.greatest(F.size(w) - (n - 1), F.lit(0))
            g = F.slice(w, F.lit(1), k)
            for i in range(1, n):
                g = F.zip_with(g, F.slice(w, F.lit(1 + i), k), lambda a, b: F.concat(a, F.lit(" "), b))
            parts.append(g)
        return F.array_distinct(F.concat(*parts))

    split = F.filter(F.split(F.trim("words"), " "), lambda x: x != "")
    return join_one(written(words.select("id", F.explode(let(split, grams)).alias("term"))), terms, ["term"])


def skills_of(texts: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """texts (id, text) with skills (array in the lexicon's order), empty where none is found; every row by itself, whatever
    its id. One expression a term: a lexicon of some hundred terms, given by the caller. term_hits() is for larger ones."""
    lexicon = SKILLS if lexicon is None else lexicon

    def found(words: Column) -> Column:
        named = [F.when(reduce(or_, (has_term(words, t) for t in dict.fromkeys(terms))), F.lit(k)) for k, terms in lexicon.items() if terms]
        return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")

    return texts.select("id", let(word_text(F.col("text")), found).alias("skills"))


def compare_skills(wanted: DataFrame, have: list[str]) -> DataFrame:
    """Wanted (id, skills) with matched and gaps against the skills of a profile."""
    own = F.array(*map(F.lit, have)) if have else F.array().cast("array<string>")
    return wanted.select("id", F.array_intersect("skills", own).alias("matched"), F.array_except("skills", own).alias("gaps"))


def pick_profile(texts: DataFrame, profiles: dict[str, list[str]], default: str) -> DataFrame:
    """Id and profile with the most of its keywords in the text; none or a tie gives the default. One expression a
    profile: profiles are few and given by the caller."""
    def choose(counts: Column) -> Column:
        best = F.array_max(F.transform(counts, lambda c: c["n"]))
        top = F.filter(counts, lambda c: c["n"] == best)
        return F.when((best > 0) & (F.size(top) == 1), top[0]["name"]).otherwise(default)

    count = lambda words: F.array(*[F.struct(sum((has_term(words, k).cast("int") for k in dict.fromkeys(keys)), F.lit(0)).alias("n"), F.lit(name).alias("name")) for name, keys in profiles.items()])
    return texts.select("id", let(word_text(F.col("text")), lambda words: let(count(words), choose)).alias("profile"))
