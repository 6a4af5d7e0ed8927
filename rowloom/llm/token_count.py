"""Token counts by a map-side lookup in two tiers; no shuffle at all.

A text is cut into pre-tokens at which the tokenizer's merges never join: before a run of spaces, and around characters
that no longer piece holds. The number of tokens of a text is the sum over its pre-tokens.

* Tier 1, broadcast: a table of the FREQUENT most frequent pre-tokens with their lengths in tokens, as counted over whole
  texts of a bounded sample (about SAMPLE documents, drawn over all of the corpus; each task sends counts of at most
  TASK_ENTRIES pre-tokens).
* Tier 2: each worker keeps the lengths of pre-tokens that it had to encode, in a cache of bounded size.

The result doesn't depend on what either tier holds.
"""

from __future__ import annotations

import collections
import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, text_of

#: Entries of a worker's cache; it starts anew when full. Longer pre-tokens aren't kept.
CACHE_ENTRIES, CACHE_CHARS = 800_000, 48
LIMIT = 4096
#: Documents that the sample for tier 1 has about, pre-tokens that a task sends, and pre-tokens of the table.
SAMPLE, TASK_ENTRIES, FREQUENT = 1_000, 2_048, 50_000
MARK = "▁"
#: What this worker process keeps from task to task: a Counter for each model.
WORKER: dict[str, Counter] = {}


def cut_pattern(pieces: list[str]) -> re.Pattern:
    """Pre-tokens of a text in which spaces are marks: cuts are before marks, around line feeds and tabs, and between a
    letter and a sign.

    It is read off the vocabulary that merges never cross these cuts: no piece has a mark after another character (else
    there are no pre-tokens, an error), none joins a line feed or tab to anything, and none has one of the signs after a
    letter.
    """
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece spans a space: this tokenizer has no pre-tokens")
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    alone = {c for c in "\n\t" if not any(c in x for x in pairs)}
    signs = set("!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~") - {b for a, b in pairs if a.isalpha()}
    a, s = ("".join(map(re.escape, sorted(x))) for x in (alone, signs))
    word = f"{MARK}*[^{MARK}{a}]+"
    return re.compile("|".join([f"[{a}]+"] * bool(a) + [f"{MARK}*[^{MARK}{a}]*?[^\\W\\d_](?=[{s}])"] * bool(s) + [word, f"{MARK}+"]))


class Counter:
    """Counts for one process: the model, the table of tier 1 and the cache of tier 2."""

    def __init__(self, model: bytes, frequent: dict[str, int] | None = None):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not self.sp.is_byte(i) and not self.sp.is_control(i) and not self.sp.is_unknown(i)]
        self.find = cut_pattern(pieces).findall
        self.frequent, self.cache = frequent or {}, {}

    def lengths(self, pretokens: list[str]) -> list[int]:
        """Tokens of each pre-token, encoded alone.

        A pre-token that starts with a mark is encoded without its first, which the library puts back; any other after
        a line feed, which no piece joins to what follows, and whose tokens are taken off.
        """
        out = self.sp.encode([p[1:] if p[0] == MARK and len(p) > 1 else "\n" + p for p in pretokens], num_threads=1)
        return [1 if p == MARK else len(ids) if p[0] == MARK else len(ids) - self.newline for p, ids in zip(pretokens, out, strict=True)]

    @property
    def newline(self) -> int:
        return self.__dict__.setdefault("_newline", len(self.sp.encode("\n", num_threads=1)))

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.find(MARK + text.replace(" ", MARK)) if text else []

    def counts(self, texts: list[str]) -> list[int]:
        cut = list(map(self.cut, texts))
        known, cache = self.frequent.get, self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        parts = [[known(p) or cache.get(p) or p for p in x] for x in cut]
        misses = list({p for x in parts for p in x if p.__class__ is str})
        own = {}
        for at in range(0, len(misses), 4096):
            some = misses[at : at + 4096]
            own.update(zip(some, self.lengths(some), strict=True))
        cache.update((p, n) for p, n in own.items() if len(p) <= CACHE_CHARS)
        return [sum(own[p] if p.__class__ is str else p for p in x) for x in parts]


def frequent_pretokens(docs: DataFrame, model: bytes, text: str = "text") -> list[str]:
    """Pre-tokens of a sample of docs, the most frequent first. The rows of a task are counted there, so none is shuffled."""
    total = docs.count()
    some = docs.sample(fraction=min(1.0, SAMPLE / max(1, total)), seed=1) if total > SAMPLE else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        counter, found = Counter(shared.value), collections.Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(counter.cut(t or ""))
        top = found.most_common(TASK_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["p", "n"])

    sent = some.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "p string, n long").toArrow()
    best = sent.group_by("p").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("p", "ascending")])
    return [p for p in best.column("p").slice(0, FREQUENT).to_pylist() if len(p) <= CACHE_CHARS]


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes and n_tokens of every row, as the library counts the whole text, without added tokens.

    Null counts as empty: no bytes, no tokens. Repeated rows are counted each; extra columns are ignored unless kept, and
    kept ones named n_bytes or n_tokens give way to the results; an empty table gives an empty result. Texts are taken in
    slices of a few MB, a longer one alone.
    """
    model = open(model_path, "rb").read()
    counter, frequent = Counter(model), frequent_pretokens(docs, model, text)
    shared = spark.sparkContext.broadcast((model, dict(zip(frequent, counter.lengths(frequent), strict=True))))
    key = hashlib.sha256(model + repr(sorted(frequent)).encode()).hexdigest()

    def setup() -> None:
        if key not in WORKER:
            WORKER.clear()
            WORKER[key] = Counter(*shared.value)

    own = docs.withColumn("n_bytes", F.octet_length(text_of(text)).cast("long"))
    return map_texts(own, [*keep, "n_bytes"], text, [("n_tokens", pa.int64(), "long")], lambda texts: [WORKER[key].counts(texts)], setup)


def with_limit(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
