"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text. A window of a document is compressed
with the ordinary dictionary and with the ordinary and toxic ones together; the bytes saved by the toxic one are the
window's distance. The text of the document is scored from its windows' distances by thresholds and weights calibrated
on labelled rows that the dictionaries haven't seen.

Toxic documents are mostly ordinary text, so what the toxic dictionary is trained on is the part of their text that
ordinary documents don't have: words in several contexts in toxic documents (copies of one document have one context)
that are rare in ordinary ones. Dictionaries trained on the whole of toxic and of ordinary text were tried first and
tell next to nothing (README). Both compressors know ordinary text alike, so that a difference is the toxic part's.

The length of a text is among its figures, since a text of many windows meets one of some distance by chance; leaving it
out costs recall on held-out rows (README).
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, text_of

#: Labelled rows that the fit takes to the driver at most, and bytes of their texts, for each label: the bounds of the fit.
FIT_ROWS, FIT_BYTES = 2_000, 32 << 20
#: Windows that the ordinary dictionary is trained on at most: those of the smallest hashes over all ordinary texts.
FIT_WINDOWS = 40_000
#: Bytes of text in a window, whole words.
WINDOW = 32
ORDINARY_BYTES, TOXIC_BYTES = 6_000, 1_024
#: Contexts and documents that a toxic word needs, and how many times more usual it has to be in toxic documents.
CONTEXTS, DOCUMENTS, TIMES = 8, 4, 3
#: Rows held out from every fit: crc32 of the doc_id as text, modulo this, is 0.
FOLDS = 5
WORKER: dict[bytes, tuple] = {}


def held_out(key: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)) == 0


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text, lower-cased, as runs of whole words of at least size bytes; a space stands at both ends."""
    out: list[bytes] = []
    run: list[bytes] = []
    n = 0
    for w in text.lower().encode().split():
        run.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" %b " % b" ".join(run))
            run, n = [], 0
    if run:
        out.append(b" %b " % b" ".join(run))
    return out


def compressor(content: bytes):
    """Compressed size under a dictionary of this content, with settings for very short inputs."""
    parameters = zstandard.ZstdCompressionParameters(window_log=13, hash_log=12, chain_log=12, search_log=1, min_match=5, target_length=16, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=parameters).compress


def distances(text: str, pair: tuple) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window; one window of distance 0 for a text without words."""
    ordinary, toxic = pair
    found = windows(text)
    return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in found), np.int64, len(found)) if found else np.zeros(1, np.int64)


def figures(d: np.ndarray) -> list[float]:
    """What a text's score is made of: largest distance, second largest, windows at 4 bytes or more, and length."""
    top = np.sort(d)[::-1][:3]
    top = np.pad(top, (0, 3 - len(top)))
    over = int((d >= 4).sum())
    return [float(min(max(top[0], 0), 10)), float(min(max(top[1], 0), 10)), float(min(max(top[2], 0), 10)), math.log1p(over), over / math.sqrt(len(d)), math.log1p(len(d))]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains on samples, its last size bytes; too little text is its own dictionary."""
    try:
        return zstandard.train_dictionary(size + 400, samples, k=32, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def bare(word: bytes) -> bytes:
    """A word without signs at its ends."""
    return word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def sampled(found: Iterable[bytes], most: int) -> list[bytes]:
    """found in its order if it has at most so many windows, else those of the smallest hashes, wherever they stand."""
    kept = heapq.nsmallest(most + 1, ((zlib.crc32(x), i, x) for i, x in enumerate(found)))
    return [x for _, _, x in sorted(kept[:most], key=lambda k: k[1])]


def dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """Contents of the ordinary dictionary and of the ordinary and toxic ones together."""
    split = {y: [[bare(w) for w in t.lower().encode().split()] for t, label in rows if label == y] for y in (0, 1)}
    usual: Counter = Counter()
    for words in split[0]:
        usual.update(words)
    contexts: dict[bytes, set] = defaultdict(set)
    holders: Counter = Counter()
    for words in split[1]:
        holders.update(set(words))
        for before, word in zip([b"", *words], words, strict=False):
            contexts[word].add(before)
    rate = len(split[1]) / max(1, len(split[0]))
    marked = {w for w, c in contexts.items() if w and len(c) >= CONTEXTS and holders[w] >= DOCUMENTS and len(c) >= TIMES * rate * (usual[w] + 1)}
    toxic = [s for words in split[1] if len(s := b" %b " % b" ".join(w for w in words if w in marked)) > 2]
    ordinary = sampled((x for t, y in rows if not y for x in windows(t, 256)), FIT_WINDOWS)
    base = _dictionary(ordinary, ORDINARY_BYTES) or b" "
    return base, base + _dictionary(toxic, TOXIC_BYTES)


def fit(rows: list[tuple[str, int]]) -> dict:
    """A model from labelled texts (text, toxic 0 or 1): dictionaries, and weights of figures() by logistic regression.

    Weights are calibrated on texts that the dictionaries used for them haven't seen: each third of the rows is measured
    with dictionaries from the other two. The dictionaries of the model come from all rows. With one label only, every
    text scores by that label alone.
    """
    rows = sorted(set(rows))
    part = lambda t: zlib.crc32(t.encode()) % 3
    x, y = [], []
    for k in range(3):
        pair = tuple(map(compressor, dictionaries([r for r in rows if part(r[0]) != k])))
        own = [r for r in rows if part(r[0]) == k]
        x += [figures(distances(t, pair)) for t, _ in own]
        y += [float(label) for _, label in own]
    base, both = dictionaries(rows)
    model = {"ordinary": base, "toxic": both}
    if len(set(y)) < 2:
        share = (sum(y) + 0.5) / (len(y) + 1)
        return model | {"mean": [0.0] * 6, "scale": [1.0] * 6, "weights": [0.0] * 6, "bias": math.log(share / (1 - share))}
    x, y = np.array(x), np.array(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(7), np.diag([1.0] * 6 + [1e-6])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return model | {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w[:6].tolist(), "bias": float(w[6])}


def score_texts(texts: list[str], model: dict) -> list[float]:
    key = model["toxic"] + repr(model["weights"]).encode()
    if key not in WORKER:
        WORKER[key] = compressor(model["ordinary"]), compressor(model["toxic"])
    out = []
    for t in texts:
        z = (np.array(figures(distances(t, WORKER[key]))) - model["mean"]) / model["scale"]
        out.append(float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(z @ model["weights"]) + model["bias"]))))))
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> list[tuple[str, int]]:
    """Up to rows labelled texts of each label, whole, those of the smallest hashes of doc_id, none held out; texts that would
    take more than size bytes with those before them are left out. First ids and sizes come to the driver, then texts."""
    own = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    chosen = None
    for y in (0, 1):
        some = own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", text_of().alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("key"))
    # ids may repeat in docs, so the rows are bounded once more
    measured = found.select("doc_id", "toxic", "order", "key", F.octet_length("text").alias("size"))
    fitting = []
    for y in (0, 1):
        taken = 0
        for r in measured.where(F.col("toxic") == y).orderBy("order", "doc_id", "key").limit(rows).collect():
            if taken + r["size"] <= size:
                fitting.append((r["doc_id"], r["key"], r["toxic"]))
                taken += r["size"]
    if not fitting:
        return []
    kept = docs.sparkSession.createDataFrame(fitting, measured.select("doc_id", "key", "toxic").schema).distinct()
    return [(r["text"], int(r["toxic"])) for r in found.join(F.broadcast(kept), ["doc_id", "key", "toxic"]).select("text", "toxic").distinct().collect()]


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score (0 to 1) and predicted (1 if score >= 0.5) of every row of docs (doc_id, text).

    The fit takes at most FIT_ROWS rows and FIT_BYTES bytes of each label to the driver, whole texts; the model (a few KB) is broadcast
    and whole texts are scored in place, without a shuffle. Null counts as empty; a text without words has one window of
    distance 0; repeated rows get the same score; extra columns are ignored unless kept, and kept ones named score or
    predicted give way to the results; an empty table gives an empty result, and empty labels a score of one half.
    """
    model = spark.sparkContext.broadcast(fit(labelled_rows(docs, labels)))
    out = map_texts(docs, list(keep), "text", [("score", pa.float64(), "double")], lambda texts: [score_texts(texts, model.value)])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
