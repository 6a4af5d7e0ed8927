"""Every stage of the pipeline, and the operators' kept columns, with nulls, repeated rows, an empty table and clashing names."""

import hashlib
import json
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import byte_bpe, exact_dedup, html_text, mixing, quality_rules, queries, token_count, toxicity

CLASH = ["score", "predicted", "kept", "row", "n", "_t", "_p", "_n", "key", "ids", "token_ids", "fp", "spread", "recipe", "p", "n_bytes", "n_tokens", "host", "lines", "line", "words", "_kept", "_text", "_html", "_hash", "_part", "doc_id2"]
LONG = " ".join(f"long{i % 71} text" for i in range(30_000))
TEXTS = [None, "", " ", "one text of some words", "one  text of\nsome words", "one text of some words", "other text here, of more words than the first one has", LONG, LONG + " end"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """A folder whose labels are those of the smallest tables."""
    return sf


@pytest.fixture(scope="module")
def docs(spark):
    """Rows of odd texts; ids repeat (with equal and with other texts) and are null; the names of columns clash."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[6]), (None, TEXTS[3]), (None, "only here, under no id at all"), (None, "only here, under no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_odd_rows(spark, folder, docs, name):
    out = STAGES[name](spark, docs, folder)
    if name != "byte_bpe":
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"`{c}` <> 'own {c}'" for c in CLASH)).count() == 0
        assert not out.exceptAll(docs.unionByName(docs).unionByName(docs).unionByName(docs)).count()
    else:
        assert out.count() == docs.count() and out.where("n_tokens IS NULL OR decoded_sha256 IS NULL").count() == 0
    assert STAGES[name](spark, docs.where("doc_id < 0"), folder).count() == 0


def test_one_of_each_group_stays(spark, folder, docs):
    kept = sorted(((r["doc_id"], r["text"]) for r in STAGES["exact_dedup"](spark, docs, folder).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(0, None), (2, " "), (3, TEXTS[3]), (3, TEXTS[6]), (7, LONG), (8, LONG + " end"), (None, "only here, under no id at all")], key=str)
    near = STAGES["simhash_near_dedup"](spark, docs, folder).select("doc_id", "text").collect()
    assert sum(r["text"] == TEXTS[3] for r in near) == 1 and (None, "only here, under no id at all") in map(tuple, near)


def test_kept_columns_with_clashing_names(spark, docs):
    """A kept column with the name of a result gives way to it; all others stay."""
    keep = tuple(docs.columns)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    model = public_tokenizers.path(queries.PIECE_MODEL)
    made = {
        "score predicted": toxicity.score(spark, docs, labels, keep=keep),
        "n_bytes n_tokens": token_count.count_tokens(spark, docs, model, keep=keep),
        "ids decoded": byte_bpe.encode(spark, docs, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN, keep=keep, decoded=True),
        "text n_chars": html_text.extract(docs, html="text", keep=keep),
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed": quality_rules.base_rules(docs, keep),
    }
    for results, df in made.items():
        rest = [c for c in CLASH if c not in results.split()]
        assert sorted(df.columns) == sorted({*docs.columns, *results.split()})
        assert df.count() == docs.count() and df.where(" OR ".join(f"`{c}` <> 'own {c}'" for c in rest)).count() == 0


def test_repeated_ids_have_verdicts_of_their_own(spark):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    body = lambda k: " ".join(f"w{name(k)}{name(i)}" for i in range(60))
    shared = [f"shared line {chr(97 + i)} here" for i in range(2)]
    rows = [(100 + i, "\n".join([*shared, body(i)]), "h") for i in range(12)]
    rows += [(0, "\n".join([shared[0], body(50)]), "h"), (0, "\n".join([*shared, body(51)]), "h"), (0, body(52), "h"), (None, shared[0], "h")]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r["n_boilerplate_words"] for r in out.where("doc_id = 0").collect()) == [0, 4, 8]
    assert out.where("doc_id IS NULL").first()["n_boilerplate_words"] == 4


def test_chunks_in_all_scripts(spark):
    """Long texts of any script have many chunks, so that none moves as a whole."""
    rng = np.random.default_rng(3)
    scripts = {"latin": (97, 122), "cyrillic": (0x430, 0x44F), "greek": (0x3B1, 0x3C9), "arabic": (0x627, 0x64A), "hindi": (0x905, 0x939), "thai": (0xE01, 0xE2E), "chinese": (0x4E00, 0x9F00), "kana": (0x3041, 0x3090), "hangul": (0xAC00, 0xD7A0), "emoji": (0x1F600, 0x1F64F)}
    rows = [(k, "".join(map(chr, rng.integers(a, b, 20_000)))) for k, (a, b) in scripts.items()]
    df = spark.createDataFrame(rows, "name string, text string")
    found = {r["name"]: r["n"] for r in df.select("name", F.size(exact_dedup.chunks(F.col("text"))).alias("n")).collect()}
    assert min(found.values()) > 100, found


def test_scores_by_plain_dictionaries(spark, sf):
    """op5 on all documents, against a plain computation with two dictionaries of zstandard and the same weights."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_rows(docs, labels))
    got = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in queries.op5_toxicity(spark, sf).collect()}
    size = {}
    for kind in ("ordinary", "toxic"):
        parameters = zstandard.ZstdCompressionParameters(window_log=13, hash_log=12, chain_log=12, search_log=1, min_match=5, target_length=16, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[kind], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
        size[kind] = lambda w, c=plain: len(c.compress(w))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        saved, run = [], ""
        for word in text.lower().encode().split():
            run = run + b" " + word if run else word
            if len(run) + 1 >= toxicity.WINDOW:
                saved.append(size["ordinary"](b" " + run + b" ") - size["toxic"](b" " + run + b" "))
                run = ""
        if run:
            saved.append(size["ordinary"](b" " + run + b" ") - size["toxic"](b" " + run + b" "))
        saved = saved or [0]
        top = [min(max(v, 0), 10) for v in sorted(saved, reverse=True)[:3]]
        over = sum(v >= 4 for v in saved)
        x = [*top, *[0] * (3 - len(top)), math.log1p(over), over / math.sqrt(len(saved)), math.log1p(len(saved))]
        z = model["bias"] + sum((a - m) / s * w for a, m, s, w in zip(x, model["mean"], model["scale"], model["weights"], strict=True))
        assert abs(got[i][0] - 1 / (1 + math.exp(-z))) < 1e-9
        assert got[i][1] == (got[i][0] >= 0.5) and got[i][2] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_rates_by_brute_force(spark, sf):
    """op2 on all documents: posteriors by a plain naive Bayes over the same features, and totals that meet their targets."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    domains = list(mixing.TARGETS)
    label = {r["doc_id"]: "toxic" if r["toxic"] == 1 else "low" if r["quality"] == 0 else "clean" for r in labels.collect()}
    features = {r["doc_id"]: set(r["f"]) for r in docs.select("doc_id", mixing.features(mixing.text_of()).alias("f")).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for i, f in features.items():  # the features themselves
        words = [w for w in text[i].lower().replace("\n", " ").split(" ")]
        assert {w[:5] for w in words if not any(c in w for c in "\t\r\x0b\x0c")} <= f
    fitted = [i for i in features if i in label]
    n = {d: sum(label[i] == d for i in fitted) for d in domains}
    total = sum(n.values())
    counts = {}
    for i in fitted:
        for f in features[i]:
            counts.setdefault(f, dict.fromkeys(domains, 0))[label[i]] += 1

    def odd(c):
        every = sum(c.values())
        return sum((c[d] - every * (n[d] / total)) ** 2 / (every * (n[d] / total) + 1) for d in domains)

    best = sorted((f for f, c in counts.items() if sum(c.values()) >= mixing.SUPPORT and odd(c) >= mixing.SIGNIFICANCE), key=lambda f: (-odd(counts[f]), f))[: mixing.FEATURES]
    share = {f: {d: min((counts[f][d] + mixing.SMOOTHING * sum(counts[f].values()) / total + 0.5) / (n[d] + mixing.SMOOTHING + 1), 0.999) for d in domains} for f in best}
    tokens = dict.fromkeys(domains, 0.0)
    budget = 0
    for r in queries.op2_mixing(spark, sf).collect():
        logit = {d: math.log((n[d] + 1) / (total + len(domains))) + sum(math.log(share[f][d] if f in features[r["doc_id"]] else 1 - share[f][d]) for f in best) for d in domains}
        top = max(logit.values())
        odds = {d: math.exp(v - top) for d, v in logit.items()}
        for d in domains:
            assert abs(r[f"p_{d}"] - odds[d] / sum(odds.values())) < 1e-6
            tokens[d] += r["rate"] * r["n_tokens"] * r[f"p_{d}"]
        assert r["n_tokens"] == len([w for w in text[r["doc_id"]].split() if w]) or not text[r["doc_id"]].isascii()
        assert r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
        budget += r["n_tokens"]
    report: dict = {}
    mixing.mixing_rates(docs, labels, report=report).count()
    assert report["budget"] == budget and np.allclose([tokens[d] for d in domains], report["totals"], rtol=1e-6)


def test_run_equals_stages_in_turn(spark, sf):
    """run() gives the rows of its stages, one after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    digest = lambda df: hashlib.sha256(json.dumps(sorted(map(str, df.collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, sf)) == digest(docs)
