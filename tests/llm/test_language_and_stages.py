"""Language filters against sets of n-grams; the pipeline's language and mixing stages against plain counts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrykit.llm import language, mixing

FOLDER = "/root/testdata/sf0.01"


def plain_grams(text):
    """Letter runs of a text with their edges, three characters at a time."""
    return [f" {run} "[i : i + 3] for run in re.findall(r"[^\W\d_]+", text.lower()) for i in range(len(run))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


def test_filters_hold_what_sets_hold(rows):
    """No n-gram of a language is missed, others are found as often as the filter's own rate says, and the counts decide alike."""
    alpha, texts = language.letters(), [t for t in rows["text"] if t and not re.search(r"[^\W\d_]", re.sub(r"[A-Za-zÀ-ÿß]", "", t))]
    hash_of = {}
    for t in texts:
        h, _ = language.grams(" " + t.lower() + " ", alpha)
        grams = plain_grams(t)
        assert len(h) == len(grams)
        hash_of.update(zip(grams, h.view(np.int64).tolist(), strict=True))
    counts = defaultdict(Counter)
    for t, lang in zip(rows["text"], rows["lang"], strict=True):
        if t in set(texts[:200]):
            counts[lang].update(plain_grams(t))
    found = pd.DataFrame([(lang, hash_of[g], n) for lang, c in counts.items() for g, n in c.items() if n > 1], columns=["lang", "gram", "n"])
    model = language.Filter(sorted(counts), found)
    rate = {lang: {g: n / sum(k for k in c.values() if k > 1) for g, n in c.items() if n > 1} for lang, c in counts.items()}
    top = Counter()
    for r in rate.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    sets = {lang: {g for g, x in r.items() if x >= language.MIN_RATE and x >= language.MIN_SHARE * top[g]} for lang, r in rate.items()}
    wrong = asked = 0
    said = model.predict(pd.Series(texts), alpha)["lang_pred"].tolist()
    for t, pred in zip(texts, said, strict=True):
        grams = plain_grams(t)
        h = np.array([hash_of[g] for g in grams], np.int64).view(np.uint64)
        total, hits = model.counts(h, np.zeros(len(h), np.int64), 1)
        exact = np.array([sum(g in sets[lang] for g in grams) for lang in model.langs])
        assert total[0] == len(grams) and (hits[0] >= exact).all()
        wrong, asked = wrong + (hits[0] - exact).sum(), asked + (len(grams) - exact).sum()
        order = np.sort(exact)
        assert pred == model.langs[exact.argmax()] or order[-1] - order[-2] <= 0.02 * len(grams)
    assert wrong <= 3 * model.false.max() * asked + 10


def test_ties_and_repeated_rows(spark):
    alpha = language.letters()
    h = language.grams(" ab ", alpha)[0].view(np.int64).tolist()
    model = language.Filter(["aa", "bb"], pd.DataFrame([(lang, g, 5) for lang in ("aa", "bb") for g in h], columns=["lang", "gram", "n"]))
    docs = spark.createDataFrame([(1, "ab", "x"), (1, "ab", "x"), (2, None, "x"), (3, "12 .", "x")], "doc_id long, text string, _said string")
    got = language.identify(docs, model).collect()
    assert sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in got) == [(1, "aa", 0.5), (1, "aa", 0.5), (2, "und", 0.0), (3, "und", 0.0)]


def test_language_stage_drops_what_no_language_has(spark, rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10_000_001, "Съешь же ещё этих мягких французских булок да выпей чаю", None, "s", 5), (10_000_002, "12345 --- 678", None, "s", 5), (10_000_003, None, None, "s", 0), (10_000_004, "zqx wvk jqz xkw qqj zzx", None, "s", 5)]
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), FOLDER).select("doc_id").collect()}
    assert not kept & {r[0] for r in odd}
    letters = [i for i, t in zip(rows["doc_id"], rows["text"], strict=True) if len(re.findall(r"[^\W\d_]", t or "")) > 20]
    assert len(kept & set(letters)) > 0.99 * len(letters)


def test_mixing_stage_writes_what_the_mix_takes(spark, rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, FOLDER).select("doc_id").collect())
    plan = mixing.mix(docs).select("doc_id", "repeats").collect()
    assert out == Counter({r["doc_id"]: r["repeats"] for r in plan if r["repeats"]}) and max(out.values()) <= mixing.MAX_REPEATS
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(rows["doc_id"], rows["text"], strict=True)}
    words, targets = Counter(), {r["source"]: r["target"] for r in mixing.mix(docs).select("source", F.col("target").cast("double")).distinct().collect()}
    for i, source in zip(rows["doc_id"], rows["source"], strict=True):
        words[source] += out[i] * size[i]
    assert all(-1 <= t - words[s] <= 0.02 * t for s, t in targets.items())


def test_fit_of_many_documents_of_one_length(spark):
    """Over a thousand documents of one length are ranked in buckets, and just as many are taken as the plan says."""
    docs = spark.createDataFrame([(i, "a b c" if i < 2500 else "x " * (i % 7 + 1), "st"[i % 2]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 1 and part["repeats"].max() - part["repeats"][part["size"] == 3].min() <= 1
