"""Collocations against a plain count, counting quotient filters against dictionaries; odd texts."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrykit.llm import common, phrases, quotient
from quarrykit.llm.quotient import Packing

FOLDER = "/root/testdata/sf0.001"


def plain(rows, least, longest=5, within=100):
    """Sorted (lang, phrase, a, l, r, n, score) by counting everything."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        for p, a in cands.items():
            score, k = min((floor(Fraction(1000 * a * n[lang], c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
            if 100 * longer[p] < within * a:
                out.append((lang, " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score))
    return sorted(out)


def mined(docs, **how):
    within = how.pop("within", 100)
    return sorted(tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "n", "score")) for r in phrases.scored(*phrases.frequent_phrases(docs, "text", "lang", **how), within).collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_given_documents(spark, monkeypatch, broadcast):
    if not broadcast:  # words are joined with the texts, all tables are shuffled; tiny filters are sent often
        monkeypatch.setattr(common, "SMALL", 0)
        monkeypatch.setattr(phrases, "HELD", 1000)
        monkeypatch.setattr(phrases, "KEYS", 50)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert mined(docs, least=20) == plain(rows, 20)
    assert mined(docs, least=50, longest=3, within=60) == plain(rows, 50, 3, 60)


def test_odd_texts(spark):
    rows = [("en", "New York, new york! NEW\tYORK\x0bnew york"), (None, "ÄB äb ÄB äb. x\x00y x\x00y"), (None, None), ("en", ""), ("fr", ". , ;"), ("en", "new york new york"), ("en", "new york new york"), ("de", "a b " * 700_000)]
    docs = spark.createDataFrame([(*r, 1, "z", 2, "w") for r in rows], "lang string, text string, id int, ids string, a int, word string")
    assert mined(docs, least=2) == plain(rows, 2)
    assert mined(docs.limit(0), least=2) == [] and mined(docs.filter("lang = 'fr'"), least=2) == []


def test_ranks(spark):
    found = [("en", f"p{i:04}", 5 + i % 3, 1, 1, 9, i // 7) for i in range(900)] + [("de", "x y", 1, 1, 1, 1, 1)] * 1
    got = phrases.ranked(spark.createDataFrame(found, "lang string, phrase string, a long, l long, r long, n long, score long"), 50).collect()
    want = [r for lang in ("de", "en") for r in [x for x in sorted(found, key=lambda r: (-r[6], -r[2], r[1])) if x[0] == lang][:50]]
    assert [(r["lang"], r["phrase"]) for r in sorted(got, key=lambda r: (r["lang"], r["rank"]))] == [(r[0], r[1]) for r in want]
    assert sorted(r["rank"] for r in got if r["lang"] == "en") == list(range(1, 51))


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 5), st.integers(1, 40), st.integers(0, 9), st.randoms(use_true_random=False))
def test_filters_keep_every_count(n, bits, top, random):
    """Pieces of several filters, written, read and merged, give back the n-grams and their counts."""
    packing = Packing(n, min(bits, 31))
    most = min((1 << packing.bits) - 1, random.choice([3, 50, 1 << 31]))
    grams = [tuple(random.randint(1, max(1, most)) for _ in range(n)) for _ in range(random.randint(0, 60))]
    top = min(top, packing.widths[0])
    parts, want = [], Counter()
    for _ in range(3):
        some = [random.choice(grams) for _ in range(random.randint(0, 80))] if grams else []
        times = np.array([random.choice([1, 2, 254, 255, 256, 10**12]) for _ in some], np.int64)
        for g, t in zip(some, times.tolist(), strict=True):
            want[g] += t
        ids = np.array([x for g in some for x in g], np.uint64)
        limbs = packing.pack(ids, np.arange(len(some)) * n)
        parts += [(b, blob) for b, blob in quotient.pieces(packing, *quotient.merged([(limbs, times)]), top)]
    got = Counter()
    for bucket in {b for b, _ in parts}:
        limbs, counts = quotient.merged([quotient.read(packing, blob, bucket, top) for b, blob in parts if b == bucket])
        for g, c in zip(packing.unpack(limbs).tolist(), counts.tolist(), strict=True):
            assert tuple(g) not in got
            got[tuple(g)] = c
    assert got == want


def test_filters_are_compact():
    """A million bigrams of 15-bit ids take half of what their bare codes and counters of four bytes each would."""
    ids = np.random.default_rng(1).integers(1, 1 << 15, 1_000_001).astype(np.uint64)
    packing = Packing(2, 15)
    limbs, counts = quotient.merged([(packing.pack(ids, np.arange(1_000_000)), np.ones(1_000_000, np.int64))])
    assert sum(len(blob) for _, blob in quotient.pieces(packing, limbs, counts, 5)) < 4.2 * len(counts)
