"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the n-grams (a letter run with its edges) of a bounded sample of labelled texts per language; those that
a language's sample holds once only, such as typing errors, are left out. A language contains an n-gram whose rate in it is at least MIN_RATE and MIN_SHARE of the highest rate in any language.
The filters of all languages lie side by side: slot s holds one bit per language, so the AND of the slots of an
n-gram is the bitmask of all languages that contain it. Of a text, the n-grams with each bit are counted, the counts
are corrected for the filter's false positives, and the highest decides. The score is its share of all counts.

Only text and language labels are learned from. Null texts and those without letters are 'und' with score 0; ties go
to the first language in code-point order; rows with null language are not learned from but are predicted; with no
labelled row at all every text is 'und'. Whole texts are read, long ones in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import pieces, table

NGRAM, MIN_RATE, MIN_SHARE = 3, 2e-6, 0.05
#: At most about this many labelled texts per language are learned from, chosen by hash.
SAMPLE = 2000
#: Slots of 8 bytes per n-gram of the sample, at least; a filter has 2 ** k of them.
SLOTS_PER_GRAM = 16
#: Odd factors, of whose products with an n-gram's hash the highest bits are its slots.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double, coverage double"


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, alpha: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a lower-cased text that starts with a blank, and where each ends."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = alpha[code]
    at = np.flatnonzero(letter | np.concatenate(([True], letter[:-1])))
    letter = letter[at]
    code = np.where(letter, code[at], 32).astype(np.uint64)
    many = len(code) - n + 1
    if many <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, inner = np.zeros(many, np.uint64), np.ones(many, bool)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : i + many]
        if 0 < i < n - 1:
            inner &= letter[i : i + many]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31)))[inner], at[n - 1 :][inner]


def batches_of(texts: pd.Series, most: int = 1 << 18) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts joined to about ``most`` characters: the lower-cased string, where each part starts, whose it is."""
    parts, starts, owner, length = [], [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, most) if text else ():
            part = " " + piece.lower() + " "
            parts.append(part)
            starts.append(length)
            owner.append(i)
            length += len(part)
            if length >= most:
                yield "".join(parts), np.array(starts), np.array(owner)
                parts, starts, owner, length = [], [], [], 0
    if parts:
        yield "".join(parts), np.array(starts), np.array(owner)


class Filter:
    """Bit-sliced Bloom filters: ``slots[s]`` has bit l of language l."""

    def __init__(self, langs: list[str], found: pd.DataFrame) -> None:
        """found: (lang, gram, n)."""
        self.langs = langs
        rate = found["n"] / found.groupby("lang")["n"].transform("sum")
        contains = (rate >= MIN_RATE) & (rate >= MIN_SHARE * rate.groupby(found["gram"]).transform("max"))
        kept = found[contains]
        self.bits = max(10, int(SLOTS_PER_GRAM * max(1, kept["gram"].nunique())).bit_length())
        # 64 languages to a plane
        self.planes = np.zeros(((len(langs) + 63) // 64, 1 << self.bits), np.uint64)
        for k, lang in enumerate(langs):
            h = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
            for at in self.places(h):
                self.planes[k // 64][at] |= np.uint64(1 << k % 64)
        full = [np.count_nonzero(self.planes[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / (1 << self.bits) for k in range(len(langs))]
        self.false = np.array(full) ** len(FACTORS)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [h * np.uint64(f) >> np.uint64(64 - self.bits) for f in FACTORS]

    def counts(self, h: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Per owner the number of n-grams, and of those that each language contains."""
        places, found = self.places(h), np.zeros((owners, len(self.langs)), np.int64)
        for p, plane in enumerate(self.planes):
            mask = plane[places[0]]
            for at in places[1:]:
                mask &= plane[at]
            for k in range(64 * p, min(64 * p + 64, len(self.langs))):
                found[:, k] = np.bincount(owner[(mask >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=owners)
        return np.bincount(owner, minlength=owners), found

    def predict(self, texts: pd.Series, alpha: np.ndarray) -> pd.DataFrame:
        total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)), np.int64)
        for text, starts, owner in batches_of(texts):
            h, at = grams(text, alpha)
            n, found = self.counts(h, np.searchsorted(starts, at, "right") - 1, len(starts))
            np.add.at(total, owner, n)
            np.add.at(hits, owner, found)
        true = np.clip((hits - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None)
        best, total_true = true.argmax(axis=1), true.sum(axis=1)
        top = true[np.arange(len(texts)), best]
        known = total > 0
        lang = np.where(known, np.array(self.langs, object)[best], UNKNOWN)
        score = np.where(total_true > 0, top / np.maximum(total_true, 1e-9), 0.0)
        return pd.DataFrame({"lang_pred": lang, "score": np.where(known, score, 0.0), "coverage": np.minimum(top / np.maximum(total, 1), 1.0)})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(rows: DataFrame, sample: int = SAMPLE) -> Filter | None:
    """rows: (text, lang, pick), pick a number that chooses evenly. The n-grams of a sample bounded per language come to the driver."""
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alpha = letters()
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                for text, _, _ in batches_of(texts, 1 << 20):
                    gram, n = np.unique(grams(text, alpha)[0].view(np.int64), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    picked = rows.filter(F.pmod(F.xxhash64("pick"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    found = picked.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1").toPandas()
    return Filter(sorted(sizes), found)


def identify(docs: DataFrame, model: Filter | None) -> DataFrame:
    """The columns of ``docs`` (it needs a text) with lang_pred, score and coverage, the share of n-grams that the language has."""
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 32 slots for each n-gram of the bounded sample

    @F.pandas_udf(SCHEMA)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        alpha = letters()
        for batch in texts:
            yield shared.value.predict(batch, alpha)

    return docs.withColumn("_said", predict(F.col("text"))).select(*docs.columns, "_said.lang_pred", "_said.score", "_said.coverage")


def trained(docs: DataFrame) -> Filter | None:
    return learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang", F.col("doc_id").alias("pick")))


def op5_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = identify(docs.select("doc_id", "text"), trained(docs))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_identify_language": op5_identify_language}
#: None: a learned model; tests measure held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
