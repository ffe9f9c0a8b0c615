"""Phrase collocations: exact counts of word n-grams by counting quotient filters, scored at their weakest cut.

A-Z are lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into words. All
counts are per language. A phrase can be frequent only if its words and all phrases within it are, so frequent words get
ids first, and texts are stored once as ids with a 0 wherever a piece ends or a rarer word stands. For each length from
two words up each task counts the n-grams whose two parts of one word less may be frequent, in a counting quotient
filter, and sends its pieces by bucket; a bucket's pieces are merged in one task and phrases below the threshold leave.
The occupied quotients of what stays, 64 MB at most, go to the tasks of the next length: where they say yes in error the
exact count decides. Buckets hold about BUCKET words' n-grams, so memory stays bounded however many texts there are.

Ids are looked up in a broadcast table of up to ``common.SMALL`` frequent words; beyond that each text is joined with
the words it holds, with the same result. Null texts have no words, a null language is ``und``; empty texts and tables
give no phrases, repeated rows count each time, other columns are not read. Texts are read whole, in parts of a MiB.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.llm import common, quotient
from quarrykit.llm.common import LOWER, UPPER, numbered, small, stored, table
from quarrykit.llm.quotient import Packing

LEAST, LONGEST, TOP, WITHIN = 100, 5, 2000, 100
NO_LANG = "und"
#: Words for each bucket; n-grams a task holds before it makes them one filter; keys of its word counts.
BUCKET, HELD, KEYS = 1 << 23, 1 << 21, 1 << 19
#: Bits of the quotients that go to all tasks at most, and those that Spark's bitmap functions put in one row.
SLOTS, ROW = 29, 1 << 15
ENDS = b".,;:!?\n\v\f\r"
MARKED = bytes.maketrans(ENDS + b"\t", b"." * len(ENDS) + b" ")


def parts(raw: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A marked text cut at spaces into parts of about ``most`` bytes."""
    at = 0
    while len(raw) - at > most:
        end = raw.find(b" ", at + most)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def marked_words(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in parts, a full stop where a piece ends."""
    for part in parts((raw or b"").lower().translate(MARKED)):  # of bytes, lower() changes A-Z alone
        yield part.replace(b".", b" . ").split()


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n); the empty word stands for all words of a language."""
    found: defaultdict[str, Counter] = defaultdict(Counter)

    def said() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, c in found.items() for word, n in (*c.items(), (b"", c.total()))]
        found.clear()
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        for lang, raw in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            for words in marked_words(raw.as_py()):
                found[lang].update(words)
                found[lang].pop(b".", None)
            if sum(map(len, found.values())) > KEYS:
                yield said()
    yield said()


def frequent_words(texts: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, a, n) of words that stand ``least`` times in their language; n counts all its words."""
    each = texts.mapInArrow(word_counts, "lang string, word binary, n long")
    counted = stored(each.groupBy("lang", "word").agg(F.sum("n").alias("a")).filter((F.col("a") >= least) | (F.length("word") == 0)), "phrases-counts")
    totals = counted.filter(F.length("word") == 0).select("lang", F.col("a").alias("n"))
    words = numbered(counted.filter(F.length("word") > 0), "phrases-words", "id")
    return words.join(small(totals), "lang").select((F.col("id") + 1).cast("int").alias("id"), "lang", F.col("word").cast("string").alias("word"), "a", "n")


class Known(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def ids_of(raw: bytes, known: Known) -> np.ndarray:
    """The ids of a text, with single zeros between runs of two or more known words."""
    found = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in marked_words(raw)]
    ids = np.concatenate(([0], *found, [0])).astype(np.int32)
    there = ids != 0
    ids[1:-1][there[1:-1] & ~there[:-2] & ~there[2:]] = 0
    there = ids != 0
    return ids[1:][there[1:] | there[:-1]]


def encoded(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(ids): texts as ids of frequent words; texts without two such words in a row may be left out."""
    few, known = words.count() <= common.SMALL, None
    if few:
        of_lang: defaultdict[str, Known] = defaultdict(Known)
        for r in words.select("id", "lang", F.col("word").cast("binary").alias("word")).toLocalIterator():
            of_lang[r["lang"]][bytes(r["word"])] = r["id"]
        known = texts.sparkSession.sparkContext.broadcast(dict(of_lang))
        asked = texts
    else:  # each text with a map of its own frequent words
        rows = stored(texts.withColumn("_row", F.monotonically_increasing_id()), "phrases-texts")
        plain = F.translate(F.col("text").cast("string"), UPPER + ENDS.decode() + "\t", LOWER + " " * (len(ENDS) + 1))
        held = rows.select("_row", "lang", F.explode(F.array_distinct(F.split(plain, " "))).alias("word"))
        maps = held.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("_row").agg(F.collect_list(F.struct(F.col("word").cast("binary").alias("word"), "id")).alias("own"))
        asked = rows.join(maps, "_row").select("lang", "text", "own")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.int32)]
            for i, lang in enumerate(batch["lang"].to_pylist()):
                mine = known.value.get(lang) if few else Known((x["word"], x["id"]) for x in batch["own"][i].as_py())
                if mine and (raw := batch["text"][i].as_py()):
                    out.append(ids_of(raw, mine))
            ends = np.cumsum([len(x) for x in out])
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))], ["ids"])

    return stored(asked.mapInArrow(encode, "ids array<int>"), "phrases-ids")


def counted(texts: DataFrame, n: int, bits: int, least: int, top: int, shorter: tuple[int, np.ndarray] | None) -> DataFrame:
    """(ids, a, slot) of the phrases of n words that stand ``least`` times; slot is the quotient's first SLOTS bits.

    ``shorter``: bits of a quotient and which of them phrases of n - 1 words occupy; none: any words may be a phrase.
    """
    packing, inner = Packing(n, bits), Packing(n - 1, bits)
    top, slots = min(top, packing.widths[0]), min(SLOTS, packing.widths[0])
    there = texts.sparkSession.sparkContext.broadcast(shorter)

    def starts_of(ids: np.ndarray) -> np.ndarray:
        """Where n words in a row begin whose parts may be frequent."""
        zeros = np.concatenate(([0], np.cumsum(ids == 0)))
        whole = lambda k: zeros[k:] == zeros[: len(zeros) - k]
        if there.value is None or len(ids) < n:
            return np.flatnonzero(whole(n)) if len(ids) >= n else np.zeros(0, np.int64)
        width, occupied = there.value
        at = np.flatnonzero(whole(n - 1))
        slot = inner.quotient(inner.pack(ids, at), width).astype(np.int64)
        may = np.zeros(len(ids) + 1, bool)
        may[at] = (occupied[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        return np.flatnonzero(may[:-1] & may[1:] & np.concatenate((whole(n), np.zeros(n - 1, bool))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def sent() -> pa.RecordBatch:
            rows = list(quotient.pieces(packing, *quotient.merged(held), top))
            held.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "piece"])

        for batch in batches:
            ids = batch["ids"].flatten().to_numpy().astype(np.uint64)
            for a in range(0, len(ids), HELD):
                part = ids[a : a + HELD + n - 1]  # a window belongs to the part in which it begins
                starts = starts_of(part)
                starts = starts[starts < HELD]
                held.append((packing.pack(part, starts), np.ones(len(starts), np.int64)))
                if sum(len(h[1]) for h in held) >= HELD:
                    held[:] = [quotient.merged(held)]
                    if len(held[0][1]) > HELD // 2:
                        yield sent()
        if held:
            yield sent()

    def merge(key: tuple, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = key[0].as_py(), []
        for batch in pieces:
            for blob in batch["piece"]:
                held.append(quotient.read(packing, blob.as_py(), bucket, top))
                if len(held) > 1 and sum(len(h[1]) for h in held[1:]) >= HELD:
                    held[:] = [quotient.merged(held)]
        limbs, counts = quotient.merged(held)
        many = counts >= least
        limbs, counts = [x[many] for x in limbs], counts[many]
        ids = packing.unpack(limbs)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, n, dtype=np.int32)), pa.array(ids.ravel()))
        yield pa.record_batch([rows, pa.array(counts), pa.array(packing.quotient(limbs, slots).astype(np.int64))], ["ids", "a", "slot"])

    return texts.mapInArrow(count, "bucket int, piece binary").groupBy("bucket").applyInArrow(merge, "ids array<int>, a long, slot long")


def occupied(phrases: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Which of the quotients of phrases, slots of ``width`` bits, are taken: about 16 of them for each phrase, 2^SLOTS at most."""
    bits = min(width, max(15, (16 * phrases.count()).bit_length()))
    slot = F.shiftright("slot", width - bits) + 1
    rows = phrases.groupBy(F.bitmap_bucket_number(slot).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    found = np.zeros(max(1 << bits, ROW) // 8, np.uint8)
    for r in rows:
        at = (r["row"] - 1) * ROW // 8
        whole = np.frombuffer(bytes(r["bits"]), np.uint8)
        found[at : at + len(whole)] = whole[: len(found) - at]
    return bits, found


def frequent_phrases(docs: DataFrame, text: str, lang: str, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, a, n) of frequent words and (ids, a) of frequent phrases of two words or more."""
    texts = docs.select(F.coalesce(lang, F.lit(NO_LANG)).alias("lang"), F.col(text).cast("binary").alias("text")).filter("text is not null")
    words = stored(frequent_words(texts, least), "phrases-frequent")
    size, bits = words.agg(F.count("*"), F.max("id")).first()
    total = words.groupBy("lang").agg(F.first("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    top = max(5, (total // BUCKET).bit_length())
    bits = max(bits or 0, 1).bit_length()
    ids, found, shorter = encoded(texts, words), [], None
    for n in range(2, longest + 1):
        found.append(stored(counted(ids, n, bits, least, top, shorter), "phrases-found"))
        shorter = occupied(found[-1], min(SLOTS, Packing(n, bits).widths[0])) if n < longest else None
    return words, reduce(DataFrame.unionByName, found).select("ids", "a")


def scored(words: DataFrame, phrases: DataFrame, within: int = WITHIN) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases that no longer one holds in ``within`` percent of their occurrences or more.

    A longer phrase that holds one so often has a part of one word more than it that does so too, so that only phrases of
    one word more are looked at.
    """
    counts = small(words.select(F.array("id").alias("part"), F.col("a").alias("f")).unionByName(phrases.select(F.col("ids").alias("part"), F.col("a").alias("f"))))
    size = F.size("ids")
    cut = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.join(counts.select(F.col("part").alias("left"), F.col("f").alias("l")), F.slice("ids", F.lit(1), F.col("k")) == F.col("left"))
    cut = cut.join(counts.select(F.col("part").alias("right"), F.col("f").alias("r")), F.slice("ids", F.col("k") + 1, size - F.col("k")) == F.col("right"))
    of_lang = small(words.select("id", "lang", "n"))
    cut = cut.join(of_lang, F.col("ids")[0] == F.col("id"))
    number = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) * 1000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    best = cut.groupBy("ids", "a", "lang", "n").agg(weakest).select("ids", "a", "lang", "n", "w.l", "w.r", "w.score")
    longer = phrases.filter(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), F.col("a").alias("f"))
    held = longer.groupBy("ids").agg(F.max("f").alias("f")).join(phrases, "ids").filter(100 * number("f") >= within * number("a")).select("ids")
    kept = best.join(small(held), "ids", "left_anti")
    spelled = kept.select("*", F.posexplode("ids").alias("at", "one")).join(small(words.select(F.col("id").alias("one"), "word")), "one")
    spelled = spelled.groupBy("ids", "a", "lang", "n", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    return spelled.select("lang", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"), "a", "l", "r", "n", "score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language with their rank; first within 64 parts of it, so that no task sorts a whole one."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    few = found.withColumn("_part", F.pmod(F.hash("phrase"), F.lit(64))).withColumn("rank", place("lang", "_part")).filter(F.col("rank") <= top)
    return few.withColumn("rank", place("lang")).filter(F.col("rank") <= top).drop("_part")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(*frequent_phrases(table(spark, sf_dir, "documents"), "text", "lang"))
    return ranked(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_phrases": op11_phrases}
ORACLE_SQL = {
    "op11_phrases": f"""WITH w AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM
 (SELECT lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, any_value(m) AS m, count(*) AS a FROM
 (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS m)) GROUP BY 1, 2),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS p FROM g WHERE m >= 2 AND a >= {LEAST}),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
 FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(p[:k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(p[k + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT lang, phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, array_to_string(p[i:i + j - 1], ' ') AS phrase, max(a) AS f FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b ANTI JOIN h ON h.lang = b.lang AND h.phrase = b.phrase AND 100 * h.f >= {WITHIN} * b.a QUALIFY rank <= {TOP}"""
}
