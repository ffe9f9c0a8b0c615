"""A BM25 index on disk: written in segments, searched with upper bounds, changed by adding and deleting.

A segment holds two Parquet tables. ``postings``: a row for each term and bucket of documents, in the order of terms, so
that a search reads the row groups of its own terms; it has the documents, their term frequencies and lengths as arrays,
and beside them how many they are, the greatest frequency and the least length, which bound every score in the row.
``docs``: key, length, hash of the text and tokens of each document, joined by spaces; postings are made of it. Documents are dealt to buckets of about
BUCKET by a hash of their key, the same for all terms, so a bucket's bounds of the query's terms add up to a bound of its
documents' scores.

Deleted documents are listed with their terms; they leave results and statistics at once, and their postings when
segments are merged. The newest row of ``versions`` says which segments and deletions make the index; it is one file that
appears whole, so a reader sees the state before or after a change. Changes are one writer's business: of two at a time
the second fails, for it would write the same version.

Keys must not be null and stand once; null texts and texts without terms count as documents of no length.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.functions.hygiene import chunk_hash, tokens
from quarrykit.operators.retrieve import EPSILON, K1, B

BUCKET = 256
#: Rows that are broadcast or become literals at most.
FEW, LITERALS = 1_000_000, 4096
STATE = "version long, docs long, tokens long, segments array<struct<name: string, buckets: int>>, deleted array<string>"


def part(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def postings(docs: pa.Table) -> pa.Table:
    """The rows of one bucket, a row for each term, of its documents (bucket, key, dl, words), in the order of keys."""
    docs = docs.sort_by("key").combine_chunks()
    many, lists = docs.num_rows, pc.split_pattern(docs["words"].combine_chunks(), " ")
    terms = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(many), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    pairs, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * many + row, return_counts=True)
    term, row = np.divmod(pairs, many)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    offsets, dl = pa.array(np.append(starts, len(term)), pa.int32()), docs["dl"].to_numpy()[row]
    listed = [pa.ListArray.from_arrays(offsets, c) for c in (docs["key"].combine_chunks().take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl, pa.int32()))]
    numbers = [np.full(len(starts), docs["bucket"][0].as_py()), np.diff(np.append(starts, len(term))), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)]
    return pa.table([terms.dictionary.take(pa.array(term[starts])), *[pa.array(x, pa.int32()) for x in numbers], *listed], ["term", "bucket", "n", "most", "least", "keys", "tfs", "dls"])


@dataclass
class Found:
    """One search: rows (key, score), and how many posting rows its terms have and how many of them were read."""

    hits: DataFrame
    rows: int
    read: int


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "key", text: str = "text", bucket: int = BUCKET) -> None:
        self.spark, self.path, self.key, self.text, self.bucket = spark, path, key, text, bucket

    # -- state -----------------------------------------------------------------------------------------------------

    def state(self) -> dict:
        try:
            found = self.spark.read.schema(STATE).parquet(f"{self.path}/versions").orderBy(F.desc("version")).first()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            found = None
        return found.asDict(recursive=True) if found else {"version": 0, "docs": 0, "tokens": 0, "segments": [], "deleted": []}

    def swap(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        row = self.spark.createDataFrame([tuple(state[f.split(":")[0].split()[0]] for f in ("version", "docs", "tokens", "segments", "deleted"))], STATE)
        row.coalesce(1).write.parquet(f"{self.path}/versions/at={state['version']}")

    def read(self, state: dict, what: str, names: list[str] | None = None) -> DataFrame:
        """A table of all segments, or of all deletions, with the segment's name."""
        names = names if names is not None else [s["name"] for s in state["segments"]]
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{what}/segment={n}" for n in names])

    def deletions(self, state: dict) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/deleted/{n}" for n in state["deleted"]]) if state["deleted"] else None

    def live(self, state: dict) -> DataFrame:
        """(key, dl, hash, words, segment) of the documents that are there."""
        docs, gone = self.read(state, "docs"), self.deletions(state)
        return docs if gone is None else docs.join(few(gone.select("segment", self.key)), ["segment", self.key], "left_anti")

    # -- changes ---------------------------------------------------------------------------------------------------

    def write(self, docs: DataFrame) -> tuple[str, int, int, int]:
        """A segment of docs (key, dl, hash, words): its name, buckets, documents and tokens.

        Texts are shuffled once, by bucket; what is put in the order of terms is a row for each term and bucket.
        """
        name = uuid.uuid4().hex
        docs.select(self.key, "dl", "hash", "words").write.parquet(f"{self.path}/docs/segment={name}")
        docs = self.spark.read.parquet(f"{self.path}/docs/segment={name}")
        size, length = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        buckets = -(-size // self.bucket)
        dealt = docs.filter("dl > 0").select(F.pmod(F.xxhash64(self.key), F.lit(max(buckets, 1))).cast("int").alias("bucket"), F.col(self.key).alias("key"), "dl", "words")
        schema = T.StructType().add("term", T.StringType()).add("bucket", T.IntegerType()).add("n", T.IntegerType()).add("most", T.IntegerType()).add("least", T.IntegerType()).add("keys", T.ArrayType(docs.schema[self.key].dataType)).add("tfs", T.ArrayType(T.IntegerType())).add("dls", T.ArrayType(T.IntegerType()))
        # to the order of terms from files, as ranges are taken from a run of their own
        dealt.groupBy("bucket").applyInArrow(postings, schema).write.parquet(f"{self.path}/staged/segment={name}")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/staged/segment={name}")
        rows.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.parquet(f"{self.path}/postings/segment={name}")
        return name, buckets, size, length

    def add(self, docs: DataFrame, dedup: bool = False) -> int:
        """Add documents as one segment and return how many; with ``dedup`` only the first by key of each text the index lacks."""
        state = self.state()
        new = docs.select(self.key, F.col(self.text).alias("text"))
        if dedup:
            first = new.groupBy(chunk_hash(F.coalesce("text", F.lit(""))).alias("hash")).agg(F.min(self.key).alias(self.key))
            first = first if not state["segments"] else first.join(self.live(state).select("hash"), "hash", "left_anti")
            new = new.join(few(first.select(self.key)), self.key, "left_semi")
        keys = new.select(self.key).groupBy(self.key).count()
        if state["segments"]:
            keys = keys.unionByName(self.live(state).select(self.key, F.lit(1).cast("long").alias("count")))
        clash = keys.groupBy(self.key).agg(F.sum("count").alias("n")).filter((F.col("n") > 1) | F.col(self.key).isNull()).first()
        if clash:
            raise ValueError(f"key {clash[self.key]} is null, stands twice or is in the index")
        return self._add(state, new)

    def _add(self, state: dict, new: DataFrame) -> int:
        # a lambda over one element: the tokens are made once a row
        marked = new.select(self.key, chunk_hash(F.coalesce("text", F.lit(""))).alias("hash"), F.transform(F.array(tokens(F.col("text"))), lambda ts: F.struct(F.size(ts).alias("dl"), F.array_join(ts, " ").alias("words")))[0].alias("_t"))
        name, buckets, size, length = self.write(marked.select(self.key, "_t.dl", "hash", "_t.words"))
        if size:
            self.swap(state | {"docs": state["docs"] + size, "tokens": state["tokens"] + length, "segments": [*state["segments"], {"name": name, "buckets": buckets}]})
        return size

    def delete(self, keys: DataFrame) -> int:
        """Take the documents of these keys out of results and statistics; unknown keys do nothing."""
        state = self.state()
        if not state["segments"]:
            return 0
        name = uuid.uuid4().hex
        self.live(state).join(few(keys.select(self.key).distinct()), self.key, "left_semi").select("segment", self.key, "dl", F.array_distinct(F.split("words", " ")).alias("terms")).write.parquet(f"{self.path}/deleted/{name}")
        gone = self.spark.read.parquet(f"{self.path}/deleted/{name}").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
        if gone["n"]:
            self.swap(state | {"docs": state["docs"] - gone["n"], "tokens": state["tokens"] - gone["dl"], "deleted": [*state["deleted"], name]})
        return gone["n"]

    def upsert(self, docs: DataFrame) -> int:
        """Put documents in the place of those of their keys."""
        self.delete(docs)
        return self.add(docs)

    def merge(self) -> None:
        """Rewrite all segments as one without what was deleted; old files stay for readers who began before."""
        state = self.state()
        if len(state["segments"]) + len(state["deleted"]) < 2:
            return
        if not state["docs"]:
            return self.swap(state | {"segments": [], "deleted": []})
        name, buckets, _, _ = self.write(self.live(state))
        self.swap(state | {"segments": [{"name": name, "buckets": buckets}], "deleted": []})

    # -- search ----------------------------------------------------------------------------------------------------

    def search(self, query: list[str], k: int = 10, first: int = 8) -> Found:
        """The k best documents (key, score), without those that score nothing; terms count as often as they stand in ``query``.

        The ``first`` buckets of highest bound are scored at once: their k-th score is one that the k best reach. Then only
        buckets whose bound reaches it are read.
        """
        state, times = self.state(), Counter(query)
        none = self.spark.createDataFrame([], self.read(state, "docs").select(self.key).schema if state["segments"] else f"{self.key} long").withColumn("score", F.lit(0.0))
        if not state["segments"] or not times:
            return Found(none, 0, 0)
        rows, gone = self.read(state, "postings").filter(F.col("term").isin(*times)), self.deletions(state)
        df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if gone is not None:
            lost = gone.select(F.explode(F.filter("terms", lambda t: t.isin(*times))).alias("term")).groupBy("term").count()
            df = {t: n - lost for t, n, lost in ((t, n, found.get(t, 0)) for found in [dict(map(tuple, lost.collect()))] for t, n in df.items())}
        n, average = float(state["docs"]), state["tokens"] / max(state["docs"], 1) or 1.0
        idf = {t: F.greatest(F.log((F.lit(n) - d + 0.5) / (F.lit(float(d)) + 0.5) + 1), F.lit(EPSILON)) * times[t] for t, d in df.items()}
        if not idf:
            return Found(none, 0, 0)
        weight = F.element_at(F.create_map(*[x for t, w in idf.items() for x in (F.lit(t), w)]), F.col("term"))
        bound = weight * part(F.col("most").cast("double"), F.col("least"), average)
        # a hair more, so that sums in another order do not fall below what they bound
        bounds = rows.groupBy("segment", "bucket").agg((F.sum(bound) * (1 + 1e-9)).alias("bound"), F.count("*").alias("rows"))

        def best(some: DataFrame) -> DataFrame:
            each = some.select("segment", "term", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p")).select("segment", F.col("p.keys").alias(self.key), (weight * part(F.col("p.tfs").cast("double"), F.col("p.dls"), average)).alias("s"))
            scored = each.groupBy("segment", self.key).agg(F.sum("s").alias("score"))
            scored = scored if gone is None else scored.join(few(gone.select("segment", self.key)), ["segment", self.key], "left_anti")
            return scored.select(self.key, "score").orderBy(F.desc("score"), self.key).limit(k)

        def within(chosen: list) -> Column:
            return F.struct("segment", "bucket").isin(*[F.struct(F.lit(r["segment"]), F.lit(r["bucket"])) for r in chosen]) & F.col("bucket").isin(*{r["bucket"] for r in chosen})

        least = best(rows.filter(within(bounds.orderBy(F.desc("bound"), "segment", "bucket").limit(first).collect()))).collect()
        enough = least[-1]["score"] if len(least) == k else 0.0
        kept = bounds.filter(F.col("bound") >= enough)
        total = bounds.agg(F.sum("rows"), F.sum(F.when(F.col("bound") >= enough, F.col("rows"))), F.count_if(F.col("bound") >= enough)).first()
        chosen = rows.filter(within(kept.collect())) if total[2] <= LITERALS else rows.join(few(kept.select("segment", "bucket")), ["segment", "bucket"], "left_semi")
        return Found(best(chosen), total[0], total[1])
