"""Keyword and vector search, fusion, context."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.hygiene import tokens

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def bm25(docs: DataFrame, text: str, query: list[str], k: int = 10, within: Column | None = None) -> DataFrame:
    """The columns of ``docs`` with score: the k best, without those that score nothing.

    ``query``: tokens, counted as often as they occur. Frequencies of the query's terms are taken in the row, so that
    two scans without a shuffle of postings suffice. ``within`` filters what may be returned; statistics are of all.
    """
    terms = Counter(query)
    counted = lambda ts: F.struct(F.size(ts).alias("dl"), F.array(*[F.size(F.filter(ts, F.lit(t).__eq__)) for t in terms]).alias("tf"))
    # a lambda over one element: the tokens are made once per row, however many terms ask for them
    marked = docs.withColumn("_c", F.transform(F.array(tokens(F.col(text))), counted)[0]).withColumns({"_dl": F.col("_c.dl"), "_tf": F.col("_c.tf")}).drop("_c")
    r = marked.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, average = F.lit(float(r["n"])), r["avgdl"] or 1.0
    parts = []
    for i, times in enumerate(terms.values()):
        df, tf = F.lit(float(r[f"df{i}"])), F.col("_tf")[i].cast("double")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(EPSILON))
        parts.append(times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / average)))
    scored = marked.withColumn("score", reduce(Column.__add__, parts)).filter("score > 0").drop("_dl", "_tf")
    return (scored if within is None else scored.filter(within)).orderBy(F.desc("score"), docs.columns[0]).limit(k)


def index_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, dl): the postings, to be written partitioned or sorted by term; each document has a row without a term too, for its length."""
    marked = docs.select(key, F.transform(F.array(tokens(F.col(text))), lambda ts: ts)[0].alias("_t"))
    words = marked.select(key, F.size("_t").alias("dl"), F.explode(F.array_append("_t", F.lit(None).cast("string"))).alias("term"))
    return words.groupBy("term", key, "dl").agg(F.count("term").alias("tf"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """(term, df, cf): in how many documents a term stands, and how often in all."""
    return postings.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def search_index(postings: DataFrame, key: str, query: list[str], k: int = 10) -> DataFrame:
    """(key, score) of the k best by BM25: of the postings only the query's terms and the rows of lengths are read, or made if they are not stored."""
    times = Counter(query)
    found = postings.filter(F.col("term").isin(*times))
    stats = {r["term"]: r for r in postings.filter(F.col("term").isNull() | F.col("term").isin(*times)).groupBy("term").agg(F.count("*").alias("n"), F.avg("dl").alias("av")).collect()}  # the words of one query
    every = stats.pop(None, None)
    if not stats:
        return found.select(key, F.lit(0.0).alias("score")).limit(0)
    n, average = F.lit(float(every["n"])), every["av"]
    idf = {t: F.greatest(F.log((n - float(r["n"]) + 0.5) / (F.lit(float(r["n"])) + 0.5) + 1), F.lit(EPSILON)) * times[t] for t, r in stats.items()}
    weight = F.element_at(F.create_map(*[x for t, w in idf.items() for x in (F.lit(t), w)]), F.col("term"))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    return found.groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), key).limit(k)


def best_per_group(vectors: DataFrame, column: str, query: list[float], group: str, key: str, k: int = 3) -> DataFrame:
    """(group, rank, key, score): the k nearest rows of each group."""
    scored = vectors.select(group, key, cosine(F.col(column), query).alias("score"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(group, "rank", key, "score")


def compressed(answer: Column, words: int = 150) -> Column:
    """Answers of more words: whole sentences while they fit; if not even the first does, its words and '...'. Others as they are, null as empty."""
    count = lambda s: F.size(F.array_remove(F.split(s, r"[ \t\n\x0B\f\r]+"), ""))
    parts = F.split(answer, r"(?<=[.!?])\s+")
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        fits = a["open"] & (a["n"] + count(s) <= words)
        return F.struct(F.when(fits, a["n"] + count(s)).otherwise(a["n"]).alias("n"), fits.alias("open"), F.when(fits, F.concat(a["kept"], F.array(s))).otherwise(a["kept"]).alias("kept"))

    kept = F.aggregate(parts, start, step)["kept"]
    head = F.array_join(F.slice(F.array_remove(F.split(answer, r"[ \t\n\x0B\f\r]+"), ""), 1, words), " ")
    return F.when(answer.isNull(), "").when(count(answer) <= words, answer).when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.concat(head, F.lit("...")))


def cosine(vector: Column, query: list[float]) -> Column:
    """In double precision; zero vectors score 0; a longer query is cut, a shorter one counts as filled with zeros."""
    q = F.array(*[F.lit(float(x)) for x in query])
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: F.coalesce(a.cast("double") * b, zero)), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(x * x for x in query) ** 0.5
    return F.when((norm > 0) & F.lit(length > 0), dot / (norm * (length or 1.0))).otherwise(0.0)


def vector_search(vectors: DataFrame, column: str, query: list[float], key: str, k: int = 10, least: float | None = None, within: Column | None = None) -> DataFrame:
    """The k nearest rows with score; filters come before the cut."""
    found = (vectors if within is None else vectors.filter(within)).withColumn("score", cosine(F.col(column), query))
    return (found if least is None else found.filter(F.col("score") >= least)).orderBy(F.desc("score"), key).limit(k)


def calibrated(s: Column) -> Column:
    """Raw cosine to a displayed relevance, piecewise linear."""
    return F.when(s > 0.7, 0.95 + (s - 0.7) * 0.15).when(s > 0.6, 0.90 + (s - 0.6) * 0.5).when(s > 0.5, 0.80 + (s - 0.5)).when(s > 0.4, 0.65 + (s - 0.4) * 1.5).when(s > 0.3, 0.45 + (s - 0.3) * 2).otherwise(s * 1.5)


def fuse(lists: dict[str, tuple[DataFrame, float]], key: str, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of short ranked lists (key, score): (key, score, sources)."""
    ranked = [df.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), F.lit(name).alias("source"), F.lit(weight).alias("weight")) for name, (df, weight) in lists.items()]
    each = reduce(DataFrame.unionByName, ranked)
    merged = each.groupBy(key).agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return merged.orderBy(F.desc("score"), key).limit(k)


def with_context(chunks: DataFrame, doc: str, order: str, text: str, around: int = 1, separator: str = "\n\n---\n\n") -> DataFrame:
    """Each chunk with the text of its neighbours in the document."""
    frame = Window.partitionBy(doc).orderBy(order).rowsBetween(-around, around)
    return chunks.withColumn("context", F.array_join(F.collect_list(text).over(frame), separator))


def hits_by_document(chunks: DataFrame, hits: DataFrame, doc: str, order: str, text: str, around: int = 2) -> DataFrame:
    """(doc, hits, best, context): a short list of hits (doc, order, score) by document, in the order of its chunks, each with its neighbours.

    Only the documents that are hit are read into windows.
    """
    few = F.broadcast(hits.select(doc, order, "score"))  # the k best of one search
    found = with_context(chunks.select(doc, order, text).join(few.select(doc).distinct(), doc, "left_semi"), doc, order, text, around, "\n\n").join(few, [doc, order])
    each = F.array_sort(F.collect_list(F.struct(order, "context")))
    return found.groupBy(doc).agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.array_join(F.transform(each, lambda x: x["context"]), "\n\n---\n\n").alias("context"))


def assemble(hits: DataFrame, order: list[Column], text: str, budget: int = 8000, least: int = 100) -> DataFrame:
    """Hits in order while their lengths fit the budget; the first that does not is cut if enough of it is left. For a short list."""
    before = F.sum(F.length(text)).over(Window.orderBy(*order)) - F.length(text)
    left = budget - F.col("_before")
    kept = hits.withColumn("_before", before).filter((left >= F.length(text)) | (left > least))
    return kept.withColumn(text, F.substring(F.col(text), F.lit(1), F.greatest(left, F.lit(0)).cast("int"))).drop("_before")


def hybrid_context(lists: dict[str, tuple[DataFrame, float]], chunks: DataFrame, key: str, doc: str, order: str, text: str, k: int = 10, around: int = 1, budget: int = 8000) -> DataFrame:
    """(rank, key, doc, order, score, sources, context): ranked lists (key, score) fused, each hit with its neighbours, in order while they fit the budget.

    Of ``chunks`` only the documents of the k hits are put into windows. A hit whose key no chunk has is left out before
    the budget is spent; context that is cut is the last.
    """
    found = F.broadcast(fuse(lists, key, k))  # k rows
    docs = chunks.join(found, key, "left_semi").select(doc).distinct()
    near = with_context(chunks.select(key, doc, order, text).join(F.broadcast(docs), doc, "left_semi"), doc, order, text, around)  # k documents at most
    hits = near.join(found, key).select(key, doc, order, "score", "sources", "context")
    best = [F.desc("score"), F.asc(key)]
    return assemble(hits.withColumn("rank", F.row_number().over(Window.orderBy(*best))), best, "context", budget)  # k rows


def catalog(chunks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Per document: chunks, tokens, mean tokens per chunk, first text."""
    return chunks.groupBy(doc).agg(F.count("*").alias("chunks"), F.sum(F.floor(F.length(text) / 4)).cast("long").alias("tokens"), F.min_by(F.substring(text, 1, 20), F.col(order)).alias("starts"))


def add_new(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose hash the index lacks, one per hash."""
    return chunks.join(index.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def citations(hits: DataFrame, key: str, text: str, n: int = 5, preview: int = 300) -> DataFrame:
    """(key, score, preview) of the n best hits; the score is held within 0 and 1."""
    best = hits.orderBy(F.desc("score"), key).limit(n)
    return best.select(key, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), F.substring(text, 1, preview).alias("preview"))
