"""Registered queries over the given tables, each with its SQL. Doubles are rounded in both."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.functions import hygiene
from quarrykit.operators import aggregate, chunk, profile, report, retrieve, sketches, trend
from quarrykit.operators.keyword_index import KeywordIndex
from quarrykit.plans import questions, router
from quarrykit.sources import tables
from quarrykit.sources.folders import shared_folder
from quarrykit.streaming import events as windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The functions behind the queries, which take a reader of tables.
QUERIES_OF: dict[str, Callable] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__], QUERIES_OF[f.__name__] = run, f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(sum({c}), 2) AS sum, {u} AS unit FROM lineitem"
        for c, u in zip(LINE, ("'count'", "'currency'", "'count'", "NULL"), strict=True)
    )
)
def profile_numeric(table):
    return rounded(profile.numeric_profile(table("lineitem"), LINE)).withColumn("sum", F.round("sum", 2))


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM orders" for c in _ORDERS))
def profile_nulls_distinct(table):
    return profile.completeness(table("orders").select(*_ORDERS))


_MISSING = [f"count(*) - count({c})" for c in ("doc_id", "text", "lang", "source", "n_chars")]


@query(
    f"SELECT count(*) AS rows, {len(_MISSING)}::BIGINT AS columns, CASE WHEN count(*) > 0 THEN round((count(*) * {len(_MISSING)} - ({' + '.join(_MISSING)})) / (count(*) * {len(_MISSING)}) * 100, 2) ELSE 0 END::DOUBLE AS filled_pct,"
    f" ({' + '.join(f'(count(*) > 0 AND {m} = count(*))::INTEGER' for m in _MISSING)})::BIGINT AS empty_columns, ({' + '.join(f'(2 * ({m}) > count(*))::INTEGER' for m in _MISSING)})::BIGINT AS mostly_missing FROM documents"
)
def dataset_overview(table):
    return profile.overview(table("documents").select("doc_id", "text", "lang", "source", "n_chars")).withColumn("filled_pct", F.col("filled_pct").cast("double"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def groupby_sum_flag(table):
    return rounded(aggregate.group_agg(table("lineitem"), "l_returnflag", "l_extendedprice"), 2)


@query("SELECT p_brand, round(sum(p_retailprice), 2) AS total, round(avg(p_retailprice), 4) AS average, count(p_retailprice) AS count FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 20")
def groupby_multi_agg_top20(table):
    return rounded(aggregate.group_summary(table("part"), "p_brand", "p_retailprice")).withColumn("total", F.round("total", 2))


@query(f"SELECT l_suppkey, {', '.join(f'round(sum({c}), 2) AS {c}' for c in LINE)}, round({' + '.join(f'sum({c})' for c in LINE)}, 2) AS combined FROM lineitem GROUP BY 1 ORDER BY {' + '.join(f'sum({c})' for c in LINE)} DESC, l_suppkey LIMIT 10")
def groupby_wide_top10(table):
    return rounded(aggregate.group_wide(table("lineitem"), "l_suppkey", LINE), 2)


@query("SELECT row_number() OVER (ORDER BY total DESC, l_suppkey)::INTEGER AS rank, l_suppkey, round(total, 2) AS total FROM (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 10)")
def top_suppliers(table):
    return rounded(aggregate.top_groups(table("lineitem"), "l_suppkey", F.expr("l_extendedprice * (1 - l_discount)")), 2)


@query(
    """WITH g AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_custkey) AS rank, count(*) OVER () AS of_total FROM g)
SELECT o_custkey, round(total, 2) AS total, rank::INTEGER AS rank, CASE WHEN rank <= 10 THEN 'top' ELSE 'bottom' END AS side, of_total FROM r WHERE rank <= 10 OR (of_total > 20 AND rank > of_total - 10)"""
)
def ranking_two_sided(table):
    return rounded(aggregate.two_sided(table("orders"), "o_custkey", "o_totalprice"), 2)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def top_n_rows(table):
    return aggregate.top_rows(table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 10")
def bottom_n_rows(table):
    return aggregate.top_rows(table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", largest=False)


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () * 100, 4) AS share FROM lineitem GROUP BY 1")
def share_of_total(table):
    return rounded(aggregate.shares(table("lineitem"), "l_returnflag", "l_extendedprice")).withColumn("total", F.round("total", 2))


@query(
    """WITH g AS (SELECT o_orderpriority AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY t DESC, k) AS i, count(*) OVER () AS n FROM g),
p AS (SELECT CASE WHEN b.i = 2 THEN 'top_vs_second' END AS kind, a.k AS l, b.k AS r, a.t AS lt, b.t AS rt FROM r a, r b WHERE a.i = 1 AND b.i = 2
      UNION ALL SELECT 'top_vs_bottom', a.k, b.k, a.t, b.t FROM r a, r b WHERE a.i = 1 AND b.i = b.n AND b.n >= 3)
SELECT kind, l AS left_name, r AS right_name, round(lt - rt, 2) AS difference, round((lt - rt) / least(abs(lt), abs(rt)) * 100, 4) AS pct,
       CASE WHEN abs((lt - rt) / rt * 100) > 20 THEN 'high' WHEN abs((lt - rt) / rt * 100) > 10 THEN 'medium' ELSE 'low' END AS significance FROM p"""
)
def comparison_top_pairs(table):
    return rounded(aggregate.comparisons(table("orders"), "o_orderpriority", "o_totalprice")).withColumn("difference", F.round("difference", 2))


@query(
    """WITH s AS (SELECT count(*) AS n, sum(p_size)::DOUBLE AS s1, avg(p_size) AS a1, max(p_size)::DOUBLE AS x1, min(p_size)::DOUBLE AS m1, sum(p_retailprice) AS s2, avg(p_retailprice) AS a2, max(p_retailprice) AS x2, min(p_retailprice) AS m2, count(DISTINCT p_brand) AS u FROM part)
SELECT ordinal::INTEGER AS ordinal, name, round(value, 2) AS value FROM (
 SELECT 1 AS ordinal, 'Total p_size' AS name, s1 AS value FROM s UNION ALL SELECT 2, 'Average p_size', a1 FROM s UNION ALL SELECT 3, 'Maximum p_size', x1 FROM s UNION ALL SELECT 4, 'Minimum p_size', m1 FROM s
 UNION ALL SELECT 5, 'Total p_retailprice', s2 FROM s UNION ALL SELECT 6, 'Average p_retailprice', a2 FROM s UNION ALL SELECT 7, 'Maximum p_retailprice', x2 FROM s UNION ALL SELECT 8, 'Minimum p_retailprice', m2 FROM s
 UNION ALL SELECT 9, 'Total Records', n::DOUBLE FROM s UNION ALL SELECT 10, 'Unique p_brand', u::DOUBLE FROM s WHERE u < 0.9 * n)"""
)
def metric_extraction(table):
    return profile.metrics(table("part"), ["p_partkey", "p_size", "p_retailprice"], ["p_brand"])


@query("SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count DESC, event_type LIMIT 10")
def value_counts(table):
    return aggregate.value_counts(table("events"), "event_type")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS bucket, round(sum(o_totalprice), 2) AS total, count(o_totalprice) AS count FROM orders GROUP BY 1")
def time_bucket_sum(table):
    return rounded(aggregate.time_bucket(table("orders"), "o_orderdate", "o_totalprice"), 2).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS bucket, round(sum(o_totalprice), 2) AS total, count(o_totalprice) AS count FROM orders GROUP BY 1")
def monthly_sum(table):
    return rounded(aggregate.time_bucket(table("orders"), "o_orderdate", "o_totalprice", "month"), 2).withColumn("bucket", F.date_format("bucket", "yyyy-MM"))


@query("SELECT strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day, date_diff('day', min(l_shipdate), max(l_shipdate)) AS days, date_diff('day', min(l_shipdate), max(l_shipdate)) // 30 AS months, round(epoch(max(l_shipdate) - min(l_shipdate)) / 86400 / (count(l_shipdate) - 1), 6) AS mean_interval FROM lineitem")
def date_span(table):
    return rounded(aggregate.date_span(table("lineitem"), "l_shipdate"), 6)


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates, coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0)::BIGINT AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_rows(table):
    return aggregate.duplicate_rows(table("documents"), ["text"])


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS part, round(sum(l_extendedprice), 2) AS whole, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100, 4) AS pct FROM lineitem")
def discount_ratio(table):
    one = aggregate.ratio(table("lineitem"), F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice"))
    return one.select(F.round("part", 2).alias("part"), F.round("whole", 2).alias("whole"), F.round("pct", 4).alias("pct"))


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query("SELECT left_column, right_column, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + ") ORDER BY abs(r) DESC, 1, 2 LIMIT 5")
def corr_pairs(table):
    return rounded(profile.correlations(table("lineitem"), LINE), 6)


@query("WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / w), 29)::INTEGER AS bin, lo, w FROM orders, s) SELECT bin, round(any_value(lo) + bin * any_value(w), 4) AS low, round(any_value(lo) + (bin + 1) * any_value(w), 4) AS high, count(*) AS count FROM b GROUP BY bin")
def histogram_30(table):
    return rounded(profile.histogram(table("orders"), "o_totalprice"))


@query(
    """WITH r AS (SELECT o_totalprice AS v, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE AS i FROM orders),
s AS (SELECT count(*) AS n, regr_slope(v, i) AS slope, stddev_samp(v) AS std, arg_min(v, i) AS a, arg_max(v, i) AS b FROM r)
SELECT n, round(slope, 6) AS slope, CASE WHEN abs(slope) < 0.01 * std THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round((b - a) / a * 100, 6) AS change_pct FROM s"""
)
def trend_ols(table):
    return rounded(trend.trend_ols(table("orders"), "o_orderdate", "o_totalprice", "o_orderkey"), 6)


@query(
    """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
s AS (SELECT any_value(n) AS n, avg(v) FILTER (i < n // 3) AS a, avg(v) FILTER (i >= n - n // 3) AS b FROM r)
SELECT n, round(a, 2) AS first_mean, round(b, 2) AS last_mean, round((b - a) / a * 100, 2) AS change_pct,
 CASE WHEN round((b - a) / a * 100, 2) > 5 THEN 'up' WHEN round((b - a) / a * 100, 2) < -5 THEN 'down' ELSE 'stable' END AS direction, CASE WHEN n >= 30 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM s"""
)
def trend_thirds(table):
    return rounded(trend.trend_thirds(table("orders"), "o_orderdate", "o_totalprice", "o_orderkey"), 2)


@query(
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, count(o_totalprice) AS n FROM orders),
o AS (SELECT o_orderkey, o_totalprice, n, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM orders, q WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)),
f AS (SELECT coalesce(string_agg(printf('%.2f', o_totalprice), ',' ORDER BY o_orderkey), '') AS first_values FROM (SELECT * FROM o ORDER BY o_orderkey LIMIT 5))
SELECT (SELECT count(*) FROM o) AS n_outliers, round((SELECT count(*) FROM o) / n * 100, 2) AS pct, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high, first_values FROM q, f"""
)
def anomaly_iqr(table):
    return rounded(trend.outliers_iqr(table("orders"), "o_totalprice", "o_orderkey"))


_Z = "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders), z AS (SELECT o_orderkey, o_totalprice, (o_totalprice - m) / sd AS z, m, sd FROM orders, s WHERE abs((o_totalprice - m) / sd) > {t})"


@query(_Z.format(t=1.6) + " SELECT o_orderkey, o_totalprice, round(z, 4) AS z, CASE WHEN abs(z) > 3 THEN 'high' ELSE 'medium' END AS severity FROM z ORDER BY o_orderkey LIMIT 50")
def anomaly_z_rows(table):
    return rounded(trend.outliers_z(table("orders"), "o_totalprice", "o_orderkey", 1.6))


@query(_Z.format(t=1.6) + " SELECT o_orderkey, o_totalprice, round(z, 2) AS deviation, CASE WHEN abs(z) > 3 THEN 'high' ELSE 'medium' END AS severity, round(m - 2 * sd, 4) AS expected_low, round(m + 2 * sd, 4) AS expected_high FROM z ORDER BY CASE WHEN abs(z) > 3 THEN 0 ELSE 1 END, abs(round(z, 2)) DESC, o_orderkey LIMIT 10")
def anomaly_z(table):
    return rounded(trend.outliers_expected(table("orders"), "o_totalprice", "o_orderkey", 1.6))


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier")
def union_by_name(table):
    c = table("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment")
    return aggregate.union_tables(c, table("supplier").selectExpr("s_acctbal AS balance", "s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"))


@query("SELECT substr(sha256(text), 1, 16) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def chunk_hash_dedup(table):
    chunks = table("documents").select("doc_id", F.lit(0).alias("chunk"), hygiene.chunk_hash(F.col("text")).alias("hash"))
    return chunk.first_of_each(chunks, "doc_id", "chunk").select("hash", "doc_id")


@query(
    r"SELECT doc_id, (length(trim(text, E' \t\n\r\f\v')) < 10 OR regexp_matches(lower(trim(text, E' \t\n\r\f\v')), '^page\s*\d+(\s*(of|/)?\s*\d+)?$') OR regexp_matches(trim(text, E' \t\n\r\f\v'), '^[\s\-=_]{5,}$')) AS noise,"
    r" (len(list_filter(string_split(text, E'\n'), lambda x: regexp_matches(x, '\|.*\|'))) >= 2 AND len(list_filter(string_split(text, E'\n'), lambda x: regexp_matches(x, '^\|\s*-+\s*\|'))) >= 1) AS is_table, length(text) // 4 AS tokens FROM documents"
)
def text_flags(table):
    t = F.col("text")
    return table("documents").select("doc_id", hygiene.is_noise(t).alias("noise"), hygiene.is_table(t).alias("is_table"), hygiene.token_estimate(t).alias("tokens"))


@query("SELECT doc_id, (s // 800)::INTEGER AS chunk, substr(text, s + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 800))::INTEGER AS s FROM documents WHERE length(text) > 0)")
def chunk_fixed(table):
    return chunk.fixed(table("documents"), "doc_id", "text")


_NOISE = "(length(trim({0}, E' \\t\\n\\r\\f\\v')) < 10 OR " + " OR ".join(f"regexp_matches(lower(trim({{0}}, E' \\t\\n\\r\\f\\v')), '{p}')" for p in (r"^page\s*\d+(\s*(of|/)?\s*\d+)?$", r"^[\s\-=_]{{5,}}$", r"^(published|confidential|proprietary)\s*(published|confidential|proprietary)?$")) + ")"


def _split_sql(source: str, tokens: int, overlap: int) -> str:
    """CTEs that end in ``chunks`` (key, n, piece): the texts of ``source`` (key, text), none a table, split by paragraphs and sentences."""
    same = f"p.used + n.tok <= {tokens} AND (CASE WHEN n.long THEN p.long AND p.i = n.i ELSE NOT p.long END)"
    carried = f"NOT ({same}) AND NOT n.long AND NOT p.long AND p.tok <= {overlap}"
    return (
        f"src AS ({source}),\n"
        rf"para AS (SELECT key, i, trim(p, E' \t\n\r\f\v') AS p FROM (SELECT key, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT key, string_split_regex(text, '\n\n+') AS l FROM src WHERE length(text) // 4 > {tokens})) WHERE NOT {_NOISE.format('p')}),"
        rf"""
sent AS (SELECT key, i, length(p) // 4 > {tokens} AS long, CASE WHEN length(p) // 4 > {tokens} THEN list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r\f\v')), lambda x: x <> '') ELSE [p] END AS l FROM para),
num AS (SELECT key, i, long, t, length(t) // 4 AS tok, row_number() OVER (PARTITION BY key ORDER BY i, j) AS r FROM (SELECT key, i, long, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM sent)),
rec AS (SELECT key, r, i, long, t, tok, 0 AS n, tok AS used, '' AS before FROM num WHERE r = 1
 UNION ALL SELECT n.key, n.r, n.i, n.long, n.t, n.tok, CASE WHEN {same} THEN p.n ELSE p.n + 1 END, CASE WHEN {same} THEN p.used + n.tok WHEN {carried} THEN p.tok + n.tok ELSE n.tok END, CASE WHEN {carried} THEN p.t || chr(10) || chr(10) ELSE '' END
 FROM rec p JOIN num n ON n.key = p.key AND n.r = p.r + 1),
chunks AS (SELECT key, n, CASE WHEN any_value(long) THEN string_agg(t, ' ' ORDER BY r) ELSE string_agg(before || t, chr(10) || chr(10) ORDER BY r) END AS piece FROM rec GROUP BY key, n
 UNION ALL SELECT key, 0, text FROM src WHERE length(text) // 4 <= {tokens} AND NOT {_NOISE.format("text")})"""
    )


@query(f"WITH RECURSIVE {_split_sql('SELECT doc_id AS key, text FROM documents', 500, 50)} SELECT key AS doc_id, n::INTEGER AS chunk, piece, substr(sha256(piece), 1, 16) AS hash FROM chunks")
def chunk_budgeted(table):
    return chunk.budgeted(table("documents"), "doc_id", "text", 500, 50)


@query("SELECT doc_id // 50 AS bucket, count(*) AS rows, '| doc_id | lang | source |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || doc_id || ' | ' || coalesce(lang, 'NULL') || ' | ' || coalesce(source, 'NULL') || ' |', chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1")
def chunk_rows(table):
    return chunk.table_chunks(table("documents"), F.floor(F.col("doc_id") / 50), "doc_id", ["doc_id", "lang", "source"])


_TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]{2,}') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in hygiene.STOP_WORDS) + "], t))"
_BM25_TERMS = ["idiot", "stupid", "onthe", "tionst", "idiot"]
_BM25 = f"""bm AS (
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
l AS (SELECT doc_id, len(t) AS dl, [{", ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in dict.fromkeys(_BM25_TERMS))}] AS tf FROM d),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, {", ".join(f"count(*) FILTER (tf[{i + 1}] > 0)::DOUBLE AS df{i}" for i in range(len(dict.fromkeys(_BM25_TERMS))))} FROM l)
SELECT doc_id, {" + ".join(f"{_BM25_TERMS.count(w)} * greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1), 0.25) * tf[{i + 1}] * 2.5 / (tf[{i + 1}] + 1.5 * (1 - 0.75 + 0.75 * dl / av))" for i, w in enumerate(dict.fromkeys(_BM25_TERMS)))} AS score FROM l, s)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_top10(table):
    return rounded(retrieve.bm25(table("documents").select("doc_id", "text"), "text", _BM25_TERMS).select("doc_id", "score"), 6)


def _first_vector(table) -> list[float]:
    return table("embeddings").filter("vec_id = 0").first()["embedding"]


_COS = "c AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM c ORDER BY c.score DESC, vec_id LIMIT 10")
def cosine_top10(table):
    return rounded(retrieve.vector_search(table("embeddings"), "embedding", _first_vector(table), "vec_id").select("vec_id", "score"), 6)


@query(f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM c WHERE label = 3 AND score >= 0.05 ORDER BY c.score DESC, vec_id LIMIT 10")
def cosine_within_label(table):
    return rounded(retrieve.vector_search(table("embeddings"), "embedding", _first_vector(table), "vec_id", least=0.05, within=F.col("label") == 3).select("vec_id", "score"), 6)


@query(f"WITH {_COS} SELECT vec_id, round(CASE WHEN score > 0.7 THEN 0.95 + (score - 0.7) * 0.15 WHEN score > 0.6 THEN 0.9 + (score - 0.6) * 0.5 WHEN score > 0.5 THEN 0.8 + (score - 0.5) WHEN score > 0.4 THEN 0.65 + (score - 0.4) * 1.5 WHEN score > 0.3 THEN 0.45 + (score - 0.3) * 2 ELSE score * 1.5 END, 6) AS relevance FROM c")
def calibrated_scores(table):
    return table("embeddings").select("vec_id", F.round(retrieve.calibrated(retrieve.cosine(F.col("embedding"), _first_vector(table))), 6).alias("relevance"))


@query(
    f"""WITH {_COS}, {_BM25}, v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT * FROM c ORDER BY score DESC, vec_id LIMIT 20)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20))
SELECT doc_id, round(coalesce(0.6 / (60 + v.r), 0) + coalesce(0.4 / (60 + k.r), 0), 9) AS score, CASE WHEN v.r IS NULL THEN 'keyword' WHEN k.r IS NULL THEN 'vector' ELSE 'keyword,vector' END AS sources
FROM v FULL JOIN k USING (doc_id) ORDER BY coalesce(0.6 / (60 + v.r), 0) + coalesce(0.4 / (60 + k.r), 0) DESC, doc_id LIMIT 10"""
)
def rrf_fusion(table):
    vector = retrieve.vector_search(table("embeddings"), "embedding", _first_vector(table), "vec_id", 20).select(F.col("vec_id").alias("doc_id"), "score")
    keyword = retrieve.bm25(table("documents").select("doc_id", "text"), "text", _BM25_TERMS, 20).select("doc_id", "score")
    return rounded(retrieve.fuse({"vector": (vector, 0.6), "keyword": (keyword, 0.4)}, "doc_id"), 9)


@query("SELECT conv_id, turn, md5(string_agg(text, E'\\n\\n---\\n\\n') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS context FROM conversations")
def context_window(table):
    return retrieve.with_context(table("conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("context").alias("context"))


@query(
    f"""WITH {_BM25}, h AS (SELECT bm.doc_id, bm.score, d.text FROM bm JOIN documents d USING (doc_id) WHERE bm.score > 0 ORDER BY bm.score DESC, doc_id LIMIT 10),
b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h)
SELECT doc_id, least(length(text), 8000 - used)::INTEGER AS used_chars FROM b WHERE 8000 - used >= length(text) OR 8000 - used > 100"""
)
def context_budget(table):
    hits = retrieve.bm25(table("documents").select("doc_id", "text"), "text", _BM25_TERMS)
    return retrieve.assemble(hits, [F.desc("score"), F.asc("doc_id")], "text").select("doc_id", F.length("text").alias("used_chars"))


@query("SELECT conv_id, count(*) AS chunks, sum(length(text) // 4)::BIGINT AS tokens, arg_min(substr(text, 1, 20), turn) AS starts FROM conversations GROUP BY 1")
def doc_catalog(table):
    return retrieve.catalog(table("conversations"), "conv_id", "turn", "text")


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_Q = "lower(trim(coalesce(text, '')))"


@query(
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches({_Q}, '{_re2(router.OVERVIEW)}') THEN 'overview'
 WHEN NOT regexp_matches({_Q}, '{"|".join(router.DATA)}') AND regexp_matches({_Q}, '{_re2(router.FREEFORM)}') THEN 'freeform'
 WHEN regexp_matches({_Q}, '{_re2(router.SYSTEM)}') THEN 'system'
 WHEN regexp_matches({_Q}, '{"|".join(router.DATA)}') OR regexp_matches({_Q}, '{router.STARTERS}') THEN 'data' ELSE 'freeform' END AS mode FROM conversations WHERE role = 'user'"""
)
def route_questions(table):
    return table("conversations").filter("role = 'user'").select("conv_id", "turn", router.mode_column(F.col("text")).alias("mode"))


@query("SELECT row_number() OVER (ORDER BY total DESC, o_orderpriority)::INTEGER AS rank, o_orderpriority, round(total, 2) AS total FROM (SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY total DESC, o_orderpriority LIMIT 3)")
def answered_question(table):
    return rounded(router.answer("top 3 o_orderpriority by o_totalprice where o_totalprice over 1000", table("orders")), 2)


@query("SELECT (json_extract_string(props, '$.k'))::BIGINT AS k, count(*) AS count, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_field_sums(table):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table("events").groupBy(k).agg(F.count("*").alias("count"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL '60 seconds', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS count, round(count(*) / 60, 6) AS per_second FROM events GROUP BY 1")
def stream_rate(table):
    return rounded(windows.rate(table("events"), "ts"), 6).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS count, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_by_kind(table):
    return rounded(windows.by_kind(table("events"), "ts", "event_type", "value"), 2).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS count FROM s GROUP BY user_id, i"""
)
def session_windows(table):
    return windows.sessions(table("events"), "ts", "user_id").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS fired, round(max(value), 4) AS worst, count(*) AS count FROM events WHERE value > 50 GROUP BY event_type, time_bucket(INTERVAL '300 seconds', ts)")
def value_alerts(table):
    return rounded(windows.alerts(table("events"), "ts", "event_type", "value", 50.0)).withColumn("fired", F.date_format("fired", "yyyy-MM-dd HH:mm:ss"))


def _kind_sql(table: str, column: str, physical: str) -> str:
    """A row (name, kind) of a column by the rule for its physical type."""
    count, distinct = f"count({column})", f"count(DISTINCT {column})"
    whole = f"CASE WHEN {count} > 0 AND {distinct} / {count} > 0.95 THEN 'id' ELSE 'numeric' END"
    dates = f"count(try_cast({column} AS TIMESTAMP))"
    text = f"CASE WHEN {count} = 0 THEN 'unknown' WHEN {dates} / {count} > 0.8 THEN 'datetime' WHEN {distinct} / {count} < 0.5 OR {distinct} < 50 THEN 'categorical' WHEN avg(length({column})) > 100 THEN 'text' ELSE 'categorical' END"
    return f"SELECT '{column}' AS name, {({'whole': whole, 'string': text}.get(physical) or f"coalesce(max('{physical}'), '{physical}')")} AS kind FROM {table}"


@query(" UNION ALL ".join(_kind_sql("orders", c, k) for c, k in (("o_orderkey", "whole"), ("o_custkey", "whole"), ("o_orderstatus", "string"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string"))))
def semantic_types(table):
    return profile.semantic_types(table("orders"))


@query(" UNION ALL ".join(_kind_sql("documents", c, k) for c, k in (("doc_id", "id"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "whole"))))
def semantic_types_of_texts(table):
    return profile.semantic_types(table("documents"))


@query('SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std, round(max(l_extendedprice) - min(l_extendedprice), 4) AS "range" FROM lineitem')
def distribution_stats(table):
    return rounded(profile.distribution(table("lineitem"), "l_extendedprice"))


_SIZED = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS rows, {n}::INTEGER AS columns FROM {name}" for name, n in _SIZED.items()))
def table_sizes(table):
    return profile.table_sizes({name: table(name) for name in _SIZED})


@query("SELECT DISTINCT substr(sha256(text), 1, 16) AS hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def new_chunks(table):
    chunks = table("documents").filter("text is not null").select("lang", hygiene.chunk_hash(F.col("text")).alias("hash"))
    return retrieve.add_new(chunks.filter("lang = 'en'"), chunks).select("hash")


@query("SELECT page_id, trim(substr(line, 1, instr(line, ':') - 1)) AS name, trim(substr(line, instr(line, ':') + 1)) AS value FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) WHERE instr(line, ':') > 1")
def key_value_lines(table):
    return chunk.key_values(table("pages"), "page_id", "html")


@query(
    r"SELECT bucket, line::INTEGER AS line, array_to_string(list_transform(string_split(substr(l, 2, length(l) - 2), '|'), lambda x: trim(x)), chr(9)) AS cells FROM"
    r" (SELECT bucket, i - 1 AS line, trim(p[i]) AS l FROM (SELECT bucket, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT bucket, string_split(body, chr(10)) AS p FROM ("
    + ORACLE_SQL["chunk_rows"]
    + r"))))"
    r" WHERE regexp_matches(l, '^\|.*\|$') AND NOT regexp_matches(l, '^\|[\s:|-]*\|$')"
)
def markdown_rows(table):
    tables = chunk.table_chunks(table("documents"), F.floor(F.col("doc_id") / 50), "doc_id", ["doc_id", "lang", "source"])
    return chunk.markdown_rows(tables, "bucket", "body").withColumn("cells", F.array_join("cells", "\t"))


@query(f"WITH {_BM25} SELECT doc_id, round(least(greatest(score, 0), 1), 6) AS score, substr(text, 1, 300) AS preview FROM bm JOIN documents USING (doc_id) WHERE score > 0 ORDER BY bm.score DESC, doc_id LIMIT 5")
def citations(table):
    return rounded(retrieve.citations(retrieve.bm25(table("documents").select("doc_id", "text"), "text", _BM25_TERMS), "doc_id", "text"), 6)


@query(f"SELECT mode, count(*) AS total, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM ({ORACLE_SQL['route_questions']}) GROUP BY mode")
def question_stats(table):
    asked = table("conversations").filter("role = 'user'").select(router.mode_column(F.col("text")).alias("mode"), F.lit(1).alias("one"))
    return rounded(aggregate.shares(asked, "mode", "one"))


@query(
    """WITH e AS (SELECT unnest(generate_series(time_bucket(INTERVAL '10 seconds', ts) - INTERVAL '50 seconds', time_bucket(INTERVAL '10 seconds', ts), INTERVAL '10 seconds')) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS count, round(count(*) / 60, 6) AS per_second FROM e GROUP BY s"""
)
def rolling_rate(table):
    return rounded(windows.rate(table("events"), "ts", step="10 seconds"), 6).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_TOKENS = _BM25[_BM25.index("d AS (") : _BM25.index("\nl AS")].rstrip().rstrip(",")


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term) GROUP BY term")
def bm25_index(table):
    return retrieve.term_statistics(retrieve.index_terms(table("documents"), "doc_id", "text"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_from_index(table):
    return rounded(retrieve.search_index(retrieve.index_terms(table("documents"), "doc_id", "text"), "doc_id", _BM25_TERMS), 6)


@query(f"WITH {_COS} SELECT label, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 3")
def nearest_per_label(table):
    return rounded(retrieve.best_per_group(table("embeddings"), "embedding", _first_vector(table), "label", "vec_id"), 6)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(sum({c}), 2) AS total, round(avg({c}), 4) AS average, round(min({c}), 4) AS least, round(max({c}), 4) AS most, count({c}) AS count, {u} AS unit FROM lineitem" for c, u in zip(LINE, ("NULL", "(SELECT l_linestatus FROM lineitem WHERE l_linestatus IS NOT NULL ORDER BY l_orderkey, l_linenumber LIMIT 1)", "NULL", "NULL"), strict=True)))
def metric_report(table):
    lines = table("lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber"))
    return rounded(aggregate.report(lines, LINE, {"l_extendedprice": "l_linestatus"}, "at")).withColumn("total", F.round("total", 2))


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, rank::INTEGER AS rank, name, round(total, 2) AS total FROM (SELECT l_suppkey::VARCHAR AS name, sum({c}) AS total, row_number() OVER (ORDER BY sum({c}) DESC, l_suppkey::VARCHAR) AS rank FROM lineitem GROUP BY l_suppkey) WHERE rank <= 5" for c in ("l_quantity", "l_extendedprice")))
def metric_rankings(table):
    return rounded(aggregate.rankings(table("lineitem"), "l_suppkey", ["l_quantity", "l_extendedprice"]), 2)


@query("SELECT (row_number() OVER (ORDER BY y DESC, x))::INTEGER AS at, x, round(y, 2) AS y FROM (SELECT p_brand AS x, sum(p_retailprice) AS y FROM part GROUP BY p_brand ORDER BY y DESC, x LIMIT 10)")
def bar_chart(table):
    return rounded(aggregate.chart_series(table("part"), "p_brand", "p_retailprice", "bar"), 2)


@query("SELECT (row_number() OVER (ORDER BY x))::INTEGER AS at, x, round(y, 2) AS y FROM (SELECT strftime(o_orderdate, '%Y-%m') AS x, sum(o_totalprice) AS y FROM orders GROUP BY x)")
def line_chart(table):
    return rounded(aggregate.chart_series(table("orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), "month", "o_totalprice", "line"), 2)


@query(
    """WITH RECURSIVE o AS (SELECT event_type, ts FROM events WHERE value > 50),
f AS (SELECT event_type, min(ts) AS fired FROM o GROUP BY event_type
  UNION ALL SELECT event_type, (SELECT min(ts) FROM o WHERE o.event_type = f.event_type AND o.ts >= f.fired + INTERVAL 300 SECONDS) FROM f WHERE fired IS NOT NULL)
SELECT event_type, strftime(fired, '%Y-%m-%d %H:%M:%S.%f') AS fired FROM f WHERE fired IS NOT NULL"""
)
def cooldown_alerts(table):
    found = windows.alerts_with_cooldown(table("events"), "ts", "event_type", "value", 50.0)
    return found.withColumn("fired", F.date_format("fired", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    """WITH RECURSIVE e AS (SELECT event_type, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT event_type, i, least(i + 10, 1 + max(i) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 600 SECONDS FOLLOWING)) AS after FROM e),
b AS (SELECT event_type, i, after FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.i, n.after FROM b JOIN n ON n.event_type = b.event_type AND n.i = b.after)
SELECT b.event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS count, round(sum(value), 2) AS total
FROM b JOIN e ON e.event_type = b.event_type AND e.i >= b.i AND e.i < b.after GROUP BY b.event_type, b.i"""
)
def event_batches(table):
    found = windows.batches(table("events"), "ts", "event_type", "value", "event_id", 10, 600)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return found.select("event_type", at("start"), at("last"), "count", F.round("total", 2).alias("total"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, count(value) AS count FROM events GROUP BY ALL")
def value_percentiles(table):
    return rounded(windows.percentiles(table("events"), "ts", "event_type", "value")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, text, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations),
n AS (SELECT *, list_transform(parts, lambda p: len(list_filter(string_split_regex(p, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS words FROM s),
k AS (SELECT *, len(list_filter(range(1, len(parts) + 1), lambda i: list_sum(words[1:i]) <= 20)) AS kept, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS every FROM n)
SELECT conv_id, turn, CASE WHEN text IS NULL THEN '' WHEN len(every) <= 20 THEN text WHEN kept > 0 THEN array_to_string(parts[1:kept], ' ') ELSE array_to_string(every[1:20], ' ') || '...' END AS answer FROM k""".replace("\\\\", "\\")
)
def compressed_answers(table):
    return table("conversations").select("conv_id", "turn", retrieve.compressed(F.col("text"), 20).alias("answer"))


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS chunk, 0::BIGINT AS s FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, chunk + 1, s - 200 + CASE WHEN s + 1000 < length(text) AND length(regexp_extract(substr(text, s + 1, 1000), '(?s)^.*\.')) - 1 > 500 THEN length(regexp_extract(substr(text, s + 1, 1000), '(?s)^.*\.')) ELSE 1000 END FROM w
  WHERE s - 200 + CASE WHEN s + 1000 < length(text) AND length(regexp_extract(substr(text, s + 1, 1000), '(?s)^.*\.')) - 1 > 500 THEN length(regexp_extract(substr(text, s + 1, 1000), '(?s)^.*\.')) ELSE 1000 END < length(text))
SELECT doc_id, chunk, CASE WHEN s + 1000 < length(text) AND length(regexp_extract(substr(text, s + 1, 1000), '(?s)^.*\.')) - 1 > 500 THEN regexp_extract(substr(text, s + 1, 1000), '(?s)^.*\.') ELSE substr(text, s + 1, 1000) END AS piece FROM w"""
)
def chunk_sentences(table):
    return chunk.sentence_windows(table("documents"), "doc_id", "text")


def _table_sql(tables: str, tokens: int) -> str:
    """CTEs that end in ``parts`` (bucket, part, piece): the Markdown tables of ``tables`` (bucket, body) split by rows."""
    over = f"p.used + length(line) // 4 > {tokens} - length(head) // 4 - 50"
    return f"""t AS ({tables}),
l AS (SELECT bucket, unnest(string_split(body, chr(10))[3:]) AS line, generate_subscripts(string_split(body, chr(10))[3:], 1) AS i, array_to_string(string_split(body, chr(10))[:2], chr(10)) AS head FROM t),
p AS (SELECT bucket, i, 0 AS part, length(line) // 4 AS used FROM l WHERE i = 1
  UNION ALL SELECT l.bucket, l.i, CASE WHEN {over} THEN part + 1 ELSE part END, CASE WHEN {over} THEN 0 ELSE p.used END + length(line) // 4 FROM p JOIN l ON l.bucket = p.bucket AND l.i = p.i + 1),
parts AS (SELECT bucket, part, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS piece FROM p JOIN l USING (bucket, i) GROUP BY bucket, part)"""


@query(f"WITH RECURSIVE {_table_sql(ORACLE_SQL['chunk_rows'], 200)} SELECT bucket, part, piece FROM parts")
def table_parts(table):
    tables = chunk.table_chunks(table("documents"), F.floor(F.col("doc_id") / 50), "doc_id", ["doc_id", "lang", "source"])
    return chunk.table_parts(tables, "bucket", "body", 200)


@query(
    r"""WITH h AS (SELECT conv_id, turn, length(text) AS score FROM conversations WHERE text IS NOT NULL ORDER BY score DESC, conv_id, turn LIMIT 20),
c AS (SELECT conv_id, turn, string_agg(text, E'\n\n') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM conversations)
SELECT conv_id, count(*) AS hits, max(score)::INTEGER AS best, string_agg(context, E'\n\n---\n\n' ORDER BY turn) AS context FROM h JOIN c USING (conv_id, turn) GROUP BY conv_id"""
)
def hits_by_document(table):
    turns = table("conversations")
    longest = turns.filter("text is not null").select("conv_id", "turn", F.length("text").alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(20)
    return retrieve.hits_by_document(turns, longest, "conv_id", "turn", "text")


def _index(df: DataFrame, key: str, text: str) -> KeywordIndex:
    return KeywordIndex(df.sparkSession, f"{shared_folder(df.sparkSession)}/index-{uuid.uuid4().hex}", key, text)


@query(ORACLE_SQL["bm25_top10"])
def bm25_stored(table):
    docs = table("documents")
    index, english = _index(docs, "doc_id", "text"), F.coalesce(F.col("lang") == "en", F.lit(False))
    index.add(docs.filter(english))
    index.add(docs.filter(~english))
    return rounded(index.search(_BM25_TERMS).hits, 6)


@query(ORACLE_SQL["bm25_top10"].replace("FROM documents", "FROM documents WHERE doc_id % 7 <> 0"))
def bm25_updated(table):
    docs = table("documents")
    index = _index(docs, "doc_id", "text")
    index.add(docs.filter("doc_id % 2 = 0").withColumn("text", F.lit("replaced below")))
    index.add(docs.filter("doc_id % 2 <> 0"))
    index.delete(docs.filter("doc_id % 7 = 0"))
    index.merge()
    index.upsert(docs.filter("doc_id % 2 = 0 AND doc_id % 7 <> 0"))
    return rounded(index.search(_BM25_TERMS).hits, 6)


_CHUNKS = f"pieces AS (SELECT doc_id * 1000000 + chunk AS key, doc_id, chunk, piece FROM ({ORACLE_SQL['chunk_fixed']}))"
_CHUNK_BM25 = _BM25.replace("FROM documents", "FROM pieces").replace("doc_id", "key").replace("lower(text)", "lower(piece)")


@query(
    f"""WITH {_COS}, {_CHUNKS}, {_CHUNK_BM25},
v AS (SELECT vec_id * 1000000 AS key, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT * FROM c ORDER BY score DESC, vec_id LIMIT 20)),
k AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, key LIMIT 20)),
f AS (SELECT key, coalesce(0.6 / (60 + v.r), 0) + coalesce(0.4 / (60 + k.r), 0) AS score, CASE WHEN v.r IS NULL THEN 'keyword' WHEN k.r IS NULL THEN 'vector' ELSE 'keyword,vector' END AS sources FROM v FULL JOIN k USING (key) ORDER BY score DESC, key LIMIT 10),
w AS (SELECT key, doc_id, chunk, string_agg(piece, E'\n\n---\n\n') OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM pieces),
h AS (SELECT *, row_number() OVER o AS rank, 8000 - coalesce(sum(length(context)) OVER (ORDER BY score DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM w JOIN f USING (key) WINDOW o AS (ORDER BY score DESC, key))
SELECT rank::INTEGER AS rank, key, doc_id, chunk, round(score, 9) AS score, sources, substr(context, 1, greatest(room, 0)::INTEGER) AS context FROM h WHERE room >= length(context) OR room > 100"""
)
def hybrid_context(table):
    pieces = chunk.fixed(table("documents"), "doc_id", "text").withColumn("key", F.col("doc_id") * 1000000 + F.col("chunk"))
    index = _index(pieces, "key", "piece")
    index.add(pieces)
    vector = retrieve.vector_search(table("embeddings"), "embedding", _first_vector(table), "vec_id", 20).select((F.col("vec_id") * 1000000).alias("key"), "score")
    lists = {"vector": (vector, 0.6), "keyword": (index.search(_BM25_TERMS, 20).hits, 0.4)}
    return rounded(retrieve.hybrid_context(lists, pieces, "key", "doc_id", "chunk", "piece"), 9)


_TURNS = "SELECT conv_id AS bucket, '| turn | role |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || turn || ' | ' || coalesce(role, 'NULL') || ' |', chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1"


@query(
    f"""WITH RECURSIVE {_table_sql(_TURNS, 150)},
{_split_sql("SELECT conv_id AS key, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id", 150, 60)},
e AS (SELECT key AS doc, 3 AS rank, n, 'text' AS kind, piece FROM chunks UNION ALL SELECT bucket, 2, part, 'table', piece FROM parts
 UNION ALL SELECT conv_id, 1, 0, 'statistics', '## Document Statistics: ' || conv_id || chr(10) || chr(10) || '**Total Rows:** ' || count(*) FROM conversations GROUP BY conv_id),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, kind = 'statistics', piece ORDER BY rank, n) AS times FROM e)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY rank, n) - 1)::INTEGER AS chunk, kind, piece AS text, substr(sha256(piece), 1, 16) AS hash, (length(piece) // 4)::INTEGER AS tokens FROM o WHERE times = 1 OR (kind = 'table' AND length(piece) // 4 >= 100)"""
)
def document_chunks(table):
    turns = table("conversations")
    told = turns.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    tables = chunk.table_chunks(turns, F.col("conv_id"), "turn", ["turn", "role"]).select(F.col("bucket").alias("doc"), F.lit("table").alias("kind"), F.col("body").alias("text"))
    heads = turns.groupBy(F.col("conv_id").alias("doc")).agg(F.count("*").alias("n")).select("doc", F.lit("statistics").alias("kind"), F.format_string("## Document Statistics: %s\n\n**Total Rows:** %d", F.col("doc").cast("string"), "n").alias("text"))
    parts = told.withColumn("kind", F.lit("text")).unionByName(tables).unionByName(heads).withColumn("place", F.lit(0))
    return chunk.document_chunks(parts, 150, 60)


# a log of questions, as an order's clerk may have asked them
_ASKED = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'What is the total o_totalprice over ' || (o_custkey % 900) WHEN 1 THEN 'top ' || (o_custkey % 20) || ' customers ranked' WHEN 2 THEN 'orders similar to ' || o_orderkey
 WHEN 3 THEN 'O_TOTALPRICE between ' || (o_custkey % 50) || ' and  ' || (o_custkey % 99 + 50) || ' since ' || {day} WHEN 4 THEN 'show me the o_orderstatus column where o_custkey is ' || o_custkey WHEN 5 THEN 'monthly distribution of o_totalprice in march  1995'
 WHEN 6 THEN o_orderpriority || ' less than ' || (o_custkey % 7) || '.5' ELSE o_orderstatus END AS q FROM orders"""
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _asked(table) -> DataFrame:
    orders = table("orders")
    n = lambda c, m: (F.col(c) % m).cast("string")
    texts = [
        F.concat(F.lit("What is the total o_totalprice over "), n("o_custkey", 900)), F.concat(F.lit("top "), n("o_custkey", 20), F.lit(" customers ranked")), F.concat(F.lit("orders similar to "), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("O_TOTALPRICE between "), n("o_custkey", 50), F.lit(" and  "), (F.col("o_custkey") % 99 + 50).cast("string"), F.lit(" since "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("show me the o_orderstatus column where o_custkey is "), F.col("o_custkey").cast("string")),
        F.lit("monthly distribution of o_totalprice in march  1995"), F.concat(F.col("o_orderpriority"), F.lit(" less than "), n("o_custkey", 7), F.lit(".5")), F.col("o_orderstatus"),
    ]
    return orders.select("o_orderkey", F.element_at(F.array(*texts), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("q"))


@query(
    f"""WITH a AS (SELECT o_orderkey, lower(q) AS q FROM ({_ASKED.format(day="strftime(o_orderdate, '%Y-%m-%d')")})),
n AS (SELECT *, len(list_filter(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice'], lambda c: contains(q, c))) AS named,
 CASE WHEN regexp_matches(q, '\\bsimilar\\s+to\\b') THEN 'semantic' WHEN o_orderkey % 8 = 4 THEN 'lookup' WHEN o_orderkey % 8 = 5 THEN 'temporal' WHEN o_orderkey % 8 = 0 THEN 'aggregate' WHEN o_orderkey % 8 = 1 THEN 'sort'
 WHEN o_orderkey % 8 = 3 AND regexp_matches(q, 'since \\d{{4}}') THEN 'temporal' ELSE 'unknown' END AS category FROM a),
s AS (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN 76 WHEN 1 THEN 48 WHEN 3 THEN 108 WHEN 4 THEN 58 WHEN 5 THEN 46 END / 100 AS w FROM n),
b AS (SELECT o_orderkey, category, named, CASE WHEN category = 'semantic' THEN 0.1 WHEN named > 0 THEN least(coalesce(0.6 + w, 0) + 0.1 * named, 0.95) ELSE coalesce(0.6 + w, 0) END AS score FROM s)
SELECT o_orderkey, round(score, 6)::DOUBLE AS score, category, CASE WHEN category = 'semantic' THEN 'search' WHEN score > 0.7 AND category IN ('aggregate', 'filter', 'sort', 'lookup') AND (named > 0) THEN 'compute' WHEN score > 0.5 THEN 'explain' ELSE 'search' END AS path FROM b"""
)
def question_scores(table):
    return rounded(_asked(table).select("o_orderkey", questions.scored(F.col("q"), _COLUMNS).alias("s")).select("o_orderkey", "s.*"), 6)


@query(
    f"""WITH a AS (SELECT o_orderkey, lower(q) AS q FROM ({_ASKED.format(day="strftime(o_orderdate, '%Y-%m-%d')")}))
SELECT o_orderkey, array_to_string(list_filter(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice'], lambda c: contains(q, c)), ',') AS columns,
 round(list_sum(list_transform(regexp_extract_all(q, '\\b\\d+(?:\\.\\d+)?\\b'), lambda x: x::DOUBLE)), 4) AS numbers,
 array_to_string(list_concat(regexp_extract_all(q, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'), list_transform(regexp_extract_all(q, 'march\\s+\\d{{4}}'), lambda x: 'march ' || right(x, 4))), ',') AS dates,
 CASE o_orderkey % 8 WHEN 0 THEN '>' || regexp_extract(q, 'over (\\d+)', 1) WHEN 3 THEN 'between' || replace(regexp_extract(q, 'between (\\d+ and  \\d+)', 1), '  ', ' ') WHEN 4 THEN '=' || regexp_extract(q, 'is (\\d+)', 1) WHEN 6 THEN '<' || regexp_extract(q, 'less than (\\d+)', 1) ELSE '' END AS comparisons FROM a"""
)
def question_entities(table):
    found = _asked(table).select("o_orderkey", questions.entities(F.col("q"), _COLUMNS).alias("e")).select("o_orderkey", "e.*")
    joined = F.array_join(F.transform("comparisons", lambda c: F.concat(c["op"], c["value"])), ",")
    return rounded(found.select("o_orderkey", F.array_join("columns", ",").alias("columns"), F.when(F.size("numbers") > 0, F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x)).alias("numbers"), F.array_join("dates", ",").alias("dates"), joined.alias("comparisons")))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority = '1-URGENT' AND o_orderdate >= '1995-01-01' GROUP BY 1")
def question_filters(table):
    asked = "total o_totalprice by o_orderstatus where o_totalprice between 1000 and 90000 and o_orderpriority is '1-URGENT' and o_orderdate since 1995-01-01"
    return rounded(router.answer(asked, table("orders").select("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")), 2)


def _folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


@query("SELECT doc_id::DOUBLE AS doc_id, lang, source, nullif(trim(substr(replace(text, chr(13), ' '), 1, 40)), '') AS head FROM documents")
def csv_of_encodings(table):
    docs, encodings = table("documents"), ("UTF-8", "ISO-8859-1", "UTF-16")
    head = docs.select("doc_id", "lang", "source", F.substring(F.replace("text", F.lit("\r"), F.lit(" ")), 1, 40).alias("head"))
    folder = _folder(docs)
    for i, encoding in enumerate(encodings):
        tables.write_table(head.filter(F.pmod("doc_id", F.lit(len(encodings))) == i), f"{folder}/part={i}", "csv", encoding=encoding)
    return tables.read_table(docs.sparkSession, f"{folder}/*", "csv")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 4) AS s_acctbal FROM supplier")
def json_of_lists(table):
    suppliers = table("supplier")
    folder = _folder(suppliers)
    columns = ["s_suppkey", "s_name", "s_acctbal"]
    # a file for each nation, each an object of lists
    rows = suppliers.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r")).select("s_nationkey", *[F.col(f"r.{c}").alias(c) for c in columns])
    rows.repartition(F.col("s_nationkey")).write.partitionBy("s_nationkey").json(folder)
    return rounded(tables.read_table(suppliers.sparkSession, f"{folder}/*", "json").select("s_suppkey", "s_name", "s_acctbal"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders")
def tsv_and_orc(table):
    orders = table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", "o_orderpriority")
    folder = _folder(orders)
    tables.write_table(orders.filter("o_orderkey % 2 = 0"), f"{folder}/even.tsv")
    tables.write_table(orders.filter("o_orderkey % 2 <> 0"), f"{folder}/odd.orc")
    even = tables.read_table(orders.sparkSession, f"{folder}/even.tsv").withColumn("o_orderkey", F.col("o_orderkey").cast("long")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return rounded(even.unionByName(tables.read_table(orders.sparkSession, f"{folder}/odd.orc")), 2)


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, count({a} + {b}) AS n, round(corr({a}, {b}), 6) AS r FROM (SELECT * REPLACE (CASE WHEN l_quantity > 10 THEN l_tax END AS l_tax) FROM lineitem)" for a in _NUMBERS for b in _NUMBERS))
def correlation_matrix(table):
    lines = table("lineitem").withColumn("l_tax", F.when(F.col("l_quantity") > 10, F.col("l_tax")))
    return rounded(profile.correlation_matrix(lines, _NUMBERS), 6)


@query("SELECT l_suppkey AS value, count(*) AS count FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def top_values_by_sketch(table):
    lines = table("lineitem")
    return sketches.top_values(lines, "l_suppkey", sketches.frequent(lines, "l_suppkey", F.col("l_returnflag")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, round(min({n}), 4) AS low, round(max({n}), 4) AS high, true AS distinct_fits FROM lineitem" for c, n in (("l_quantity", "l_quantity"), ("l_returnflag", "NULL::DOUBLE"), ("l_suppkey", "l_suppkey"), ("l_shipdate", "NULL::DOUBLE"))))
def profile_of_merged_parts(table):
    lines = table("lineitem").select("l_quantity", "l_returnflag", "l_suppkey", "l_shipdate")
    folder = _folder(lines)
    sketches.states(lines, part=F.date_format("l_shipdate", "yyyy")).write.parquet(folder)
    found = sketches.profile(lines.sparkSession.read.parquet(folder))
    exact = profile.completeness(lines).select("name", F.col("distinct").alias("exact"))
    fits = F.col("exact").between(F.col("distinct_low"), F.col("distinct_high"))
    return rounded(found.join(exact, "name").select("name", "rows", "nulls", "low", "high", fits.alias("distinct_fits")))


_FIGURES = ["l_quantity", "l_extendedprice", "l_tax"]
_LATE = "(SELECT * REPLACE (CASE WHEN l_quantity > 10 THEN l_tax END AS l_tax) FROM lineitem)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(sum({c}), 2) AS total, round(avg({c}), 4) AS average, round(min({c}), 4) AS least, round(max({c}), 4) AS most, round(stddev_samp({c}), 4) AS std, count({c}) AS records, count(*) - count({c}) AS nulls, round(count({c}) / count(*) * 100, 1) AS populated_pct FROM {_LATE}" for c in _FIGURES))
def long_report(table):
    lines = table("lineitem").withColumn("l_tax", F.when(F.col("l_quantity") > 10, F.col("l_tax")))
    return rounded(report.long_report(lines, _FIGURES)).withColumn("total", F.round("total", 2))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, (SELECT count(DISTINCT {c}) FROM lineitem) AS \"distinct\", (row_number() OVER (ORDER BY n DESC, v))::INTEGER AS rank, v AS value, n AS count FROM (SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY rank <= 10" for c in ("l_returnflag", "l_linestatus")))
def category_values(table):
    return report.categories(table("lineitem"), ["l_returnflag", "l_linestatus"])


@query(f"SELECT name, nulls, round(nulls / n * 100, 2) AS missing_pct FROM (SELECT 'l_tax' AS name, count(*) - count(l_tax) AS nulls, count(*) AS n FROM {_LATE} UNION ALL SELECT 'l_quantity', count(*) - count(l_quantity), count(*) FROM {_LATE}) WHERE nulls > 0 ORDER BY nulls DESC, name LIMIT 10")
def top_missing(table):
    return report.top_missing(table("lineitem").select("l_quantity", F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("l_tax")))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS name, {u} AS unit, round(min({c})::DOUBLE, 4) AS least, round(max({c})::DOUBLE, 4) AS most, round(avg({c}), 4) AS average FROM {t}" for t, c, u in (("part", "p_size", "NULL"), ("part", "p_retailprice", "'L'"), ("supplier", "s_acctbal", "'L'"))))
def all_metrics(table):
    return rounded(report.all_metrics({"part": table("part").select("p_size", "p_retailprice"), "supplier": table("supplier").select("s_acctbal")}))


@query(
    f"""WITH {_BM25}, h AS (SELECT doc_id, source, text FROM bm JOIN documents USING (doc_id) WHERE bm.score > 0 ORDER BY bm.score DESC, doc_id LIMIT 20),
f AS (SELECT text, min(coalesce(source, 'unknown') || chr(1) || lpad(doc_id::VARCHAR, 12, '0')) AS k FROM h GROUP BY text)
SELECT 'DATA CONTEXT (DO NOT SUMMARIZE, DO NOT REPEAT VERBATIM):' || chr(10) || repeat('-', 55) || chr(10) || substr(string_agg('### Info from ' || split_part(k, chr(1), 1) || ':' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k), 1, 8000) || chr(10) || repeat('-', 55) AS context FROM f"""
)
def structured_context(table):
    hits = retrieve.bm25(table("documents").select("doc_id", "source", "text"), "text", _BM25_TERMS, 20)
    return report.structured_context(hits, "source", "doc_id", "text", hygiene.is_table(F.col("text")))


@query("SELECT conv_id, count(*) AS chunks, 0::BIGINT AS tables, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def document_texts(table):
    return report.document_texts(table("conversations"), "conv_id", "turn", "text")


@query(f"SELECT count(*) AS total_chunks, sum(tokens)::BIGINT AS total_tokens, count(*) FILTER (kind = 'table') AS table_chunks, count(*) FILTER (kind = 'text') AS text_chunks, count(*) FILTER (kind = 'statistics') AS stats_chunks, sum(tokens)::BIGINT // count(*) AS avg_tokens, count(DISTINCT doc) AS sources FROM ({ORACLE_SQL['document_chunks']})")
def chunk_summary(table):
    return report.chunk_summary(QUERIES_OF["document_chunks"](table))


@query(
    """WITH q AS (SELECT o_orderkey, lower(CASE o_orderkey % 6 WHEN 0 THEN 'Brine and crude sold' WHEN 1 THEN 'total PRODUCTION of ' || o_orderpriority WHEN 2 THEN 'a small, thermal summary only' WHEN 3 THEN 'All sales in-depth' WHEN 4 THEN 'briefly: H2O injected' ELSE o_orderpriority END) AS q FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'oil,water' WHEN 1 THEN 'production' WHEN 2 THEN 'heat' WHEN 3 THEN 'sales' WHEN 4 THEN 'water' ELSE '' END AS metrics,
 CASE WHEN o_orderkey % 6 = 3 THEN 'detailed' WHEN o_orderkey % 6 IN (2, 4) THEN 'brief' ELSE 'normal' END AS detail, (CASE WHEN o_orderkey % 6 = 3 THEN 15 WHEN o_orderkey % 6 IN (2, 4) THEN 4 ELSE 8 END)::INTEGER AS wanted FROM q"""
)
def question_metrics(table):
    texts = [F.lit("Brine and crude sold"), F.concat(F.lit("total PRODUCTION of "), F.col("o_orderpriority")), F.lit("a small, thermal summary only"), F.lit("All sales in-depth"), F.lit("briefly: H2O injected"), F.col("o_orderpriority")]
    asked = table("orders").select("o_orderkey", F.element_at(F.array(*texts), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("q"))
    found = asked.select("o_orderkey", F.array_join(router.metrics_column(F.col("q")), ",").alias("metrics"), router.detail_column(F.col("q")).alias("detail"))
    return found.withColumn("wanted", router.chunks_wanted(F.col("detail")))


@query(
    r"""SELECT o_orderpriority, regexp_matches(array_to_string((array_agg(o_clerkish ORDER BY o_orderkey))[:10], ' '), '\d{4}[-/]\d{1,2}[-/]\d{1,2}') AS dated, format('{:,.2f}', sum(o_totalprice)) AS total
FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'by ' || strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderstatus END AS o_clerkish FROM orders) GROUP BY 1""".replace("\\\\", "\\")
)
def dated_and_shown(table):
    note = F.when(F.contains("o_orderpriority", F.lit("URGENT")), F.concat(F.lit("by "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(F.col("o_orderstatus"))
    orders = table("orders").select("o_orderpriority", "o_orderkey", "o_totalprice", note.alias("note"))
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    first = orders.withColumn("rank", rank).filter("rank <= 10").groupBy("o_orderpriority").agg(F.collect_list("note").alias("notes"))
    total = orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    return first.join(total, "o_orderpriority").select("o_orderpriority", hygiene.looks_dated(F.col("notes")).alias("dated"), report.amount(F.col("total")).alias("total"))
