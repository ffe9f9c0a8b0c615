"""Columns of questions: how sure each can be computed from a table, by which path, and what it names.

Expressions over a column, so that a log of questions of any length is scored where it lies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of questions that a table can answer, by category; the length of a pattern is its weight.
COMPUTED = {
    "aggregate": [r"\b(total|sum|count|average|avg|mean|median|min|max|std|variance)\b", r"\bhow many\b", r"\bwhat is the (total|sum|average|count)\b"],
    "filter": [r"\bwhere\b.*\b(is|are|equals?|greater|less|more|fewer)\b", r"\bfilter\b", r"\bonly\b.*\b(show|include|display)\b", r"\bexclude\b", r"\bwith\b.*\b(value|price|count)\b.*\b(over|under|above|below)\b"],
    "sort": [r"\b(top|bottom|highest|lowest|best|worst)\s+\d+\b", r"\brank(ed|ing)?\b", r"\bsort(ed)?\s+by\b", r"\border\s+by\b", r"\b(ascending|descending)\b"],
    "lookup": [r"\bshow\s+(me\s+)?(the\s+)?(\w+)\s+(column|field|values?)\b", r"\bget\s+(the\s+)?(\w+)\s+(for|from)\b", r"\bwhat\s+(is|are)\s+the\s+(\w+)\s+(of|for)\b", r"\blist\s+(all\s+)?(\w+)\b"],
    "temporal": [r"\b(last|previous|this|next)\s+(week|month|year|quarter|day)\b", r"\b(daily|weekly|monthly|yearly|quarterly)\b", r"\bfrom\s+\d{4}.*to\s+\d{4}\b", r"\bsince\s+(january|february|march|april|may|june|july|august|september|october|november|december|\d{4})\b"],
    "statistical": [r"\bdistribution\s+of\b", r"\bcorrelation\s+between\b", r"\bpercentile\b", r"\boutliers?\b", r"\bstandard\s+deviation\b"],
}
# Patterns of questions that need a search of texts, dates and comparisons in questions.
SEARCHED = [r"\bsimilar\s+to\b", r"\blike\s+\w+\b", r"\brelated\s+to\b", r"\babout\s+\w+\b", r"\bfind\s+(documents?|files?|content)\b", r"\bsearch\s+for\b", r"\bwhat\s+(did|does|do)\s+\w+\s+(say|mention|discuss)\b", r"\bcontext\b", r"\bsemantic\b", r"\bmeaning\b"]
DATES = [r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{1,2}/\d{1,2}/\d{4})\b", r"\b((?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4})\b", r"\b((?:last|this|next)\s+(?:week|month|year|quarter))\b"]
COMPARED = {">": r"(?:greater|more|over|above)\s+(?:than\s+)?(\d+)", "<": r"(?:less|fewer|under|below)\s+(?:than\s+)?(\d+)", "=": r"(?:equals?|is)\s+(\d+)", "between": r"between\s+(\d+\s+and\s+\d+)"}
NUMBER = r"\b(\d+(?:\.\d+)?)\b"
BASE, BY_LENGTH, BY_COLUMN, MOST, SEARCH = 0.6, 100, 0.1, 0.95, 0.1
#: Categories that a table answers alone, from SURE on and with a column or comparison named; from LIKELY on it answers with words around.
ALONE, SURE, LIKELY = ("aggregate", "filter", "sort", "lookup"), 0.7, 0.5


def named_columns(question: Column, columns: list[str]) -> Column:
    """The columns whose names stand in a question."""
    q = F.lower(question)
    return F.filter(F.array(*[F.when(F.contains(q, F.lit(c.lower())), F.lit(c)) for c in columns]).cast("array<string>"), lambda c: c.isNotNull())


def entities(question: Column, columns: list[str]) -> Column:
    """(columns, numbers, dates, comparisons) of a question; a comparison has an operator and one value, or two with ``and``."""
    q = F.lower(F.coalesce(question, F.lit("")))
    numbers = F.transform(F.regexp_extract_all(q, F.lit(NUMBER), 1), lambda x: x.cast("double"))
    dates = F.transform(F.concat(*[F.regexp_extract_all(q, F.lit(p), 1) for p in DATES]), lambda d: F.regexp_replace(d, r"\s+", " "))
    compared = lambda op: lambda v: F.struct(F.lit(op).alias("op"), F.regexp_replace(v, r"\s+", " ").alias("value"))
    found = [F.transform(F.regexp_extract_all(q, F.lit(p), 1), compared(op)) for op, p in COMPARED.items()]
    return F.struct(named_columns(F.coalesce(question, F.lit("")), columns).alias("columns"), numbers.alias("numbers"), dates.alias("dates"), F.concat(*found).alias("comparisons"))


def scored(question: Column, columns: list[str]) -> Column:
    """(score, category, path): from 0 to 1 how sure the table's columns answer a question, and how it is to be answered.

    The longest pattern that fits decides the category, the first of the longest where several do; every column named adds
    to the score. Questions that need a search have a score of their own. Paths: compute, explain (compute, then put it in
    words) and search.
    """
    q = F.lower(F.coalesce(question, F.lit("")))
    patterns = [(c, p) for c, group in COMPUTED.items() for p in group]
    fits = [F.when(q.rlike(p), F.struct(F.lit(float(len(p))).alias("weight"), F.lit(-i).alias("place"), F.lit(c).alias("category"))) for i, (c, p) in enumerate(patterns)]
    best = F.array_max(F.array(*fits))
    named, compared = F.size(named_columns(q, columns)), reduce(Column.__or__, [q.rlike(p) for p in COMPARED.values()])
    base = F.coalesce(BASE + best["weight"] / BY_LENGTH, F.lit(0.0))
    score = F.when(named > 0, F.least(base + BY_COLUMN * named, F.lit(MOST))).otherwise(base)
    category = F.coalesce(best["category"], F.lit("unknown"))
    searched = q.rlike("|".join(SEARCHED))
    path = F.when((score > SURE) & category.isin(*ALONE) & ((named > 0) | compared), "compute").when(score > LIKELY, "explain").otherwise("search")
    answer = lambda s, c, p: F.struct(s.alias("score"), c.alias("category"), p.alias("path"))
    return F.when(searched, answer(F.lit(SEARCH), F.lit("semantic"), F.lit("search"))).otherwise(answer(score, category, path))
