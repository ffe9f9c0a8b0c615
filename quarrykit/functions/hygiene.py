"""Names, cells, tokens, units: scalar functions over columns or names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a missing cell; name pattern of each unit, first match wins; words left out of search.
NULL_TOKENS = ("", "nan", "none", "null", "n/a", "na", "-")
UNITS = {
    "currency": r"price|cost|amount|revenue|salary|income|usd|eur|gbp|\$",
    "percentage": r"percent|pct|%",
    "weight": r"kg|kilogram|gram|weight|mass",
    "distance": r"meter|metre|km|mile|distance|length|height|width",
    "time": r"hour|minute|second|day|week|month|year|duration|time",
    "count": r"count|quantity|qty|number|num|total",
    "rate": r"rate|ratio",
    "temperature": r"temperature|temp|celsius|fahrenheit",
}
# Finer units by name, first match wins; words of names from which a unit is taken for granted; dates in texts.
FINE_UNITS = (
    (r"\$|usd", "USD"), (r"eur|€", "EUR"), (r"gbp|£", "GBP"), (r"inr|₹", "INR"), (r"%|percent|pct", "%"), (r"kg|kilogram", "kg"), (r"lb|pound", "lb"), (r"g|gram", "g"), (r"km|kilometer", "km"), (r"m|meter", "m"), (r"cm|centimeter", "cm"),
    (r"in|inch", "in"), (r"ft|feet|foot", "ft"), (r"l|liter|litre", "L"), (r"ml|milliliter", "ml"), (r"gal|gallon", "gal"), (r"units?|qty|quantity|count", "units"), (r"pcs|pieces", "pcs"),
)
IMPLIED_UNITS = (("USD", ("price", "cost", "amount", "revenue", "sales", "total")), ("%", ("rate", "ratio", "pct")))
DATES = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}[-/]\d{1,2}[-/]\d{2}|(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
STOP_WORDS = tuple(
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can this that these those it its i you he she we they what which who whom when where why how all each every both few more most other some such no nor not only same so than too very".split()
)


def clean_header(names: list[str]) -> list[str]:
    """Distinct column names: trimmed, white space to ``_``, odd characters out, empty ones numbered, repeats suffixed."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = "" if re.fullmatch(r"Unnamed:?\s*\d*", name.strip()) else name.strip()
        name = re.sub(r"[^\w-]", "", re.sub(r"\s+", "_", name)) or f"Column_{i + 1}"
        taken, base, k = {n.lower() for n in out}, name, 0
        while name.lower() in taken:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def clean_cell(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def unit_of(name: str) -> str | None:
    return next((u for u, p in UNITS.items() if re.search(p, name.lower())), None)


def fine_unit(name: str) -> str | None:
    """The unit a column's name spells, letters anywhere in it, else the one its kind is counted in."""
    name = name.lower()
    return next((u for p, u in FINE_UNITS if re.search(p, name)), None) or next((u for u, words in IMPLIED_UNITS if any(w in name for w in words)), None)


def looks_dated(values: Column) -> Column:
    """Whether one of the first ten values that are there, of an array of strings, holds a date."""
    return F.exists(F.slice(F.filter(values, lambda v: v.isNotNull()), 1, 10), lambda v: v.rlike(DATES))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers that stand alone, of two characters or more, without stop words."""
    alone = r"(?<![\p{L}\p{N}_])[a-z0-9]{2,}+(?![\p{L}\p{N}_])"
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(alone), 0), lambda t: ~t.isin(*STOP_WORDS))


def chunk_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def structure_hash(text: Column) -> Column:
    first = F.substring(F.substring_index(text, "\n", 1), 1, 100)
    return F.substring(F.md5(F.concat(first, F.lit(":"), F.length(text).cast("string"))), 1, 16)


#: What is noise as a whole, in lower case, and characters below which any text is.
NOISE = (r"^page\s*\d+(\s*(of|/)?\s*\d+)?$", r"^[\s\-=_]{5,}$", r"^(published|confidential|proprietary)\s*(published|confidential|proprietary)?$")
LEAST = 10


def is_noise(text: Column) -> Column:
    """Empty or very short text, page numbers, separators, classification marks."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")))
    return reduce(Column.__or__, [t.rlike(p) for p in NOISE], F.length(t) < LEAST)


def is_table(text: Column) -> Column:
    """Markdown table: two lines or more with two pipes, one of them a separator."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    piped = F.size(F.filter(lines, lambda x: x.rlike(r"\|.*\|")))
    rule = F.exists(lines, lambda x: x.rlike(r"^\|\s*-+\s*\|"))
    return (piped >= 2) & rule


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def cache_key(query: Column) -> Column:
    return F.md5(F.lower(F.trim(F.regexp_replace(query, r"\s+", " "))))
