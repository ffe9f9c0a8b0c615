"""Questions to plans: mode of a question, what it asks for, and the DataFrame that answers it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.operators import aggregate, profile, trend

# Words, phrases and patterns of each mode, looked for anywhere in the lower-cased question.
DATA = [
    "oil", "gas", "water", "condensate", "lpg", "ngl", "crude", "production", "prod", "sales", "injection", "inject", "inj", "bbl", "barrel", "mcf", "mmbtu", "volume", "vol",
    "rate", "pressure", "temp", "temperature", "density", "flare", "fuel", "energy", "btu", "heat", "well", "wells", "field", "fields", "battery", "facility", "asset", "completion", "completions", "reservoir",
    "plot", "chart", "visualize", "graph", "display", "show me", "create chart", "draw", "render", "visualization", "trend", "trends", "compare", "comparison", "analyze", "analysis", "statistics", "stats", "metric", "metrics",
    "column", "columns", "schema", "rows", "records", "table", "data quality", "missing values", "completeness", "total", "average", "avg", "sum", "max", "min", "count", "mean", "median", "std", "deviation", "variance",
    "monthly", "yearly", "daily", "weekly", "quarterly", "by month", "by year", "by date", "over time", "time series",
]
OVERVIEW_PHRASES = [
    "what's in this document", "what is in this document", "what's in the document", "what is in the document", "what's in this file", "what is in this file", "what does this document contain", "what does the document contain", "what does this file contain",
    "describe this document", "describe the document", "describe this file", "describe the file", "describe this dataset", "describe the dataset", "explain this document", "explain the document", "explain this file", "explain this dataset",
    "document overview", "dataset overview", "file overview", "data overview", "overview of the data", "overview of this data", "overview of the document", "overview of the file",
    "tell me about this document", "tell me about the document", "tell me about this file", "tell me about this dataset", "tell me what this file contains", "tell me what the file contains", "tell me in detail what's inside",
    "structure of this", "structure of the", "what data is in", "what information is in", "summarize the document", "summarize this document",
    "executive summary", "summary of this document", "summary of the document", "summary of this file", "summary of this dataset", "give me a summary", "provide a summary",
    "high level summary", "high-level summary", "brief summary", "quick summary", "full summary", "complete summary", "comprehensive summary",
]
SYSTEM_PHRASES = [
    "fix this", "fix the bug", "fix this bug", "fix the error", "fix this error", "fix the issue", "fix this issue", "solve this issue", "solve the issue", "debug", "debugging",
    "improve the engine", "improve the system", "improve the rag", "make it detailed", "make it more detailed", "add more detail", "enhance the",
    "modify the engine", "modify the rag", "modify the system", "change the architecture", "change the model", "change how you respond", "update the code", "update the prompt", "fix the prompt", "fix the intent",
    "implement this", "add a feature", "refactor", "rewrite the",
]
FREEFORM_WORDS = [
    "how to eat", "how to cook", "recipe", "food", "ice cream", "cake", "pizza", "cooking", "joke", "jokes", "tell me a joke", "funny", "poem", "story", "sing", "song", "movie", "game", "sports",
    "who is", "who was", "history of", "geography", "define", "meaning of", "what does .+ mean", "science", "physics", "biology", "chemistry",
    "hello", "hi", "hey", "good morning", "good evening", "thank you", "thanks", "bye", "goodbye", "how are you", "what's your name", "who are you",
    "advice", "help me with", "relationship", "love", "weather", "travel", "vacation",
]
STARTER_WORDS = ["what", "how", "show", "tell", "give", "list", "calculate"]
# any white space between the words of the commonest overview questions
OVERVIEW = "|".join([*OVERVIEW_PHRASES, r"what('s|\s+is)\s+in\s+(this|the)\s+(document|file|dataset)", r"(describe|explain|summary\s+of|tell\s+me\s+about)\s+(this|the)\s+(document|file|dataset)", r"(document|dataset|file)\s+overview"])
SYSTEM = "|".join(SYSTEM_PHRASES)
FREEFORM = rf"\b({'|'.join(FREEFORM_WORDS)})\b"
STARTERS = rf"^({'|'.join(STARTER_WORDS)})"
RESOURCES = {"oil": ["oil", "crude"], "gas": ["gas", "mcf", "flare"], "water": ["water", "wat"], "condensate": ["cond"], "lpg": ["lpg"], "ngl": ["ngl", "natural gas liquid"], "energy": ["energy", "btu", "heat"]}
# Words of each metric; where one of RESOURCE_NAMES is named, the general ones say nothing.
METRIC_WORDS = {
    "oil": ["oil", "crude", "petroleum"], "gas": ["gas", "natural gas", "mmcf", "mcf", "fuel gas", "flare"], "water": ["water", "wat", "h2o", "brine", "produced water"], "condensate": ["condensate", "cond"],
    "lpg": ["lpg", "liquefied petroleum"], "ngl": ["ngl", "natural gas liquid"], "heat": ["heat", "thermal"], "energy": ["energy", "btu", "mmbtu"], "injection": ["injection", "inject", "injected"], "production": ["production", "produced", "prod"], "sales": ["sales", "sold", "sale"],
}
RESOURCE_NAMES = ("oil", "gas", "water", "condensate", "lpg", "ngl", "heat", "energy")
# Words that ask for much or little, and how many chunks each mode takes.
DETAILED = ["in detail", "detailed", "full", "complete", "comprehensive", "everything", "all", "entire", "whole", "in-depth", "thorough", "elaborate", "explain deeply", "deep dive", "deeply", "extensively"]
BRIEF = ["short", "brief", "quick", "concise", "simple", "just tell me", "one line", "summary only", "tldr", "briefly", "quickly"]
CHUNKS = {"detailed": 15, "normal": 8, "brief": 4}
FLOWS = {"injection": ["inj"], "production": ["prod"], "sales": ["sale", "sold"]}
COLUMN_PARTS = {"oil": ["OIL"], "gas": ["GAS"], "water": ["WAT"], "condensate": ["COND"], "lpg": ["LPG"], "ngl": ["NGL"], "energy": ["ENERGY", "BTU", "HEAT"], "production": ["PROD"], "sales": ["SALES"], "injection": ["INJ"]}
MEASURES = ("VOL", "RATE", "ENERGY", "BTU", "HEAT")
# How a question asks to be computed, in order of precedence.
INTENTS = {
    "semantic": r"\b(similar to|related to|search for|find (documents?|files?|content)|context|semantic|meaning)\b",
    "sort": r"\b(top|bottom|highest|lowest|best|worst)\b\s*\d*|\brank(ed|ing)?\b|\b(sort(ed)?|order) by\b",
    "trend": r"\b(trends?|over time|(last|previous|next) (week|month|year|quarter|day)|daily|weekly|monthly|yearly|quarterly)\b",
    "compare": r"\bcompar(e|ed|ing|ison)\b",
    "anomaly": r"\b(outliers?|anomal(y|ies))\b",
    "correlation": r"\bcorrelat",
    "distribution": r"\b(distribution|histogram|frequency)\b",
    "aggregate": r"\b(total|sum|count|average|avg|mean|median|min|max|std|how many)\b",
}
AGGREGATES = {"total": "sum", "sum": "sum", "average": "mean", "avg": "mean", "mean": "mean", "median": "median", "min": "min", "minimum": "min", "max": "max", "maximum": "max", "std": "std", "count": "count", "how many": "count"}
CHARTS = {"time_series": ("trend", "over time", "time series", "timeline"), "bar": ("bar", "compare", "comparison", "by"), "pie": ("pie", "distribution", "breakdown", "proportion"), "histogram": ("histogram", "distribution of", "frequency"), "heatmap": ("correlation", "heatmap", "relationship")}


def mode(question: str, columns: list[str] = ()) -> str:
    """overview, freeform, system or data."""
    q = question.lower().strip()
    about_data = any(w in q for w in DATA)
    if re.search(OVERVIEW, q):
        return "overview"
    if not about_data and re.search(FREEFORM, q):
        return "freeform"
    if re.search(SYSTEM, q):
        return "system"
    named = any(c.lower() in q or c.lower().replace("_", " ") in q for c in columns)
    return "data" if named or about_data or re.search(STARTERS, q) else "freeform"


def confidence(question: str, of: str) -> float:
    hits = sum(w in question.lower() for w in DATA)
    return {"freeform": 0.9, "system": 0.9, "overview": 0.95}.get(of, min(0.6 + 0.05 * hits, 0.98))


def mode_column(text: Column) -> Column:
    """``mode`` of a column of questions, as an expression."""
    q = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    about_data = q.rlike("|".join(DATA))
    return F.when(q.rlike(OVERVIEW), "overview").when(~about_data & q.rlike(FREEFORM), "freeform").when(q.rlike(SYSTEM), "system").when(about_data | q.rlike(STARTERS), "data").otherwise("freeform")


def metrics_in(question: str) -> list[str]:
    q = question.lower()
    return [m for m, words in (RESOURCES | FLOWS).items() if any(w in q for w in words)]


def metrics_column(text: Column) -> Column:
    """The metrics that each question of a column names, as an array; general ones only where no resource is named."""
    q = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.array(*[F.when(q.rlike("|".join(words)), F.lit(m)) for m, words in METRIC_WORDS.items()]), lambda m: m.isNotNull())
    resources = F.filter(found, lambda m: m.isin(*RESOURCE_NAMES))
    return F.when(F.size(resources) > 0, resources).otherwise(found)


def detail_column(text: Column) -> Column:
    """detailed, normal or brief for a column of questions; the words that ask for it stand alone, so that small asks for nothing."""
    q = F.lower(F.coalesce(text, F.lit("")))
    alone = lambda words: rf"\b({'|'.join(words)})\b"
    return F.when(q.rlike(alone(DETAILED)), "detailed").when(q.rlike(alone(BRIEF)), "brief").otherwise("normal")


def chunks_wanted(mode: Column) -> Column:
    return F.element_at(F.create_map(*[x for m, n in CHUNKS.items() for x in (F.lit(m), F.lit(n))]), mode)


def metric_columns(metrics: list[str], columns: list[str]) -> list[str]:
    """Columns of a measure that fit one of the resources asked for and all of the flows; units of measure left out."""
    resources, flows = [m for m in metrics if m in RESOURCES], [m for m in metrics if m in FLOWS]
    fits = lambda c, ms: [any(p in c for p in COLUMN_PARTS[m]) for m in ms]
    out = []
    for name in columns:
        c = name.upper()
        if not metrics or c.endswith("_UOM") or not any(m in c for m in MEASURES):
            continue
        if (any(fits(c, resources)) and all(fits(c, flows))) if resources else any(fits(c, flows)):
            out.append(name)
    return out


@dataclass
class Plan:
    """What a question asks for."""

    mode: str
    intent: str = "profile"
    function: str = "sum"
    n: int = 10
    group: str | None = None
    value: str | None = None
    filters: list[str] = field(default_factory=list)
    path: str = "retrieve"


def plan(question: str, df: DataFrame) -> Plan:
    q = question.lower()
    found = Plan(mode(question, df.columns))
    found.intent = next((i for i, p in INTENTS.items() if re.search(p, q)), "profile")
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    named = [c for c in df.columns if re.search(rf"\b{re.escape(c.lower())}\b|\b{re.escape(c.lower().replace('_', ' '))}\b", q)]
    values = [c for c in named if c in numeric] or [c for c in metric_columns(metrics_in(question), df.columns) if c in numeric]
    by = re.search(r"\b(?:by|per|for each)\s+([\w ]+)", q)
    asked_by = [c for c in named if by and (c.lower() in by[1] or c.lower().replace("_", " ") in by[1])]
    groups = [c for c in named if c not in numeric] or (asked_by if found.intent != "sort" or len(named) > len(asked_by) else [])
    found.group = groups[0] if groups else None
    found.value = next((c for c in values if c != found.group), None)
    found.function = next((f for w, f in AGGREGATES.items() if re.search(rf"\b{w}\b", q)), "sum")
    found.n = int(m[1]) if (m := re.search(r"\b(?:top|bottom|first|best|worst|highest|lowest)\s+(\d+)", q)) else 10
    for c in named:
        name = rf"\b{re.escape(c.lower())}\s*(?:is\s+)?"
        if (m := re.search(rf"{name}(not\s+)?between\s+(\d+(?:\.\d+)?)\s+and\s+(\d+(?:\.\d+)?)", q)) and c in numeric:
            found.filters.append(f"`{c}` {'NOT ' if m[1] else ''}BETWEEN {m[2]} AND {m[3]}")
        # words and days stand in quotes or as one word, as the question spells them
        elif (m := re.search(rf"{name}(not\s+|!)?(?:equals?|=|is)?\s*(?:'([^']*)'|\"([^\"]*)\")", question, re.I)) and c not in numeric:
            value = (m[2] if m[2] is not None else m[3]).replace("\\", "\\\\").replace("'", "\\'")
            found.filters.append(f"`{c}` {'<>' if m[1] else '='} '{value}'")
        elif (m := re.search(rf"{name}(since|from|after|before|until)\s+(\d{{4}}-\d{{2}}-\d{{2}})\b", q)) and c not in numeric:
            found.filters.append(f"`{c}` {({'since': '>=', 'from': '>=', 'after': '>', 'before': '<', 'until': '<='})[m[1]]} '{m[2]}'")
        for op, sign in (("(?:greater than|more than|over|above|>)", ">"), ("(?:less than|under|below|<)", "<"), ("(?:equals?|=)", "=")):
            if m := re.search(rf"\b{re.escape(c.lower())}\s*(?:is\s+)?{op}\s*(\d+(?:\.\d+)?)", q):
                found.filters.append(f"`{c}` {sign} {m[1]}")
    found.path = "retrieve" if found.intent == "semantic" or found.mode in ("freeform", "system") else "compute"
    return found


def answer(question: str, df: DataFrame, ts: str | None = None, key: str | None = None) -> DataFrame:
    """The rows that answer a question about a table."""
    p = plan(question, df)
    if p.path != "compute":
        raise ValueError(f"not a question about the table ({p.mode}, {p.intent})")
    for f in p.filters:
        df = df.filter(f)
    if p.mode == "overview":
        return profile.overview(df)
    if p.intent == "correlation":
        return profile.correlations(df)
    if p.value is None:
        return profile.numeric_profile(df)
    if p.intent == "trend" and ts:
        return trend.trend_thirds(df, ts, p.value, key or ts)
    if p.intent == "anomaly" and key:
        return trend.outliers_expected(df, p.value, key)
    if p.intent == "distribution":
        return profile.histogram(df, p.value)
    if p.group and p.intent == "compare":
        return aggregate.comparisons(df, p.group, p.value)
    if p.group and p.intent == "sort":
        return aggregate.top_groups(df, p.group, F.col(p.value), p.n)
    if p.group:
        return aggregate.group_agg(df, p.group, p.value, p.function)
    return df.agg(aggregate.FUNCTIONS[p.function](p.value).alias(p.value))


def charts(question: str, df: DataFrame, columns: list[str]) -> dict:
    """What to draw: up to three chart kinds, up to four columns, category and date column."""
    q = question.lower()
    if mode(question, df.columns) != "data":
        return {"show": False, "kinds": [], "columns": []}
    date = next((c for c in df.columns if re.search("DATE|TIME", c.upper())), None)
    category = "ITEM_NAME" if "ITEM_NAME" in df.columns else next((f.name for f in df.schema if isinstance(f.dataType, T.StringType)), None)
    kinds = [k for k, words in CHARTS.items() if any(w in q for w in words)]
    kinds = kinds or [k for k, ok in (("time_series", date), ("bar", category), ("pie", len(columns) >= 2)) if ok]
    return {"show": True, "kinds": kinds[:3], "columns": columns[:4], "category": category, "date": date}
