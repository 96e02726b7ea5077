"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query's tokens leave out.
STOPWORDS = "a an and are as at be by for from how in is it of on or procedure the to what when where which with".split()
# Asset types by tag prefix.
ASSET_TYPES = {"P": "pump", "V": "valve", "HX": "heat_exchanger", "COMP": "compressor", "MTR": "motor", "M": "motor", "TK": "tank", "T": "tank", "BLR": "boiler", "B": "boiler", "R": "reactor"}


def preview(text: Column, limit: int = 220, ellipsis: str = "...") -> Column:
    """White space collapsed, cut at limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - len(ellipsis))), F.lit(ellipsis)))


def query_tokens(text: Column) -> Column:
    """Distinct search tokens in order: three characters or more, no stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_.-]*)"), 1)
    trimmed = F.transform(found, lambda t: F.regexp_replace(t, "^[._-]+|[._-]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS)))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether the text has any of the keywords as a substring."""
    out = text.contains(keywords[0])
    for k in keywords[1:]:
        out = out | text.contains(k)
    return out


def asset_type(tag: Column) -> Column:
    """Type by the tag's prefix; null for an unknown prefix."""
    types = F.create_map(*(F.lit(x) for pair in ASSET_TYPES.items() for x in pair))
    return F.try_element_at(types, F.upper(F.substring_index(tag, "-", 1)))


def chunk_starts(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Where a text's overlapping windows start; none for an empty text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
