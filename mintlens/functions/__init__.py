"""Column-level helpers (all built-in Spark expressions, no Python UDFs).

These are the scalar building blocks the operators share: dual-encoded JSON,
strict integer ids, decimals, block timestamps, truthiness, the canonical
group key, and decimal/timestamp rendering for JSON output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain types (fixed). Prices keep their payment token and are never
# converted; 38 digits with 18 after the point hold every observed price.
PRICE_TYPE = "decimal(38,18)"
ID_TYPE = "bigint"
STR_MAP = "map<string,string>"

# The two contracts whose events are NFT activity.
NFT_CONTRACTS = ("nft", "nftmarket")


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- B1: dual-encoded JSON ---------------------------------------------------

def json_or_default(c: Column | str, ddl: str, default: Column | None = None) -> Column:
    """Parse JSON that arrives as an object or as a JSON string (Spark reads an
    object into a STRING field as its raw text, so both shapes are text here).
    Empty or malformed text yields ``default``."""
    parsed = F.from_json(col_(c), ddl)
    return parsed if default is None else F.coalesce(parsed, default)


def json_map(c: Column | str) -> Column:
    """JSON object text -> MAP<STRING,STRING> (keeps key case and presence;
    nested values come back as JSON text). Of a repeated key the last value counts. Not an object -> empty map."""
    none = F.create_map().cast(STR_MAP)
    return F.map_concat(none, F.coalesce(F.from_json(col_(c), STR_MAP), none))


def present(m: Column, key: str) -> Column:
    """Key presence, as opposed to a non-null value."""
    return F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))


def first_present(m: Column, *keys: str) -> Column:
    """``d.get(k1, d.get(k2, ...))``: the first key that is *present* wins,
    even when its value is null. Presence is looked up only where it decides: the key has no value, a later one has."""
    out = m[keys[-1]]
    for k in reversed(keys[:-1]):
        out = F.when(m[k].isNotNull() | out.isNull() | present(m, k), m[k]).otherwise(out)
    return out


def first_truthy(*cols: Column) -> Column:
    """``a or b or ...`` on text values: empty text counts as absent."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


# -- casts ---------------------------------------------------------------------

def strict_id(c: Column | str) -> Column:
    """Integer id from text or a JSON number; surrounding blanks are allowed,
    fractions and other text give NULL (the row is then dropped or
    quarantined by the caller)."""
    return F.trim(col_(c)).try_cast(ID_TYPE)


def price(c: Column | str) -> Column:
    """Unbounded-precision price text -> DECIMAL(38,18); unparseable -> NULL."""
    return F.trim(col_(c)).try_cast(PRICE_TYPE)


def truthy(c: Column | str) -> Column:
    """Truthiness of a JSON scalar read as text: ``true``, non-zero numbers
    and non-empty strings count; ``false``, ``0``, ``''`` and NULL do not."""
    v = F.lower(F.trim(col_(c)))
    num = v.try_cast("double")
    return (F.when(v.isNull() | (v == "") | (v == "false") | (v == "null"), F.lit(False))
            .when(num.isNotNull(), num != 0)
            .otherwise(F.lit(True)))


def epoch_ms_ts(c: Column | str) -> Column:
    """Milliseconds since the epoch -> TIMESTAMP (NULL stays NULL)."""
    return F.timestamp_millis(col_(c).try_cast("bigint"))


def block_ts(c: Column | str, ingest_ts: Column) -> Column:
    """ISO-8601 text, naive = UTC (session time zone), ``Z`` accepted;
    missing or unparseable -> the explicit ingest time (not now(), so a
    re-run gives the same rows)."""
    text = F.trim(col_(c))
    return F.coalesce(F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp")), ingest_ts)


# A whole ISO-8601 date, alone or with a time of day: a cast alone would also take "12:30" or "2026".
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}.*)?$"


# -- E2: canonical group key ------------------------------------------------

def grouping_key(c: Column | str) -> Column:
    """Canonical text of a JSON object: keys sorted at every depth, no blanks, value types kept
    (1 and "1" stay apart). ``{}``, NULL, malformed text and other JSON values become ``{}``."""
    v = F.try_parse_json(col_(c))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)).otherwise(F.lit("{}"))


# -- B19 ---------------------------------------------------------------------

def burned(supply: Column | str = "supply", circulating: Column | str = "circulating_supply") -> Column:
    """supply - circulating, only when both are known (NULL propagates)."""
    return col_(supply) - col_(circulating)


# -- A8: output rendering --------------------------------------------------

def decimal_text(c: Column | str) -> Column:
    """Decimal as plain text with trailing zeros trimmed ("7", "9.9")."""
    s = col_(c).cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)


def iso_ts(c: Column | str) -> Column:
    """Timestamp as ISO-8601 UTC text with an explicit offset."""
    return F.date_format(col_(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

