"""Keyset pages (F2, F3, F5) and the page-parameter rules.

A page is ``key > cursor ORDER BY key LIMIT n`` (or the descending form);
Spark plans the filter into the scan and the order+limit as a
TakeOrderedAndProject, i.e. a per-partition top-n followed by a merge of at
most n rows per partition -- no full sort and no shuffle of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page size rules.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
MIN_LIMIT = 1


def page_params(cursor=None, limit=None) -> tuple[int, int]:
    """validate page parameters. A missing limit means the default; a
    limit above the maximum is clamped, below the minimum raised to it. A
    value that is not an integer is an error."""
    try:
        c = 0 if cursor in (None, "") else int(cursor)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"cursor must be an integer, got {cursor!r}") from exc
    try:
        n = DEFAULT_LIMIT if limit in (None, "") else int(limit)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"limit must be an integer, got {limit!r}") from exc
    return c, max(MIN_LIMIT, min(n, MAX_LIMIT))


def keyset_page(df: DataFrame, key: str, cursor, limit: int, descending: bool = False) -> DataFrame:
    """Rows strictly after ``cursor`` in key order, at most ``limit`` of them."""
    _, n = page_params(0, limit)
    k = F.col(key)
    if cursor is not None:
        df = df.where(k < F.lit(cursor) if descending else k > F.lit(cursor))
    return df.orderBy(k.desc() if descending else k.asc()).limit(n)


def next_cursor(rows: list, key: str, limit: int):
    """The next cursor is the last key of a *full* page, else None."""
    return rows[-1][key] if len(rows) == limit and rows else None


def activity_cursor(he_block: Column | str, tx_seq: Column | str) -> Column:
    """Output form of the activity cursor: ``block:seq``, both parts whole whatever their size."""
    return F.concat_ws(":", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in (he_block, tx_seq)])


def parse_activity_cursor(cursor: str | tuple[int, int]) -> tuple[int, int]:
    """The pair (he_block, tx_seq) of a cursor; anything else is an error."""
    parts = cursor.split(":") if isinstance(cursor, str) else cursor
    try:
        block, seq = (int(x) for x in parts)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"cursor must be block:seq, got {cursor!r}") from exc
    return block, seq
