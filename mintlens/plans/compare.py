"""Order-insensitive comparison of a Spark result with an oracle result
(used by scripts/check_oracle.py and the tests)."""

from __future__ import annotations

import math
import os

import pandas as pd

# set MINTLENS_EXACT=1 to compare floats bit for bit
EXACT = os.environ.get("MINTLENS_EXACT") == "1"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if v is pd.NaT:
        return None
    if isinstance(v, float):
        return v if EXACT else round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def canon(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def same(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return False, f"columns {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"rows {len(spark_pdf)} vs {len(oracle_pdf)}"
    a, b = canon(spark_pdf), canon(oracle_pdf)
    if a != b:
        return False, f"values differ: {list(set(a) - set(b))[:2]} vs {list(set(b) - set(a))[:2]}"
    return True, ""
