"""Registered queries: one per operator of the blueprint, each over the driver
tables (through the fixture derivations) at full size, plus the equivalent
DuckDB SQL used as an independent oracle.

Outputs are flattened for comparison: decimals are cast to DOUBLE at the very
end (on both sides), timestamps stay timestamps, every computed column has
the same alias on both sides.
"""

from .common import ORACLE, QUERIES, comparable, register

# registration order matters: later modules reuse oracles registered earlier
from . import market, parsing, snapshots, open_work, display_rules, read_views, capture, landed, survey_named, keys, kept  # noqa: E402,F401,I001

__all__ = ["ORACLE", "QUERIES", "comparable", "register"]
