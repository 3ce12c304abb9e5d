"""Connected components of an edge list, by alternating star contraction.

Every round is two grouped minima and two equi joins; nothing is collected,
and each round's edges are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _hang(lines: DataFrame) -> DataFrame:
    """(u, v) lines -> (v, m): every v next to u is hung below m, the least of u and its v."""
    least = lines.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return lines.join(least, "u").select("u", "v", "m")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every end of an edge; ``component`` is the least node reachable.

    ``a`` and ``b`` are long columns. Loops (a = b), nulls and repeated edges are
    ignored; an empty edge list gives an empty result. The number of rounds grows
    with the logarithm of the longest path.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    cur = materialize(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "cc")
    seen = None
    while True:
        state = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # larger neighbours of u go below the least of its neighbourhood
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # then u and its smaller neighbours go below the least of those
        hung = _hang(large.distinct())
        small = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")
        cur = materialize(small.distinct(), "cc")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
