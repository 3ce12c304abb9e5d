"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Rows of equal text form a group with a vector (bytes, tokens, rows). Groups are dealt by hash into
cells of a bounded number of groups; in each cell the groups are placed, largest first,
in the shard whose residual capacity has the greatest dot product with the group's vector. Every
shard's capacity in a cell is an equal share of that cell, so the shards of all cells together
are balanced, and cells are packed in parallel however many there are.

A group larger than half of a shard's share of a cell is divided into pieces of about an eighth of
that share by a hash of the row's id first, so a text that makes up a third of all rows is spread like the others.

Slots are gapless: a row's number inside its (shard, cell), after the rows of the
earlier cells of that shard.

Defined cases: null text counts as no bytes and is grouped with empty texts; repeated rows and ids are
rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, quoted, ship_code

GROUPS_A_CELL = 8192
ROW_BYTES = 16
PIECES_A_SHARE = 8
SALTS = 64                      # keys over which the rows of one text are spread in joins
WEIGHTS = (10.0, 1.0, 0.02)     # of bytes, tokens and rows in the dot product: bytes lead


def place(vectors: np.ndarray, shards: int, first: int = 0, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of each group: largest group first, greatest weighted dot product with the residual
    capacity. Ties go round from shard ``first``."""
    total = np.maximum(vectors.sum(axis=0), 1e-12)
    v = vectors / total * shards              # a shard's capacity is 1 in every dimension
    order = np.lexsort((-v.sum(axis=1), -v.max(axis=1)))
    weighed = v * np.array(weights)
    left = np.ones((shards, vectors.shape[1]))
    out = np.empty(len(v), np.int64)
    for k in order.tolist():
        s = int((left @ weighed[k]).argmax())
        out[k] = s
        left[s] -= v[k]
    return (out + first) % shards


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, g): what the packing needs of each row."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    return docs.select(
        quoted(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("g"))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) of every row of ``docs``."""
    rows = materialize(measured(docs, id_col, text_col), "shard-rows")
    group = ["g", "size"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    cells = max(1, math.ceil(total[0] / GROUPS_A_CELL))
    share_rows = max(1.0, (total[1] or 1) / (cells * shards))
    share_bytes = max(1.0, (total[2] or 1) / (cells * shards))
    share = F.greatest(F.col("n") / share_rows, F.col("n") * F.col("size") / share_bytes)
    large = groups.where(share > 0.5).select(*group, F.least(F.ceil(share * PIECES_A_SHARE), F.col("n")).alias("pieces"))
    piece = F.pmod(F.xxhash64("doc_id", "g"), F.coalesce("pieces", F.lit(1)))
    unit = [*group, "piece"]
    # the rows of a large group meet their number of pieces under as many keys as there are salts
    salt = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(SALTS))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    dealt = rows.withColumn("salt", salt).join(large, [*group, "salt"], "left").withColumn("piece", piece).drop("pieces", "salt").withColumn(
        "cell", F.pmod(F.xxhash64(*unit), F.lit(cells)))
    dealt = materialize(dealt, "shard-dealt")
    units = dealt.groupBy("cell", *unit).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["g", "size", "piece"], ignore_index=True)
        vectors = np.column_stack([part["n"] * part["size"], part["tokens"], part["n"]]).astype(float)
        part["shard"] = place(vectors, shards, int(part["cell"].iloc[0]) % shards).astype(np.int32)
        return part[[*unit, "shard"]]

    ship_code(docs.sparkSession)
    placed = units.groupBy("cell").applyInPandas(pack, "g bigint, size bigint, piece bigint, shard int")
    here = materialize(dealt.join(placed, unit), "shard-placed")
    held = here.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))     # shards x cells rows
    before = held.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "g", "size")) - 1
    return here.withColumn("inside", inside).join(before, ["shard", "cell"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"))


def write_shards(docs: DataFrame, out: str, shards: int = 40, text_col: str = "text", shard_col: str = "shard") -> str:
    """Writes every row of ``docs`` with all its columns below ``out``, one folder a shard; returns the name of the
    partition column, which is ``shard_col`` with as many ``_`` in front as make it differ from the others. Rows are
    told apart by numbers of their own, so ids may be null or repeated; which shard a row gets depends on
    how ``docs`` is partitioned."""
    name, = free_names(docs, shard_col)
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key"))
    packed = materialize(packed, "shard-write")
    texts = packed.select("key", F.col("row").getField(text_col).alias("text"))
    where = assign(texts, shards, "key", "text").select(F.col("doc_id").alias("key"), F.col("shard").alias("shard"))
    rows = packed.join(where, "key").select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(name))
    rows.write.partitionBy(name).parquet(out)
    return name
