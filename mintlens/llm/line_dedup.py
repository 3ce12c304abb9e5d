"""Line deduplication over overlapping windows of three lines.

The lines of a text (split at \\n) that hold a word are taken three at a time, each window
overlapping the next by two. A window found again at a later place, in the same text or
another, covers its three lines; the covered lines of a text are merged and removed. Places
are ordered by (id, line). Windows are compared by 128 hash bits.

DataFrame functions only. The window table is written once; a window that occurs in a third of all
texts is one partial row a task in the grouping, and one row on the narrow side of the join back.

Defined cases: null text stays null; texts with fewer than three lines with a word have no window
and stay as they are; lines without a word are never windowed and never removed; a text that loses
all its lines becomes empty (its blank lines stay); rows with equal id are taken for the same
place, so repeated rows keep equal lines; a null id sorts before all others; other columns may have any names,
those of the helper columns included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, quoted

WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _places(lines: Column) -> Column:
    """Indexes of the lines that hold a word."""
    at = F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i))
    return F.filter(at, lambda i: i.isNotNull())


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.length(text).alias("b"))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, p, h1, h2): every window of every text; ``p`` counts the lines with a word."""
    filled = docs.select(quoted(id_col).alias("doc_id"), _text_key(quoted(text_col)).alias("t"),
                         F.filter(_lines(quoted(text_col)), lambda x: x.rlike(WORD)).alias("l"))
    three = F.transform(F.sequence(F.lit(0), F.size("l") - 3), lambda i: F.struct(
        F.xxhash64(F.col("l")[i], F.col("l")[i + 1], F.col("l")[i + 2]).alias("h1"),
        F.xxhash64(F.lit(1), F.col("l")[i], F.col("l")[i + 1], F.col("l")[i + 2]).alias("h2")))
    return filled.where(F.size("l") >= 3).select("doc_id", "t", F.posexplode(three).alias("p", "w")).select(
        "doc_id", "t", "p", "w.h1", "w.h2")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, p) of the windows that occur at an earlier place as well."""
    all_windows = materialize(windows(docs, id_col, text_col), "line-windows")
    place = F.struct("doc_id", "p")
    repeated = all_windows.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    return all_windows.join(repeated, ["h1", "h2"]).where(place > F.col("first")).select("doc_id", "t", "p")


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; ``text_col`` loses the covered lines. Adds ``__n_lines`` (lines
    with a word) and ``__n_removed`` as the last two columns; if ``docs`` has such a column, the new one gets a
    further ``_`` in front."""
    n_lines, n_removed, own, t, p, key, ls, at, stay = free_names(
        docs, "__n_lines", "__n_removed", "__id", "__t", "__p", "__k", "__l", "__at", "__stay")
    covered = later_windows(docs, id_col, text_col).groupBy("doc_id", "t").agg(F.collect_set("p").alias(p))
    covered = covered.select(F.col("doc_id").alias(own), F.col("t").alias(t), p)
    text, lines, places = quoted(text_col), F.col(ls), F.col(at)
    rows = docs.withColumn(key, _text_key(text))
    joined = rows.join(covered, quoted(id_col).eqNullSafe(F.col(own)) & (F.col(key) == F.col(t)), "left")
    gone = F.flatten(F.transform(p, lambda w: F.array(places[w], places[w + 1], places[w + 2])))
    whole = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col(p).isNull(), whole).otherwise(F.array_except(whole, gone))
    out = (joined.withColumn(ls, _lines(text)).withColumn(at, _places(lines)).withColumn(stay, kept)
           .withColumn(n_lines, F.coalesce(F.size(places), F.lit(0)).cast("long"))
           .withColumn(n_removed, F.coalesce(F.size(lines) - F.size(stay), F.lit(0)).cast("long"))
           .withColumn(text_col, F.when(F.col(p).isNull(), text).otherwise(
               F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))))
    return out.select(*[quoted(c) for c in docs.columns], n_lines, n_removed)


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the covered lines removed and ``chars_col`` counted anew where it changed; a document
    all of whose lines with a word are gone goes as a whole."""
    out = remove_lines(docs, id_col, text_col)
    n_lines, n_removed = (F.col(c) for c in out.columns[-2:])
    out = out.where((n_removed == 0) | (n_removed < n_lines))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(n_removed > 0, F.length(quoted(text_col)).cast(
            docs.schema[chars_col].dataType)).otherwise(quoted(chars_col)))
    return out.select(*[quoted(c) for c in docs.columns])


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
  FROM documents WHERE text IS NOT NULL),
filled AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
three AS (
  SELECT doc_id, p, i, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2,
         line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS body
  FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS n FROM three WHERE i2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM placed WHERE n > 1),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) FILTER (WHERE g.i IS NULL) AS text,
         count(*) FILTER (WHERE regexp_matches(r.line, '[^\x20\x09-\x0D]')) AS n_lines, count(g.i) AS n_removed
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
