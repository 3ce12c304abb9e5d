"""Small corpora with the awkward cases: nulls, empty and long texts, repeated rows and ids, clashing columns."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType())])

SYLLABLES = {"en": ["th", "er", "ing", "and", "whe", "on"], "de": ["sch", "ung", "ö", "ver", "ein", "ß"],
             "fr": ["eau", "é", "que", "ment", "ç", "oi"]}


def words(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def lines(rng: random.Random, n: int, lang: str = "en") -> str:
    return "\n".join(words(rng, rng.randint(3, 12), lang) for _ in range(n))


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang): near copies, exact copies and the awkward cases."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((k, lines(rng, rng.randint(1, 9), lang), lang))
    for k in range(8):      # copies, and copies with one word changed
        base = out[rng.randrange(n)][1]
        out.append((n + k, base if k % 2 else base.replace(base.split()[0], "changed", 1), "en"))
    out += [(100, None, "en"), (101, "", "de"), (102, "  \n\t \n", None), (103, "?!", "fr"), (104, "one", "en"),
            (105, "One two", "en"), (106, words(rng, 20_000), "en"), (107, "x" * 3000, "en"), (None, "no id here at all", "en"),
            (108, "same same same same same same", "en"), (108, "same same same same same same", "en"),
            (109, "é́ 漢字 😀 <|endoftext|> \x0b\x1c\x85 a  b\r\n", "fr"), (109, "another text with that id", "en")]
    return out


def frame(spark, data=None, clash: bool = False):
    """The rows as documents; with ``clash`` there are columns named like the operators' own."""
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if clash:
        for name in ("fp", "t", "p", "h1", "shard", "size", "n", "slot", "score", "ids", "k", "part", "rule", "item_id", "component"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


#: Names that operators give their own helper columns, which documents may have as well.
HELPERS = ["__n_lines", "__n_removed", "__id", "__t", "__p", "__k", "__l", "__at", "__stay", "__n", "__shard", "__key", "__row", "key",
           "row", "doc_id_", "a.b", "with `ticks`", "First", "h2", "g", "cell", "piece", "own", "item", "ones", "word", "payload", "sha1"]


def clashing(df):
    """``df`` with a column of each of HELPERS that tells its row."""
    return df.select("*", *[F.concat_ws("/", F.lit(str(k)), F.col("doc_id"), F.col("text")).alias(x) for k, x in enumerate(HELPERS)])


def own_columns(rows, text=True):
    """Each row's values of HELPERS; all must tell the same (id, text) as when they were made."""
    for r in rows:
        told = {r[x].split("/", 1)[1] for x in HELPERS}
        assert len(told) == 1
        if text:
            assert told == {"/".join(str(x) for x in (r["doc_id"], r["text"]) if x is not None)}
