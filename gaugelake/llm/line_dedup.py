"""Line dedup: lines that spread over many distinct sites are boilerplate.

A HyperLogLog sketch of sites for each line hash merges in partial aggregation. Its estimate decides far from the threshold;
lines near it get an exact distinct count. Boilerplate stays once, where it comes first, and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import discard, materialize

_EDGE = r"^[ \t-\r]+|[ \t-\r]+$"


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Two longs that tell rows apart by id and text; equal rows share them."""
    name = F.coalesce(id_col.cast("string"), F.lit("\u0001"))
    return [F.xxhash64(name, text).alias("k1"), F.xxhash64(text, F.lit(11), name).alias("k2")]


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    *,
    min_sites: int = 5,
    min_words: int = 3,
    lg_k: int = 12,
    margin: float = 0.1,
) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with ``text`` (what is left), n_lines, n_removed_lines.

    Lines are cut at line feeds and compared without white space at their ends, by two 64-bit hashes; those of under ``min_words``
    words are left alone. A line on ``min_sites`` distinct sites or more stays at its first place (least id, null last, then line number) and
    goes elsewhere. A null site is no site. Estimates farther than ``margin`` from the threshold decide (6 standard errors
    at the default ``lg_k``); the rest is counted exactly. Null texts stay null with 0 lines; rows equal in id and text are treated alike,
    so where such a row holds a line's first place, each of them keeps it. Texts of any length are taken whole; an empty table gives an empty result; other
    columns of any name stay in ``row``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text, name = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("pos").alias("pos"))
    cut = docs.select(*row_key(name, text), name.alias("id"), F.col(f"`{site_col}`").alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    cut = cut.withColumn("line", F.regexp_replace("line", _EDGE, "")).where(F.col("line").rlike(r"^(?:[^ \t-\r]+[ \t-\r]+){%d}[^ \t-\r]" % (min_words - 1)))
    # Written once and read by all that follows: cutting and trimming the texts costs more.
    lines = cut.select("k1", "k2", "site", F.col("pos"), place.alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    lines, _ = materialize(lines, "lines")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sites"), F.min("place").alias("first"))
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("n")).where(F.col("n") >= min_sites * (1 - margin))
    spread, path = materialize(spread, "spread")
    near = spread.where(F.col("n") <= min_sites * (1 + margin))
    exact = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"]).distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites)
    found = spread.where(F.col("n") > min_sites * (1 + margin)).unionByName(near.join(exact, ["h1", "h2"]).drop("exact")).drop("n")
    found, _ = materialize(found, "found")  # a table on either side: a line of very many places can be split over tasks
    discard(path)

    gone = lines.join(found, ["h1", "h2"]).where(F.col("place") != F.col("first"))
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))  # a document's own lines
    whole = docs.select(row, *row_key(name, text), F.split(text, "\n").alias("lines")).join(gone, ["k1", "k2"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    return whole.select("row", kept.alias("text"), F.when(F.col("lines").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed_lines"))
