"""Cross-site boilerplate lines (operator 5) by distinct-site spread, in DataFrame operations only.

A HyperLogLog sketch of the sites of each line hash is merged by aggregation; lines whose estimate is clearly above
or below the threshold are settled, those within the sketch's error band get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, free_name, identity, only, row_identity, stored


def line_key(line: Column) -> Column:
    """What makes two lines alike: the line without spaces, tabs and returns at its ends."""
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 10) -> DataFrame:
    """Distinct values of ``line`` (of ``lines``: columns ``line, site``) that occur on at least ``min_sites`` sites."""
    band = 4 * 1.04 / (1 << lg_k) ** 0.5
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    guess = spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band))
    guess = checkpointed(guess)
    sure = guess.where(F.col("sites") > min_sites * (1 + band)).select("line")
    near = guess.where(F.col("sites") <= min_sites * (1 + band)).select("line")
    exact = only(lines, near, "line").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionAll(exact.where(F.col("sites") >= min_sites).select("line"))


def drop_boilerplate(docs: DataFrame, min_sites: int = 10, min_chars: int = 10, site: str = "source", text: str = "text", lg_k: int = 10) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and ``n_lines``, ``n_removed`` added.

    A line of at least ``min_chars`` code points that occurs on ``min_sites`` or more sites is boilerplate, and goes
    whatever its share of the document. A document stays whole only if nothing but blank lines would be left and
    another row has the very same text: it is a copy, and near-duplicate removal's business. A null site is a site of
    its own; null texts stay null with 0 lines, an empty text is one empty line; lines repeated in a document all go;
    repeated rows are treated alike; an empty table stays empty. If the input already has columns named ``n_lines``
    or ``n_removed``, they are replaced.
    """
    hidden = {n: free_name([*docs.columns, "n_lines", "n_removed"], n) for n in ("id_", "lines_", "at_")}
    every = F.split(column(text), "\n", -1)
    site_of = F.coalesce(F.concat(F.lit("s"), column(site).cast("string")), F.lit("-"))
    own = row_identity(docs)
    marks = F.transform(every, lambda x: F.when(F.length(line_key(x)) >= min_chars, identity(line_key(x))))
    solid = F.size(F.filter(every, lambda x: line_key(x) != ""))
    rows = docs.where(column(text).isNotNull()).select(own.alias("id"), site_of.alias("site"), marks.alias("lines"), solid.alias("solid"), identity(column(text)).alias("whole"))
    rows = stored(rows, "lines")
    lines = rows.select(F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"), "site")
    bad = checkpointed(boilerplate(lines, min_sites, lg_k))
    met = only(rows.select("id", "solid", "whole", F.posexplode("lines").alias("pos", "line")).where("line is not null"), bad, "line")
    at = met.groupBy("id").agg(F.collect_set("pos").alias("at"), F.count(F.lit(1)).alias("n"), F.first("solid").alias("solid"), F.first("whole").alias("whole"))
    at = stored(at.withColumn("rows", F.col("n") / F.size("at")), "boilerplate")
    emptied = at.where(F.size("at") == F.col("solid"))
    twice = emptied.groupBy("whole").agg(F.sum("rows").alias("rows")).where("rows > 1").select("whole")
    copies = checkpointed(only(emptied.select("id", "whole"), twice, "whole").select("id"))
    at = at.join(copies, "id", "left_anti").select(F.col("id").alias(hidden["id_"]), F.col("at").alias(hidden["at_"]))
    joined = docs.withColumn(hidden["id_"], own).join(at, hidden["id_"], "left").withColumn(hidden["lines_"], every)
    gone, all_lines = F.col(hidden["at_"]), F.col(hidden["lines_"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")
    out = joined.withColumns({"n_lines": F.coalesce(F.size(all_lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"), text: F.when(gone.isNotNull(), kept).otherwise(column(text))})
    return out.drop(*hidden.values())
