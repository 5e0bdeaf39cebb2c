"""Running values per key in two levels, so that no key's rows meet in one task.

Rows of a key are cut into stretches of the order column; a stretch is summed up in one row, those rows (few for
each key) are accumulated, and what came before a stretch is joined to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH = 1 << 20


def running(df: DataFrame, key: str, order: str, aggregates: dict[str, tuple[Column, str]], stretch: int = STRETCH) -> DataFrame:
    """``df`` with running values by ``order`` within ``key``: name to (column, "max" or "count")."""
    cut = df.withColumn("stretch__", F.floor(F.col(order) / stretch))
    before = W.partitionBy(key).orderBy("stretch__").rowsBetween(W.unboundedPreceding, -1)
    here = W.partitionBy(key, "stretch__").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    one = {"max": F.max, "count": lambda c: F.count(c)}
    both = {"max": F.max, "count": F.sum}
    sums = cut.groupBy(key, "stretch__").agg(*[one[how](c).alias(f"{n}__sum") for n, (c, how) in aggregates.items()])
    sums = sums.select(F.col(key).alias("key__"), F.col("stretch__").alias("at__"), *[both[how](f"{n}__sum").over(before.partitionBy(key)).alias(f"{n}__before") for n, (_, how) in aggregates.items()])
    cut = cut.withColumns({f"{n}__here": one[how](c).over(here) for n, (c, how) in aggregates.items()})
    joined = cut.join(sums, cut[key].eqNullSafe(sums["key__"]) & (cut["stretch__"] == sums["at__"]))
    total = lambda n, how: F.greatest(f"{n}__here", f"{n}__before") if how == "max" else F.col(f"{n}__here") + F.coalesce(f"{n}__before", F.lit(0))
    out = joined.withColumns({n: total(n, how) for n, (_, how) in aggregates.items()})
    return out.drop("stretch__", "key__", "at__", *[f"{n}__{x}" for n in aggregates for x in ("here", "before")])


def with_halo(df: DataFrame, at: Column, reach: int, wide: int = 8) -> DataFrame:
    """``df`` dealt into stretches of ``at`` (column ``stretch__``), each with the rows up to ``reach`` before it.

    ``own__`` marks the rows that belong to their stretch; window functions over key and stretch then see all rows
    they need, and a key's rows are spread over its stretches.
    """
    width = max(1, reach * wide)
    own, next_ = F.floor(at / width), F.floor((at + reach) / width)
    dealt = df.withColumn("stretch__", F.explode(F.array_distinct(F.array(own, next_))))
    return dealt.withColumn("own__", F.col("stretch__") == own)
