"""Mixing sources to target weights (operator 8) by entropy balancing, in DataFrame operations only.

Rates r of documents minimise sum(r log r - r) under one token constraint for each source, sum(size r) = target,
and 0 <= r <= ``most``. The solution is r = min(most, exp(u z)) with z = size / mean size of the source and one
multiplier u for each source; the convex dual is solved by safeguarded Newton steps for all sources at once, each
step one aggregation. Rates are then rounded to copies: within small hashed blocks of a source, longest documents
first, each document takes the copies that bring the words taken so far nearest to the sum of its rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, chosen, column, free_name, identity, join_unequal, kept_as, row_identity, stored, words_of

WEIGHTS = (5.0, 2.0, 1.0)
_LIMIT = 500.0


def numbered(names: DataFrame, by: list[Column]) -> DataFrame:
    """``names`` with ``number``, 0, 1, ... in the order of ``by``: by range, and within it by a window."""
    dealt = names.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt.withColumn("inside", F.row_number().over(W.partitionBy("part").orderBy(*by))))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """``source, source_size, n, target`` from per-source totals (``source, source_size, n``).

    Sources in code point order, null last, weigh the repeating ``weights`` and share the total; a target stops
    at ``most`` times its source's size and the excess is shared again by weight, until no further source is full.
    """
    t = numbered(sizes, [F.col("source").isNull(), F.encode("source", "UTF-8")])
    t = checkpointed(t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))))
    whole = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(1.0)).alias("weight")).first()
    level, full = whole["size"] / whole["weight"], None
    while True:
        is_full = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        now = t.agg(F.sum(F.when(is_full, F.col("source_size"))).alias("size"), F.sum(F.when(~is_full, F.col("weight"))).alias("weight"), F.count_if(is_full).alias("n")).first()
        if now["n"] == full or not now["weight"]:
            break
        level, full = (whole["size"] - most * (now["size"] or 0)) / now["weight"], now["n"]
    target = F.when(is_full, most * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return t.select("source", "source_size", "n", target.cast("double").alias("target"))


def rate(u: Column, z: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(_LIMIT), u * z)))


def _sum(x: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that runs agree."""
    return F.sum(x.cast("decimal(38,8)")).cast("double")


def multipliers(cells: DataFrame, targets: DataFrame, most: float = 3.0, tolerance: float = 1e-7, steps: int = 60) -> DataFrame:
    """``source`` (null-safe), ``source_size, target, mean`` and the multiplier ``u``.

    ``cells`` holds ``source, size, n``: documents of one size in one source share a rate. Each Newton step sums
    gradient and curvature over the cells; where a step leaves the bracket, the bracket is halved.
    """
    now = checkpointed(
        targets.where("source_size > 0").select(
            "source", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean"),
            F.log(F.col("target") / F.col("source_size")).alias("u"), F.lit(-_LIMIT).alias("low"), F.lit(_LIMIT).alias("high"),
        )
    )
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    for _ in range(steps):
        z = F.col("size") / F.col("mean")
        r = rate(F.col("u"), z, most)
        c, s = cells.alias("c"), now.alias("s")
        got = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source")).agg(
            _sum(F.col("n") * F.col("size") * r).alias("mass"), _sum(F.when(r < most, F.col("n") * F.col("size") * z * r).otherwise(0.0)).alias("slope")
        )
        g = got.alias("g")
        t = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "mass", "slope")
        over = F.col("mass") > F.col("target")
        t = t.withColumns({"high": F.when(over, F.col("u")).otherwise(F.col("high")), "low": F.when(over, F.col("low")).otherwise(F.col("u"))})
        newton = F.col("u") - (F.col("mass") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        ready = F.abs(F.col("mass") - F.col("target")) <= tolerance * F.col("target")
        u = F.when(full, F.lit(_LIMIT)).when(ready, F.col("u")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        narrow = F.col("high") - F.col("low") <= 1e-12 * (1 + F.abs("u"))
        t = checkpointed(t.select("source", "source_size", "target", "mean", u.alias("u"), "low", "high", (ready | full | narrow).alias("ready")))
        now = t.drop("ready")
        if t.where(~F.col("ready")).isEmpty():
            break
    return now.select("source", "source_size", "target", "mean", "u")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int = 256, source: str = "source", key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep``, then size, source_size, target, rate and copies (0 up to ``most``).

    size is the number of words. Null texts have size 0 and, like all documents of size 0, one copy. A null source
    is a source of its own. Rows alike in key, source, text and the kept columns get the same copies; null keys
    are told apart by their texts. An empty table gives no rows. A kept column
    with the name of a result gets an underscore before it.
    """
    names = kept_as(keep, ["size", "source_size", "target", "rate", "copies"])
    hashed = identity(*map(column, dict.fromkeys([key, source, text, *keep])))
    kept = {n: f"kept{i}_" for i, n in enumerate(names)}
    rows = docs.select(hashed.alias("id_"), column(source).cast("string").alias("source"), words_of(column(text)).alias("size"), *chosen(keep, tuple(kept.values())))
    rows = stored(rows.withColumn("named", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))), "mix")
    cells = checkpointed(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    targets = checkpointed(source_targets(totals, weights, most))
    solved = multipliers(cells, targets, most)
    t, s = targets.alias("t"), solved.alias("s")
    facts = t.join(s, F.col("t.source").eqNullSafe(F.col("s.source")), "left").select(F.coalesce(F.concat(F.lit("s"), "t.source"), F.lit("-")).alias("named"), "t.source_size", "t.target", "t.n", "mean", "u")
    facts = checkpointed(facts)
    meet = (lambda x: x.join(F.broadcast(facts), "named")) if _few(facts) else (lambda x: join_unequal(x, facts, "named"))
    distinct = stored(rows.where("size > 0").groupBy("id_", "named", "size").agg(F.count(F.lit(1)).alias("m")), "mix-rows")
    rated = meet(distinct).select(
        "id_", "named", "size", "m", rate(F.col("u"), F.col("size") / F.col("mean"), most).alias("rate"), F.pmod(F.col("id_.a"), F.ceil(F.col("n") / block)).alias("block")
    )
    line = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "id_", "size", "m", "rate")))
    zero = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<struct<id_:struct<a:bigint,b:bigint>,rate:double,copies:bigint>>").alias("out"))

    def place(state: Column, x: Column) -> Column:
        words = x["size"] * x["m"]
        due = state["due"] + words * x["rate"]
        copies = F.when(words == 0, F.lit(1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(int(most)), F.round(due / words)))).cast("bigint")
        entry = F.struct(x["id_"].alias("id_"), x["rate"].alias("rate"), copies.alias("copies"))
        return F.struct((due - copies * words).alias("due"), F.concat(state["out"], F.array(entry)).alias("out"))

    placed = rated.groupBy("named", "block").agg(line.alias("line")).select(F.explode(F.aggregate("line", zero, place, lambda x: x["out"])).alias("x")).select("x.*")
    return meet(rows.join(placed, "id_", "left")).select(
        *[F.col(v).alias(k) for k, v in kept.items()], "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as mixed: each row as many times as it has copies. Columns, nulls and ties as in ``mix``."""
    own, copies = free_name(docs.columns, "row_"), free_name(docs.columns, "copies_")
    named = docs.withColumn(own, row_identity(docs))
    taken = mix(named, weights, most, source=source, key=key, text=text, keep=(own,)).groupBy(own).agg(F.max("copies").alias(copies))
    out = named.join(taken.where(F.col(copies) > 0), own)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*map(column, docs.columns))


def _few(table: DataFrame) -> bool:
    """Whether the table of sources is small enough to send everywhere (counted, not assumed)."""
    return table.limit(100_001).count() <= 100_000
