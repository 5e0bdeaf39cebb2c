"""Queries of the engine over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import from_bytes, to_bytes
from .frame import EventFrame
from .operators import aggregations as A
from .operators.joins import ConfigurationLookup, JSONField, LookupField, QueryField, TableLookup
from .operators.windows import KEY, ORDER, TIME

HOUR, DAY = 3_600_000, 86_400_000
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: The events with key, milliseconds, order and cents, as the oracles read them.
E = "e AS (SELECT event_id AS seq, user_id AS k, epoch_us(ts) // 1000 AS ms, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents, props FROM events)"
#: The same in an order of arrival in which many come late.
LATE = "a AS (SELECT *, ms + (seq * 7919 % 97) * 3600000 AS arr FROM e), l AS (SELECT *, max(ms) OVER (PARTITION BY k ORDER BY arr, seq ROWS UNBOUNDED PRECEDING) AS rm, max(ms) OVER (PARTITION BY k) AS mx FROM a)"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str, late: bool = False) -> EventFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    if not late:
        return EventFrame.of(df, "user_id", "ts", "event_id", ordered=True)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    arrival = ms + F.col("event_id") * 7919 % 97 * HOUR
    return EventFrame.of(df, "user_id", "ts", arrival * 1_000_000 + F.col("event_id"), stretch=30 * DAY * 1_000_000)


def rows(frame: EventFrame, *columns: str, key: str = "user_id") -> DataFrame:
    return frame.df.select(F.col(KEY).alias(key), *columns)


# projections, filters, scalar functions


@query(f"WITH {E} SELECT seq AS event_id, k AS user_id, cents FROM e WHERE event_type = 'purchase' AND cents > 5000 OR event_type = 'refund'")
def filter_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kept = e[(e["event_type"] == "purchase") & (e["cents"] > 5000) | (e["event_type"] == "refund")]
    return rows(kept, "event_id", "cents")


@query(f"WITH {E} SELECT seq AS event_id, cents, cents * 2 AS twice, event_type || '!' AS shout, CAST(7 AS INTEGER) AS seven FROM e")
def project_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)[["event_id", "event_type", "cents"]]
    e["twice"] = e["cents"] * 2
    e["shout"] = e["event_type"] + "!"
    e["seven"] = 7
    return e[["event_id", "cents", "twice", "shout", "seven"]].df.select("event_id", "cents", "twice", "shout", "seven")


@query(f"WITH {E} SELECT seq AS event_id, coalesce(nullif(event_type, 'view'), 'none') AS event_type, 'x' AS extra FROM e")
def fill_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    e["event_type"] = e["event_type"].apply(lambda c: F.nullif(c, F.lit("view")))
    e.fill(event_type="none", extra="x").drop(["value", "props"]).drop("absent", errors="ignore")
    return e.df.select("event_id", "event_type", "extra")


@query(
    f"""WITH {E} SELECT seq AS event_id, cents + 1 AS plus, cents - 5 AS minus, cents * 3 AS times, cents / 8.0::DOUBLE AS ratio,
    ((cents - 3000) % 7 + 7) % 7 AS modulo, abs(cents - 3000) AS distance, cents < 3000 AS lt, cents >= 3000 AS ge, cents <> 3000 AS ne FROM e"""
)
def scalar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    c = e["cents"]
    named = {"plus": c + 1, "minus": c - 5, "times": c * 3, "ratio": c / 8, "modulo": (c - 3000) % 7, "distance": (c - 3000).abs(), "lt": c < 3000, "ge": c >= 3000, "ne": c != 3000}
    return e.apply(lambda v: {"event_id": v["event_id"], **named}).df.select("event_id", *named)


@query(
    f"""WITH {E}, n AS (SELECT seq, nullif(cents % 3, 0) AS a, nullif(cents % 2, 0) AS b FROM e)
    SELECT seq AS event_id, a IS NOT DISTINCT FROM b AS same, a IS DISTINCT FROM b AS other, a IS NULL AS none, b IS NOT NULL AS some,
      NOT coalesce(a <> 0, false) AS negated, CASE WHEN coalesce(a <> 0, false) THEN b ELSE a END AS both_, CASE WHEN coalesce(a <> 0, false) THEN a ELSE b END AS either FROM n"""
)
def null_safe_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    e["a"] = F.nullif(F.col("cents") % 3, F.lit(0))
    e["b"] = F.nullif(F.col("cents") % 2, F.lit(0))
    a, b = e["a"], e["b"]
    named = {"same": a == b, "other": a != b, "none": a.isnull(), "some": b.notnull(), "negated": ~a, "both_": a & b, "either": a | b}
    return e.apply(lambda v: {"event_id": v["event_id"], **named}).df.select("event_id", *named)


@query(f"WITH {E} SELECT seq AS event_id, event_type IN ('view', 'click') AS listed, contains(event_type, 'ur') AS has, event_type[2] AS second, event_type[-1] AS last FROM e")
def isin_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    t = e["event_type"]
    named = {"listed": t.isin(["view", "click"]), "has": t.contains("ur"), "second": t[1], "last": t[-1]}
    return e.apply(lambda v: {"event_id": v["event_id"], **named}).df.select("event_id", *named)


@query("SELECT seq AS event_id, word FROM (SELECT event_id AS seq, unnest(string_split(event_type || ' ' || (event_id % 5), ' ')) AS word FROM events)")
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    words = e.apply(lambda v: F.split(F.concat(v["event_type"], F.lit(" "), (v["event_id"] % 5).cast("string")), " "), expand=True)
    return words.df.select(F.col(ORDER).alias("event_id"), F.col("value").alias("word"))


@query(f"WITH {E} SELECT event_type AS key, seq AS event_id, k AS user_id, ms - 1000 AS time FROM e")
def group_by_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).group_by("event_type").set_timestamp(lambda v, k, t, h: t - 1000)
    return e.df.select(F.col(KEY).alias("key"), "event_id", "user_id", F.col(TIME).alias("time"))


@query(f"WITH {E} SELECT seq AS event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM e")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    e["p"] = from_bytes(F.encode("props", "UTF-8"), "json", "struct<k:bigint>")
    return e.apply(lambda v: {"event_id": v["event_id"], "k": v["p"]["k"]}).df.select("event_id", "k")


@query(f"WITH {E} SELECT seq AS event_id, lower(hex(encode(event_type))) AS text, lower(lpad(to_hex(cents), 8, '0')) AS number, cents::INTEGER AS back, value AS double_back FROM e")
def wire_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).df
    number, text = to_bytes(F.col("cents"), "integer"), to_bytes(F.col("event_type"), "string")
    double = from_bytes(to_bytes(F.col("value"), "double"), "double")
    return e.select("event_id", F.lower(F.hex(text)).alias("text"), F.lower(F.hex(number)).alias("number"), from_bytes(number, "integer").alias("back"), double.alias("double_back"))


@query(f"WITH {E} SELECT seq AS event_id, cents, NULL::BIGINT AS twice FROM e WHERE cents < 2000 UNION ALL SELECT seq, NULL, cents * 2 FROM e WHERE cents > 9000")
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = events(spark, sf_dir), events(spark, sf_dir)
    low = e[e["cents"] < 2000].apply(lambda v: {"event_id": v["event_id"], "cents": v["cents"]})
    high = f[f["cents"] > 9000].apply(lambda v: {"event_id": v["event_id"], "twice": v["cents"] * 2})
    return low.concat(high).df.select("event_id", "cents", "twice")


@query(f"WITH {E} SELECT seq AS event_id, cents * 2 + 1 AS value FROM e WHERE cents % 2 = 1")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)[["event_id", "cents"]]
    odd = e.filter(lambda v: v["cents"] % 2, python=True)
    out = odd.apply(lambda v: {"event_id": v["event_id"], "value": v["cents"] * 2 + 1}, returns="event_id bigint, value bigint")
    return out.df.select("event_id", "value")


@query(f"WITH {E} SELECT k AS user_id, seq AS event_id, cents * 2 AS twice, cents % 7 AS rest FROM e WHERE cents % 7 > 0 AND cents % 2 = 1")
def frame_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made by functions, as masks and as assigned values."""
    e = events(spark, sf_dir)
    e = e[e.apply(lambda v: v["cents"] % 7)]
    e["twice"] = e.apply(lambda v: {"c": v["cents"]}).apply(lambda v: v["c"] * 2)
    e["rest"] = e.apply(lambda v: v["cents"] % 7, returns="bigint")
    return rows(e[e.apply(lambda v: v["cents"] % 2 == 1, returns="boolean")], "event_id", "twice", "rest")


@query(f"WITH {E} SELECT seq AS event_id, true AS has, false AS has_not, event_type AS header FROM e")
def contains_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    e["has"], e["has_not"] = e.contains(["cents", "props"]), e.contains("absent")
    e = e.set_headers(lambda v, k, t, h: F.array(F.struct(F.lit("type").alias("key"), F.encode(v["event_type"], "UTF-8").alias("value"))))
    return e.df.select("event_id", "has", "has_not", F.decode(F.col("_headers")[0]["value"], "UTF-8").alias("header"))


@query(f"WITH {E}, t AS (SELECT seq AS event_id, cents FROM e WHERE cents % 3 <> 0) SELECT event_id, 100000 // (cents % 3) AS value FROM t")
def error_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback swallows the exceptions of a function, and their records."""
    e = events(spark, sf_dir)[["event_id", "cents"]]
    e.on_error = lambda error, value: isinstance(error, ZeroDivisionError)
    out = e.apply(lambda v: {"event_id": v["event_id"], "value": 100_000 // (v["cents"] % 3)}, returns="event_id bigint, value bigint")
    return out.df.select("event_id", "value")


def _shortcut(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir).apply(lambda v: v["cents"])
        out = getattr(e.tumbling_window(DAY), name)().final()
        value = F.array_join(F.col("value").cast("array<string>"), ",").alias("value") if name == "collect" else "value"
        return rows(out, value, "start", "end")

    run.__name__ = f"shortcut_{name}"
    query(f'WITH {E}, w AS (SELECT k, ms // {DAY} * {DAY} AS s, {sql} AS value FROM e GROUP BY 1, 2), m AS (SELECT k, max(ms) AS mx FROM e GROUP BY 1) SELECT k AS user_id, value, s AS start, s + {DAY} AS "end" FROM w JOIN m USING (k) WHERE s + {DAY} <= mx')(run)


_shortcut("sum", "sum(cents)::BIGINT")
_shortcut("count", "count(*)")
_shortcut("mean", "sum(cents)::DOUBLE / count(*)")
_shortcut("min", "min(cents)")
_shortcut("max", "max(cents)")
_shortcut("collect", "string_agg(cents::VARCHAR, ',' ORDER BY ms, seq)")


# time windows


@query(
    f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), g AS (SELECT k, ms // {DAY} * {DAY} AS s, count(*) AS n, sum(cents)::BIGINT AS total, sum(cents)::DOUBLE / count(*) AS mean FROM p GROUP BY 1, 2),
    m AS (SELECT k, max(ms) AS mx FROM p GROUP BY 1) SELECT k AS user_id, n, total, mean, s AS start, s + {DAY} AS "end" FROM g JOIN m USING (k) WHERE s + {DAY} <= mx"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = e[e["event_type"] == "purchase"].tumbling_window(DAY).agg(n=A.Count(), total=A.Sum("cents"), mean=A.Mean("cents")).final()
    return rows(out, "n", "total", "mean", "start", "end")


def _tumbling(aggregate: str, agg: A.BaseAggregator, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = events(spark, sf_dir).tumbling_window(DAY).agg(x=agg).final()
        return rows(out, "x", "start", "end")

    run.__name__ = f"tumbling_{aggregate}"
    query(f'WITH {E}, w AS (SELECT k, ms // {DAY} * {DAY} AS s, {sql} AS x FROM e GROUP BY 1, 2), m AS (SELECT k, max(ms) AS mx FROM e GROUP BY 1) SELECT k AS user_id, x, s AS start, s + {DAY} AS "end" FROM w JOIN m USING (k) WHERE s + {DAY} <= mx')(run)


_tumbling("sum", A.Sum("cents"), "sum(cents)::BIGINT")
_tumbling("count", A.Count(), "count(*)")
_tumbling("mean", A.Mean("cents"), "sum(cents)::DOUBLE / count(*)")
_tumbling("min", A.Min("cents"), "min(cents)")
_tumbling("max", A.Max("cents"), "max(cents)")


def _several() -> dict[str, A.BaseAggregator]:
    return {
        "n": A.Count("cents"), "total": A.Sum("cents"), "mean": A.Mean("cents"), "low": A.Min("cents"), "high": A.Max("cents"),
        "earliest": A.Earliest("event_type"), "latest": A.Latest("event_type"), "first": A.First("cents"), "last": A.Last("cents"),
    }


SEVERAL = """count(cents) AS n, sum(cents)::BIGINT AS total, sum(cents)::DOUBLE / count(cents) AS mean, min(cents) AS low, max(cents) AS high,
  arg_min(event_type, (ms, {o})) AS earliest, arg_max(event_type, (ms, {o})) AS latest, arg_min(cents, {o}) AS first, arg_max(cents, {o}) AS last"""


def windows_sql(duration: int, step: int, body: str) -> str:
    """Records with every window start that holds them."""
    return f"w AS (SELECT *, unnest(generate_series(greatest(0, (ms - {duration}) // {step} + 1), ms // {step})) * {step} AS s FROM {body})"


def final_sql(duration: int, step: int, grace: int, aggregates: str, columns: str) -> str:
    return f"""WITH {E}, {windows_sql(duration, step, "e")}, g AS (SELECT k, s, {aggregates} FROM w GROUP BY 1, 2), m AS (SELECT k, max(ms) AS mx FROM e GROUP BY 1)
    SELECT k AS user_id, {columns}, s AS start, s + {duration} AS "end" FROM g JOIN m USING (k) WHERE s + {duration} + {grace} <= mx"""


NAMES = "n, total, mean, low, high, earliest, latest, first, last"
COLUMNS = [c.strip() for c in NAMES.split(",")]


@query(final_sql(DAY, DAY, 6 * HOUR, SEVERAL.format(o="seq"), NAMES))
def tumbling_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).tumbling_window(DAY, grace_ms=6 * HOUR).agg(**_several()).final()
    return rows(out, *COLUMNS, "start", "end")


@query(final_sql(DAY, 8 * HOUR, 3 * HOUR, SEVERAL.format(o="seq"), NAMES))
def hopping_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).hopping_window(DAY, 8 * HOUR, grace_ms=3 * HOUR).agg(**_several()).final()
    return rows(out, *COLUMNS, "start", "end")


@query(final_sql(DAY, 7 * HOUR, 0, "sum(cents)::BIGINT AS value", "value"))
def hopping_sum_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).apply(lambda v: v["cents"])
    return rows(e.hopping_window(DAY, 7 * HOUR).sum().final(), "value", "start", "end")


@query(f"""WITH {E}, w AS (SELECT event_type, ms // {DAY} * {DAY} AS s, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, n, s AS start, s + {DAY} AS "end" FROM w WHERE s + {DAY} <= (SELECT max(ms) FROM e) // {DAY} * {DAY}""")
def tumbling_final_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).group_by("event_type").tumbling_window(DAY).agg(n=A.Count()).final("partition")
    return rows(out, "n", "start", "end", key="event_type")


@query(f"""WITH {E}, {windows_sql(DAY, 8 * HOUR, "e")}, g AS (SELECT k, s, count(*) AS n FROM w GROUP BY 1, 2) SELECT k AS user_id, n, s AS start, s + {DAY} AS "end" FROM g WHERE s + {DAY} <= ((SELECT max(ms) FROM e) - {3 * HOUR}) // {8 * HOUR} * {8 * HOUR}""")
def hopping_final_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).hopping_window(DAY, 8 * HOUR, grace_ms=3 * HOUR).agg(n=A.Count()).final("partition")
    return rows(out, "n", "start", "end")


@query(final_sql(DAY, DAY, 0, "string_agg(cents::VARCHAR, ',' ORDER BY ms, seq) AS list", "list"))
def tumbling_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).tumbling_window(DAY).agg(list=A.Collect("cents")).final()
    return rows(out, F.array_join(F.col("list").cast("array<string>"), ",").alias("list"), "start", "end")


@query(final_sql(DAY, DAY, 0, "string_agg(event_type, '>' ORDER BY seq) AS value", "value"))
def reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).apply(lambda v: v["event_type"])
    out = e.tumbling_window(DAY).reduce(lambda old, new: F.concat(old, F.lit(">"), new), lambda v: v).final()
    return rows(out, "value", "start", "end")


class _Range(A.Aggregator):
    """Largest less smallest value, as a custom aggregator."""

    returns = "bigint"

    def initialize(self):
        return None

    def agg(self, old, new, timestamp):
        return (new, new) if old is None else (min(old[0], new), max(old[1], new))

    def finish(self, value):
        return None if value is None else int(value[1] - value[0])


@query(final_sql(DAY, DAY, 0, "max(cents) - min(cents) AS spread", "spread"))
def custom_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(events(spark, sf_dir).tumbling_window(DAY).agg(spread=_Range("cents")).final(), "spread", "start", "end")


@query(f"WITH {E} SELECT k AS user_id, seq AS event_id, ms // {DAY} * {DAY} AS start, (sum(cents) OVER w)::BIGINT AS total, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY k, ms // {DAY} ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def tumbling_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).tumbling_window(DAY).agg(total=A.Sum("cents"), n=A.Count()).current()
    return rows(out, F.col(ORDER).alias("event_id"), "start", "total", "n")


def late_sql(duration: int, step: int, grace: int) -> str:
    return f"""WITH {E}, {LATE}, {windows_sql(duration, step, "l")},
    g AS (SELECT k, s, {SEVERAL.format(o="arr * 1000000 + seq")}, any_value(mx) AS mx FROM w WHERE s > rm - {grace} - {duration} GROUP BY 1, 2)
    SELECT k AS user_id, {NAMES}, s AS start, s + {duration} AS "end" FROM g WHERE s <= mx - {grace} - {duration}"""


@query(late_sql(12 * HOUR, 12 * HOUR, 6 * HOUR))
def tumbling_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir, late=True).tumbling_window(12 * HOUR, grace_ms=6 * HOUR).agg(**_several()).final()
    return rows(out, *COLUMNS, "start", "end")


@query(late_sql(DAY, 8 * HOUR, 3 * HOUR))
def hopping_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir, late=True).hopping_window(DAY, 8 * HOUR, grace_ms=3 * HOUR).agg(**_several()).final()
    return rows(out, *COLUMNS, "start", "end")


@query(f"""WITH {E}, {LATE}, {windows_sql(12 * HOUR, 12 * HOUR, "l")} SELECT seq AS event_id, s AS start, s + {12 * HOUR} AS "end", rm - ms AS late_by_ms FROM w WHERE s <= rm - {12 * HOUR}""")
def late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = events(spark, sf_dir, late=True).tumbling_window(12 * HOUR).agg(n=A.Count()).late()
    return late.select("event_id", "start", "end", "late_by_ms")


def sliding_sql(duration: int, grace: int, arrival: bool) -> str:
    source, order = ("l WHERE ms > rm - {g} - 1 - {d}".format(g=grace, d=duration), "arr, seq") if arrival else ("e", "seq")
    head = f"WITH {E}{', ' + LATE if arrival else ''}, r AS (SELECT * FROM {source}), m AS (SELECT k AS mk, max(ms) AS mx FROM e GROUP BY 1)"
    return f"""{head}, x AS (SELECT k, ms, (sum(cents) OVER w)::BIGINT AS total, count(*) OVER w AS n, max(cents) OVER w AS high, row_number() OVER (PARTITION BY k, ms ORDER BY {order}) AS rn
      FROM r WINDOW w AS (PARTITION BY k ORDER BY ms RANGE BETWEEN {duration} PRECEDING AND CURRENT ROW))
    SELECT k AS user_id, total, n, high, greatest(0, ms - {duration}) AS start, ms AS "end" FROM x JOIN m ON k = mk WHERE rn = 1 AND greatest(0, ms - {duration}) <= mx - {grace} - 1 - {duration}"""


@query(sliding_sql(6 * HOUR, 0, False))
def sliding_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).sliding_window(6 * HOUR).agg(total=A.Sum("cents"), n=A.Count(), high=A.Max("cents")).final()
    return rows(out, "total", "n", "high", "start", "end")


@query(sliding_sql(6 * HOUR, HOUR, True))
def sliding_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir, late=True).sliding_window(6 * HOUR, grace_ms=HOUR).agg(total=A.Sum("cents"), n=A.Count(), high=A.Max("cents")).final()
    return rows(out, "total", "n", "high", "start", "end")


# count windows


def count_sql(n: int, step: int) -> str:
    return f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) - 1 AS rn FROM e),
    w AS (SELECT *, unnest(generate_series(greatest(0, (rn - {n} + {step}) // {step}), rn // {step})) AS i FROM r)
    SELECT k AS user_id, sum(cents)::BIGINT AS total, string_agg(cents::VARCHAR, ',' ORDER BY seq) AS list, min(ms) AS start, max(ms) AS "end" FROM w GROUP BY k, i HAVING count(*) = {n}"""


def _count_query(name: str, n: int, step: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir)
        w = e.sliding_count_window(n) if step == 1 else e.tumbling_count_window(n) if step == n else e.hopping_count_window(n, step)
        out = w.agg(total=A.Sum("cents"), list=A.Collect("cents")).final()
        return rows(out, "total", F.array_join(F.col("list").cast("array<string>"), ",").alias("list"), "start", "end")

    run.__name__ = name
    query(count_sql(n, step))(run)


_count_query("count_tumbling", 4, 4)
_count_query("count_hopping", 5, 2)
_count_query("count_sliding", 3, 1)


@query(f"""WITH {E}, r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY seq) - 1) // 4 AS i FROM e)
SELECT k AS user_id, seq AS event_id, (sum(cents) OVER w)::BIGINT AS total, min(ms) OVER w AS start, max(ms) OVER w AS "end" FROM r WINDOW w AS (PARTITION BY k, i ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def count_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).tumbling_count_window(4).agg(total=A.Sum("cents")).current()
    return rows(out, F.col(ORDER).alias("event_id"), "total", "start", "end")


# joins


def _sides(spark: SparkSession, sf_dir: str) -> tuple[EventFrame, EventFrame]:
    """Purchases (left) and views (right) of users."""
    a, b = events(spark, sf_dir), events(spark, sf_dir)
    left = a[a["event_type"] == "purchase"].apply(lambda v: {"l_id": v["event_id"], "cents": v["cents"]})
    right = b[b["event_type"] == "view"].apply(lambda v: {"r_id": v["event_id"], "r_cents": v["cents"]})
    return left, right


SIDES = f"{E}, l AS (SELECT k, ms, seq AS l_id, cents FROM e WHERE event_type = 'purchase'), r AS (SELECT k, ms, seq AS r_id, cents AS r_cents FROM e WHERE event_type = 'view')"


def _asof(how: str, split: int | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = _sides(spark, sf_dir)
        return rows(left.join_asof(right, how, split_ms=split or 7 * DAY), "l_id", "cents", "r_id", "r_cents")

    run.__name__ = f"asof_{how}" + ("_split" if split else "")
    kind = "LEFT " if how == "left" else ""
    query(f"WITH {SIDES} SELECT l.k AS user_id, l_id, cents, r_id, r_cents FROM l ASOF {kind}JOIN r ON l.k = r.k AND l.ms >= r.ms")(run)


_asof("inner", None)
_asof("left", None)
_asof("left", 2 * DAY)

BACK, AHEAD = 24 * HOUR, 12 * HOUR
PAIRS = f"SELECT l.k AS user_id, l_id, cents, r_id, r_cents, greatest(l.ms, r.ms) AS time FROM l JOIN r ON l.k = r.k AND r.ms BETWEEN l.ms - {BACK} AND l.ms + {AHEAD}"
ALONE_L = f"SELECT l.k, l_id, cents, NULL, NULL, l.ms FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.k = r.k AND r.ms BETWEEN l.ms - {BACK} AND l.ms)"
ALONE_R = f"SELECT r.k, NULL, NULL, r_id, r_cents, r.ms FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = r.k AND l.ms >= r.ms - {AHEAD} AND l.ms < r.ms)"


def _interval(how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = _sides(spark, sf_dir)
        out = left.join_interval(right, how, backward_ms=BACK, forward_ms=AHEAD)
        return rows(out, "l_id", "cents", "r_id", "r_cents", F.col(TIME).alias("time"))

    run.__name__ = f"interval_{how}"
    parts = [PAIRS, *([ALONE_L] if how in ("left", "outer") else []), *([ALONE_R] if how in ("right", "outer") else [])]
    query(f"WITH {SIDES} " + " UNION ALL ".join(parts))(run)


for _how in ("inner", "left", "right", "outer"):
    _interval(_how)


def _late_sides(spark: SparkSession, sf_dir: str) -> tuple[EventFrame, EventFrame]:
    """The same in an order of arrival in which many come late."""
    a, b = events(spark, sf_dir, late=True), events(spark, sf_dir, late=True)
    left = a[a["event_type"] == "purchase"].apply(lambda v: {"l_id": v["event_id"], "cents": v["cents"]})
    right = b[b["event_type"] == "view"].apply(lambda v: {"r_id": v["event_id"], "r_cents": v["cents"]})
    return left, right


LATE_SIDES = f"""{E}, a AS (SELECT *, (ms + (seq * 7919 % 97) * {HOUR}) * 1000000 + seq AS place FROM e), l AS (SELECT k, ms, place, seq AS l_id, cents FROM a WHERE event_type = 'purchase'),
  r AS (SELECT k, ms, place, seq AS r_id, cents AS r_cents FROM a WHERE event_type = 'view')"""


@query(
    f"""WITH {LATE_SIDES}, m AS (SELECT l_id, max(r.ms) AS newest FROM l JOIN r ON l.k = r.k AND r.place < l.place GROUP BY 1),
    x AS (SELECT l.l_id, arg_max(r_id, (r.ms, r.place)) AS r_id, arg_max(r_cents, (r.ms, r.place)) AS r_cents FROM l JOIN m USING (l_id) JOIN r ON l.k = r.k AND r.place < l.place AND r.ms <= l.ms AND r.ms >= newest - {2 * DAY} GROUP BY 1)
    SELECT l.k AS user_id, l.l_id, cents, r_id, r_cents FROM l LEFT JOIN x USING (l_id)"""
)
def asof_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _late_sides(spark, sf_dir)
    return rows(left.join_asof(right, "left", grace_ms=2 * DAY, by_arrival=True), "l_id", "cents", "r_id", "r_cents")


@query(
    f"""WITH {LATE_SIDES}, p AS (SELECT l.k, l_id, cents, r_id, r_cents, greatest(l.ms, r.ms) AS time, r.place < l.place AS right_first FROM l JOIN r ON l.k = r.k
      AND (CASE WHEN r.place < l.place THEN r.ms BETWEEN l.ms - {BACK} AND l.ms ELSE l.ms BETWEEN r.ms - {AHEAD} AND r.ms END))
    SELECT k AS user_id, l_id, cents, r_id, r_cents, time FROM p
    UNION ALL SELECT k, l_id, cents, NULL, NULL, ms FROM l WHERE l_id NOT IN (SELECT l_id FROM p WHERE right_first)
    UNION ALL SELECT k, NULL, NULL, r_id, r_cents, ms FROM r WHERE r_id NOT IN (SELECT r_id FROM p WHERE NOT right_first)"""
)
def interval_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _late_sides(spark, sf_dir)
    out = left.join_interval(right, "outer", backward_ms=BACK, forward_ms=AHEAD, by_arrival=True)
    return rows(out, "l_id", "cents", "r_id", "r_cents", F.col(TIME).alias("time"))


@query(f"WITH {SIDES} SELECT l.k AS user_id, l_id, coalesce(r_cents, cents) AS cents FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ms >= r.ms")
def asof_keep_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    right = right.apply(lambda v: {"cents": v["r_cents"]})
    return rows(left.join_asof(right, "left", on_merge="keep-right"), "l_id", "cents")


def _orders(spark: SparkSession, sf_dir: str) -> EventFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    return EventFrame.of(df, "o_custkey", "t", "o_orderkey")


@query("SELECT o_orderkey, c_name AS name, c_nationkey AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = TableLookup({"customer": spark.read.parquet(f"{sf_dir}/customer.parquet")})
    out = _orders(spark, sf_dir).join_lookup(tables, {"c": LookupField("customer", ["c_name", "c_nationkey"], "c_custkey", order_by="c_name")})
    return out.df.select("o_orderkey", F.col("c.c_name").alias("name"), F.col("c.c_nationkey").alias("nation"))


@query("SELECT r_regionkey, coalesce(string_agg(n_name, ',' ORDER BY n_name DESC), '') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = EventFrame.of(spark.read.parquet(f"{sf_dir}/region.parquet"), "r_regionkey", F.lit(0))
    tables = TableLookup({"nation": spark.read.parquet(f"{sf_dir}/nation.parquet")})
    out = regions.join_lookup(tables, {"n": LookupField("nation", ["n_name"], "n_regionkey", order_by="n_name", descending=True, first_match_only=False)}, on="r_regionkey")
    return out.df.select("r_regionkey", F.array_join(F.transform("n", lambda x: x["n_name"]), ",").alias("nations"))


@query("SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1) ON o_custkey = c_custkey")
def lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("driftline_customer")
    field = QueryField("SELECT c_custkey, count(*) AS n FROM driftline_customer GROUP BY c_custkey", "c_custkey", default={"n": 0})
    out = _orders(spark, sf_dir).join_lookup(TableLookup({}), {"q": field})
    return out.df.select("o_orderkey", F.coalesce("q.n", F.lit(0)).cast("long").alias("n"))


VERSIONS = "v AS (SELECT ms AS valid_from, k % 40 AS target, row_number() OVER (PARTITION BY k % 40 ORDER BY seq * 7919 % 1009, seq) AS version, cents FROM e WHERE event_type = 'refund')"


@query(f"WITH {E}, {VERSIONS}, x AS (SELECT e.seq, arg_max(v.cents, v.version) AS c FROM e JOIN v ON v.target = e.k AND v.valid_from <= e.ms GROUP BY 1) SELECT e.seq AS event_id, c::VARCHAR AS setting FROM e LEFT JOIN x USING (seq)")
def config_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = events(spark, sf_dir)
    log = events(spark, sf_dir).df.where("event_type = 'refund'")
    order = W.partitionBy(F.col("user_id") % 40).orderBy(F.col("event_id") * 7919 % 1009, "event_id")
    log = log.select(F.lit("limits").alias("type"), (F.col("user_id") % 40).cast("string").alias("target_key"), F.row_number().over(order).alias("version"), F.col(TIME).alias("valid_from"), F.lit("created").alias("event"), F.to_json(F.struct("cents")).alias("content"))
    out = e.join_lookup(ConfigurationLookup(log), {"setting": JSONField("limits", "$.cents")}, on=lambda v, k: k)
    return out.df.select("event_id", "setting")


# state


@query(f"""WITH RECURSIVE {E}, t AS (SELECT DISTINCT event_type || '-' || k AS id, ms FROM e),
keep AS (SELECT id, min(ms) AS ms FROM t GROUP BY 1 UNION ALL SELECT id, ms FROM (SELECT t.id, min(t.ms) AS ms FROM keep JOIN t ON t.id = keep.id AND t.ms >= keep.ms + {DAY} GROUP BY t.id, keep.ms))
SELECT id, ms AS time FROM keep""")
def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).group_by(lambda v: F.concat_ws("-", v["event_type"], v["user_id"].cast("string")), name="id")

    def new(value, state):
        if state.exists("seen"):
            return False
        state.set("seen", True, ttl=DAY)
        return True

    return e.filter(new, stateful=True).df.select(F.col(KEY).alias("id"), F.col(TIME).alias("time"))


@query(f"WITH {E} SELECT seq AS event_id, (sum(cents) OVER (PARTITION BY k ORDER BY seq))::BIGINT AS balance FROM e")
def stateful_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    def add(value, state):
        total = state.get("total", 0) + value["cents"]
        state.set("total", total)
        return {"event_id": value["event_id"], "balance": total}

    return events(spark, sf_dir).apply(add, returns="event_id bigint, balance bigint", stateful=True).df.select("event_id", "balance")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
