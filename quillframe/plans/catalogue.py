"""One query for each operator, and the SQL to hold it against. Doubles are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.config import Options
from quillframe.functions import casts
from quillframe.functions.resample import Resampler
from quillframe.operators.frame import Frame, NullFiller, Series, Sorter, concat_series, label_product, make_multi_level_labels, opaque

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_KEYS = {"events": ["event_id"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"]}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def frame(spark: SparkSession, sf: str, name: str, *columns: str, labels: tuple[str, ...] | None = None) -> Frame:
    """A table as a frame, labelled and ordered by its key. Pass only columns that are needed: they are all the scan reads."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    keys = _KEYS.get(name, [])
    df = df.select(*dict.fromkeys([*keys, *columns])) if columns else df
    return Frame.from_spark(df, labels if labels is not None else keys, keys, name)


def nulled(spark: SparkSession, sf: str) -> Frame:
    """Events with a value that is null for errors."""
    f = frame(spark, sf, "events", "event_type", "value")
    t, v = f.field("event_type").id, f.field("value").id
    return f.with_col("value", F.when(F.col(t) != "error", F.col(v)))


_NULLED = "SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS v, ts FROM events"


def out(f: Frame, *rounded: str, labels: bool = True, places: int = 3) -> DataFrame:
    df = f.to_spark(labels)
    return df.withColumns({c: F.round(c, places) for c in rounded})


# ---- filters, projection, nulls ----


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05")
def filter_and(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_discount")
    f = Frame.from_spark(df, ["l_orderkey"], ["l_orderkey"])
    return out(f.filter({"l_quantity": lambda c: c >= 30, "l_discount": lambda c: c < 0.05}))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_by_value(spark, sf):
    return out(frame(spark, sf, "orders", "o_orderpriority").filter_by_value({"o_orderpriority": "1-URGENT"}))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def filter_opaque(spark, sf):
    f = frame(spark, sf, "events", "event_type", "value")
    return out(f.filter({"event_type": lambda c: c == "click", "value": opaque(lambda v: v > 50)})).select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'O' THEN 'big' ELSE 'other' END AS size FROM orders")
def where_cond(spark, sf):
    f = frame(spark, sf, "orders", "o_totalprice", "o_orderstatus")
    return out(f.where({"o_totalprice": lambda c: c > 200000, "o_orderstatus": lambda c: c == "O"}, "big", "other", "size"))


@query(f"SELECT event_id, v AS value FROM ({_NULLED}) WHERE v IS NOT NULL")
def drop_null(spark, sf):
    return out(nulled(spark, sf).select("value").drop_null("value"))


@query(f"SELECT event_id, event_type FROM ({_NULLED}) WHERE v IS NULL")
def is_null(spark, sf):
    return out(nulled(spark, sf).is_null("value").select("event_type"))


@query(f"SELECT event_id, coalesce(v, 0) AS value FROM ({_NULLED})")
def fill_zero(spark, sf):
    return out(nulled(spark, sf).select("value").fill_null({"value": NullFiller(zero=True)}))


@query(f"SELECT event_id, coalesce(v, -1.5) AS value FROM ({_NULLED})")
def fill_float(spark, sf):
    return out(nulled(spark, sf).select("value").fill_null({"value": NullFiller(value=-1.5)}))


@query(f"SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS value FROM ({_NULLED})")
def fill_forward(spark, sf):
    return out(nulled(spark, sf).select("value").fill_null({"value": NullFiller(forward=True)}))


@query(f"SELECT event_id, coalesce(first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value FROM ({_NULLED})")
def fill_backward(spark, sf):
    return out(nulled(spark, sf).select("value").fill_null({"value": NullFiller(backward=True)}))


@query("SELECT event_id, CASE WHEN value <= 90 THEN value END AS value FROM events")
def set_nulls(spark, sf):
    f = frame(spark, sf, "events", "value")
    return out(f.set_nulls("value", F.col(f.field("value").id) > 90))


@query("SELECT c_custkey, c_mktsegment, c_acctbal AS balance, round(c_acctbal * 2, 3) AS double_balance FROM customer")
def with_columns(spark, sf):
    f = frame(spark, sf, "customer", "c_mktsegment", "c_acctbal").with_col("c_acctbal", "balance")
    return out(f.with_col("double_balance", lambda c: c["balance"] * 2), "double_balance")


@query("SELECT c_nationkey, c_mktsegment, c_custkey FROM customer")
def labels_and_columns(spark, sf):
    f = frame(spark, sf, "customer", "c_mktsegment", "c_nationkey").set_as_labels("c_nationkey").reset_labels("c_custkey")
    return out(f.reorder_cols(["c_mktsegment", "c_custkey"]))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_name FROM customer")
def relabel(spark, sf):
    return out(frame(spark, sf, "customer", "c_name").relabel().set_label_names(["ordinal"]))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def head(spark, sf):
    return out(frame(spark, sf, "customer", "c_name").head(20))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 20")
def tail(spark, sf):
    return out(frame(spark, sf, "customer", "c_name").tail(20))


@query("SELECT c_custkey, c_name FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) BETWEEN 51 AND 100")
def range_rows(spark, sf):
    return out(frame(spark, sf, "customer", "c_name").range(50, 100))


@query("SELECT c_custkey, c_name FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) IN (1, 8, 100)")
def subset_rows(spark, sf):
    return out(frame(spark, sf, "customer", "c_name").subset([99, 0, 7]))


@query("SELECT c_custkey, c_name FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) <> 6")
def drop_row(spark, sf):
    return out(frame(spark, sf, "customer", "c_name").drop_row(5))


@query("SELECT c_custkey, c_name, true AS moved, 1 AS times FROM customer")
def shuffle_rows(spark, sf):
    """Every row once, and whether the rows as a whole have moved: fewer than one in ten of them lies where it lay, or beside it."""
    f = frame(spark, sf, "customer", "c_name").shuffle(7).reset_labels().set_label_names(["place"])
    df = f.to_spark().withColumn("near", (F.abs(F.col("place") + 1 - F.col("c_custkey")) < 2).cast("int"))
    moved = df.agg(F.sum("near") * 10 < F.count("*")).first()[0]
    return df.groupBy("c_custkey", "c_name").agg(F.lit(moved).alias("moved"), F.count("*").cast("int").alias("times"))


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) IN (1, 3) THEN -value ELSE value END AS value FROM events")
def set_rows(spark, sf):
    return out(frame(spark, sf, "events", "value").set_rows(lambda c: -c, "value", [0, 2]))


@query("SELECT event_id, round(value * 2 + 1, 3) AS value FROM events")
def apply_column(spark, sf):
    return out(frame(spark, sf, "events", "value").apply({"value": lambda c: c * 2 + 1}), "value")


@query("SELECT event_id, round(value * 2 + 1, 3) AS value FROM events")
def apply_opaque(spark, sf):
    return out(frame(spark, sf, "events", "value").apply({"value": opaque(lambda v: v * 2 + 1)}), "value")


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) END AS mixed FROM events""")
def cast_string_float(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x1d").alias("mixed"))
    return out(Frame.from_spark(df, ["event_id"], ["event_id"]).cast({"k": casts.FLOAT, "mixed": casts.FLOAT}))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate FROM orders")
def cast_time_string(spark, sf):
    return out(frame(spark, sf, "orders", "o_orderdate").cast({"o_orderdate": casts.STRING}))


# ---- order ----


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def sort_topk(spark, sf):
    return out(frame(spark, sf, "orders", "o_totalprice").sort(Sorter("o_totalprice", casts.FLOAT, True)).head(10))


@query(f"SELECT event_id, row_number() OVER (ORDER BY event_type DESC NULLS LAST, v NULLS LAST, event_id) - 1 AS place FROM ({_NULLED})")
def sort_stable(spark, sf):
    f = nulled(spark, sf).sort(Sorter("event_type", casts.STRING, True), Sorter("value", casts.FLOAT))
    f = f.reset_labels().set_label_names(["place"])
    return out(f.select("event_id"))


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_rows(spark, sf):
    a = frame(spark, sf, "customer", "c_name").set_label_names(["key"]).set_col_names(["name"])
    return out(a.append(frame(spark, sf, "supplier", "s_name")))


# ---- groups ----

_GROUPS = {"sum": "sum(l_quantity)", "mean": "avg(l_quantity)", "median": "median(l_quantity)", "stdDev": "stddev_pop(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)", "count": "nullif(count(l_quantity), 0)", "nunique": "nullif(count(DISTINCT l_quantity), 0)"}


def _group(kind: str, sql: str) -> None:
    def f(spark, sf):
        df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey")
        g = Frame.from_spark(df, ["l_orderkey"], ["l_orderkey"]).group_by("l_returnflag", "l_linestatus").agg(kind, "l_quantity")
        return out(g, *([] if kind in ("count", "nunique") else [f"{kind}_l_quantity"]))

    f.__name__ = f"group_{kind.lower()}"
    value = sql if kind in ("count", "nunique") else f"round({sql}, 3)"
    query(f'SELECT l_returnflag, l_linestatus, {value} AS "{kind}_l_quantity" FROM lineitem GROUP BY 1, 2')(f)


for _k, _s in _GROUPS.items():
    _group(_k, _s)


def _of_events(kind: str, column: str, sql: str) -> None:
    def f(spark, sf):
        return out(frame(spark, sf, "events", "event_type", column).group_by("event_type").agg(kind, column))

    f.__name__ = f"group_{kind}"
    query(f"SELECT event_type, {sql} AS {kind}_{column} FROM events GROUP BY 1")(f)


for _k, _c, _s in (("earliest", "ts", "min(ts)"), ("latest", "ts", "max(ts)"), ("first", "value", "arg_min(value, event_id)"), ("last", "value", "arg_max(value, event_id)")):
    _of_events(_k, _c, _s)


@query("SELECT event_type, value AS nth_value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 3")
def group_nth(spark, sf):
    return out(frame(spark, sf, "events", "event_type", "value").group_by("event_type").nth(2, "value"))


@query("SELECT event_type, value AS nth_value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 2")
def group_nth_from_end(spark, sf):
    return out(frame(spark, sf, "events", "event_type", "value").group_by("event_type").nth(-2, "value"))


@query("SELECT event_type, round(max(value) - min(value), 3) AS spread_value FROM events GROUP BY 1")
def group_reduce(spark, sf):
    g = frame(spark, sf, "events", "event_type", "value").group_by("event_type")
    return out(g.reduce("spread", lambda c: F.max(c) - F.min(c), "value"), "spread_value")


@query("SELECT event_type, round(max(value) - min(value), 3) AS spread_value FROM events GROUP BY 1")
def group_reduce_opaque(spark, sf):
    g = frame(spark, sf, "events", "event_type", "value").group_by("event_type")
    return out(g.reduce("spread", opaque(lambda v: float(v.max() - v.min())), "value"), "spread_value")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 3) AS mean_value FROM events")
def align_mean(spark, sf):
    return out(frame(spark, sf, "events", "event_type", "value").group_by("event_type").col("value").align().mean(), "mean_value")


@query("SELECT user_id, round(sum(value), 3) AS sum_value FROM events GROUP BY 1 HAVING count(*) > 12")
def having_count(spark, sf):
    g = frame(spark, sf, "events", "user_id", "value").group_by("user_id").having_count(lambda n: n > 12)
    return out(g.sum("value"), "sum_value")


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 3) AS value FROM events WINDOW w AS (PARTITION BY event_type)")
def group_apply_zscore(spark, sf):
    g = frame(spark, sf, "events", "event_type", "value").group_by("event_type")
    g = g.apply(lambda c, w: (c - F.avg(c).over(w)) / F.stddev_pop(c).over(w), "value")
    return out(g.frame.select("value"), "value")


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 3) AS value FROM events WINDOW w AS (PARTITION BY event_type)")
def group_apply_of_group(spark, sf):
    g = frame(spark, sf, "events", "event_type", "value").group_by("event_type")
    g = g.apply(lambda c, of: (c - of["mean"]) / of["std"], "value", of_group={"mean": F.avg, "std": F.stddev_pop})
    return out(g.frame.select("value"), "value")


@query('SELECT l_returnflag, l_linestatus, round(median(l_quantity), 3) AS "median_l_quantity" FROM lineitem GROUP BY 1, 2')
def group_median_spread(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey")
    g = Frame.from_spark(df, ["l_orderkey"], ["l_orderkey"]).group_by("l_returnflag", "l_linestatus")
    return out(g.median("l_quantity", spread=True), "median_l_quantity")


@query("SELECT event_type, value FROM events")
def group_rows(spark, sf):
    return out(frame(spark, sf, "events", "event_type", "value").group_by("event_type").to_frame())


@query("SELECT event_type, value FROM events WHERE event_type = 'click'")
def get_group(spark, sf):
    return out(frame(spark, sf, "events", "event_type", "value").group_by("event_type").get_group("click"))


@query("SELECT 'c_acctbal' AS name, round(sum(c_acctbal), 2) AS sum FROM customer UNION ALL SELECT 'c_nationkey', sum(c_nationkey) FROM customer")
def col_sums(spark, sf):
    return out(frame(spark, sf, "customer", "c_acctbal", "c_nationkey").sum().set_label_names(["name"]), "sum", places=2)


@query("SELECT 'c_acctbal' AS name, round(avg(c_acctbal), 3) AS mean FROM customer UNION ALL SELECT 'c_nationkey', round(avg(c_nationkey), 3) FROM customer")
def col_means(spark, sf):
    return out(frame(spark, sf, "customer", "c_acctbal", "c_nationkey").mean().set_label_names(["name"]), "mean")


@query("SELECT 'c_acctbal' AS name, round(max(c_acctbal) - min(c_acctbal), 3) AS spread FROM customer UNION ALL SELECT 'c_nationkey', max(c_nationkey) - min(c_nationkey) FROM customer")
def col_reduce(spark, sf):
    f = frame(spark, sf, "customer", "c_acctbal", "c_nationkey").cast({"c_nationkey": casts.FLOAT})
    return out(f.reduce("spread", lambda c: F.max(c) - F.min(c)).set_label_names(["name"]), "spread")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS count FROM customer GROUP BY 1")
def value_counts(spark, sf):
    return frame(spark, sf, "customer", "c_nationkey")["c_nationkey"].value_counts_frame()


@query("SELECT min(event_id) AS event_id, event_type FROM events GROUP BY event_type")
def unique_first(spark, sf):
    return out(frame(spark, sf, "events", "event_type")["event_type"].unique())


# ---- joins ----

_FIRST_ORDER = "(SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"


def _customers(spark, sf) -> Frame:
    return frame(spark, sf, "customer", "c_name").set_label_names(["key"])


def _orders(spark, sf) -> Frame:
    f = frame(spark, sf, "orders", "o_custkey", "o_totalprice")
    return f.set_as_labels("o_custkey").subset_labels([1]).set_label_names(["key"])


@query(f"SELECT c_custkey AS key, c_name, o_totalprice FROM customer LEFT JOIN {_FIRST_ORDER} ON c_custkey = o_custkey")
def merge_left(spark, sf):
    return out(_customers(spark, sf).merge(_orders(spark, sf)))


@query("SELECT o_custkey AS key, o_totalprice, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def merge_right(spark, sf):
    return out(_customers(spark, sf).merge(_orders(spark, sf), "right"))


@query(f"SELECT c_custkey AS key, c_name, o_totalprice FROM customer JOIN {_FIRST_ORDER} ON c_custkey = o_custkey")
def merge_inner(spark, sf):
    return out(_customers(spark, sf).merge(_orders(spark, sf), "inner"))


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def merge_on_keys(spark, sf):
    a = frame(spark, sf, "nation", "n_name", "n_regionkey")
    m = a.merge(frame(spark, sf, "region", "r_name"), left_on=["n_regionkey"], right_on=["r_regionkey"])
    return out(m.select("n_name", "r_name"))


@query(f"SELECT c_custkey AS key, o_totalprice FROM customer LEFT JOIN {_FIRST_ORDER} ON c_custkey = o_custkey")
def lookup_left(spark, sf):
    return out(_customers(spark, sf).lookup(_orders(spark, sf)))


def _math(name: str, sql: str) -> None:
    def f(spark, sf):
        a = frame(spark, sf, "customer", "c_acctbal").set_label_names(["key"])["c_acctbal"]
        b = frame(spark, sf, "supplier", "s_acctbal").set_label_names(["key"])["s_acctbal"]
        return out(getattr(a, name)(b), "c_acctbal")

    f.__name__ = f"series_{name}"
    query(f"SELECT c_custkey AS key, round({sql}, 3) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")(f)


for _k, _s in (("add", "c_acctbal + s_acctbal"), ("subtract", "c_acctbal - s_acctbal"), ("multiply", "c_acctbal * s_acctbal"), ("divide", "c_acctbal / nullif(s_acctbal, 0)")):
    _math(_k, _s)


@query("SELECT c_custkey AS key, round(CASE WHEN s_acctbal IS NULL THEN c_acctbal ELSE c_acctbal - s_acctbal END, 3) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def series_subtract_ignoring_nulls(spark, sf):
    a = frame(spark, sf, "customer", "c_acctbal").set_label_names(["key"])["c_acctbal"]
    b = frame(spark, sf, "supplier", "s_acctbal").set_label_names(["key"])["s_acctbal"]
    return out(a.subtract(b, True), "c_acctbal")


@query("SELECT c_custkey AS key, c_acctbal, s_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def concat_two_series(spark, sf):
    a = frame(spark, sf, "customer", "c_acctbal").set_label_names(["key"])["c_acctbal"]
    b = frame(spark, sf, "supplier", "s_acctbal").set_label_names(["key"])["s_acctbal"]
    return out(concat_series(a, b))


@query("SELECT a.r_name AS a, b.n AS b FROM region a, (VALUES (1), (2), (3)) b(n)")
def multi_level_labels(spark, sf):
    names = frame(spark, sf, "region", "r_name")["r_name"].get_values()
    a, b = make_multi_level_labels([names, [1, 2, 3]])
    return spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b int")


@query("SELECT r_name, n_name FROM region, nation")
def multi_level_labels_of_tables(spark, sf):
    return out(label_product(frame(spark, sf, "region", "r_name"), frame(spark, sf, "nation", "n_name")))


# ---- reshape ----

_PIVOT = {"sum": "sum", "mean": "avg", "median": "median", "stdDev": "stddev_pop", "count": "count", "min": "min", "max": "max"}


def _pivot(how: str, sql: str) -> None:
    def f(spark, sf):
        df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
        p = Frame.from_spark(df, ["l_orderkey"], ["l_orderkey"]).pivot_table("l_returnflag", "l_linestatus", "l_quantity", how)
        return out(p.reorder_cols(["F", "O"]), *([] if how == "count" else ["F", "O"]))

    f.__name__ = f"pivot_{how.lower()}"
    cell = lambda v: f"nullif(count(l_quantity) FILTER (WHERE l_linestatus = '{v}'), 0)" if how == "count" else f"round({sql}(l_quantity) FILTER (WHERE l_linestatus = '{v}'), 3)"
    query(f'SELECT l_returnflag, {cell("F")} AS "F", {cell("O")} AS "O" FROM lineitem GROUP BY 1')(f)


for _k, _s in _PIVOT.items():
    _pivot(_k, _s)


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"arg_max(value, event_id) FILTER (WHERE event_type = '{x}') AS \"{x}|value\"" for x in _TYPES) + " FROM events GROUP BY 1")
def promote(spark, sf):
    f = frame(spark, sf, "events", "event_type", "user_id", "value").set_as_labels("event_type", "user_id").subset_labels([1, 2])
    return out(f.promote_to_col_level("event_type"))


def _turned(field: str, value: str) -> str:
    return f"SELECT '{field}' AS field, " + ", ".join(f'max({value}) FILTER (WHERE n_nationkey = {k}) AS "{k}"' for k in range(25)) + " FROM nation"


@query(f"{_turned('n_name', 'n_name')} UNION ALL {_turned('n_regionkey', 'CAST(n_regionkey AS VARCHAR)')}")
def transpose_small(spark, sf):
    return out(frame(spark, sf, "nation", "n_name", "n_regionkey").transpose().set_label_names(["field"]))


# ---- analytic ----


def _values(spark, sf) -> Series:
    return nulled(spark, sf)["value"]


@query(f"SELECT event_id, round(coalesce(sum(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 2) AS value FROM ({_NULLED})")
def cumsum(spark, sf):
    return out(_values(spark, sf).cumsum(), "value", places=2)


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY v NULLS LAST) AS DOUBLE) END AS value FROM ({_NULLED})")
def rank_dense(spark, sf):
    return out(_values(spark, sf).rank())


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round((rank() OVER (ORDER BY v NULLS LAST) - 1) / (count(v) OVER ()), 6) END AS value FROM ({_NULLED})")
def percentile(spark, sf):
    return out(_values(spark, sf).percentile(), "value", places=6)


@query(f"SELECT event_id, CASE WHEN v <= 10 THEN '<=10' WHEN v <= 50 THEN '10-50' WHEN v <= 90.5 THEN '50-90.5' WHEN v > 90.5 THEN '>90.5' END AS value FROM ({_NULLED})")
def bin_values(spark, sf):
    return out(_values(spark, sf).bin([10, 50, 90.5], True, True))


@query(f"""SELECT event_id, CASE WHEN p < 0.25 THEN 'low' WHEN p < 0.75 THEN 'mid' WHEN p < 1 THEN 'high' END AS value
FROM (SELECT event_id, CASE WHEN v IS NOT NULL THEN (rank() OVER (ORDER BY v NULLS LAST) - 1) / (count(v) OVER ()) END AS p FROM ({_NULLED}))""")
def percentile_bin(spark, sf):
    return out(_values(spark, sf).percentile_bin([0, 0.25, 0.75, 1], names=["low", "mid", "high"]))


@query(f"SELECT event_id, lag(v) OVER (ORDER BY event_id) AS value FROM ({_NULLED})")
def shift_1(spark, sf):
    return out(_values(spark, sf).shift(1))


@query(f"SELECT event_id, lead(v, 3) OVER (ORDER BY event_id) AS value FROM ({_NULLED})")
def shift_neg3(spark, sf):
    return out(_values(spark, sf).shift(-3))


def _rolling(kind: str, sql: str) -> None:
    def f(spark, sf):
        name = f"{kind}_value"
        return out(_values(spark, sf).rolling_n(3).agg(kind), *([] if kind in ("count", "nunique") else [name]))

    f.__name__ = f"rolling_n_{kind.lower()}"
    value = f"nullif({sql}, 0)" if kind in ("count", "nunique") else f"round({sql}, 3)"
    query(f"""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n, {value} AS r
FROM ({_NULLED}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT a.event_id, b.r AS "{kind}_value" FROM e a JOIN e b ON b.i = least(a.i, a.n - 2)""")(f)


_ROLLING = {"sum": "sum(v) OVER w", "mean": "avg(v) OVER w", "max": "max(v) OVER w", "min": "min(v) OVER w", "count": "count(v) OVER w", "median": "median(v) OVER w", "stdDev": "stddev_pop(v) OVER w"}
_ROLLING |= {"nunique": "count(DISTINCT v) OVER w", "first": "first_value(v) OVER w", "last": "last_value(v) OVER w"}
for _k, _s in _ROLLING.items():
    _rolling(_k, _s)

_THREE = f"""WITH e AS (SELECT event_id, v, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM ({_NULLED})), w AS (
SELECT a.event_id, a.i - least(a.i, a.n - 2) AS place, list(b.v ORDER BY b.i) AS l FROM e a JOIN e b ON b.i - least(a.i, a.n - 2) BETWEEN 0 AND 2 GROUP BY 1, 2)"""


@query(f"{_THREE} SELECT event_id, l[2] AS nth_value FROM w")
def rolling_n_nth(spark, sf):
    return out(_values(spark, sf).rolling_n(3).nth(1))


@query(f"{_THREE} SELECT event_id, round(list_max(l) - list_min(l), 3) AS spread_value FROM w")
def rolling_n_reduce(spark, sf):
    return out(_values(spark, sf).rolling_n(3).reduce("spread", lambda c, w: F.max(c).over(w) - F.min(c).over(w)), "spread_value")


@query(f"{_THREE}, t AS (SELECT event_id, l[3 - place] AS v FROM w), r AS (SELECT event_id, round(sum(v) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 3) AS r, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM t) SELECT a.event_id, b.r AS sum_value FROM r a JOIN r b ON b.i = least(a.i, a.n - 2)")
def rolling_n_apply(spark, sf):
    """Each window's values turned round, then summed by window."""
    return out(_values(spark, sf).rolling_n(3).apply(F.reverse).sum(), "sum_value")


@query(f"SELECT event_id, CAST(NULL AS DOUBLE) AS sum_value FROM ({_NULLED})")
def rolling_n_having(spark, sf):
    return out(_values(spark, sf).rolling_n(3).having_count(lambda n: n > 3).sum(), "sum_value")


_HOUR = "WITH w AS (SELECT e.event_id, e.ts, list(f.ts ORDER BY f.ts) AS l FROM events e JOIN events f ON f.ts >= e.ts AND f.ts < e.ts + INTERVAL 1 HOUR GROUP BY 1, 2)"


def _of_hour(kind: str, sql: str, made: Callable | None = None) -> None:
    def f(spark, sf):
        r = frame(spark, sf, "events", "ts")["ts"].rolling_duration(timedelta(hours=1))
        return out(made(r) if made else r.agg(kind))

    f.__name__ = f"rolling_duration_{kind}"
    query(f'{_HOUR} SELECT event_id, {sql} AS "{kind}_ts" FROM w')(f)


_of_hour("count", "len(l)")
_of_hour("nunique", "list_unique(l)")
_of_hour("earliest", "l[1]")
_of_hour("latest", "l[-1]")
_of_hour("first", "l[1]")
_of_hour("last", "l[-1]")
_of_hour("nth", "l[2]", lambda r: r.nth(1))
_of_hour("reduce", "len(l)", lambda r: r.reduce("reduce", lambda a: F.size(a).cast("long")))


@query("""WITH w AS (SELECT e.event_id, e.ts, count(*) AS n, max(f.ts) AS last FROM events e JOIN events f ON f.ts >= e.ts AND f.ts < e.ts + INTERVAL 1 HOUR GROUP BY 1, 2)
SELECT a.event_id, (SELECT max_by(b.last, b.ts) FROM w b WHERE b.n > 2 AND b.ts <= a.ts AND b.last >= a.ts) AS last_ts FROM w a""")
def rolling_duration_having(spark, sf):
    r = frame(spark, sf, "events", "ts")["ts"].rolling_duration(timedelta(hours=1))
    return out(r.having_count(lambda n: n > 2).last())


@query(f"{_HOUR}, t AS (SELECT a.event_id, (SELECT max_by(b.l[len(b.l) - list_position(b.l, a.ts) + 1], b.ts) FROM w b WHERE b.ts <= a.ts AND list_contains(b.l, a.ts)) AS t FROM w a) SELECT event_id, t AS first_ts FROM t")
def rolling_duration_apply(spark, sf):
    """Each window's times turned round: a row keeps that at its own place in its own window."""
    r = frame(spark, sf, "events", "ts")["ts"].rolling_duration(timedelta(hours=1))
    return out(r.apply(F.reverse).first())


_RESAMPLES = {
    "year": (Resampler(by_year=True), "date_trunc('year', ts)"),
    "month": (Resampler(by_month=True), "date_trunc('month', ts)"),
    "day": (Resampler(by_day=True), "date_trunc('day', ts)"),
    "week_sunday": (Resampler(by_week=True), "ts::date - dayofweek(ts)::int"),
    "week_monday": (Resampler(by_week=True, start_of_week=1), "date_trunc('week', ts)"),
    "30min": (Resampler(by_duration=timedelta(minutes=30)), "time_bucket(INTERVAL 30 MINUTE, ts)"),
    "7days": (Resampler(by_duration=timedelta(days=7)), "date_trunc('week', ts)"),
}


def _resample(name: str, how: Resampler, sql: str) -> None:
    def f(spark, sf):
        return out(frame(spark, sf, "events", "ts").resample({"ts": how}))

    f.__name__ = f"resample_{name}"
    query(f"SELECT event_id, ({sql})::timestamp AS ts FROM events")(f)


for _k, (_h, _s) in _RESAMPLES.items():
    _resample(_k, _h, _s)


@query("SELECT date_trunc('day', ts)::timestamp AS ts, round(sum(value), 3) AS sum_value, count(value) AS n FROM events GROUP BY 1")
def resample_then_group(spark, sf):
    g = frame(spark, sf, "events", "ts", "value").resample({"ts": Resampler(by_day=True)}).group_by("ts")
    return out(g.sum("value").merge(g.count("value").set_col_names(["n"])), "sum_value")


@query("""SELECT l_returnflag, round(avg(l_extendedprice), 2) AS mean_l_extendedprice FROM lineitem WHERE l_quantity >= 10 AND l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1""")
def flagship(spark, sf):
    """Scan, filter, group, mean: filters and column choice reach the scan, and the mean is partial before its one shuffle."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_quantity", "l_shipdate", "l_extendedprice")
    f = Frame.from_spark(df, ["l_orderkey"], ["l_orderkey"])
    f = f.filter({"l_quantity": lambda c: c >= 10, "l_shipdate": lambda c: c < F.lit("1998-09-02").cast("timestamp_ntz")})
    return out(f.group_by("l_returnflag").mean("l_extendedprice"), "mean_l_extendedprice", places=2)


# ---- sources and sinks: a round trip each ----


def _local(spark, sf) -> Frame:
    return frame(spark, sf, "nation", "n_name", "n_regionkey")


def _shared(spark) -> str:
    """A new folder that driver and executors share and that goes with the session: below ``spark.checkpoint.dir``, or a local one where that is unset."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/quillframe-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


_NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def records_round_trip(spark, sf):
    from quillframe.sources import read_records, to_records

    return out(read_records(spark, to_records(_local(spark, sf)), label_levels=1).cast({"n_regionkey": casts.FLOAT}))


@query(_NATIONS)
def rows_round_trip(spark, sf):
    from quillframe.sources import read_rows, to_rows

    return out(read_rows(spark, to_rows(_local(spark, sf)), label_levels=1))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, sf):
    from quillframe.sources import read_json, to_json

    return out(read_json(spark, to_json(_local(spark, sf))))


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderstatus FROM orders")
def csv_round_trip(spark, sf):
    from quillframe.sources import read_csv, write_csv

    to = _shared(spark)
    write_csv(frame(spark, sf, "orders", "o_totalprice", "o_orderstatus"), to)
    return out(read_csv(spark, to, label_levels=1, infer_types=True))


@query(_NATIONS)
def dataclass_round_trip(spark, sf):
    from dataclasses import make_dataclass

    from quillframe.sources import read_dataclasses, to_dataclasses

    kind = make_dataclass("Nation", [("n_nationkey", int), ("n_name", str), ("n_regionkey", int)])
    items, nulls = to_dataclasses(_local(spark, sf), kind)
    return out(read_dataclasses(spark, items, nulls, label_levels=1))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS \"0\", CAST(n_regionkey AS DOUBLE) AS \"1\" FROM nation")
def matrix_source(spark, sf):
    import numpy as np

    from quillframe.sources import read_matrix

    got = _local(spark, sf).to_spark().select("n_nationkey", "n_regionkey").collect()
    return out(read_matrix(spark, np.array(got, float)), labels=False)


# ---- operators that had no query of their own ----


@query("SELECT c_custkey AS key, c_name, upper(c_mktsegment) AS segment FROM customer")
def with_label(spark, sf):
    f = frame(spark, sf, "customer", "c_name", "c_mktsegment").with_label("c_custkey", "key")
    return out(f.with_label("segment", lambda c: F.upper(c["c_mktsegment"])).swap_labels("key", "segment").drop_col("c_mktsegment"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def subset_and_drop(spark, sf):
    f = frame(spark, sf, "customer", "c_name", "c_mktsegment", "c_nationkey").subset_cols([0, 2])
    return out(f.with_label("other", lambda c: c["c_nationkey"] + 1).reorder_labels(["other", "c_custkey"]).drop_labels("other").subset_labels([0]))


@query("SELECT c_custkey, c_name FROM customer")
def filter_cols(spark, sf):
    return out(frame(spark, sf, "customer", "c_name", "c_mktsegment", "c_nationkey").filter_cols(lambda n: n.endswith("_name")))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer QUALIFY c_mktsegment = 'BUILDING'")
def filter_index(spark, sf):
    at = frame(spark, sf, "customer", "c_mktsegment").filter_index("c_mktsegment", lambda c: c == "BUILDING")
    return spark.createDataFrame([(i,) for i in at], "place long")


@query("SELECT c_custkey, -c_acctbal AS c_acctbal FROM customer")
def with_values(spark, sf):
    s = frame(spark, sf, "customer", "c_acctbal")["c_acctbal"]
    return out(s.with_values(-F.col(s.value.id)))


@query("SELECT s_suppkey AS key, s_acctbal AS v, c_acctbal AS v_1 FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey")
def series_merge(spark, sf):
    a = frame(spark, sf, "supplier", "s_acctbal").set_label_names(["key"])["s_acctbal"].set_name("v")
    return out(a.merge(frame(spark, sf, "customer", "c_acctbal").set_label_names(["key"])["c_acctbal"].set_name("v")))


@query("SELECT s_suppkey AS key, c_acctbal FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey")
def series_lookup(spark, sf):
    a = frame(spark, sf, "supplier", "s_acctbal").set_label_names(["key"])["s_acctbal"]
    return out(a.lookup(frame(spark, sf, "customer", "c_acctbal").set_label_names(["key"])["c_acctbal"]))


@query("SELECT o_custkey AS key, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def lookup_right(spark, sf):
    return out(_customers(spark, sf).lookup(_orders(spark, sf), "right"))


@query(f"SELECT c_custkey AS key, o_totalprice FROM customer JOIN {_FIRST_ORDER} ON c_custkey = o_custkey")
def lookup_inner(spark, sf):
    return out(_customers(spark, sf).lookup(_orders(spark, sf), "inner"))


def _all_of(kind: str, sql: str) -> None:
    def f(spark, sf):
        got = frame(spark, sf, "customer", "c_acctbal", "c_nationkey").cast({"c_nationkey": casts.FLOAT})
        return out(getattr(got, {"stdDev": "std"}.get(kind, kind))().set_label_names(["name"]), *([] if kind in ("count", "nunique") else [kind]))

    f.__name__ = f"col_{kind.lower()}"
    value = lambda c: sql.format(c) if kind in ("count", "nunique") else f"round({sql.format(c)}, 3)"
    query(" UNION ALL ".join(f"SELECT '{c}' AS name, {value(c)} AS \"{kind}\" FROM customer" for c in ("c_acctbal", "c_nationkey")))(f)


for _k, _s in (("median", "median({})"), ("stdDev", "stddev_pop({})"), ("min", "min({})::DOUBLE"), ("max", "max({})::DOUBLE"), ("count", "count({})"), ("nunique", "count(DISTINCT {})")):
    _all_of(_k, _s)


@query("SELECT event_type AS key, row_number() OVER (ORDER BY min(event_id)) - 1 AS place, count(*) AS rows FROM events GROUP BY 1")
def group_iterator(spark, sf):
    g = frame(spark, sf, "events", "event_type", "value").group_by("event_type")
    names = g.list_groups()
    return spark.createDataFrame([(names[k], k, len(x)) for k, x in enumerate(g)], "key string, place long, rows long")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def row_iterator(spark, sf):
    rows = [(x["n_nationkey"], x["n_name"], k) for k, x in enumerate(frame(spark, sf, "nation", "n_name"))]
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, place long")


@query("SELECT c_nationkey, c_name FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) = 8")
def value_at(spark, sf):
    f = frame(spark, sf, "customer", "c_name", "c_nationkey")
    return spark.createDataFrame([(f.at(7, 1), f.at(7, 0))], "c_nationkey int, c_name string")


@query("SELECT true AS same, 1 AS differences")
def equal_records_of_a_frame(spark, sf):
    from quillframe.sources import equal_records, to_records

    f = _local(spark, sf)
    want = to_records(f)
    same, _ = equal_records(f, want)
    want[3][1] = "elsewhere"
    return spark.createDataFrame([(same, len(equal_records(f, want)[1]))], "same boolean, differences int")


@query("SELECT true AS frames, true AS groups, false AS other")
def equality(spark, sf):
    from quillframe.sources import equal_frames, equal_groups

    a, b, c = (frame(spark, sf, "customer", "c_nationkey", "c_acctbal") for _ in range(3))
    c = c.apply({"c_acctbal": lambda v: v + 1})
    key = "c_nationkey"
    return spark.createDataFrame([(equal_frames(a, b), equal_groups(a.group_by(key), b.group_by(key)), equal_groups(a.group_by(key), c.group_by(key)))], "frames boolean, groups boolean, other boolean")


@query("SELECT 1000 AS rows, true AS numbers, true AS dates, true AS words, true AS some_null")
def mock_csv(spark, sf):
    from quillframe.sources import read_csv, write_mock_csv

    to = _shared(spark)
    write_mock_csv(spark, "amount,day,word\n1.5,2020-01-01,x\n2,2020-02-01,y\n", to, 1000, null_share=0.2)
    df = read_csv(spark, to, infer_types=True, blank_as_null=True).to_spark(False)
    kinds = dict(df.dtypes)
    row = df.agg(F.count("*").cast("int").alias("rows"), F.count("amount").alias("a"), F.count("word").alias("w"))
    return row.select("rows", F.lit(kinds["amount"] == "double").alias("numbers"), F.lit(kinds["day"] == "date").alias("dates"), F.lit(kinds["word"] == "string").alias("words"), F.col("a").between(700, 900).alias("some_null"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20")
def in_place(spark, sf):
    m = frame(spark, sf, "customer", "c_name", "c_acctbal", "c_nationkey").in_place()
    m.filter({"c_acctbal": lambda c: c > 0}).filter({"c_nationkey": lambda c: c < 20}).drop_col("c_nationkey")
    return out(m.result)


@query("SELECT c_custkey, c_name AS x, c_mktsegment AS x_1 FROM customer")
def deduplicated_names(spark, sf):
    return out(frame(spark, sf, "customer", "c_name", "c_mktsegment").set_col_names(["x", "x"]).deduplicate_names())


@query("SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'none') THEN c_mktsegment END AS c_mktsegment FROM customer")
def null_strings(spark, sf):
    options = Options()
    options.add_null_string("BUILDING")
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    return out(Frame.from_spark(df, ["c_custkey"], ["c_custkey"], options=options))


@query("SELECT o_orderkey, o_orderdate FROM orders")
def cast_text_to_time(spark, sf):
    """Dates in four of the formats that are known by default."""
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    t, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "dd MMM yy HH:mm 'UTC'", "yyyy-MM-dd HH:mm:ss Z 'UTC'"]
    text = F.when(k == 0, F.date_format(t, forms[0])).when(k == 1, F.date_format(t, forms[1])).when(k == 2, F.date_format(t, forms[2])).otherwise(F.date_format(t, "MM-dd-yyyy"))
    return out(Frame.from_spark(df.select("o_orderkey", text.alias("o_orderdate")), ["o_orderkey"], ["o_orderkey"]).cast({"o_orderdate": casts.DATETIME}))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def reader_and_writer(spark, sf):
    from quillframe.sources import Reader, Writer, read_json, to_json

    return out(Frame.read(spark, Reader(read_json, _local(spark, sf).write(Writer(to_json)))))


@query("SELECT n_name AS label, CAST(n_regionkey AS BIGINT) AS v FROM nation")
def series_of_values(spark, sf):
    from quillframe.sources import read_series

    f = _local(spark, sf)
    return out(read_series(spark, f["n_regionkey"].get_values(), {"label": f["n_name"].get_values()}, "v"))


@query("SELECT 1 AS kept, 'KeyError' AS error, count(*) AS rows FROM customer WHERE c_acctbal > 0")
def first_error(spark, sf):
    """An operator that fails is kept as the error; what follows it is left out."""
    tried = frame(spark, sf, "customer", "c_acctbal").attempt().filter({"c_acctbal": lambda c: c > 0}).select("nothing").head(3)
    return spark.createDataFrame([(1, type(tried.err()).__name__, len(tried.result))], "kept int, error string, rows long")


@query("SELECT 26 AS rows, 3 AS columns")
def dimensions_of_csv(spark, sf):
    from quillframe.sources import csv_dimensions, to_records

    text = "\n".join(",".join(r) for r in to_records(_local(spark, sf)))
    return spark.createDataFrame([csv_dimensions(text)], "rows int, columns int")
