"""Price and return tables derived from the shared relational tables, so that every operator can be run on them.

Roles: A -> equity, R -> muni_bond, N -> taxable_bond. A price is sum(extended price) / sum(quantity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.session import table

ROLES = ["equity", "muni_bond", "taxable_bond"]


def role(flag: Column) -> Column:
    return F.when(flag == "A", "equity").when(flag == "R", "muni_bond").otherwise("taxable_bond")


def _priced(spark: SparkSession, sf_dir: str, **keys: Column) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    named = [c.alias(k) for k, c in keys.items()]
    price = (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")
    return rows.groupBy(*named, role(F.col("l_returnflag")).alias("role")).agg(price)


def px_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, session=F.to_date("l_shipdate"))


def px_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, month=F.date_format("l_shipdate", "yyyy-MM"))


def px_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, path_id=F.col("l_suppkey") % 4, month=F.date_format("l_shipdate", "yyyy-MM"))


def calendar_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date from the first to the last ship date: session, month, session_no (from 1)."""
    ends = table(spark, sf_dir, "lineitem").agg(F.min(F.to_date("l_shipdate")).alias("a"), F.max(F.to_date("l_shipdate")).alias("z"))
    days = ends.select(F.posexplode(F.sequence("a", "z")).alias("i", "session"))
    return days.select("session", F.date_format("session", "yyyy-MM").alias("month"), (F.col("i") + 1).cast("long").alias("session_no"))


def _returns(priced: DataFrame) -> DataFrame:
    w = Window.partitionBy("path_id", "role").orderBy("month")
    r = priced.withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(w))
    wide = r.groupBy("path_id", "month").pivot("role", ROLES).agg(F.first("r")).na.drop("any", subset=ROLES)
    number = F.row_number().over(Window.partitionBy("path_id").orderBy("month")).cast("long")
    return wide.select("path_id", number.alias("period_index"), "month", *ROLES)


def ret_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, period_index, month, equity, muni_bond, taxable_bond): monthly log returns, complete months only."""
    return _returns(px_path(spark, sf_dir))


def ret_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table's one monthly history, columns as ret_path's."""
    return _returns(px_month(spark, sf_dir).withColumn("path_id", F.lit(0).cast("long")))


def long_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ret_path as (path_id, period_index, role, r)."""
    return ret_path(spark, sf_dir).unpivot(["path_id", "period_index", "month"], ROLES, "role", "r")


def _states(returns: DataFrame) -> DataFrame:
    w = Window.partitionBy("path_id").orderBy("equity", "period_index")
    return returns.withColumn("state", (F.ntile(4).over(w) - 1).cast("long"))


def state_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ret_path with state 0..3: the quarter of the path that the month's equity return ranks in."""
    return _states(ret_path(spark, sf_dir))


def state_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ret_month with states as state_path's."""
    return _states(ret_month(spark, sf_dir))


_ROLE = "CASE l_returnflag WHEN 'A' THEN 'equity' WHEN 'R' THEN 'muni_bond' ELSE 'taxable_bond' END AS role"
_PRICE = "sum(l_extendedprice) / sum(l_quantity) AS price"
#: The same tables as common table expressions of the SQL twins.
SQL = {
    "px_daily": f"SELECT CAST(l_shipdate AS DATE) AS session, {_ROLE}, {_PRICE} FROM lineitem GROUP BY ALL",
    "px_month": f"SELECT strftime(l_shipdate, '%Y-%m') AS month, {_ROLE}, {_PRICE} FROM lineitem GROUP BY ALL",
    "px_path": f"SELECT l_suppkey % 4 AS path_id, strftime(l_shipdate, '%Y-%m') AS month, {_ROLE}, {_PRICE} FROM lineitem GROUP BY ALL",
    "calendar": "SELECT CAST(d AS DATE) AS session, strftime(d, '%Y-%m') AS month, row_number() OVER (ORDER BY d) AS session_no "
    "FROM (SELECT unnest(generate_series(CAST(min(CAST(l_shipdate AS DATE)) AS TIMESTAMP), CAST(max(CAST(l_shipdate AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM lineitem)",
    "r0": "SELECT path_id, month, role, ln(price) - lag(ln(price)) OVER (PARTITION BY path_id, role ORDER BY month) AS r FROM px_path",
    "w0": "SELECT path_id, month, max(r) FILTER (role = 'equity') AS equity, max(r) FILTER (role = 'muni_bond') AS muni_bond, max(r) FILTER (role = 'taxable_bond') AS taxable_bond FROM r0 GROUP BY ALL",
    "ret_path": "SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY month) AS period_index, month, equity, muni_bond, taxable_bond FROM w0 WHERE equity IS NOT NULL AND muni_bond IS NOT NULL AND taxable_bond IS NOT NULL",
    "long_path": "SELECT path_id, period_index, month, role, r FROM (UNPIVOT ret_path ON equity, muni_bond, taxable_bond INTO NAME role VALUE r)",
    "state_path": "SELECT *, ntile(4) OVER (PARTITION BY path_id ORDER BY equity, period_index) - 1 AS state FROM ret_path",
}
_NEEDS = {"r0": ["px_path"], "w0": ["r0"], "ret_path": ["w0"], "long_path": ["ret_path"], "state_path": ["ret_path"]}


def with_views(*names: str, **more: str) -> str:
    """WITH and the named tables, those that they need first, then more."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
