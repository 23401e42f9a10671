"""Queries of the data layer: alignment, coverage, months, sets, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.operators import alignment as al
from pathloom.sources import standin as st
from pathloom.sources.standin import ROLES, with_views

Q, O = {}, {}
R = lambda c, n=6: F.round(c, n)


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _aligned(s, d):
    return al.align(st.calendar_daily(s, d), st.px_daily(s, d))


ALIGNED = {
    "grid": "SELECT session, month, session_no, unnest(['equity', 'muni_bond', 'taxable_bond']) AS role FROM calendar",
    "aligned": "SELECT g.*, price, price IS NOT NULL AND price > 0 AS observed FROM grid g LEFT JOIN px_daily USING (session, role)",
    "returns": "SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY role ORDER BY session) AS r FROM aligned",
    "per": "SELECT month, session, bool_and(r IS NOT NULL) AS valid FROM returns GROUP BY ALL",
    "coverage": "SELECT month, count(*) AS expected_sessions, count(*) FILTER (valid) AS valid_sessions, count(*) = count(*) FILTER (valid) AS complete FROM per GROUP BY ALL",
    "sync": "SELECT session, month, max(r) FILTER (role = 'equity') AS equity, max(r) FILTER (role = 'muni_bond') AS muni_bond, max(r) FILTER (role = 'taxable_bond') AS taxable_bond FROM returns GROUP BY ALL HAVING count(r) = 3",
}
BASE = with_views("px_daily", "calendar", **ALIGNED)


@q("w1_monthly_log_returns", with_views("px_month") + "SELECT month, role, round(r, 6) AS log_return FROM (SELECT month, role, ln(price) - lag(ln(price)) OVER (PARTITION BY role ORDER BY month) AS r FROM px_month) WHERE r IS NOT NULL")
def _(s, d):
    w = Window.partitionBy("role").orderBy("month")
    r = st.px_month(s, d).withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(w))
    return r.where("r IS NOT NULL").select("month", "role", R("r").alias("log_return"))


@q("p2_session_gaps", BASE + """, rng AS (SELECT role, min(session) FILTER (observed) AS a, max(session) FILTER (observed) AS z FROM aligned GROUP BY 1)
SELECT role, count(*) FILTER (session BETWEEN a AND z) AS in_range, count(*) FILTER (observed) AS observed, count(*) FILTER (session BETWEEN a AND z AND NOT observed) AS gaps FROM aligned JOIN rng USING (role) GROUP BY 1""")
def _(s, d):
    return _aligned(s, d).groupBy("role").agg(F.count_if("in_range").alias("in_range"), F.count_if("observed").alias("observed"), F.count_if("gap").alias("gaps"))


@q("w1_session_returns", BASE + "SELECT session, role, round(r, 6) AS log_return FROM returns WHERE r IS NOT NULL")
def _(s, d):
    return al.session_returns(_aligned(s, d)).where("r IS NOT NULL").select("session", "role", R("r").alias("log_return"))


@q("j2_synchronized_sessions", BASE + "SELECT session, round(equity, 6) AS equity, round(muni_bond, 6) AS muni_bond, round(taxable_bond, 6) AS taxable_bond FROM sync")
def _(s, d):
    return al.synchronized(al.session_returns(_aligned(s, d))).select("session", *[R(r).alias(r) for r in ROLES])


@q("a2_month_coverage", BASE + "SELECT * FROM coverage")
def _(s, d):
    return al.month_coverage(al.session_returns(_aligned(s, d)))


@q("a1_complete_month_returns", BASE + "SELECT month, round(sum(equity), 6) AS equity, round(sum(muni_bond), 6) AS muni_bond, round(sum(taxable_bond), 6) AS taxable_bond FROM sync WHERE month IN (SELECT month FROM coverage WHERE complete) GROUP BY 1")
def _(s, d):
    return al.complete_month_returns(al.session_returns(_aligned(s, d))).select("month", *[R(r).alias(r) for r in ROLES])


@q("j12_direct_month_crosscheck", BASE + """, pr AS (SELECT month, role, session, price, lag(price) OVER (PARTITION BY role ORDER BY session) AS prior FROM aligned),
e AS (SELECT month, role, ln(arg_max(price, session)) - ln(arg_min(prior, session)) AS direct FROM pr WHERE month IN (SELECT month FROM coverage WHERE complete) GROUP BY ALL),
m AS (SELECT month, role, sum(r) AS summed FROM returns GROUP BY ALL)
SELECT month, role, round(direct, 6) AS direct, abs(direct - summed) < 1e-9 AS agrees FROM e JOIN m USING (month, role)""")
def _(s, d):
    a = _aligned(s, d)
    r = al.session_returns(a)
    direct = al.direct_month_returns(a, al.month_coverage(r).where("complete").select("month"))
    summed = r.groupBy("month", "role").agg(F.sum("r").alias("summed"))
    return direct.join(summed, ["month", "role"]).select("month", "role", R("direct").alias("direct"), (F.abs(F.col("direct") - F.col("summed")) < 1e-9).alias("agrees"))


@q("p6_outlier_flags", BASE + "SELECT session, role, round(exp(r) - 1, 6) AS simple_return FROM returns WHERE abs(exp(r) - 1) > CASE role WHEN 'equity' THEN 0.2 ELSE 0.1 END")
def _(s, d):
    return al.outlier_flags(al.session_returns(_aligned(s, d))).select("session", "role", R("simple_return").alias("simple_return"))


@q("t1_outlier_top10", BASE + "SELECT session, role, round(exp(r) - 1, 6) AS simple_return FROM returns WHERE r IS NOT NULL ORDER BY abs(round(exp(r) - 1, 6)) DESC, session, role LIMIT 10")
def _(s, d):
    r = al.session_returns(_aligned(s, d)).where("r IS NOT NULL").select("session", "role", R(F.expm1("r")).alias("simple_return"))
    return r.orderBy(F.abs("simple_return").desc(), "session", "role").limit(10)


@q("w5_continuation_segments", BASE + """, m AS (SELECT month, (CAST(month[1:4] AS BIGINT) - 1970) * 12 + CAST(month[6:7] AS BIGINT) - 1 AS ordinal FROM coverage WHERE complete),
c AS (SELECT *, coalesce(ordinal - lag(ordinal) OVER (ORDER BY month) = 1, false) AS continues FROM m)
SELECT month, ordinal, continues, CAST(sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (ORDER BY month) AS BIGINT) AS segment_id FROM c""")
def _(s, d):
    return al.continuation(al.month_coverage(al.session_returns(_aligned(s, d))).where("complete").select("month"))


@q("w7_month_offsets", BASE + "SELECT month, expected_sessions AS sessions, CAST(sum(expected_sessions) OVER (ORDER BY month) - expected_sessions AS BIGINT) AS start_offset FROM coverage WHERE complete")
def _(s, d):
    return al.month_offsets(al.session_returns(_aligned(s, d)))


@q("m27_segment_lengths", BASE + """, m AS (SELECT month, (CAST(month[1:4] AS BIGINT) - 1970) * 12 + CAST(month[6:7] AS BIGINT) - 1 AS ordinal FROM coverage WHERE complete),
c AS (SELECT *, ordinal - row_number() OVER (ORDER BY month) AS g FROM m)
SELECT min(month) AS first_month, max(month) AS last_month, count(*) AS months FROM c GROUP BY g""")
def _(s, d):
    c = al.continuation(al.month_coverage(al.session_returns(_aligned(s, d))).where("complete").select("month"))
    return c.groupBy("segment_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("months")).drop("segment_id")


MACRO = {
    "macro": "SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS x FROM orders GROUP BY 1",
    "spread": "SELECT strftime(ts, '%Y-%m') AS month, avg(value) AS y FROM events GROUP BY 1",
}


def _macro(s, d):
    return st.table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("x"))


def _spread(s, d):
    return st.table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.avg("value").alias("y"))


@q("w3_macro_growth", with_views(**MACRO) + "SELECT month, round(100 * ln(x / lag(x, 1) OVER (ORDER BY month)), 6) AS growth_1, round(100 * ln(x / lag(x, 12) OVER (ORDER BY month)), 6) AS growth_12 FROM macro")
def _(s, d):
    w = Window.orderBy("month")
    g = lambda k: R(100 * F.ln(F.col("x") / F.lag("x", k).over(w)))
    return _macro(s, d).select("month", g(1).alias("growth_1"), g(12).alias("growth_12"))


@q("j3_macro_full_outer", with_views(**MACRO) + "SELECT month, round(x, 2) AS x, round(y, 6) AS y FROM macro FULL JOIN spread USING (month)")
def _(s, d):
    return _macro(s, d).join(_spread(s, d), "month", "full").select("month", R("x", 2).alias("x"), R("y").alias("y"))


def _months(s, d):
    return al.month_coverage(al.session_returns(_aligned(s, d)))


@q("j7_month_eligibility_full_outer", with_views("px_daily", "calendar", **ALIGNED, **MACRO) + "SELECT month, coalesce(complete, false) AS asset_ok, x IS NOT NULL AS macro_ok, coalesce(complete, false) AND x IS NOT NULL AS eligible FROM coverage FULL JOIN macro USING (month)")
def _(s, d):
    j = _months(s, d).join(_macro(s, d), "month", "full")
    a, m = F.coalesce("complete", F.lit(False)), F.col("x").isNotNull()
    return j.select("month", a.alias("asset_ok"), m.alias("macro_ok"), (a & m).alias("eligible"))


@q("u1_common_months", with_views("px_daily", "calendar", **ALIGNED, **MACRO) + "SELECT month FROM coverage WHERE complete INTERSECT SELECT month FROM macro")
def _(s, d):
    return _months(s, d).where("complete").select("month").intersect(_macro(s, d).select("month"))


@q("u2_excluded_months_anti", with_views("px_daily", "calendar", **ALIGNED, **MACRO) + """SELECT 'asset_only' AS side, month FROM coverage WHERE complete AND month NOT IN (SELECT month FROM macro)
UNION ALL SELECT 'macro_only', month FROM macro WHERE month NOT IN (SELECT month FROM coverage WHERE complete)""")
def _(s, d):
    a, m = _months(s, d).where("complete").select("month"), _macro(s, d).select("month")
    left = a.join(m, "month", "left_anti").select(F.lit("asset_only").alias("side"), "month")
    return left.unionByName(m.join(a, "month", "left_anti").select(F.lit("macro_only").alias("side"), "month"))


@q("u3_month_universe", with_views("px_daily", "calendar", **ALIGNED, **MACRO) + "SELECT month FROM coverage UNION SELECT month FROM macro")
def _(s, d):
    return _months(s, d).select("month").union(_macro(s, d).select("month")).distinct()


@q("u4_role_set_equality", with_views("px_month") + "SELECT count(*) AS missing FROM (SELECT unnest(['equity', 'muni_bond', 'taxable_bond']) AS role EXCEPT SELECT role FROM px_month)")
def _(s, d):
    want = s.range(1).select(F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    return want.exceptAll(st.px_month(s, d).select("role").distinct()).agg(F.count("*").alias("missing"))


@q("a3_weekday_mean", """WITH days AS (SELECT CAST(unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP), CAST(max(CAST(ts AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM events),
wd AS (SELECT day, strftime(day, '%Y-%m') AS month FROM days WHERE isodow(day) <= 5), v AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1),
m AS (SELECT month, count(*) AS expected, count(v) AS seen, avg(v) AS a FROM wd LEFT JOIN v USING (day) GROUP BY 1)
SELECT month, expected, seen, CASE WHEN seen >= 0.8 * expected THEN round(a, 6) END AS mean_value FROM m""")
def _(s, d):
    e = st.table(s, d, "events").select(F.to_date("ts").alias("day"), "value")
    ends = e.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))
    wd = ends.where(F.dayofweek("day").between(2, 6)).withColumn("month", F.date_format("day", "yyyy-MM"))
    m = wd.join(e.groupBy("day").agg(F.avg("value").alias("v")), "day", "left").groupBy("month").agg(F.count("*").alias("expected"), F.count("v").alias("seen"), F.avg("v").alias("a"))
    return m.select("month", "expected", "seen", F.when(F.col("seen") >= 0.8 * F.col("expected"), R("a")).alias("mean_value"))


@q("m16_standardize", with_views("ret_path") + "SELECT path_id, period_index, round((equity - avg(equity) OVER w) / stddev_pop(equity) OVER w, 6) AS z FROM ret_path WINDOW w AS (PARTITION BY path_id)")
def _(s, d):
    w = Window.partitionBy("path_id")
    return st.ret_path(s, d).select("path_id", "period_index", R((F.col("equity") - F.avg("equity").over(w)) / F.stddev_pop("equity").over(w)).alias("z"))


@q("s9_holdout_split", with_views("ret_path") + "SELECT CASE WHEN period_index > n - 24 THEN 'holdout' ELSE 'design' END AS part, count(*) AS months, min(month) AS first_month, max(month) AS last_month FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM ret_path) GROUP BY 1")
def _(s, d):
    n = F.count("*").over(Window.partitionBy("path_id"))
    part = F.when(F.col("period_index") > n - 24, "holdout").otherwise("design")
    return st.ret_path(s, d).withColumn("part", part).groupBy("part").agg(F.count("*").alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@q("f4_month_ordinals", with_views("px_month") + "SELECT DISTINCT month, (CAST(month[1:4] AS BIGINT) - 1970) * 12 + CAST(month[6:7] AS BIGINT) - 1 AS ordinal FROM px_month")
def _(s, d):
    from pathloom.functions.scalar import month_ordinal, ordinal_month

    m = st.px_month(s, d).select("month").distinct().withColumn("ordinal", month_ordinal(F.col("month")))
    return m.select(ordinal_month(F.col("ordinal")).alias("month"), "ordinal")


@q("f14_week_boundaries", "SELECT w AS week, CAST(floor(252 * w / 52) AS BIGINT) AS boundary FROM (SELECT unnest(range(53)) AS w)")
def _(s, d):
    return s.range(53).select(F.col("id").alias("week"), F.expr("252 * id div 52").alias("boundary"))


@q("f10_categorical_draws", "SELECT event_id, CASE WHEN u < 0.1 THEN 0 WHEN u < 0.4 THEN 1 WHEN u < 0.8 THEN 2 ELSE 3 END AS pick, CAST(least(floor(u * 7), 6) AS BIGINT) AS rank FROM (SELECT event_id, (event_id * 7919 % 1000) / 1000.0 AS u FROM events)")
def _(s, d):
    from pathloom.functions.scalar import categorical, uniform_rank

    u = st.table(s, d, "events").select("event_id", (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("u"))
    return u.select("event_id", categorical(F.col("u"), [0.1, 0.3, 0.4, 0.2]).alias("pick"), uniform_rank(F.col("u"), F.lit(7)).alias("rank"))


@q("f12_packed_ids", "SELECT o_orderkey, ((o_orderkey % 16) << 28) | ((o_orderkey % 65536) << 12) | ((o_orderkey % 16) << 8) | (o_orderkey % 256) AS entity FROM orders")
def _(s, d):
    from pathloom.functions.scalar import pack_bits

    k = F.col("o_orderkey")
    return st.table(s, d, "orders").select(k, pack_bits([(k % 16, 4), (k % 65536, 16), (k % 16, 4), (k % 256, 8)]).alias("entity"))


@q("p16_path_ids", "SELECT c_custkey, 'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS path_id FROM customer")
def _(s, d):
    return st.table(s, d, "customer").select("c_custkey", F.format_string("P%06d", "c_custkey").alias("path_id"))
