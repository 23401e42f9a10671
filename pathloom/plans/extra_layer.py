"""Further queries: coverage of joins, pools, gates, weights and defects."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.operators import alignment as al
from pathloom.operators import metrics as me
from pathloom.operators import states as sp
from pathloom.plans.data_layer import BASE, R, _aligned
from pathloom.plans.path_layer import EPI, LONG, STATE, WIDE, rounded
from pathloom.session import cut
from pathloom.sources import standin as st
from pathloom.sources.standin import ROLES, with_views

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


@q("p7_unexplained_factor_moves", BASE + ", f AS (SELECT session, role, price / lag(price) OVER (PARTITION BY role ORDER BY session) - 1 AS move FROM aligned) SELECT role, count(*) FILTER (abs(move) > 0.05) AS flagged, count(move) AS moves FROM f GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("role").orderBy("session")
    f = _aligned(s, d).withColumn("move", F.col("price") / F.lag("price").over(w) - 1)
    return f.groupBy("role").agg(F.count_if(F.abs("move") > al.FACTOR_MOVE).alias("flagged"), F.count("move").alias("moves"))


@q("p12_action_mask", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 0.0 END, 0) <> 0 OR coalesce(o_totalprice, 0) <> 0 AS acted FROM orders")
def _(s, d):
    a = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.lit(0.0)), F.lit(0.0)) != 0
    return st.table(s, d, "orders").select("o_orderkey", (a | (F.coalesce("o_totalprice", F.lit(0.0)) != 0)).alias("acted"))


@q("p14_eligibility_table", BASE + "SELECT month, complete AS eligible, expected_sessions - valid_sessions AS excluded_sessions, CASE WHEN complete THEN '' ELSE 'missing ' || CAST(expected_sessions - valid_sessions AS VARCHAR) || ' sessions' END AS reason FROM coverage")
def _(s, d):
    gone = F.col("expected_sessions") - F.col("valid_sessions")
    c = al.month_coverage(al.session_returns(_aligned(s, d)))
    return c.select("month", F.col("complete").alias("eligible"), gone.alias("excluded_sessions"), F.when(F.col("complete"), "").otherwise(F.concat(F.lit("missing "), gone.cast("string"), F.lit(" sessions"))).alias("reason"))


@q("p8_outlier_resolution", BASE + ", o AS (SELECT session, role, exp(r) - 1 AS x FROM returns WHERE abs(exp(r) - 1) > 0.3), n AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders WHERE o_totalprice > 300000) SELECT session, role, CASE WHEN n.session IS NOT NULL THEN 'explained' WHEN x > 0 THEN 'action' ELSE 'unresolved' END AS resolution FROM o LEFT JOIN n USING (session)")
def _(s, d):
    o = al.session_returns(_aligned(s, d)).select("session", "role", F.expm1("r").alias("x")).where(F.abs("x") > 0.3)
    n = st.table(s, d, "orders").where("o_totalprice > 300000").select(F.to_date("o_orderdate").alias("session"), F.lit(True).alias("known")).distinct()
    return o.join(n, "session", "left").select("session", "role", F.when(F.col("known"), "explained").when(F.col("x") > 0, "action").otherwise("unresolved").alias("resolution"))


@q("w6_daily_continuation", BASE + ", m AS (SELECT session, session_no FROM calendar WHERE session IN (SELECT session FROM sync)) SELECT session, coalesce(session_no - lag(session_no) OVER (ORDER BY session) = 1, false) AS continues FROM m")
def _(s, d):
    m = al.synchronized(al.session_returns(_aligned(s, d)))
    return m.select("session", F.coalesce(F.col("session_no") - F.lag("session_no").over(Window.orderBy("session")) == 1, F.lit(False)).alias("continues"))


@q("p19_forward_links", WIDE + ", m AS (SELECT path_id, period_index, CAST(left(month, 4) AS INT) * 12 + CAST(right(month, 2) AS INT) AS t FROM ret_path), c AS (SELECT path_id, period_index, coalesce(t - lag(t) OVER o = 1, false) AS continues FROM m WINDOW o AS (PARTITION BY path_id ORDER BY period_index)) SELECT path_id, period_index, lead(continues) OVER (PARTITION BY path_id ORDER BY period_index) AS linked FROM c QUALIFY linked IS NOT NULL")
def _(s, d):
    o = Window.partitionBy("path_id").orderBy("period_index")
    t = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    mask = st.ret_path(s, d).withColumn("t", t).withColumn("continues", F.coalesce(F.col("t") - F.lag("t").over(o) == 1, F.lit(False)))
    return mask.select("path_id", "period_index", F.lead("continues").over(o).alias("linked")).where("linked IS NOT NULL")


@q("w17_prefix_sums", LONG + "SELECT path_id, role, period_index, round(sum(r) OVER (PARTITION BY path_id, role ORDER BY period_index), 6) AS total FROM long_path")
def _(s, d):
    o = Window.partitionBy("path_id", "role").orderBy("period_index").rowsBetween(Window.unboundedPreceding, 0)
    return st.long_path(s, d).select("path_id", "role", "period_index", R(F.sum("r").over(o)).alias("total"))


@q("w20_quarter_hold", WIDE + "SELECT path_id, period_index, round(first_value(equity) OVER (PARTITION BY path_id, (period_index - 1) // 3 ORDER BY period_index), 6) AS held FROM ret_path")
def _(s, d):
    w = Window.partitionBy("path_id", F.floor((F.col("period_index") - 1) / 3)).orderBy("period_index")
    return st.ret_path(s, d).select("path_id", "period_index", R(F.first("equity").over(w)).alias("held"))


@q("w23_period_numbering", WIDE + "SELECT path_id, period_index, (period_index - 1) // 12 + 1 AS simulation_year, (period_index - 1) % 12 + 1 AS period_in_year FROM ret_path")
def _(s, d):
    i = F.col("period_index") - 1
    return st.ret_path(s, d).select("path_id", "period_index", (F.floor(i / 12) + 1).alias("simulation_year"), (i % 12 + 1).alias("period_in_year"))


@q("w26_evaluation_window", WIDE + "SELECT path_id, count(*) AS n, round(sum(equity), 6) AS total FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS m FROM ret_path) WHERE period_index > CAST(floor(0.37 * (m - 24 + 1)) AS BIGINT) AND period_index <= CAST(floor(0.37 * (m - 24 + 1)) AS BIGINT) + 24 GROUP BY 1")
def _(s, d):
    m = F.count("*").over(Window.partitionBy("path_id"))
    x = st.ret_path(s, d).withColumn("from", F.floor(F.lit(0.37) * (m - 24 + 1)))
    return x.where((F.col("period_index") > F.col("from")) & (F.col("period_index") <= F.col("from") + 24)).groupBy("path_id").agg(F.count("*").alias("n"), R(F.sum("equity")).alias("total"))


@q("w15_squared_run_acf", STATE + ", c AS (SELECT path_id, period_index, state, equity - avg(equity) OVER (PARTITION BY path_id) AS c FROM state_path) SELECT a.path_id, count(*) AS pairs, round(sum(a.c * a.c * b.c * b.c) / sqrt(sum(a.c ** 4) * sum(b.c ** 4)), 6) AS acf FROM c a JOIN c b ON a.path_id = b.path_id AND b.period_index = a.period_index - 1 AND a.state = b.state GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("path_id")
    o = w.orderBy("period_index")
    c = st.state_path(s, d).withColumn("c", (F.col("equity") - F.avg("equity").over(w)) ** 2)
    c = c.withColumn("b", F.lag("c").over(o)).withColumn("t", F.lag("state").over(o)).where("t = state")
    return c.groupBy("path_id").agg(F.count("*").alias("pairs"), R(F.sum(F.col("c") * F.col("b")) / F.sqrt(F.sum(F.col("c") ** 2) * F.sum(F.col("b") ** 2))).alias("acf"))


@q("w16_autocovariances", LONG + ", c AS (SELECT path_id, role, period_index, (r - avg(r) OVER w) / stddev_pop(r) OVER w AS z, count(*) OVER w AS n FROM long_path WINDOW w AS (PARTITION BY path_id, role)) SELECT a.path_id, a.role, k AS lag, round(sum(a.z * b.z) / any_value(a.n), 6) AS gamma FROM c a, range(0, 7) t(k), c b WHERE a.path_id = b.path_id AND a.role = b.role AND b.period_index = a.period_index - k GROUP BY ALL")
def _(s, d):
    w = Window.partitionBy("path_id", "role")
    o = w.orderBy("period_index")
    c = st.long_path(s, d).withColumn("z", (F.col("r") - F.avg("r").over(w)) / F.stddev_pop("r").over(w)).withColumn("n", F.count("*").over(w))
    for k in range(7):
        c = c.withColumn(f"b{k}", F.lag("z", k).over(o))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"b{k}").alias("b")) for k in range(7)]))
    x = c.select("path_id", "role", "z", "n", each.alias("e"))
    return x.groupBy("path_id", "role", "e.lag").agg(R(F.sum(F.col("z") * F.col("e.b")) / F.max("n")).alias("gamma"))


@q("a6_lf_rollup_counts", WIDE + "SELECT path_id, count(*) AS monthly, count(*) // 3 AS quarterly, count(*) // 12 AS annual FROM ret_path GROUP BY 1")
def _(s, d):
    n = F.count("*")
    return st.ret_path(s, d).groupBy("path_id").agg(n.alias("monthly"), F.floor(n / 3).alias("quarterly"), F.floor(n / 12).alias("annual"))


@q("a13_censored_episodes", EPI + "SELECT state, count(*) AS episodes, count(*) FILTER (first = 1) AS left_censored, count(*) FILTER (last = m) AS right_censored FROM (SELECT *, max(last) OVER (PARTITION BY path_id) AS m FROM epi) GROUP BY 1")
def _(s, d):
    e = sp.episodes(st.state_path(s, d)).withColumn("m", F.max("last").over(Window.partitionBy("path_id")))
    return e.groupBy("state").agg(F.count("*").alias("episodes"), F.count_if(F.col("first") == 1).alias("left_censored"), F.count_if(F.col("last") == F.col("m")).alias("right_censored"))


@q("a24_source_runs", "WITH d AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS k FROM lineitem), i AS (SELECT g, k - row_number() OVER (PARTITION BY g ORDER BY k) AS run FROM d), r AS (SELECT g, run, count(*) AS n FROM i GROUP BY 1, 2) SELECT g, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1")
def _(s, d):
    x = st.table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("k")).distinct()
    i = x.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("g").orderBy("k")))
    return i.groupBy("g", "run").agg(F.count("*").alias("n")).groupBy("g").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@q("a28_quality_counts", BASE + "SELECT count(*) AS expected, count(*) FILTER (observed) AS observed, count(r) AS returns, count(*) FILTER (abs(exp(r) - 1) > 0.2) AS large FROM returns")
def _(s, d):
    return al.session_returns(_aligned(s, d)).agg(F.count("*").alias("expected"), F.count_if("observed").alias("observed"), F.count("r").alias("returns"), F.count_if(F.abs(F.expm1("r")) > 0.2).alias("large"))


@q("j13_full_outer_replay", WIDE + "SELECT count(*) AS rows, count(*) FILTER (a.equity IS DISTINCT FROM b.equity) AS differences FROM ret_path a FULL JOIN (SELECT * FROM ret_path WHERE path_id < 3) b USING (path_id, period_index)")
def _(s, d):
    r = cut(st.ret_path(s, d).select("path_id", "period_index", "equity"))  # once: sums of doubles differ by the order that their parts come in
    a = r.withColumnRenamed("equity", "x")
    b = r.where("path_id < 3").withColumnRenamed("equity", "y")
    return a.join(b, ["path_id", "period_index"], "full").agg(F.count("*").alias("rows"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differences"))


@q("d11_state_gap", STATE + ", o AS (SELECT path_id, state, n * 1.0 / sum(n) OVER (PARTITION BY path_id) AS share FROM (SELECT path_id, state, count(*) AS n FROM state_path GROUP BY 1, 2)) SELECT round(max(abs(a.share - b.share)), 6) AS gap FROM o a JOIN o b ON a.state = b.state AND a.path_id = 0 AND b.path_id = 1")
def _(s, d):
    o = sp.occupancy(st.state_path(s, d))
    a, b = (o.where(F.col("path_id") == i).select("state", F.col("share").alias(c)) for i, c in ((0, "a"), (1, "b")))
    return a.join(b, "state").agg(R(F.max(F.abs(F.col("a") - F.col("b")))).alias("gap"))


_cross = " UNION ALL ".join(f"SELECT path_id, '{a}' AS early, '{b}' AS late, corr({a}, n_{b}) AS c FROM y GROUP BY 1" for a in ROLES for b in ROLES)


@q("d10_cross_lag_gap", WIDE + ", y AS (SELECT *, " + ", ".join(f"lead({r}) OVER (PARTITION BY path_id ORDER BY period_index) AS n_{r}" for r in ROLES) + f" FROM ret_path QUALIFY n_equity IS NOT NULL), c AS ({_cross}) SELECT a.path_id, round(max(abs(a.c - b.c)), 6) AS gap FROM c a JOIN c b ON b.path_id = 0 AND a.path_id <> 0 AND a.early = b.early AND a.late = b.late GROUP BY 1")
def _(s, d):
    blocks = me.cross_lag_block(st.ret_path(s, d), ROLES)
    return me.cross_lag_gap(blocks.where("path_id <> 0"), blocks.where("path_id = 0")).select("path_id", R("gap").alias("gap"))


@q("m6_state_names", STATE + ", m AS (SELECT state, avg(equity) AS a FROM state_path GROUP BY 1) SELECT state, CASE WHEN a < -0.02 THEN 'falling' WHEN a < 0.02 THEN 'flat' ELSE 'rising' END AS name FROM m")
def _(s, d):
    m = sp.conditional_means(st.state_path(s, d), ["equity"])
    return m.select("state", F.when(F.col("equity") < -0.02, "falling").when(F.col("equity") < 0.02, "flat").otherwise("rising").alias("name"))


@q("g31_offset_grid", STATE + ", m AS (SELECT state, avg(equity) AS a FROM state_path GROUP BY 1), t AS (SELECT avg(equity) AS t FROM state_path) SELECT state, CAST(k AS DOUBLE) AS policy, round(k * (a - t), 6) AS offset_value FROM m, t, (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS k)")
def _(s, d):
    x = st.state_path(s, d)
    m = sp.conditional_means(x, ["equity"]).withColumn("policy", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 1.0)])))
    t = F.broadcast(x.agg(F.avg("equity").alias("t")))  # one row
    return m.join(t).select("state", "policy", R(F.col("policy") * (F.col("equity") - F.col("t"))).alias("offset_value"))


@q("g32_smallest_qualified", "SELECT o_orderpriority AS policy, min(o_orderkey) AS smallest FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def _(s, d):
    return st.table(s, d, "orders").where("o_totalprice > 200000").groupBy(F.col("o_orderpriority").alias("policy")).agg(F.min("o_orderkey").alias("smallest"))


@q("g13_states_to_daily", STATE + "SELECT path_id, state, count(*) * 21 AS sessions FROM state_path GROUP BY 1, 2")
def _(s, d):
    x = st.state_path(s, d).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(21))))
    return x.groupBy("path_id", "state").agg(F.count("*").alias("sessions"))


@q("u5_allowlist_differences", "SELECT count(*) FILTER (c_custkey IS NULL) AS unknown, count(*) FILTER (o_custkey IS NULL) AS unused FROM (SELECT DISTINCT o_custkey FROM orders) FULL JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    o = st.table(s, d, "orders").select("o_custkey").distinct()
    j = o.join(st.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "full")
    return j.agg(F.count_if(F.col("c_custkey").isNull()).alias("unknown"), F.count_if(F.col("o_custkey").isNull()).alias("unused"))


@q("v5_state_gate", STATE + ", o AS (SELECT state, count(*) * 1.0 / (SELECT count(*) FROM state_path) AS p, count(*) AS n FROM state_path GROUP BY 1) SELECT state, round(p, 6) AS share, abs(p - 0.25) <= greatest(5 * sqrt(p * (1 - p) / n), 0.01) AS passed FROM o")
def _(s, d):
    x = st.state_path(s, d).groupBy("state").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return x.select("state", R("p").alias("share"), (F.abs(F.col("p") - 0.25) <= F.greatest(5 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), F.lit(0.01))).alias("passed"))


@q("v8_frequency_totals", with_views("px_month", "px_path") + "SELECT 'month' AS source, count(*) AS n FROM px_month UNION ALL SELECT 'path', count(*) FROM px_path")
def _(s, d):
    a = st.px_month(s, d).agg(F.lit("month").alias("source"), F.count("*").alias("n"))
    return a.unionByName(st.px_path(s, d).agg(F.lit("path").alias("source"), F.count("*").alias("n")))


@q("i25_pair_cap_ratios", WIDE + ", m AS (SELECT path_id, avg(equity) * 12 AS m, stddev_samp(equity) * sqrt(12) AS v FROM ret_path GROUP BY 1) SELECT round(greatest(abs(a.m - b.m) / b.v / 0.05, abs(a.m - b.m) / 0.01, abs(a.v - b.v) / b.v / 0.05), 4) AS location_scale FROM m a, m b WHERE a.path_id = 0 AND b.path_id = 1")
def _(s, d):
    m = me.base_metrics(st.long_path(s, d).where("role = 'equity' AND path_id < 2"))
    one = m.agg(*[F.max(F.when(F.col("path_id") == i, F.col(c))).alias(f"{n}{i}") for i in (0, 1) for n, c in (("m", "annual_mean"), ("v", "annual_volatility"))])
    gap = F.abs(F.col("m0") - F.col("m1"))
    return one.select(F.round(F.greatest(gap / F.col("v1") / 0.05, gap / 0.01, F.abs(F.col("v0") - F.col("v1")) / F.col("v1") / 0.05), 4).alias("location_scale"))


@q("b11_fragmentation_gates", EPI + ", b AS (SELECT state, avg(length) AS mean_length, avg(CAST(length = 1 AS DOUBLE)) AS singles FROM epi GROUP BY 1) SELECT state, mean_length >= 1.5 AS mean_ok, singles <= 0.75 AS singles_ok FROM b")
def _(s, d):
    b = sp.dwell(st.state_path(s, d))
    return b.select("state", (F.col("mean_dwell") >= 1.5).alias("mean_ok"), (F.col("one_period_share") <= 0.75).alias("singles_ok"))


@q("b9_supported_length", EPI + ", c AS (SELECT l, state, sum(greatest(length - l + 1, 0)) AS starts FROM epi, range(1, 7) t(l) GROUP BY 1, 2) SELECT max(l) AS length FROM (SELECT l FROM c GROUP BY 1 HAVING min(starts) >= 8)")
def _(s, d):
    e = sp.episodes(st.state_path(s, d)).withColumn("l", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))))
    c = e.groupBy("l", "state").agg(F.sum(F.greatest(F.col("length") - F.col("l") + 1, F.lit(0))).alias("starts"))
    return c.groupBy("l").agg(F.min("starts").alias("least")).where("least >= 8").agg(F.max("l").alias("length"))


@q("m18_bic", STATE + ", m AS (SELECT state, avg(equity) AS m, var_pop(equity) AS v FROM state_path GROUP BY 1), l AS (SELECT sum(-0.5 * ((equity - m) ** 2 / v + ln(2 * pi() * v))) AS ll, count(*) AS n FROM state_path JOIN m USING (state)) SELECT round(-2 * ll + 19 * ln(n), 4) AS bic FROM l")
def _(s, d):
    x = st.state_path(s, d)
    m = x.groupBy("state").agg(F.avg("equity").alias("m"), F.var_pop("equity").alias("v"))
    gap = F.col("equity") - F.col("m")
    l = x.join(m, "state").agg(F.sum(-0.5 * (gap * gap / F.col("v") + F.ln(2 * F.pi() * F.col("v")))).alias("ll"), F.count("*").alias("n"))
    return l.select(F.round(-2 * F.col("ll") + 19 * F.ln("n"), 4).alias("bic"))


@q("t7_role_order", with_views("px_month") + "SELECT month, role, row_number() OVER (ORDER BY month, list_position(['taxable_bond', 'equity', 'muni_bond'], role)) AS place FROM px_month")
def _(s, d):
    at = F.array_position(F.array(F.lit("taxable_bond"), F.lit("equity"), F.lit("muni_bond")), F.col("role"))
    return st.px_month(s, d).select("month", "role", F.row_number().over(Window.orderBy("month", at)).cast("long").alias("place"))


@q("u8_pooled_rows", with_views("px_month", "px_path") + "SELECT role, count(*) AS n, round(min(price), 6) AS lo FROM (SELECT role, price FROM px_month UNION ALL SELECT role, price FROM px_path) GROUP BY 1")
def _(s, d):
    p = st.px_month(s, d).select("role", "price").unionByName(st.px_path(s, d).select("role", "price"))
    return p.groupBy("role").agg(F.count("*").alias("n"), R(F.min("price"), 6).alias("lo"))


@q("f6_fisher_z", "SELECT event_id, round(atanh((event_id % 199 - 99) / 100.0), 6) AS z FROM events")
def _(s, d):
    from pathloom.functions.scalar import fisher_z

    return st.table(s, d, "events").select("event_id", R(fisher_z((F.col("event_id") % 199 - 99) / F.lit(100.0))).alias("z"))


@q("f7_tanh_exposure", "SELECT event_id, round(tanh(value / 100), 6) AS exposure FROM events")
def _(s, d):
    return st.table(s, d, "events").select("event_id", R(F.tanh(F.col("value") / 100)).alias("exposure"))
