"""Queries over return paths: roll-ups, metrics, states, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.operators import metrics as me
from pathloom.operators import states as sp
from pathloom.plans.data_layer import R
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


def rounded(df, *keys):
    return df.select(*keys, *[R(c).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keys])


WIDE, LONG, STATE = with_views("ret_path"), with_views("long_path"), with_views("state_path")
PAIRS = me.PAIRS
_each = lambda f, roles=ROLES: ", ".join(f.format(r=r) for r in roles)
_pair = lambda f: ", ".join(f.format(a=a, b=b) for a, b in PAIRS)
HQ = "list_sort(list({x}))[CAST(ceil({p} * (count(*) - 1)) AS BIGINT) + 1]"
CORR = "coalesce(greatest(least(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 1), -1), 0)"

for _k, _name in ((3, "a5_quarterly_rollup"), (12, "a5_annual_rollup")):

    @q(_name, WIDE + f"SELECT path_id, (period_index - 1) // {_k} + 1 AS bucket, {_each('round(sum({r}), 6) AS {r}')} FROM ret_path GROUP BY ALL HAVING count(*) = {_k}")
    def _(s, d, k=_k):
        return rounded(me.roll_up(st.ret_path(s, d), k), "path_id", "bucket")


@q("a7_weekly_252_52", "WITH b AS (SELECT event_id % 252 AS s, value FROM events), k AS (SELECT s, (SELECT count(*) - 1 FROM range(52) t(w) WHERE 252 * w // 52 <= s) AS week FROM range(252) r(s)) SELECT week, count(*) AS sessions, round(sum(value), 4) AS total FROM b JOIN k USING (s) GROUP BY 1")
def _(s, d):
    from pathloom.functions.scalar import week_of_session

    e = st.table(s, d, "events").select(week_of_session(F.col("event_id") % 252).alias("week"), "value")
    return e.groupBy("week").agg(F.count("*").alias("sessions"), R(F.sum("value"), 4).alias("total"))


@q("d21_compounding_audit", WIDE + ", qu AS (SELECT path_id, (period_index - 1) // 3 AS b, sum(equity) AS x, count(*) AS k FROM ret_path GROUP BY ALL), an AS (SELECT path_id, (period_index - 1) // 12 AS b, sum(equity) AS y, count(*) AS k FROM ret_path GROUP BY ALL) SELECT an.path_id, an.b AS year, abs(sum(x) - any_value(y)) < 1e-12 AS exact FROM an JOIN qu ON qu.path_id = an.path_id AND qu.b // 4 = an.b WHERE an.k = 12 AND qu.k = 3 GROUP BY ALL")
def _(s, d):
    r = st.ret_path(s, d)
    qu, an = me.roll_up(r, 3), me.roll_up(r, 12)
    j = an.alias("a").join(qu.alias("q"), (F.col("a.path_id") == F.col("q.path_id")) & (F.floor((F.col("q.bucket") - 1) / 4) == F.col("a.bucket") - 1))
    return j.groupBy("a.path_id", (F.col("a.bucket") - 1).alias("year"), "a.equity").agg(F.sum("q.equity").alias("x")).select("path_id", "year", (F.abs(F.col("x") - F.col("equity")) < 1e-12).alias("exact"))


@q("a29_rows_by_frequency_grouping_sets", LONG + "SELECT coalesce(role, 'all') AS role, count(*) AS n, round(min(r), 6) AS lo, round(max(r), 6) AS hi FROM long_path GROUP BY GROUPING SETS ((role), ())")
def _(s, d):
    g = st.long_path(s, d).rollup("role").agg(F.count("*").alias("n"), R(F.min("r")).alias("lo"), R(F.max("r")).alias("hi"))
    return g.withColumn("role", F.coalesce("role", F.lit("all")))


@q("d_base_metrics", LONG + "SELECT path_id, role, count(*) AS n, round(avg(r) * 12, 6) AS annual_mean, round(stddev_samp(r) * sqrt(12), 6) AS annual_volatility, round(min(r), 6) AS worst, round(max(r), 6) AS best FROM long_path GROUP BY ALL")
def _(s, d):
    return rounded(me.base_metrics(st.long_path(s, d)), "path_id", "role")


@q("a8_covariance_by_path", WIDE + f"SELECT path_id, {_pair('round(covar_samp({a}, {b}), 6) AS cov_{a}_{b}')}, {_each('round(var_samp({r}), 6) AS cov_{r}_{r}')} FROM ret_path GROUP BY 1")
def _(s, d):
    return rounded(me.covariances(st.ret_path(s, d)), "path_id")


@q("a9_mean_of_path_covariances", WIDE + f"SELECT {_pair('round(avg(c_{a}_{b}), 6) AS cov_{a}_{b}')} FROM (SELECT path_id, {_pair('covar_samp({a}, {b}) AS c_{a}_{b}')} FROM ret_path GROUP BY 1)")
def _(s, d):
    return me.covariances(st.ret_path(s, d)).agg(*[R(F.avg(f"cov_{a}_{b}")).alias(f"cov_{a}_{b}") for a, b in PAIRS])


@q("d4_correlation_safe", WIDE + "SELECT path_id, " + ", ".join(f"round({CORR.format(a=a, b=b)}, 6) AS corr_{a}_{b}" for a, b in PAIRS) + " FROM ret_path GROUP BY 1")
def _(s, d):
    return rounded(me.correlations(st.ret_path(s, d)), "path_id")


@q("i3_higher_quantiles", LONG + "SELECT path_id, role, " + ", ".join(f"round({HQ.format(x='r', p=p)}, 6) AS hq_{round(p * 100):02d}" for p in (0.1, 0.5, 0.9)) + " FROM long_path GROUP BY ALL")
def _(s, d):
    return rounded(me.quantiles(st.long_path(s, d), [0.1, 0.5, 0.9]), "path_id", "role")


@q("a27_linear_quantiles", LONG + "SELECT role, " + ", ".join(f"round(quantile_cont(r, {p}), 6) AS q_{round(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM long_path GROUP BY 1")
def _(s, d):
    return st.long_path(s, d).groupBy("role").agg(*[R(F.percentile("r", p)).alias(f"q_{round(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)])


@q("d2_tail_means", LONG + f", e AS (SELECT path_id, role, {HQ.format(x='r', p=0.1)} AS lo, {HQ.format(x='r', p=0.9)} AS hi FROM long_path GROUP BY ALL) SELECT path_id, role, round(avg(r) FILTER (r <= lo), 6) AS lower_mean, round(avg(r) FILTER (r >= hi), 6) AS upper_mean FROM long_path JOIN e USING (path_id, role) GROUP BY ALL")
def _(s, d):
    return rounded(me.tail_means(st.long_path(s, d), 0.1, 0.9), "path_id", "role")


for _name, _t, _sql in (("w8_acf_raw", lambda x: x, "r"), ("w8_acf_abs", F.abs, "abs(r)"), ("w8_acf_squared", lambda x: x * x, "r * r")):

    @q(_name, LONG + f", c AS (SELECT path_id, role, period_index, {_sql} - avg({_sql}) OVER (PARTITION BY path_id, role) AS c FROM long_path), l AS (SELECT *, unnest([1, 3, 6, 12]) AS lag FROM c) SELECT a.path_id, a.role, CAST(a.lag AS BIGINT) AS lag, round(coalesce(sum(a.c * b.c), 0) / sum(a.c * a.c), 6) AS acf FROM l a LEFT JOIN c b ON a.path_id = b.path_id AND a.role = b.role AND b.period_index = a.period_index - a.lag GROUP BY ALL")
    def _(s, d, t=_t):
        return rounded(me.autocorrelations(st.long_path(s, d), [1, 3, 6, 12], t), "path_id", "role", "lag")


@q("w14_acf_gap_aware", LONG + ", c AS (SELECT path_id, role, period_index, month[1:4] AS seg, r - avg(r) OVER (PARTITION BY path_id, role) AS c FROM long_path) SELECT a.path_id, a.role, count(*) AS pairs, round(sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 6) AS acf FROM c a JOIN c b ON a.path_id = b.path_id AND a.role = b.role AND b.period_index = a.period_index - 2 AND a.seg = b.seg GROUP BY ALL")
def _(s, d):
    x = st.long_path(s, d).withColumn("segment_id", F.substring("month", 1, 4))
    return rounded(me.gap_aware_autocorrelation(x, 2), "path_id", "role")


@q("w12_cross_lag", WIDE + ", y AS (SELECT path_id, equity AS x, lead(taxable_bond) OVER (PARTITION BY path_id ORDER BY period_index) AS y FROM ret_path) SELECT path_id, round(" + CORR.format(a="x", b="y") + ", 6) AS cross_lag FROM y WHERE y IS NOT NULL GROUP BY 1")
def _(s, d):
    return rounded(me.cross_lag(st.ret_path(s, d), "equity", "taxable_bond"), "path_id")


@q("w9_drawdowns", LONG + """, a AS (SELECT *, sum(r) OVER o AS wealth FROM long_path WINDOW o AS (PARTITION BY path_id, role ORDER BY period_index)),
b AS (SELECT *, greatest(0, max(wealth) OVER (PARTITION BY path_id, role ORDER BY period_index)) AS peak FROM a),
c AS (SELECT *, sum(CASE WHEN wealth < peak THEN 0 ELSE 1 END) OVER (PARTITION BY path_id, role ORDER BY period_index) AS run FROM b),
e AS (SELECT path_id, role, run, min(wealth - peak) AS low, count(*) FILTER (wealth < peak) AS length FROM c GROUP BY ALL)
SELECT path_id, role, round(1 - exp(min(low)), 6) AS depth, max(length) AS duration FROM e GROUP BY ALL""")
def _(s, d):
    return rounded(me.drawdowns(st.long_path(s, d)), "path_id", "role")


@q("w11_rolling_12m", LONG + "SELECT path_id, role, period_index, round(total, 6) AS total FROM (SELECT *, sum(r) OVER o AS total, count(*) OVER o AS k FROM long_path WINDOW o AS (PARTITION BY path_id, role ORDER BY period_index ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE k = 12")
def _(s, d):
    return me.rolling_sums(st.long_path(s, d), 12).select("path_id", "role", "period_index", R("total").alias("total"))


@q("d3_downside_coexceedance", WIDE + ", e AS (SELECT path_id, " + ", ".join(f"{HQ.format(x=r, p=0.1)} AS q_{r}" for r in ROLES) + f" FROM ret_path GROUP BY 1) SELECT path_id, {_pair('round(avg(CAST({a} <= q_{a} AND {b} <= q_{b} AS DOUBLE)), 6) AS co_{a}_{b}')} FROM ret_path JOIN e USING (path_id) GROUP BY 1")
def _(s, d):
    return rounded(me.coexceedance(st.ret_path(s, d)), "path_id")


@q("i23_marginal_moments", LONG + "SELECT path_id, role, round(avg(r), 6) AS mean, round(var_pop(r), 6) AS variance, round(avg((r - m) ** 3) / var_pop(r) ** 1.5, 5) AS skewness, round(avg((r - m) ** 4) / var_pop(r) ** 2, 5) AS kurtosis FROM (SELECT *, avg(r) OVER (PARTITION BY path_id, role) AS m FROM long_path) GROUP BY ALL")
def _(s, d):
    return st.long_path(s, d).groupBy("path_id", "role").agg(R(F.avg("r")).alias("mean"), R(F.var_pop("r")).alias("variance"), R(F.skewness("r"), 5).alias("skewness"), R(F.kurtosis("r") + 3, 5).alias("kurtosis"))


@q("a30_cagr_distribution", LONG + ", g AS (SELECT path_id, role, exp(avg(r) * 12) - 1 AS cagr FROM long_path GROUP BY ALL) SELECT role, round(avg(cagr), 6) AS mean_cagr, round(quantile_cont(cagr, 0.05), 6) AS q05, round(quantile_cont(cagr, 0.5), 6) AS q50, round(quantile_cont(cagr, 0.95), 6) AS q95 FROM g GROUP BY 1")
def _(s, d):
    g = st.long_path(s, d).groupBy("path_id", "role").agg((F.exp(F.avg("r") * 12) - 1).alias("cagr"))
    return g.groupBy("role").agg(R(F.avg("cagr")).alias("mean_cagr"), *[R(F.percentile("cagr", p)).alias(f"q{round(100 * p):02d}") for p in (0.05, 0.5, 0.95)])


@q("p17_spread", WIDE + "SELECT path_id, round(avg(taxable_bond - muni_bond) * 12, 6) AS spread_mean, round(stddev_samp(taxable_bond - muni_bond) * sqrt(12), 6) AS spread_volatility FROM ret_path GROUP BY 1")
def _(s, d):
    x = F.col("taxable_bond") - F.col("muni_bond")
    return st.ret_path(s, d).groupBy("path_id").agg(R(F.avg(x) * 12).alias("spread_mean"), R(F.stddev_samp(x) * F.sqrt(F.lit(12.0))).alias("spread_volatility"))


@q("w10_max_drawdown_batch", LONG + ", a AS (SELECT *, sum(r) OVER (PARTITION BY path_id, role ORDER BY period_index) AS w FROM long_path) SELECT role, round(max(1 - exp(w - p)), 6) AS worst FROM (SELECT *, greatest(0, max(w) OVER (PARTITION BY path_id, role ORDER BY period_index)) AS p FROM a) GROUP BY 1")
def _(s, d):
    return me.drawdowns(st.long_path(s, d)).groupBy("role").agg(R(F.max("depth")).alias("worst"))


EPI = STATE + """, n AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY path_id ORDER BY period_index) = state THEN 0 ELSE 1 END AS new FROM state_path),
u AS (SELECT *, sum(new) OVER (PARTITION BY path_id ORDER BY period_index) AS run FROM n),
epi AS (SELECT path_id, run, state, min(period_index) AS first, max(period_index) AS last, count(*) AS length FROM u GROUP BY ALL)
"""


@q("a10_occupancy", STATE + "SELECT path_id, state, n, round(n / sum(n) OVER (PARTITION BY path_id), 6) AS share FROM (SELECT path_id, state, count(*) AS n FROM state_path GROUP BY 1, 2)")
def _(s, d):
    return rounded(sp.occupancy(st.state_path(s, d)), "path_id", "state")


@q("a11_transition_matrix", STATE + "SELECT state, next, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM (SELECT state, next, count(*) AS n FROM (SELECT state, lead(state) OVER (PARTITION BY path_id ORDER BY period_index) AS next FROM state_path) WHERE next IS NOT NULL GROUP BY 1, 2)")
def _(s, d):
    return rounded(sp.transitions(st.state_path(s, d)), "state", "next")


@q("w22_episodes", EPI + "SELECT path_id, CAST(run AS BIGINT) AS run, state, first, last, length FROM epi")
def _(s, d):
    return sp.episodes(st.state_path(s, d))


@q("a12_dwell_stats", EPI + "SELECT state, count(*) AS episodes, round(avg(length), 6) AS mean_dwell, round(quantile_cont(length, 0.5), 6) AS median_dwell, round(avg(CAST(length = 1 AS DOUBLE)), 6) AS one_period_share FROM epi GROUP BY 1")
def _(s, d):
    return rounded(sp.dwell(st.state_path(s, d)), "state")


@q("a26_survival_curve", EPI + "SELECT state, m AS months, round(avg(CAST(length >= m AS DOUBLE)), 6) AS survival FROM epi, range(1, 13) t(m) GROUP BY ALL")
def _(s, d):
    return rounded(sp.survival(st.state_path(s, d)), "state", "months")


@q("a12_state_conditional_means", STATE + f"SELECT state, count(*) AS n, {_each('round(avg({r}), 6) AS {r}')} FROM state_path GROUP BY 1")
def _(s, d):
    return rounded(sp.conditional_means(st.state_path(s, d), ROLES), "state")


@q("t4_canonical_labels", STATE + ", m AS (SELECT state, avg(muni_bond) AS a, avg(equity) AS b FROM state_path GROUP BY 1) SELECT state, row_number() OVER (ORDER BY a, b, state) - 1 AS canonical FROM m")
def _(s, d):
    return sp.canonical_labels(st.state_path(s, d), ["muni_bond", "equity"])


@q("w24_state_support", EPI + "SELECT state, count(*) FILTER (first > lo AND last < hi) AS episodes, CAST(sum(greatest(length - 1, 0)) AS BIGINT) AS eligible_starts FROM (SELECT *, min(first) OVER p AS lo, max(last) OVER p AS hi FROM epi WINDOW p AS (PARTITION BY path_id)) GROUP BY 1")
def _(s, d):
    return sp.support(st.state_path(s, d), 2)


@q("w25_realized_blocks", STATE + """, b AS (SELECT *, CASE WHEN period_index % 5 = 1 OR coalesce(lag(state) OVER (PARTITION BY path_id ORDER BY period_index), -1) <> state THEN 1 ELSE 0 END AS f FROM state_path),
k AS (SELECT path_id, state, sum(f) OVER (PARTITION BY path_id ORDER BY period_index) AS block FROM b), l AS (SELECT path_id, state, block, count(*) AS length FROM k GROUP BY ALL)
SELECT state, count(*) AS blocks, round(avg(length), 6) AS mean_length, round(avg(CAST(length = 1 AS DOUBLE)), 6) AS singleton_share FROM l GROUP BY 1""")
def _(s, d):
    o = Window.partitionBy("path_id").orderBy("period_index")
    x = st.state_path(s, d).withColumn("f", (F.col("period_index") % 5 == 1) | (F.coalesce(F.lag("state").over(o), F.lit(-1)) != F.col("state")))
    return rounded(sp.realized_blocks(x, "f"), "state")


@q("a21_duplicate_paths", LONG + ", p AS (SELECT path_id, role, sha256(string_agg(CAST(round(r, 6) AS VARCHAR), ',' ORDER BY period_index)) AS h FROM long_path GROUP BY ALL), g AS (SELECT h, count(*) AS m FROM p GROUP BY 1) SELECT count(*) AS distinct_paths, CAST(sum(m) - count(*) AS BIGINT) AS duplicate_copies, max(m) AS largest FROM g")
def _(s, d):
    from pathloom.operators.diversity import path_diversity

    return path_diversity(st.long_path(s, d), ["path_id", "role"])


@q("a23_repeated_windows", STATE + ", w AS (SELECT path_id, period_index, list(state) OVER (PARTITION BY path_id ORDER BY period_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM state_path), g AS (SELECT x, count(*) AS m FROM w WHERE len(x) = 4 GROUP BY 1) SELECT CAST(sum(m) AS BIGINT) AS windows, count(*) AS distinct_windows, CAST(coalesce(sum(m) FILTER (m > 1), 0) AS BIGINT) AS repeated FROM g")
def _(s, d):
    from pathloom.operators.diversity import repeated_windows

    return repeated_windows(st.state_path(s, d), "state", 4)


@q("a25_top_source_use", "SELECT l_suppkey, count(*) AS uses, count(DISTINCT l_partkey) AS distinct_parts FROM lineitem GROUP BY 1 ORDER BY uses DESC, l_suppkey LIMIT 10")
def _(s, d):
    g = st.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("uses"), F.count_distinct("l_partkey").alias("distinct_parts"))
    return g.orderBy(F.desc("uses"), "l_suppkey").limit(10)


@q("u7_range_overlap", EPI + "SELECT count(*) AS overlaps FROM epi a JOIN epi b ON a.path_id = b.path_id AND a.run < b.run AND a.first <= b.last AND b.first <= a.last")
def _(s, d):
    from pathloom.operators.diversity import overlapping_ranges

    return overlapping_ranges(sp.episodes(st.state_path(s, d)), "path_id", "run", "first", "last").agg(F.count("*").alias("overlaps"))


@q("j8_states_to_daily", with_views("px_daily", "state_path") + "SELECT session, role, state FROM px_daily p JOIN (SELECT month, state FROM state_path WHERE path_id = 0) s ON strftime(session, '%Y-%m') = month")
def _(s, d):
    states = st.state_path(s, d).where("path_id = 0").select("month", "state")
    return st.px_daily(s, d).withColumn("month", F.date_format("session", "yyyy-MM")).join(states, "month").select("session", "role", "state")


@q("j10_state_pool_rank", STATE + "SELECT path_id, state, row_number() OVER (PARTITION BY path_id, state ORDER BY period_index) - 1 AS rank, period_index FROM state_path")
def _(s, d):
    rank = F.row_number().over(Window.partitionBy("path_id", "state").orderBy("period_index")) - 1
    return st.state_path(s, d).select("path_id", "state", rank.cast("long").alias("rank"), "period_index")
