"""Queries of inference, strategies and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import distances as di
from pathloom.operators import inference as inf
from pathloom.operators import metrics as me
from pathloom.operators import strategies as sg
from pathloom.plans.data_layer import R
from pathloom.plans.path_layer import HQ, LONG, STATE, WIDE, rounded
from pathloom.sources import standin as st
from pathloom.sources.standin import ROLES

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


# replicates: each path's returns, a replicate a month; the observed value is the first path's
REP = LONG + ", cell AS (SELECT role AS name, (1 + count(*) FILTER (r >= 0.05)) / (count(*) + 1) AS p FROM long_path GROUP BY 1)"


def _cells(s, d):
    return st.long_path(s, d).groupBy(F.col("role").alias("name")).agg(((1 + F.count_if(F.col("r") >= 0.05)) / (F.count("*") + 1)).alias("p"))


@q("i2_plus_one_pvalue", REP + " SELECT name, round(p, 6) AS p FROM cell")
def _(s, d):
    r = st.long_path(s, d).select(F.col("role").alias("name"), F.col("r").alias("x"))
    obs = r.select("name").distinct().withColumn("observed", F.lit(0.05))
    return rounded(inf.plus_one_p(r, obs, "name"), "name")


@q("i1_holm", REP + """, k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM cell)
SELECT name, round(p, 6) AS p, rank, round(max(least(p * (m - rank + 1), 1)) OVER (ORDER BY p, name), 6) AS adjusted_p, bool_and(p <= 0.05 / (m - rank + 1)) OVER (ORDER BY p, name) AS rejected FROM k""")
def _(s, d):
    return rounded(inf.holm(_cells(s, d)), "name", "rank", "rejected")


@q("i18_max_z_cell", LONG + """, s AS (SELECT role AS component, avg(r) AS c, stddev_samp(r) AS k FROM long_path WHERE path_id > 0 GROUP BY 1),
o AS (SELECT role AS component, max(r) AS observed FROM long_path WHERE path_id = 0 GROUP BY 1), t AS (SELECT max(abs((observed - c) / k)) AS statistic FROM o JOIN s USING (component)),
z AS (SELECT path_id * 1000 + period_index AS replicate, max(abs((r - c) / k)) AS z FROM long_path JOIN s ON role = component WHERE path_id > 0 GROUP BY 1)
SELECT round(statistic, 6) AS statistic, round((1 + count(*) FILTER (z >= statistic)) / (count(*) + 1), 6) AS p, count(*) AS replicates FROM z, t GROUP BY statistic""")
def _(s, d):
    r = st.long_path(s, d)
    rep = r.where("path_id > 0").select((F.col("path_id") * 1000 + F.col("period_index")).alias("replicate"), F.col("role").alias("component"), F.col("r").alias("x"))
    obs = r.where("path_id = 0").groupBy(F.col("role").alias("component")).agg(F.max("r").alias("observed"))
    return rounded(inf.max_z(rep, obs), "replicates")


@q("i5_critical_values", LONG + f" SELECT role, round({HQ.format(x='abs(r)', p=0.95)}, 6) AS critical FROM long_path GROUP BY 1")
def _(s, d):
    return rounded(inf.critical_values(st.long_path(s, d).select("role", F.abs("r").alias("x")), "role", 0.95), "role")


@q("i9_power_audit", "SELECT o_orderpriority AS claim, count(*) FILTER (o_totalprice > 150000) AS detections, count(*) FILTER (o_totalprice > 150000) >= 0.4 * count(*) AS passed FROM orders GROUP BY 1")
def _(s, d):
    hit = F.count_if(F.col("o_totalprice") > 150000)
    return st.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("claim")).agg(hit.alias("detections"), (hit >= 0.4 * F.count("*")).alias("passed"))


@q("a16_kernel_means", STATE + " SELECT state, count(*) AS n, round(avg(equity), 6) AS mean, round(stddev_samp(equity) / sqrt(count(*)), 6) AS standard_error FROM state_path GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    g = st.state_path(s, d).groupBy("state").agg(F.count("*").alias("n"), R(F.avg("equity")).alias("mean"), R(F.stddev_samp("equity") / F.sqrt(F.count("*"))).alias("standard_error"))
    return g.where("n >= 2")


@q("a17_kernel_window_statistics", STATE + ", w AS (SELECT state, path_id, count(*) AS c, sum(equity) AS r FROM state_path GROUP BY 1, 2) SELECT state, CAST(sum(c) AS BIGINT) AS n, round(sum(r) / sum(c), 6) AS ratio_mean, round(sum(r * r), 6) AS rr, round(sum(c * r), 6) AS cr, CAST(sum(c * c) AS BIGINT) AS cc FROM w GROUP BY 1")
def _(s, d):
    w = st.state_path(s, d).groupBy("state", "path_id").agg(F.count("*").alias("c"), F.sum("equity").alias("r"))
    return w.groupBy("state").agg(F.sum("c").alias("n"), R(F.sum("r") / F.sum("c")).alias("ratio_mean"), R(F.sum(F.col("r") * F.col("r"))).alias("rr"), R(F.sum(F.col("c") * F.col("r"))).alias("cr"), F.sum(F.col("c") * F.col("c")).alias("cc"))


_over = "OVER (PARTITION BY path_id ORDER BY period_index"
_sums = ", ".join(f"sum({r}) {_over} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {r}_{k}" for r in ROLES for k in (1, 6))
_trends = ", ".join(f"lag(l_{r}) {_over}) - avg(l_{r}) {_over} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS {r}_trend" for r in ROLES)
FEAT = WIDE + ", l AS (SELECT *, " + ", ".join(f"sum({r}) {_over}) AS l_{r}" for r in ROLES) + f" FROM ret_path), f AS (SELECT *, {_sums}, {_trends}, sum(taxable_bond - muni_bond) {_over} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS spread_6, count(*) {_over} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS k FROM l)"
_fc = [f"{r}_{k}" for r in ROLES for k in (1, 6, "trend")] + ["spread_6"]


@q("w18_strategy_features", FEAT + " SELECT path_id, period_index, " + ", ".join(f"round({c}, 6) AS {c}" for c in _fc) + " FROM f WHERE k = 12")
def _(s, d):
    return rounded(sg.trailing_features(st.ret_path(s, d)).select("path_id", "period_index", *_fc), "path_id", "period_index")


@q("r2_winner_weights", FEAT + ", g AS (SELECT *, greatest(equity_6, muni_bond_6, taxable_bond_6) AS b FROM f WHERE k = 12) SELECT path_id, period_index, " + ", ".join(f"CAST({r}_6 = b AS DOUBLE) / (CAST(equity_6 = b AS INT) + CAST(muni_bond_6 = b AS INT) + CAST(taxable_bond_6 = b AS INT)) AS w_{r}" for r in ROLES) + " FROM g")
def _(s, d):
    return sg.winner_weights(sg.trailing_features(st.ret_path(s, d)), "_6")


IVOL = WIDE + ", v AS (SELECT *, (period_index - 1) // 3 AS bucket, count(*) OVER p AS k, " + ", ".join(f"1 / stddev_samp(exp({r}) - 1) OVER p AS i_{r}" for r in ROLES) + " FROM ret_path WINDOW p AS (PARTITION BY path_id ORDER BY period_index ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), x AS (SELECT path_id, period_index, equity, muni_bond, taxable_bond, " + ", ".join(f"first_value(CASE WHEN k = 12 THEN i_{r} / (i_equity + i_muni_bond + i_taxable_bond) END) OVER (PARTITION BY path_id, bucket ORDER BY period_index) AS w_{r}" for r in ROLES) + " FROM v), iv AS (SELECT * FROM x WHERE w_equity IS NOT NULL)"


@q("w19_inverse_volatility_weights", IVOL + " SELECT path_id, period_index, " + ", ".join(f"round(w_{r}, 6) AS w_{r}" for r in ROLES) + " FROM iv")
def _(s, d):
    return rounded(sg.inverse_volatility_weights(st.ret_path(s, d)).drop(*ROLES), "path_id", "period_index")


_simple = lambda w: " + ".join(f"(exp({r}) - 1) * {w}_{r}" for r in ROLES)


@q("r6_timer_sharpe", IVOL + ", c AS (SELECT " + ", ".join(f"avg(w_{r}) / (avg(w_equity) + avg(w_muni_bond) + avg(w_taxable_bond)) AS c_{r}" for r in ROLES) + f" FROM iv), t AS (SELECT path_id, {_simple('w')} AS x, {_simple('c')} AS y FROM iv, c), u AS (SELECT path_id, avg(x) / stddev_samp(x) * sqrt(12) AS timer, avg(y) / stddev_samp(y) * sqrt(12) AS static FROM t GROUP BY 1) SELECT path_id, round(timer, 5) AS timer, round(static, 5) AS static, round(timer - static, 5) AS improvement FROM u")
def _(s, d):
    x = sg.timer_improvements(sg.inverse_volatility_weights(st.ret_path(s, d)))
    return x.select("path_id", *[R(c, 5).alias(c) for c in ("timer", "static", "improvement")])


@q("r11_directional_alpha", WIDE + ", " + "g AS (SELECT *, " + ", ".join(f"lag(CASE WHEN {r} >= 0 THEN 1.0 ELSE -1.0 END) OVER (PARTITION BY path_id ORDER BY period_index) AS s_{r}" for r in ROLES) + " FROM ret_path), u AS (" + " UNION ALL ".join(f"SELECT path_id, '{a}' AS predictor, '{b}' AS outcome, s_{a} * {b} AS x FROM g" for a in ROLES for b in ROLES) + ") SELECT path_id, predictor, outcome, round(avg(x) / stddev_samp(x) * sqrt(12), 5) AS sharpe FROM u WHERE x IS NOT NULL GROUP BY ALL")
def _(s, d):
    return sg.directional_sharpes(st.ret_path(s, d)).select("path_id", "predictor", "outcome", R("sharpe", 5).alias("sharpe"))


@q("r10_memorisation_hits", STATE + """, w AS (SELECT path_id, period_index, state, string_agg(CAST(state AS VARCHAR), ',') OVER o AS key, count(*) OVER o AS k FROM state_path WINDOW o AS (PARTITION BY path_id ORDER BY period_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, min(state) OVER o AS lo, max(state) OVER o AS hi FROM w WHERE k = 2 WINDOW o AS (PARTITION BY path_id, key ORDER BY period_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT path_id, period_index, lo = hi AS known, CASE WHEN lo = hi THEN lo END AS guess, state AS actual FROM b""")
def _(s, d):
    return sg.memorisation_hits(st.state_path(s, d), "state", 2)


@q("r1_ridge_fit")
def _(s, d):
    f = sg.trailing_features(st.ret_path(s, d))
    cols = ["equity_1", "equity_6", "equity_trend", "spread_6"]
    b = sg.ridge(f, cols, "equity")
    return s.createDataFrame([(n, float(v)) for n, v in zip(["intercept", *cols], b, strict=True)], "term string, coefficient double")


AB = LONG + ", a AS (SELECT role, r AS x, row_number() OVER (PARTITION BY role ORDER BY r) AS k FROM long_path WHERE path_id = 0), b AS (SELECT role, r AS y, row_number() OVER (PARTITION BY role ORDER BY r) AS k FROM long_path WHERE path_id = 1)"


@q("d7_wasserstein_1d", AB + " SELECT role, round(avg(abs(x - y)), 6) AS distance FROM a JOIN b USING (role, k) GROUP BY 1")
def _(s, d):
    r = st.long_path(s, d)
    pick = lambda i: r.where(F.col("path_id") == i).select("role", F.col("r").alias("x"))
    return rounded(di.wasserstein(pick(0), pick(1), "role"), "role")


DIRECTIONS = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.6, 0.8, 0.0], [0.6, 0.0, -0.8], [0.0, 0.6, 0.8]]
# both samples on the reference's (path 1's) centre and scale, as many evenly spaced rows of each
JOINT = WIDE + ", n AS (SELECT count(*) FILTER (path_id = 0) AS na, count(*) FILTER (path_id = 1) AS nb FROM ret_path), st AS (SELECT " + ", ".join(f"avg({r}) AS m_{r}, stddev_samp({r}) AS s_{r}" for r in ROLES) + " FROM ret_path WHERE path_id = 1), z AS (SELECT path_id, period_index - 1 AS i, CASE path_id WHEN 0 THEN na ELSE nb END AS n, least(256, na, nb) AS size, " + ", ".join(f"({r} - m_{r}) / s_{r} AS {r}" for r in ROLES) + " FROM ret_path, st, n WHERE path_id < 2), js AS (SELECT z.* FROM z JOIN range(0, 256) t(k) ON k < size AND i = CASE WHEN k = size - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1) / (size - 1))) AS BIGINT) END)"
_proj = " UNION ALL ".join(f"SELECT path_id, {i} AS direction, {d[0]} * equity + {d[1]} * muni_bond + {d[2]} * taxable_bond AS x FROM js" for i, d in enumerate(DIRECTIONS))


@q("d5_sliced_wasserstein", JOINT + f", p AS ({_proj}), k AS (SELECT *, row_number() OVER (PARTITION BY path_id, direction ORDER BY x) AS k FROM p), g AS (SELECT a.direction, avg(abs(a.x - b.x)) AS g FROM k a JOIN k b ON a.path_id = 0 AND b.path_id = 1 AND a.direction = b.direction AND a.k = b.k GROUP BY 1) SELECT round(avg(g), 6) AS distance FROM g")
def _(s, d):
    w = st.ret_path(s, d)
    return rounded(di.sliced_wasserstein(w.where("path_id = 0"), w.where("path_id = 1"), ROLES, DIRECTIONS))


@q("d5_energy_distance", JOINT + """, a AS (SELECT * FROM js WHERE path_id = 0), b AS (SELECT * FROM js WHERE path_id = 1),
m AS (SELECT (SELECT avg(sqrt((a.equity - b.equity) ** 2 + (a.muni_bond - b.muni_bond) ** 2 + (a.taxable_bond - b.taxable_bond) ** 2)) FROM a, b) AS xy,
(SELECT avg(sqrt((x.equity - y.equity) ** 2 + (x.muni_bond - y.muni_bond) ** 2 + (x.taxable_bond - y.taxable_bond) ** 2)) FROM a x, a y) AS xx,
(SELECT avg(sqrt((x.equity - y.equity) ** 2 + (x.muni_bond - y.muni_bond) ** 2 + (x.taxable_bond - y.taxable_bond) ** 2)) FROM b x, b y) AS yy)
SELECT round(sqrt(greatest(0, 2 * xy - xx - yy)), 6) AS distance FROM m""")
def _(s, d):
    w = st.ret_path(s, d)
    return rounded(di.energy(w.where("path_id = 0"), w.where("path_id = 1"), ROLES))


@q("d9_tail_dependence_gap", WIDE + f", e AS (SELECT {HQ.format(x='equity', p=0.1)} AS qe, {HQ.format(x='muni_bond', p=0.1)} AS qm FROM ret_path WHERE path_id = 1), c AS (SELECT path_id, avg(CAST(equity <= qe AND muni_bond <= qm AS DOUBLE)) AS co FROM ret_path, e WHERE path_id < 2 GROUP BY 1) SELECT round(abs(max(co) FILTER (path_id = 0) - max(co) FILTER (path_id = 1)) / 0.02, 6) AS gap FROM c")
def _(s, d):
    w = st.ret_path(s, d)
    ends = w.where("path_id = 1").agg(me.higher_quantile(F.collect_list("equity"), 0.1).alias("qe"), me.higher_quantile(F.collect_list("muni_bond"), 0.1).alias("qm"))
    c = w.where("path_id < 2").join(F.broadcast(ends)).withColumn("co", ((F.col("equity") <= F.col("qe")) & (F.col("muni_bond") <= F.col("qm"))).cast("double"))
    mean = lambda i: F.avg(F.when(F.col("path_id") == i, F.col("co")))
    return c.agg(R(F.abs(mean(0) - mean(1)) / 0.02).alias("gap"))


@q("d8_shape_gap", WIDE + ", m AS (SELECT path_id, avg(equity) AS m FROM ret_path GROUP BY 1), k AS (SELECT path_id, avg((equity - m) ** 3) / var_pop(equity) ** 1.5 AS sk, avg((equity - m) ** 4) / var_pop(equity) ** 2 AS ku FROM ret_path JOIN m USING (path_id) GROUP BY 1) SELECT round(abs(a.sk - b.sk), 5) AS skew_gap, round(abs(a.ku - b.ku), 5) AS kurtosis_gap FROM k a, k b WHERE a.path_id = 0 AND b.path_id = 1")
def _(s, d):
    g = st.ret_path(s, d).where("path_id < 2").groupBy("path_id").agg(F.skewness("equity").alias("sk"), F.kurtosis("equity").alias("ku"))
    one = g.agg(*[F.max(F.when(F.col("path_id") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("sk", "ku")])
    return one.select(R(F.abs(F.col("sk0") - F.col("sk1")), 5).alias("skew_gap"), R(F.abs(F.col("ku0") - F.col("ku1")), 5).alias("kurtosis_gap"))


@q("i4_clopper_pearson")
def _(s, d):
    g = st.table(s, d, "labels").where("toxic IS NOT NULL").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n")).first()
    lo, hi = inf.clopper_pearson(g["k"], g["n"])
    return s.createDataFrame([(g["k"], g["n"], lo, hi)], "successes long, trials long, low double, high double")
