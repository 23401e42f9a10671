"""Queries of simulation, regime models, block lengths, validation gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.operators import metrics as me
from pathloom.operators import regimes as rg
from pathloom.operators import simulation as sim
from pathloom.operators import states as sp
from pathloom.plans.data_layer import R
from pathloom.plans.path_layer import PAIRS, STATE, WIDE, rounded
from pathloom.sources import standin as st
from pathloom.sources.standin import ROLES, with_views

Q, O = {}, {}
SEED, PI, P = 20260714, [0.4, 0.3, 0.2, 0.1], [[0.7, 0.1, 0.1, 0.1], [0.2, 0.6, 0.1, 0.1], [0.1, 0.2, 0.6, 0.1], [0.25, 0.25, 0.25, 0.25]]
HORIZON, PATHS = 24, 40
RESTARTS = 50


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _pools(s, d):
    daily = _library(s, d).select(F.col("source_month").alias("month"))  # a month without a whole session cannot be drawn
    one = st.state_month(s, d).join(daily, "month", "left_semi")
    rank = F.row_number().over(Window.partitionBy("state").orderBy("period_index")) - 1
    return one.select("state", rank.cast("long").alias("rank"), F.col("month").alias("source_month"))


def _library(s, d):
    """Daily returns of the history's months, sessions numbered in their month."""
    w = Window.partitionBy("role").orderBy("session")
    r = st.px_daily(s, d).withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(w))
    wide = r.groupBy("session").pivot("role", ROLES).agg(F.first("r")).na.drop("any", subset=ROLES).withColumn("source_month", F.date_format("session", "yyyy-MM"))
    n = F.row_number().over(Window.partitionBy("source_month").orderBy("session")).cast("long")
    return wide.select("source_month", n.alias("session_in_month"), *ROLES)


def _paths(s, d):
    sizes = {r["state"]: r["n"] for r in _pools(s, d).groupBy("state").agg(F.count("*").alias("n")).collect()}  # four rows
    sel = sim.select_paths(s, PATHS, HORIZON, SEED, PI, P, [sizes.get(i, 1) for i in range(4)])
    return sim.materialize(sel, _pools(s, d), _library(s, d))


@q("g7_select_paths")
def _(s, d):
    return sim.select_paths(s, PATHS, HORIZON, SEED, PI, P, [20, 20, 20, 20])


@q("g8_generate_paths")
def _(s, d):
    return _paths(s, d)


@q("v6_generated_compounding")
def _(s, d):
    daily = _paths(s, d)
    monthly = daily.groupBy("path_id", F.col("model_month").alias("period_index")).agg(*[F.sum(r).alias(r) for r in ROLES])
    year = me.roll_up(monthly, 12).groupBy("path_id").agg(F.sum("equity").alias("y"))
    total = daily.groupBy("path_id").agg(F.sum("equity").alias("t"))
    return year.join(total, "path_id").select("path_id", (F.abs(F.col("y") - F.col("t")) < 1e-9).alias("exact"))


@q("y8_replay_equality")
def _(s, d):
    a, b = _paths(s, d), _paths(s, d)
    keys = ["path_id", "period_index"]
    j = a.join(b.select(*keys, F.col("equity").alias("again")), keys, "full")
    return j.agg(F.count("*").alias("rows"), F.count_if(~F.col("equity").eqNullSafe(F.col("again"))).alias("differences"))


# supplied draws: each customer's balance digits stand in for uniforms
DRAWS = "draws AS (SELECT c_nationkey AS path_id, c_custkey AS t, (c_custkey * 7919 % 1000) / 1000.0 AS u FROM customer WHERE c_custkey > 0)"
_case = lambda row: f"CASE WHEN u < {row[0]} THEN 0 WHEN u < {round(row[0] + row[1], 12)} THEN 1 WHEN u < {round(row[0] + row[1] + row[2], 12)} THEN 2 ELSE 3 END"


@q("g11_markov_states_from_draws", f"WITH RECURSIVE {DRAWS}, n AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY t) AS k FROM draws), r AS (SELECT path_id, k, {_case(PI)} AS state FROM n WHERE k = 1 UNION ALL SELECT n.path_id, n.k, CASE r.state WHEN 0 THEN {_case(P[0])} WHEN 1 THEN {_case(P[1])} WHEN 2 THEN {_case(P[2])} ELSE {_case(P[3])} END FROM r JOIN n ON n.path_id = r.path_id AND n.k = r.k + 1) SELECT path_id, k AS period_index, state FROM r")
def _(s, d):
    c = st.table(s, d, "customer").where("c_custkey > 0").select(F.col("c_nationkey").alias("path_id"), F.col("c_custkey").alias("t"), (F.col("c_custkey") * 7919 % 1000 / F.lit(1000.0)).alias("u"))
    draws = c.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "u"))), lambda x: x["u"]).alias("u"))
    states = draws.select("path_id", F.posexplode(sim.state_fold(F.col("u"), PI, P)).alias("i", "state"))
    return states.select("path_id", (F.col("i") + 1).cast("long").alias("period_index"), "state")


@q("g15_ideal_restarts", STATE + "SELECT state, count(*) AS n, count(*) FILTER (coalesce(lag_state <> state, true) OR u < 1 / 3.0) AS restarts FROM (SELECT state, lag(state) OVER (PARTITION BY path_id ORDER BY period_index) AS lag_state, (period_index * 7919 % 1000) / 1000.0 AS u FROM state_path) GROUP BY 1")
def _(s, d):
    x = st.state_path(s, d).withColumn("u", F.col("period_index") * 7919 % 1000 / F.lit(1000.0))
    return sim.ideal_restarts(x, 3.0).groupBy("state").agg(F.count("*").alias("n"), F.count_if("restart").alias("restarts"))


def _trace_rows(s, d, conditioned: bool):
    one = st.state_month(s, d).orderBy("period_index").select("state").collect()  # one monthly history
    source = np.array([r[0] for r in one])
    links = np.ones(len(source), bool)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                u = sim.uniforms(SEED, (1, 1, 2, path, 0, 0), 3 * 120).reshape(3, 120)
                if conditioned:
                    target = sim.markov_path(np.array(PI), np.array(P), u[0])
                    idx, why = sim.conditioned_trace(target, source, links, u[1], u[2], 3.0)
                else:
                    idx, why = sim.bootstrap_trace(len(source), links, u[1], u[2], 3.0), [""] * 120
                yield pa.RecordBatch.from_arrays([pa.array([path] * 120), pa.array(range(1, 121)), pa.array(idx), pa.array(why)], ["path_id", "period_index", "source_index", "reason"])

    return s.range(1, PATHS + 1).mapInArrow(run, "path_id long, period_index long, source_index long, reason string")


@q("g14_conditioned_bootstrap")
def _(s, d):
    return _trace_rows(s, d, True)


@q("g16_stationary_bootstrap")
def _(s, d):
    return _trace_rows(s, d, False).drop("reason")


@q("g30_alpha_policy", STATE + ", o AS (SELECT state, avg(equity) AS o FROM state_path GROUP BY 1) SELECT path_id, period_index, round(equity - 0.5 * o, 6) AS equity FROM state_path JOIN o USING (state)")
def _(s, d):
    x = st.state_path(s, d)
    return sim.alpha_policy(x, sp.conditional_means(x, ROLES).drop("n"), 0.5).select("path_id", "period_index", R("equity").alias("equity"))


@q("g38_desynchronized_defect", WIDE + "SELECT path_id, period_index, round(x, 6) AS taxable_bond FROM (SELECT path_id, period_index, lag(taxable_bond) OVER (PARTITION BY path_id ORDER BY period_index) AS x FROM ret_path) WHERE x IS NOT NULL")
def _(s, d):
    return sim.desynchronize(st.ret_path(s, d)).select("path_id", "period_index", R("taxable_bond").alias("taxable_bond"))


@q("f8_gaussian_log_density", STATE + ", m AS (SELECT state AS k, avg(equity) AS m, var_pop(equity) AS v FROM state_path GROUP BY 1) SELECT path_id, period_index, k, round(-0.5 * ((equity - m) ** 2 / v + ln(2 * pi() * v)), 5) AS log_density FROM state_path, m")
def _(s, d):
    x = st.state_path(s, d)
    m = F.broadcast(x.groupBy(F.col("state").alias("k")).agg(F.avg("equity").alias("m"), F.var_pop("equity").alias("v")))  # a row a state
    gap = F.col("equity") - F.col("m")
    return x.join(m).select("path_id", "period_index", "k", R(-0.5 * (gap * gap / F.col("v") + F.ln(2 * F.pi() * F.col("v"))), 5).alias("log_density"))


@q("m1_fit_regimes")
def _(s, d):
    x = st.ret_month(s, d).withColumn("segment_id", F.lit(0))
    return rg.fit_restarts(x, ROLES, 4, RESTARTS, SEED)


@q("t3_best_restart")
def _(s, d):
    x = st.ret_month(s, d).withColumn("segment_id", F.lit(0))
    f = rg.fit_restarts(x, ROLES, 2, RESTARTS, SEED)
    return f.agg(F.max_by(F.struct("restart", "log_likelihood", "converged"), F.struct("log_likelihood", -F.col("restart"))).alias("b")).select("b.*")


@q("m12_viterbi_states")
def _(s, d):
    x = st.ret_path(s, d)

    def run(key, group):
        import pyarrow as pa

        g = group.sort_by("period_index")
        v = np.stack([g[r].to_numpy() for r in ROLES], 1)
        v = (v - v.mean(0)) / v.std(0)
        f = rg.canonical(rg.fit_once(v, [len(v)], 2, SEED, 0))
        e = rg.log_emissions(v, f["means"], f["spread"])
        _, smooth, _, _ = rg.forward_backward(e, f["start"], f["transition"])
        return pa.table({"path_id": g["path_id"], "period_index": g["period_index"], "state": rg.viterbi(e, f["start"], f["transition"]), "probability": np.exp(smooth.max(1))})

    return x.groupBy("path_id").applyInArrow(run, "path_id long, period_index long, state long, probability double")


@q("b3_block_lengths")
def _(s, d):
    from pathloom.operators import blocks

    def run(key, group):
        import pyarrow as pa

        g = group.sort_by("period_index")
        x = g["r"].to_numpy()
        length = blocks.automatic_length(x, np.zeros(len(x), np.int64))
        return pa.table({"path_id": [key[0].as_py()], "role": [key[1].as_py()], "length": [length], "combined": [blocks.combine([length], "monthly")]})

    return st.long_path(s, d).groupBy("path_id", "role").applyInArrow(run, "path_id long, role string, length double, combined long")


@q("b19_dependence_vector", WIDE + "SELECT path_id, " + ", ".join(f"round(atanh(covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b}))), 5) AS z_{a}_{b}" for a, b in PAIRS) + " FROM ret_path GROUP BY 1")
def _(s, d):
    from pathloom.functions.scalar import fisher_z

    c = me.correlations(st.ret_path(s, d))
    return c.select("path_id", *[R(fisher_z(F.col(f"corr_{a}_{b}")), 5).alias(f"z_{a}_{b}") for a, b in PAIRS])


@q("m37_var1_moments", WIDE + "SELECT path_id, round(sum(x * equity), 6) AS xy, round(sum(x * x), 6) AS xx, count(*) AS n FROM (SELECT path_id, equity, lag(equity) OVER (PARTITION BY path_id ORDER BY period_index) AS x FROM ret_path) WHERE x IS NOT NULL GROUP BY 1")
def _(s, d):
    x = st.ret_path(s, d).withColumn("x", F.lag("equity").over(Window.partitionBy("path_id").orderBy("period_index"))).where("x IS NOT NULL")
    return x.groupBy("path_id").agg(R(F.sum(F.col("x") * F.col("equity"))).alias("xy"), R(F.sum(F.col("x") * F.col("x"))).alias("xx"), F.count("*").alias("n"))


@q("m31_rolling_origin_splits", WIDE + "SELECT path_id, fold, count(*) FILTER (period_index <= n - 72 + 12 * fold) AS training, count(*) FILTER (period_index > n - 72 + 12 * fold AND period_index <= n - 60 + 12 * fold) AS validation FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS n, unnest(range(6)) AS fold FROM ret_path) GROUP BY ALL")
def _(s, d):
    n = F.count("*").over(Window.partitionBy("path_id"))
    x = st.ret_path(s, d).withColumn("n", n).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    edge = F.col("n") - 72 + 12 * F.col("fold")
    return x.groupBy("path_id", "fold").agg(F.count_if(F.col("period_index") <= edge).alias("training"), F.count_if((F.col("period_index") > edge) & (F.col("period_index") <= edge + 12)).alias("validation"))


@q("m30_aligned_jaccards", STATE + "SELECT a.state, round(count(*) FILTER (b.state = a.state) / (count(*) + any_value(c.n) - count(*) FILTER (b.state = a.state)), 6) AS jaccard FROM (SELECT * FROM state_path WHERE path_id = 0) a JOIN (SELECT * FROM state_path WHERE path_id = 1) b USING (period_index) JOIN (SELECT state, count(*) AS n FROM state_path WHERE path_id = 1 AND period_index IN (SELECT period_index FROM state_path WHERE path_id = 0) GROUP BY 1) c ON c.state = a.state GROUP BY 1")
def _(s, d):
    x = st.state_path(s, d)
    j = x.where("path_id = 0").select("period_index", F.col("state").alias("a")).join(x.where("path_id = 1").select("period_index", F.col("state").alias("b")), "period_index")
    e = j.withColumn("state", F.explode(F.array_distinct(F.array("a", "b"))))
    g = e.groupBy("state").agg(F.count_if(F.col("a") == F.col("b")).alias("both"), F.count("*").alias("any"))
    return g.select("state", R(F.col("both") / F.col("any")).alias("jaccard"))


@q("t9_minimum_bic")
def _(s, d):
    x = st.ret_month(s, d).withColumn("segment_id", F.lit(0))
    n = x.count()
    best = [(k, rg.fit_restarts(x, ROLES, k, RESTARTS, SEED, tied=True).agg(F.max("log_likelihood")).first()[0]) for k in range(2, 6)]
    out = [(k, float(rg.bic(l, n, k, len(ROLES)))) for k, l in best]
    return s.createDataFrame(out, "n_states long, bic double").agg(F.min_by("n_states", F.struct("bic", "n_states")).alias("n_states"))


@q("v4_risk_gate", with_views("ret_path") + ", a AS (SELECT stddev_samp(equity) AS v FROM ret_path WHERE path_id = 0), b AS (SELECT stddev_samp(equity) AS v FROM ret_path WHERE path_id > 0) SELECT round(b.v / a.v, 6) AS ratio, b.v / a.v BETWEEN 0.9 AND 1.1 AS passed FROM a, b")
def _(s, d):
    x = st.ret_path(s, d)
    v = x.agg(F.stddev_samp(F.when(F.col("path_id") == 0, F.col("equity"))).alias("a"), F.stddev_samp(F.when(F.col("path_id") > 0, F.col("equity"))).alias("b"))
    return v.select(R(F.col("b") / F.col("a")).alias("ratio"), (F.col("b") / F.col("a")).between(0.9, 1.1).alias("passed"))


@q("v1_violations", with_views("ret_path") + "SELECT count(*) FILTER (equity IS NULL OR muni_bond IS NULL OR taxable_bond IS NULL) AS missing, count(*) FILTER (abs(equity) > 5) AS out_of_bounds, count(*) - count(DISTINCT path_id * 100000 + period_index) AS duplicate_keys FROM ret_path")
def _(s, d):
    bad = F.col("equity").isNull() | F.col("muni_bond").isNull() | F.col("taxable_bond").isNull()
    return st.ret_path(s, d).agg(F.count_if(bad).alias("missing"), F.count_if(F.abs("equity") > 5).alias("out_of_bounds"), (F.count("*") - F.count_distinct(F.col("path_id") * 100000 + F.col("period_index"))).alias("duplicate_keys"))


@q("v12_simple_compounding", WIDE + "SELECT path_id, (period_index - 1) // 12 AS year, round(exp(sum(equity)) - 1, 6) AS simple_return FROM ret_path GROUP BY ALL HAVING count(*) = 12")
def _(s, d):
    g = st.ret_path(s, d).groupBy("path_id", F.floor((F.col("period_index") - 1) / 12).alias("year")).agg(F.count("*").alias("k"), (F.exp(F.sum(F.log1p(F.expm1("equity")))) - 1).alias("x"))
    return g.where("k = 12").select("path_id", "year", R("x").alias("simple_return"))


@q("y9_output_comparison", with_views("px_month") + "SELECT count(*) AS differences FROM (SELECT month, role FROM px_month EXCEPT SELECT strftime(l_shipdate, '%Y-%m'), CASE l_returnflag WHEN 'A' THEN 'equity' WHEN 'R' THEN 'muni_bond' ELSE 'taxable_bond' END FROM lineitem)")
def _(s, d):
    left = st.px_month(s, d).select("month", "role")
    right = st.px_path(s, d).select("month", "role")
    return left.exceptAll(right.distinct()).agg(F.count("*").alias("differences"))
