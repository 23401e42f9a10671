"""Every registered query that has an SQL twin equals it on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from pathloom import registry

DIR = "/root/testdata/sf0.001"
FAST_ROWS_ONLY = ["g7_select_paths", "g14_conditioned_bootstrap", "m12_viterbi_states", "b3_block_lengths", "i4_clopper_pearson"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else float(f"{float(v):.7g}") + 0.0
    return v if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", FAST_ROWS_ONLY)
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_fits_read_the_whole_table(spark, tmp_path):
    from pathloom.sources import standin

    rows = spark.read.parquet(f"{DIR}/lineitem.parquet")
    rows.where("l_suppkey % 4 <> 0").write.parquet(f"{tmp_path}/lineitem.parquet")  # no row of path 0
    assert standin.ret_month(spark, str(tmp_path)).count() > 12
    fits = registry.QUERIES["m1_fit_regimes"](spark, str(tmp_path)).collect()
    assert [f.restart for f in sorted(fits, key=lambda f: f.restart)] == list(range(50))
    best = registry.QUERIES["t3_best_restart"](spark, str(tmp_path)).collect()
    assert len(best) == 1 and 0 <= best[0].restart < 50
    assert registry.QUERIES["t9_minimum_bic"](spark, str(tmp_path)).first().n_states in range(2, 6)
    for name in ("g8_generate_paths", "g14_conditioned_bootstrap", "g16_stationary_bootstrap"):
        assert registry.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert registry.QUERIES["y8_replay_equality"](spark, str(tmp_path)).first().differences == 0
    assert all(r.exact for r in registry.QUERIES["v6_generated_compounding"](spark, str(tmp_path)).collect())


def test_replay_compares_one_history(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pathloom.sources import standin

    ret_path, spread = standin.ret_path, standin.ret_path(spark, DIR)
    # as sums of doubles do whose parts come in another order
    monkeypatch.setattr(standin, "ret_path", lambda s, d: ret_path(s, d).withColumn("equity", F.col("equity") + F.rand() * 1e-12))
    got = registry.QUERIES["j13_full_outer_replay"](spark, DIR).first()
    assert (got.rows, got.differences) == (spread.count(), spread.where("path_id = 3").count())
