"""Keyed random streams, regime-conditioned path selection, bootstrap traces and month-block materialisation.

A stream is named by six integers and is the same wherever and whenever it is drawn; per-path work runs in Arrow
kernels over path ids, everything before and after is joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources.standin import ROLES

#: Restart reasons in order of precedence.
REASONS = ["first", "target_segment", "state_change", "source_end", "source_gap", "state_mismatch", "bernoulli", "continue"]


def uniforms(seed: int, key: tuple[int, ...], count: int) -> np.ndarray:
    """count uniforms of the stream with this master seed and spawn key."""
    return np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence(seed, spawn_key=key))).random(count)


def pick(probabilities: np.ndarray, u: float) -> int:
    """First class whose cumulative probability exceeds u, else the last."""
    k = int(np.searchsorted(np.cumsum(probabilities), u, side="right"))
    return min(k, len(probabilities) - 1)


def markov_path(stationary: np.ndarray, transition: np.ndarray, u: np.ndarray, segments: list[int] | None = None) -> np.ndarray:
    """States from supplied uniforms; the stationary law at the start of every segment."""
    out, starts = np.empty(len(u), np.int64), {0} if segments is None else {0, *np.cumsum(segments)[:-1].tolist()}
    for t, x in enumerate(u):
        out[t] = pick(stationary if t in starts else transition[out[t - 1]], x)
    return out


def bootstrap_trace(n: int, links: np.ndarray, restart_u: np.ndarray, source_u: np.ndarray, mean_length: float) -> np.ndarray:
    """Stationary bootstrap without wrap: source indices. links[i]: row i + 1 continues row i."""
    out = np.empty(len(restart_u), np.int64)
    for t, (u, v) in enumerate(zip(restart_u, source_u, strict=True)):
        last = out[t - 1] if t else n - 1
        restart = t == 0 or last == n - 1 or not links[last] or u < 1 / mean_length
        out[t] = min(int(v * n), n - 1) if restart else last + 1
    return out


def conditioned_trace(target: np.ndarray, source_states: np.ndarray, links: np.ndarray, restart_u: np.ndarray, source_u: np.ndarray, mean_length: float, segment_start: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
    """State-conditioned stationary bootstrap: source indices and the reason of each step."""
    pools = {int(s): np.flatnonzero(source_states == s) for s in np.unique(target)}
    n, out, why = len(source_states), np.empty(len(target), np.int64), []
    for t, s in enumerate(target):
        last = int(out[t - 1]) if t else -1
        if t == 0:
            reason = "first"
        elif segment_start is not None and segment_start[t]:
            reason = "target_segment"
        elif s != target[t - 1]:
            reason = "state_change"
        elif last == n - 1:
            reason = "source_end"
        elif not links[last]:
            reason = "source_gap"
        elif source_states[last + 1] != s:
            reason = "state_mismatch"
        elif restart_u[t] < 1 / mean_length:
            reason = "bernoulli"
        else:
            reason = "continue"
        pool = pools[int(s)]
        out[t] = last + 1 if reason == "continue" else pool[min(int(source_u[t] * len(pool)), len(pool) - 1)]
        why.append(reason)
    return out, why


def ideal_restarts(states: DataFrame, length: float) -> DataFrame:
    """Restart flags that ignore the source: first row, state change, or u < 1 / length. states (path_id, period_index, state, u)."""
    from pyspark.sql import Window

    o = Window.partitionBy("path_id").orderBy("period_index")
    new = F.coalesce(F.lag("state").over(o) != F.col("state"), F.lit(True))
    return states.withColumn("restart", new | (F.col("u") < 1 / length))


def select_paths(spark: SparkSession, n_paths: int, months: int, seed: int, stationary: list[float], transition: list[list[float]], pool_sizes: list[int], key: tuple[int, int] = (1, 5)) -> DataFrame:
    """(path_id, model_month, state, rank): a Markov state path and one uniform pool rank a month."""
    pi, p = np.array(stationary), np.array(transition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                u = uniforms(seed, (*key, 1, 1, path, 0), 2 * months)
                states = markov_path(pi, p, u[:months])
                rank = np.minimum((u[months:] * np.array(pool_sizes)[states]).astype(np.int64), np.array(pool_sizes)[states] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(months, path)), pa.array(np.arange(1, months + 1)), pa.array(states), pa.array(rank)], ["path_id", "model_month", "state", "rank"])

    return spark.range(1, n_paths + 1).mapInArrow(run, "path_id long, model_month long, state long, rank long")


def materialize(selection: DataFrame, pools: DataFrame, library: DataFrame) -> DataFrame:
    """Whole daily blocks of the selected months: pools (state, rank, source_month), library (source_month, session_in_month, roles)."""
    from pyspark.sql import Window

    chosen = selection.join(pools, ["state", "rank"]).join(library, "source_month")
    o = Window.partitionBy("path_id").orderBy("model_month", "session_in_month")
    return chosen.withColumn("period_index", F.row_number().over(o).cast("long")).select("path_id", "period_index", "model_month", "session_in_month", "state", "source_month", *ROLES)


def state_fold(draws: F.Column, stationary: list[float], transition: list[list[float]]) -> F.Column:
    """The Markov path as an expression: an array of uniforms to an array of states."""
    from pathloom.functions.scalar import categorical

    def step(acc, u):
        last = F.element_at(acc, -1)
        nxt = categorical(u, transition[-1])
        for i in reversed(range(len(transition) - 1)):
            nxt = F.when(last == i, categorical(u, transition[i])).otherwise(nxt)
        return F.concat(acc, F.array(F.when(F.size(acc) == 0, categorical(u, stationary)).otherwise(nxt)))

    return F.aggregate(draws, F.array().cast("array<int>"), step)


def alpha_policy(paths: DataFrame, offsets: DataFrame, scale: float) -> DataFrame:
    """Subtract scale * (kernel mean - target) by state; offsets (state, role columns)."""
    o = offsets.select("state", *[F.col(r).alias(f"o_{r}") for r in ROLES])
    return paths.join(F.broadcast(o), "state").select(*[c for c in paths.columns if c not in ROLES], *[(F.col(r) - scale * F.col(f"o_{r}")).alias(r) for r in ROLES])


def desynchronize(wide: DataFrame) -> DataFrame:
    """The injected defect of a taxable column lagged by one row."""
    from pyspark.sql import Window

    return wide.withColumn("taxable_bond", F.lag("taxable_bond").over(Window.partitionBy("path_id").orderBy("period_index"))).where("taxable_bond IS NOT NULL")
