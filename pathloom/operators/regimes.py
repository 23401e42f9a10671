"""Gaussian hidden Markov models: restarts fitted in parallel, decoding, forward-backward, chain diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.operators.simulation import uniforms


def log_emissions(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Diagonal Gaussian log densities, rows x states."""
    gap = x[:, None, :] - means
    return -0.5 * (gap * gap / variances + np.log(2 * np.pi * variances)).sum(2)


def tied_log_emissions(x: np.ndarray, means: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    inverse, (_, logdet) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
    gap = x[:, None, :] - means
    return -0.5 * (np.einsum("tki,ij,tkj->tk", gap, inverse, gap) + logdet + x.shape[1] * np.log(2 * np.pi))


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def forward_backward(e: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Filtered and smoothed log probabilities, expected transition counts and log likelihood of one segment."""
    with np.errstate(divide="ignore"):
        ls, lt = np.log(start), np.log(transition)
    n, k = e.shape
    f, b = np.empty((n, k)), np.zeros((n, k))
    f[0] = ls + e[0]
    for t in range(1, n):
        f[t] = _lse(f[t - 1][:, None] + lt, 0) + e[t]
    for t in range(n - 2, -1, -1):
        b[t] = _lse(lt + e[t + 1] + b[t + 1], 1)
    ll = float(_lse(f[-1], 0))
    xi = np.exp(f[:-1, :, None] + lt + (e[1:] + b[1:])[:, None, :] - ll).sum(0) if n > 1 else np.zeros((k, k))
    return f - _lse(f, 1)[:, None], f + b - ll, xi, ll


def viterbi(e: np.ndarray, start: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Most probable states; ties to the lowest state."""
    with np.errstate(divide="ignore"):
        ls, lt = np.log(start), np.log(transition)
    n, k = e.shape
    score, back = ls + e[0], np.zeros((n, k), np.int64)
    for t in range(1, n):
        step = score[:, None] + lt
        back[t] = step.argmax(0)
        score = step.max(0) + e[t]
    out = np.empty(n, np.int64)
    out[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def predictive_scores(e: np.ndarray, weights: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """One-step predictive log densities from supplied initial weights."""
    out, w = np.empty(len(e)), weights
    for t in range(len(e)):
        joint = np.log(np.maximum(w, 1e-300)) + e[t]
        out[t] = _lse(joint, 0)
        w = np.exp(joint - out[t]) @ transition
    return out


def fit_once(x: np.ndarray, lengths: list[int], k: int, seed: int, restart: int, rounds: int = 200, tolerance: float = 1e-6, floor: float = 1e-3, tied: bool = False) -> dict:
    """One EM restart in log space with a variance floor after every M step."""
    u = uniforms(seed, (1, 1, 1, k, restart, 0), k * x.shape[1] + k)
    means = x[(u[:k] * len(x)).astype(int)] + 0.1 * (u[k:].reshape(k, -1) - 0.5)
    spread = np.tile(x.var(0), (k, 1)) if not tied else np.cov(x.T, ddof=0)
    start, transition = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
    history: list[float] = []
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for _ in range(rounds):
        e = tied_log_emissions(x, means, spread) if tied else log_emissions(x, means, spread)
        parts = [forward_backward(e[a:z], start, transition) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        history.append(sum(p[3] for p in parts))
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            break
        g = np.exp(np.concatenate([p[1] for p in parts]))
        start = np.mean([np.exp(p[1][0]) for p in parts], 0)
        xi = sum(p[2] for p in parts) + 1e-10
        transition = xi / xi.sum(1, keepdims=True)
        weight = np.maximum(g.sum(0), 1e-10)
        means = g.T @ x / weight[:, None]
        gap = x[:, None, :] - means
        if tied:
            spread = np.einsum("tk,tki,tkj->ij", g, gap, gap) / len(x)
            values, vectors = np.linalg.eigh(spread)
            spread = (vectors * np.maximum(values, floor)) @ vectors.T
        else:
            spread = np.maximum((g[:, :, None] * gap * gap).sum(0) / weight[:, None], floor)
    return {"restart": restart, "log_likelihood": history[-1], "iterations": len(history), "converged": len(history) > 1 and abs(history[-1] - history[-2]) < tolerance, "start": start, "transition": transition, "means": means, "spread": spread}


def canonical(fit: dict) -> dict:
    """States renumbered by the lexicographic order of their means."""
    order = np.lexsort(fit["means"].T[::-1])
    out = dict(fit)
    out["start"], out["means"], out["transition"] = fit["start"][order], fit["means"][order], fit["transition"][np.ix_(order, order)]
    out["spread"] = fit["spread"][order] if fit["spread"].shape[0] == len(order) and fit["spread"].shape == fit["means"].shape else fit["spread"]
    return out


def stationary(transition: np.ndarray) -> np.ndarray:
    k = len(transition)
    a = np.vstack([transition.T - np.eye(k), np.ones(k)])
    return np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0]


def chain_report(transition: np.ndarray, steps: int = 120, distance: float = 0.01, most_self: float = 0.98) -> dict:
    """Row sums, irreducibility, aperiodicity, self-probabilities and mixing time of a chain."""
    p, pi = np.asarray(transition, float), stationary(np.asarray(transition, float))
    reach = np.linalg.matrix_power((p > 0).astype(float) + np.eye(len(p)), len(p)) > 0
    power, mixed = np.eye(len(p)), None
    for t in range(1, steps + 1):
        power = power @ p
        if 0.5 * np.abs(power - pi).sum(1).max() <= distance:
            mixed = t
            break
    return {"stochastic": bool(np.allclose(p.sum(1), 1) and (p >= 0).all()), "irreducible": bool(reach.all()), "aperiodic": bool((np.diag(p) > 0).any()), "self_ok": bool((np.diag(p) < most_self).all()), "mixing_steps": mixed, "stationary": pi}


def align_labels(a: np.ndarray, b: np.ndarray, k: int) -> tuple[tuple[int, ...], float]:
    """The relabelling of b that agrees most with a, and the adjusted Rand index."""
    table = np.zeros((k, k))
    np.add.at(table, (a, b), 1)
    best = max(permutations(range(k)), key=lambda m: sum(table[m[j], j] for j in range(k)))
    pairs = lambda v: (v * (v - 1) / 2).sum()
    n, both, rows, columns = len(a), pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    expected, most = rows * columns / max(n * (n - 1) / 2, 1), (rows + columns) / 2
    return best, float((both - expected) / (most - expected)) if most != expected else 1.0


def bic(log_likelihood: float, n: int, k: int, d: int) -> float:
    """-2 LL + q ln n for a tied-covariance model of k states and d features."""
    return -2 * log_likelihood + ((k - 1) + k * (k - 1) + k * d + d * (d + 1) / 2) * np.log(n)


def fit_restarts(values: DataFrame, columns: list[str], k: int, restarts: int, seed: int, tied: bool = False) -> DataFrame:
    """All restarts, a task each: (restart, log_likelihood, iterations, converged, start, transition, means). values is a monthly history, some hundred rows."""
    rows = values.orderBy("period_index").select("segment_id", *columns).collect()
    x = np.array([r[1:] for r in rows], float)
    x = (x - x.mean(0)) / x.std(0)
    ids = np.array([r[0] for r in rows])
    lengths = np.diff(np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                f = canonical(fit_once(x, lengths, k, seed, i, tied=tied))
                yield pa.RecordBatch.from_pylist([{"restart": i, "log_likelihood": f["log_likelihood"], "iterations": f["iterations"], "converged": bool(f["converged"]), "start": f["start"].tolist(), "transition": f["transition"].tolist(), "means": f["means"].tolist()}], schema=pa.schema([("restart", pa.int64()), ("log_likelihood", pa.float64()), ("iterations", pa.int64()), ("converged", pa.bool_()), ("start", pa.list_(pa.float64())), ("transition", pa.list_(pa.list_(pa.float64()))), ("means", pa.list_(pa.list_(pa.float64())))]))

    spark = values.sparkSession
    return spark.range(0, restarts, 1, min(restarts, 8)).mapInArrow(run, "restart long, log_likelihood double, iterations long, converged boolean, start array<double>, transition array<array<double>>, means array<array<double>>")
