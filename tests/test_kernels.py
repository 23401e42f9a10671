"""Numeric kernels against exact values and plain versions."""

import math

import numpy as np

from pathloom.operators import blocks, inference, regimes, simulation


def test_keyed_stream():
    # fixed values of the public generator
    want = [0.6396249948208429, 0.38678227036821944, 0.14734896911229223, 0.83354355799587376, 0.29601375576793598]
    assert simulation.uniforms(20260714, (1, 1, 6, 1, 1, 2), 5).tolist() == want


def test_traces_restart_for_the_right_reasons():
    source, links = np.array([0, 0, 1, 1, 0]), np.array([True, True, True, False, True])
    idx, why = simulation.conditioned_trace(np.array([0, 0, 1, 1, 1]), source, links, np.full(5, 0.9), np.zeros(5), 2.0)
    assert idx.tolist() == [0, 1, 2, 3, 2] and why == ["first", "continue", "state_change", "continue", "source_gap"]
    plain = simulation.bootstrap_trace(3, np.array([True, True, True]), np.array([0.9, 0.9, 0.9, 0.5]), np.full(4, 0.4), 2.0)
    assert plain.tolist() == [1, 2, 1, 2]  # the restart test is strict


def test_forward_backward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(1)
    e, start, p = rng.normal(size=(5, 2)), np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]])
    paths = {}
    for code in range(32):
        s = [(code >> t) & 1 for t in range(5)]
        paths[tuple(s)] = math.log(start[s[0]]) + sum(e[t, s[t]] for t in range(5)) + sum(math.log(p[a, b]) for a, b in zip(s, s[1:], strict=False))
    filtered, smooth, xi, ll = regimes.forward_backward(e, start, p)
    assert np.isclose(ll, np.logaddexp.reduce(list(paths.values()))) and np.isclose(xi.sum(), 4)
    assert regimes.viterbi(e, start, p).tolist() == list(max(paths, key=paths.get))
    one = sum(math.exp(v - ll) for k, v in paths.items() if k[2] == 1)
    assert np.isclose(math.exp(smooth[2, 1]), one) and np.allclose(np.exp(filtered).sum(1), 1)


def test_regimes_are_found():
    rng = np.random.default_rng(2)
    states = np.repeat([0, 1, 0, 1], 60)
    x = rng.normal(size=(240, 2)) * 0.5 + np.array([[-2, 0], [2, 1]])[states]
    fits = [regimes.canonical(regimes.fit_once(x, [240], 2, 7, i)) for i in range(4)]
    best = max(fits, key=lambda f: f["log_likelihood"])
    found = regimes.viterbi(regimes.log_emissions(x, best["means"], best["spread"]), best["start"], best["transition"])
    assert (found == states).mean() > 0.98 and regimes.align_labels(states, found, 2)[1] > 0.95
    assert np.allclose(regimes.stationary(best["transition"]) @ best["transition"], regimes.stationary(best["transition"]))
    assert regimes.chain_report(np.array([[0.9, 0.1], [0.2, 0.8]]))["irreducible"]


def test_binomial_interval():
    low, high = inference.clopper_pearson(5, 20)
    tail = lambda k, p: sum(math.comb(20, i) * p**i * (1 - p) ** (20 - i) for i in range(k, 21))
    assert abs(tail(5, low) - 0.025) < 1e-9 and abs(1 - tail(6, high) - 0.025) < 1e-9
    assert inference.clopper_pearson(0, 10)[0] == 0 and inference.clopper_pearson(10, 10)[1] == 1


def test_block_lengths():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=400)
    slow = noise.copy()
    for t in range(1, 400):
        slow[t] += 0.75 * slow[t - 1]
    one = np.zeros(400, int)
    assert blocks.automatic_length(noise, one) < blocks.automatic_length(slow, one) and blocks.combine([3.2, 40.0], "monthly") == 12


def plain_length(x, band, quiet, most):
    """Bandwidth by the definition, one lag at a time; correlations of a single segment."""
    z = (x - x.mean()) / x.std()
    rho = [abs(sum(z[k:] * z[: len(z) - k]) / math.sqrt(sum(z[k:] ** 2) * sum(z[: len(z) - k] ** 2))) for k in range(1, most + 1)]
    if all(r < band for r in rho):
        return 0
    for start in range(1, most - quiet + 2):
        if all(r < band for r in rho[start - 1 : start - 1 + quiet]):
            return start
    return max(k for k, r in enumerate(rho, 1) if r >= band)


def test_automatic_lengths_equal_the_definition():
    rng, seen = np.random.default_rng(5), set()
    for i in range(60):
        x = rng.normal(size=82)
        for t in range(1, 82):
            x[t] += (i % 5) * 0.2 * x[t - 1]
        quiet, n = 5, 82
        most = min(n - 1, math.ceil(math.sqrt(n)) + quiet)
        m = plain_length(x, 2 * math.sqrt(math.log10(n) / n), quiet, most)
        want = 1.0
        if m:
            z, width = (x - x.mean()) / x.std(), min(2 * m, most)
            gamma = [sum(z[k:] * z[: n - k]) / n for k in range(width + 1)]
            w = [1.0 if k / width <= 0.5 else 2 * (1 - k / width) for k in range(width + 1)]
            g = sum(2 * w[k] * k * gamma[k] for k in range(1, width + 1))
            d = 2 * (gamma[0] + sum(2 * w[k] * gamma[k] for k in range(1, width + 1))) ** 2
            want = min((2 * g * g * n / d) ** (1 / 3), math.ceil(min(3 * math.sqrt(n), n / 3)))
        got = blocks.automatic_length(x, np.zeros(n, int))
        assert math.isclose(got, want, rel_tol=1e-9), (i, m, got, want)
        seen.add(m)
    assert 0 in seen and 1 in seen and len(seen) > 3
    assert math.isclose(blocks.autocovariances(x, np.zeros(n, int), 3)[0][0], 1.0)
