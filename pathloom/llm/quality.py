"""Quality classifier from weak labels: no hand labels are read.

1. Overlapping heuristic labellers vote good, bad or nothing on every document (``VOTES``: each a ratio of the text
   with a bound below which it says good and one above which it says bad).
2. The vote patterns of all documents are counted; there are at most 3**labellers of them, whatever the corpus. On
   the counts, expectation-maximisation estimates the share of good documents and each labeller's accuracy on good and
   on bad ones, labellers being independent given the class.
3. Each pattern's posterior is the weak label of its documents. On a bounded sample (``TRAIN_ROWS`` documents, the
   smallest hashes of doc_id and text) a linear scorer over hashed features, the labellers' ratios in steps, is
   trained against the posteriors.
4. The scorer, ``2**BITS`` weights, scores every whole document.

Defined results: null, empty and wordless texts score 0 and are rejected; equal texts score equal; rows that repeat
or lack a doc_id are scored each; an empty table gives no rows; other columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import textkit as tk

BITS = 12
TRAIN_ROWS = 20_000
STEPS = 40
#: labeller: (says good up to, says bad from), of a ratio named alike in ``ratios``.
VOTES = {
    "symbols": (0.05, 0.12),  # marks that prose seldom has, a word
    "capitals": (0.12, 0.2),  # of ASCII letters
    "broken": (0.12, 0.22),  # words that are not letters with one mark at the end at most
    "repeats": (0.05, 0.1),  # words that equal the one or two words before
    "few_kinds": (0.45, 0.72),  # how far distinct words fall short of the text's length
    "unmarked": (0.4, 0.8),  # how far commas and full stops fall short of one in twenty words
    "cells": (0.02, 0.08),  # vertical bars and doubled exclamation marks, a word
}
NAMES = list(VOTES)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


#: Byte kinds, looked up at once: bit 0 symbol, 1 capital, 2 ASCII letter, 3 part of a plain word, 4 comma or full stop.
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~!"]] |= 1
_KIND[65:91] |= 2 | 4 | 8
_KIND[97:123] |= 4 | 8
_KIND[128:] |= 8
_KIND[[ord("'"), ord("-"), *range(48, 58)]] |= 8
_KIND[[ord("."), ord(",")]] |= 16


def ratios(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """rows x labellers, and the word counts."""
    data, offsets = tk.text_bytes(batch_text)
    w = tk.Words(data, offsets)
    n, first = w.count, w.first
    kind = _KIND[data]
    of = {b: _per_row((kind >> b) & 1, offsets) for b in range(5)}
    words = n + 5  # short texts say less
    h, row = w.hashes(), w.rows()
    same = np.zeros(len(h), bool)
    for back in (1, 2):
        same[back:] |= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][fresh], minlength=len(n))
    few = np.where(n >= 20, 1 - np.log(np.maximum(kinds, 1)) / np.log(np.maximum(n, 2)), 0.0) * 2.2
    plain = np.concatenate([np.zeros(1, np.int64), np.cumsum((kind >> 3) & 1)])
    odd = (w.end - w.start) - (plain[w.end] - plain[w.start])
    last = np.zeros(len(h), bool) if not len(h) else ((kind[w.end - 1] >> 3) & 1) == 0
    broken = odd - last > 0
    broken |= last & (w.end - w.start == 1)
    double = np.zeros(len(data), bool)
    double[1:] = (data[1:] == 0x21) & (data[:-1] == 0x21)
    double |= data == 0x7C
    out = np.stack(
        [
            of[0] / words,
            of[1] / np.maximum(of[2], 1),
            _per_row(broken, first) / words,
            _per_row(same, first) / words,
            few,
            np.where(n >= 20, 1 - np.minimum(20 * of[4] / words, 1), 0.0),
            _per_row(double, offsets) / words,
        ],
        1,
    )
    return out, n


def votes(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """0 none, 1 good, 2 bad; rows x labellers."""
    lo, hi = (np.array([VOTES[k][i] for k in NAMES]) for i in (0, 1))
    v = np.where(x <= lo, 1, np.where(x >= hi, 2, 0))
    v[n == 0] = 2
    return v


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(NAMES)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """EM over the counted patterns: the posterior of good for each of all 3**labellers patterns."""
    m = len(NAMES)
    every = (np.arange(3**m)[:, None] // 3 ** np.arange(m)) % 3
    v = every[patterns]
    total = counts.sum()
    good = np.array([0.95, 0.3])[np.minimum((v == 2).sum(1), 1)]  # a start: any bad vote outweighs
    share, p = 0.5, None
    for _ in range(rounds):
        q = np.stack([good * counts, (1 - good) * counts])
        share = (q[0].sum() + 1) / (total + 2)
        p = np.stack([[((q[c][:, None] * (v == k)).sum(0) + 0.1) / (q[c].sum() + 0.3) for k in range(3)] for c in (0, 1)])  # class, vote, labeller
        ll = [np.log(p[c])[v, np.arange(m)].sum(1) for c in (0, 1)]
        good = 1 / (1 + np.exp(np.clip(np.log(1 - share) + ll[1] - np.log(share) - ll[0], -50, 50)))
    if p is None or not total:
        return np.full(3**m, 0.5)
    ll = [np.log(p[c])[every, np.arange(m)].sum(1) for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(np.log(1 - share) + ll[1] - np.log(share) - ll[0], -50, 50)))


def _features(x: np.ndarray) -> np.ndarray:
    """Hashed features: for each labeller the step its ratio stands on; rows x labellers of slots."""
    steps = np.minimum((x * STEPS).astype(np.int64), 2 * STEPS)
    return (tk.mix((steps + 1000 * np.arange(x.shape[1])).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def fit_scorer(slots: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft labels, full batches."""
    w, g2 = np.zeros(2**BITS + 1), np.full(2**BITS + 1, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w[slots].sum(1) + w[-1])))
        err = (p - target) / max(len(target), 1)
        g = np.bincount(slots.ravel(), np.repeat(err, slots.shape[1]), minlength=2**BITS + 1)
        g[-1] = err.sum()
        g += 1e-6 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(*ratios(batch.column(0)))), pa.int64())], ["pattern"])


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.chunks(batches):
        x, n = ratios(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pattern(votes(x, n)), pa.int64()), pa.array(list(_features(x)), pa.list_(pa.int64()))], ["o", "pattern", "slots"])


def fit(documents: DataFrame) -> np.ndarray:
    """The scorer's weights, from the documents alone."""
    text = documents.select("text")
    counted = text.mapInArrow(_vote_rows, "pattern long").groupBy("pattern").count().collect()  # at most 3**7 rows
    if not counted:
        return np.zeros(2**BITS + 1)
    posterior = fit_votes(np.array([r[0] for r in counted]), np.array([r[1] for r in counted], float))
    order = documents.select(F.xxhash64("doc_id", "text").alias("o"))
    last = order.orderBy("o").limit(TRAIN_ROWS).agg(F.max("o")).first()[0]
    sample = documents.select(F.xxhash64("doc_id", "text").alias("o"), "text").where(F.col("o") <= last)
    rows = sample.mapInArrow(_train_rows, "o long, pattern long, slots array<bigint>").select("o", "pattern", "slots").orderBy("o").limit(TRAIN_ROWS).collect()
    return fit_scorer(np.array([r[2] for r in rows]), posterior[np.array([r[1] for r in rows])])


def score_rows(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in tk.chunks(batches):
            x, n = ratios(batch.column(batch.schema.get_field_index("text")))
            score = np.where(n > 0, 1 / (1 + np.exp(-(w[_features(x)].sum(1) + w[-1]))), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "__quality"])

    return run


def scored(documents: DataFrame, *columns: str) -> DataFrame:
    """columns of documents, text among them, and __quality."""
    weights = documents.sparkSession.sparkContext.broadcast(fit(documents))  # 2**BITS numbers
    kept = documents.select(*columns)
    return kept.mapInArrow(score_rows(weights), kept.withColumn("__quality", F.lit(0.0)).schema)


def quality_scores(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher: better), accepted."""
    return scored(documents, "doc_id", "text").select("doc_id", F.col("__quality").alias("score"), (F.col("__quality") >= 0.5).alias("accepted"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, all columns kept."""
    return scored(documents, *documents.columns).where("__quality >= 0.5").drop("__quality")
