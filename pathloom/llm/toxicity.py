r"""Toxicity scorer: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Features of a text: its distinct
words, longer words' first ``PREFIXES`` bytes (stems that endings vary), word pairs and pairs with one word between, each hashed to one of ``2**BITS`` slots. FTRL-proximal keeps a
learning rate per coordinate and sets coordinates whose evidence stays under the L1 bound to exactly zero, so what is
broadcast for scoring is a short list of slots and weights (``2**BITS`` at most).

Training reads at most ``TRAIN_ROWS`` labelled documents, those with the smallest hashes of their doc_id among the
rows that may be learned from; they are featurised where they lie and stream through one task in a fixed order.

Defined results: a null, empty or wordless text gets the bias alone; labels that are null are not learned from,
repeated or contradicting labels all count; rows that repeat a doc_id are scored each; a row without doc_id is scored
and not held out; without any label every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import textkit as tk

BITS = 20
TRAIN_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
PREFIXES = (4, 5, 6)
#: True for bytes of a word: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def slots(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features' slots, row by row and with repeats, and the rows' offsets."""
    data, offsets = tk.text_bytes(text)
    w = tk.Words(data, offsets, IN_WORD)
    h, row = w.hashes(), w.rows()
    own, kinds = [row], [h]
    for size in PREFIXES:
        long = w.end - w.start > size
        own.append(row[long])
        kinds.append(w.hashes(prefix=size)[long] ^ tk.U64(size))
    for back, salt in ((1, 3), (2, 5)):
        same = row[back:] == row[:-back]
        own.append(row[back:][same])
        kinds.append((tk.mix(h[:-back] * tk.U64(salt)) + h[back:])[same])
    rows, values = np.concatenate(own), tk.mix(np.concatenate(kinds)) >> tk.U64(64 - BITS)
    order = np.argsort(rows, kind="stable")
    return values[order].astype(np.int32), np.searchsorted(rows[order], np.arange(len(offsets)))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, toxic, text) to (o, toxic, slots), each text's slots distinct."""
    for batch in tk.chunks(batches):
        values, at = slots(batch.column(2))
        lists = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["o", "toxic", "slots"])


class Ftrl:
    """FTRL-proximal with binary features; the bias is not regularised."""

    def __init__(self, size: int):
        self.z, self.n, self.bias = np.zeros(size), np.zeros(size), np.zeros(2)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def base(self) -> float:
        return -self.bias[0] * ALPHA / (BETA + np.sqrt(self.bias[1]))

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.base(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g
        b, m = self.base(), self.bias[1]
        self.bias += [g - (np.sqrt(m + g * g) - np.sqrt(m)) / ALPHA * b, g * g]


def learn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All training rows, in order, to one row: slots, weights, bias."""
    rows = [(s.values.to_numpy(), y) for b in batches for s, y in zip(b.column(2), b.column(1).to_pylist(), strict=True)]
    model = Ftrl(2**BITS)
    for _ in range(EPOCHS):
        for i, y in rows:
            model.learn(i, y)
    every = model.weights(np.arange(2**BITS))
    kept = np.flatnonzero(every).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([kept]), pa.array([every[kept]]), pa.array([model.base()])], ["slots", "weights", "bias"])


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and bias learned from the labelled documents among labels (doc_id, toxic)."""
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("o"))
    named = F.broadcast(named.orderBy("o", "doc_id", "toxic").limit(rows))
    # the bounded sample in one task, in a fixed order: the learner is sequential
    seen = documents.select("doc_id", "text").join(named, "doc_id").select("o", "toxic", "text").mapInArrow(feature_rows, "o long, toxic int, slots array<int>")
    got = seen.repartition(1).sortWithinPartitions("o", "toxic", "slots").mapInArrow(learn_rows, "slots array<int>, weights array<double>, bias double").collect()
    if not got:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return np.array(got[0][0], np.int32), np.array(got[0][1]), got[0][2]


def score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weights, bias = model.value
        table = np.zeros(2**BITS)
        table[kept] = weights
        for batch in tk.chunks(batches):
            values, at = slots(batch.column(1))
            hit = np.flatnonzero(table[values])
            row = np.searchsorted(at, hit, "right") - 1
            pair = np.unique((row.astype(np.int64) << BITS) | values[hit])  # each feature of a text counts once
            sums = np.bincount(pair >> BITS, table[pair & (2**BITS - 1)], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(sums + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def toxicity_scores(documents: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; the held-out fold's labels are not learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels.where(fold != held_fold)))  # 2**BITS weights at most
    scored = documents.select("doc_id", "text").mapInArrow(score_rows(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
