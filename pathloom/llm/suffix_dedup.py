"""Exact removal of repeated byte strings of ``SPAN`` bytes, on a sparse, hash-ordered suffix index.

A byte goes if it is covered by a SPAN-byte string that also starts anywhere else, the same document included. An
index of all suffixes (a suffix array per batch, geometrically merged) holds an entry for every byte of the corpus,
which at eight bytes an entry passes the disk bound before any merge. This index is sparse instead and ordered by the
hash of what follows an entry, in which equal neighbours are what long matches are in a suffix array:

1. Each SPAN-byte window elects one entry by its content alone: the ``GRAM``-byte gram of smallest hash in it. Windows
   that start next to each other and elect the same gram are one entry, (gram, context), the context being all bytes
   of its windows. There is an entry for every 60 bytes or so.
2. Entries are sorted by gram and context. A gram that occurs once has no repeated window. Equal contexts repeat as a
   whole: all their windows are repeated. What is left shares its gram but not its whole context.
3. The windows of what is left, and of one entry of each repeated context beside it, are compared one by one, by their
   own hashes. A window that meets an equal one is repeated.

Matches never cross documents; hashes have 64 bits, equal strings always have equal ones.

Defined results: null and empty texts have no bytes and lose none; texts are UTF-8 bytes whatever they say; repeated
rows repeat each other's strings; rows that share or lack a doc_id are judged each, told apart by a row number that
doc_id, text and their copies give; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import textkit as tk
from pathloom.session import cut, drop_cut

SPAN = 200
GRAM = 80
CHUNK = 2_000_000
_POS = 24
REPEATED, OPEN, WITNESS = 0, 1, 2


def _elected(g: np.ndarray, wide: int) -> np.ndarray:
    """Place of the smallest hash, the first of equals, of each run of wide hashes; in slices whose places fit _POS bits."""
    runs, most = len(g) - wide + 1, (1 << _POS) - wide + 1
    out = np.empty(runs, np.int64)
    for a in range(0, runs, most):
        z = min(a + most, runs)
        part = g[a : z + wide - 1]
        low = (part >> tk.U64(_POS) << tk.U64(_POS)) | np.arange(len(part), dtype=np.uint64)
        step = 1
        while 2 * step <= wide:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: z - a], low[wide - step : wide - step + z - a])
        out[a:z] = a + (low & tk.U64((1 << _POS) - 1)).astype(np.int64)
    return out


def entries(data: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, gram hash, context hash): windows lo..hi (starts, in data) elect the same gram."""
    n = len(data)
    if n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = tk.prefix_sums(data)
    m = n - gram + 1
    start = np.arange(m)
    g = tk.sum_hashes(sums, start, start + gram)
    pick = _elected(g, span - gram + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(pick)]
    fits = np.arange(len(pick)) + span <= at[1:][row]
    p = np.flatnonzero(fits)
    pick, row = pick[p], row[p]
    new = np.ones(len(p), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    lo = p[first]
    hi = p[np.append(first[1:], len(p)) - 1] if len(p) else lo
    context = tk.mix(tk.sum_hashes(sums, lo, hi + span) + (pick[first] - lo).astype(np.uint64) * tk.MIX1)
    return row[first], lo, hi, g[pick[first]].view(np.int64), context.view(np.int64)


def entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rk, text) to (rk, g, c, lo, n): entries with the place in their document and the count of windows."""
    for batch in tk.chunks(batches, limit=CHUNK):
        data, at = tk.text_bytes(batch.column(1))
        row, lo, hi, g, c = entries(data, at)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(g), pa.array(c), pa.array((lo - at[row]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32))],
            ["rk", "g", "c", "lo", "n"],
        )


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rk, text, x: list of (lo, n, sure)) to (rk, h, p, sure): every window of the entries, by its own hash."""
    for batch in tk.chunks(batches, limit=CHUNK):
        data, at = tk.text_bytes(batch.column(1))
        lists = batch.column(2)
        flat = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        lo, n, sure = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "n", "sure"))
        p = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        own = np.repeat(row, n)
        begin = at[own] + p
        h = tk.sum_hashes(tk.prefix_sums(data), begin, begin + SPAN).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(h), pa.array(p.astype(np.int32)), pa.array(np.repeat(sure, n))], ["rk", "h", "p", "sure"])


def removal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, x: list of (lo, n), y: copies): the digest of what stays of each text."""
    for batch in tk.chunks(batches, limit=CHUNK):
        data, at = tk.text_bytes(batch.column(1))
        size = np.diff(at)
        whole, lists = batch.column(3).to_pylist(), batch.column(2).to_pylist()
        removed, spans, digest = [], [], []
        for i in range(batch.num_rows):
            own = data[at[i] : at[i + 1]]
            if whole[i] and len(own) >= SPAN:  # the same text stands in another row
                removed.append(len(own)), spans.append(1), digest.append(hashlib.sha256(b"").hexdigest())
                continue
            gone = np.zeros(len(own) + 1, np.int32)
            for x in lists[i] or ():
                gone[x["lo"]] += 1
                gone[x["lo"] + x["n"] - 1 + SPAN] -= 1
            out = np.cumsum(gone[:-1]) > 0
            removed.append(int(out.sum()))
            spans.append(int((out[1:] & ~out[:-1]).sum() + out[:1].sum()))
            digest.append(hashlib.sha256(own[~out].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("rk"))
    # dealt by g once: windows over (g, c) that come first would deal all entries by both, and those over g again
    found = docs.select("rk", "text").mapInArrow(entry_rows, "rk long, g long, c long, lo int, n int").repartition("g")
    gram, context = Window.partitionBy("g"), Window.partitionBy("g", "c")
    counted = found.withColumn("m", F.count("*").over(context)).withColumn("least", F.min("m").over(gram)).withColumn("all", F.count("*").over(gram))
    counted = counted.withColumn("i", F.row_number().over(context.orderBy("rk", "lo"))).where("all > 1")
    kind = F.when(F.col("m") > 1, F.when((F.col("i") == 1) & (F.col("least") == 1), WITNESS).otherwise(REPEATED)).otherwise(OPEN)
    index = cut(counted.select("rk", "lo", "n", kind.alias("kind")))
    sure = F.col("kind") == WITNESS
    ask = index.where(F.col("kind") != REPEATED).groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("lo", "n", sure.alias("sure")))).alias("x"))
    # one entry of a repeated context keeps its verdict whatever its windows meet: it only bears witness
    text = docs.select("rk", "text").join(ask, "rk").select("rk", "text", "x")
    each = text.mapInArrow(window_rows, "rk long, h long, p int, sure boolean")
    met = each.withColumn("m", F.count("*").over(Window.partitionBy("h"))).where("m > 1 AND NOT sure").select("rk", F.col("p").alias("lo"), F.lit(1).alias("n"))
    # neighbouring windows of a document become one span again
    order = Window.partitionBy("rk").orderBy("lo")
    runs = met.distinct().withColumn("run", F.col("lo") - F.row_number().over(order)).groupBy("rk", "run").agg(F.min("lo").alias("lo"), F.count("*").cast("int").alias("n")).drop("run")
    spans = index.where(F.col("kind") != OPEN).select("rk", "lo", "n").unionByName(runs)
    lists = cut(spans.distinct().groupBy("rk").agg(F.collect_list(F.struct("lo", "n")).alias("x")))
    drop_cut(index)
    copies = docs.groupBy("rk").agg(F.count("*").alias("copies")).where("copies > 1").select("rk", F.lit(True).alias("y"))
    d = docs.join(lists, "rk", "left").join(copies, "rk", "left").select("doc_id", "text", "x", F.coalesce("y", F.lit(False)).alias("y"))
    return d.mapInArrow(removal_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
