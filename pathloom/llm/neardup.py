r"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set holds its distinct ``SHINGLE``-word shingles (words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z;
fewer words: the whole sequence as one). Its sketch is the ``K`` smallest shingle hashes. Documents with equal sets
form a class at once, so copies are never paired. Words and threshold below are op8's; the pipeline's stage takes
``STAGE_SHINGLE`` words and ``STAGE_PERCENT`` % (``SHARED`` stands for ``shared_least``). Between classes:

1. Inverted lists of the retained values. Values that one class alone retains are dropped. Linked sets (Jaccard
   index of 0.85 or more) share at least ``SHARED`` of ``K`` values except with a probability under 1e-7 (sets of
   up to ``K`` shingles: never fewer than 85 %), so classes with fewer shared values have no partner. Those with
   enough take the same test on their whole sets, where a link needs 85 % of either set: of its s shared values a
   class of n shingles needs only the rarest s - 0.85 n + 1 as keys. A passage, line or word that very many
   documents share gives no list unless it is nearly all of a document.
2. In each list all members are compared with one leader, then, in later rounds, those still outside the leader's
   component with another one, until what is left can be paired directly. A list whose members are one component
   is finished: a group of thousands of near-copies costs a few comparisons a member, not all pairs, and no link
   that would join two components is left out.
3. The union sketch's estimate filters the pairs; the full sets verify what passes.

Defined results: null, empty or wordless texts have an empty set and link with nothing; equal texts, repeated rows
included, share a component; rows that repeat a doc_id count as one document; a row without doc_id takes no part
(component null, kept); other columns are ignored, or kept by ``drop_near_copies``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import bitmap
from pathloom.llm import textkit as tk
from pathloom.llm.components import components
from pathloom.session import cut, drop_cut

SHINGLE = 3
K = 48
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The same for the stage of the pipeline, which is not bound to the query's contract.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
#: Leader rounds at most; beyond them whatever is left is paired directly, however much it is.
ROUNDS = 4
#: Open lists of a class up to which its keys travel with it in the closing join.
KEYS = 64


def shared_least(percent: int, k: int = K) -> int:
    """How many of k sketch values linked sets share, except with a probability under 1e-7."""
    p, below, m = percent / 100, 0.0, 0
    while (below := below + comb(k, m) * p**m * (1 - p) ** (k - m)) < 1e-7:
        m += 1
    return m


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tk.text_bytes(batch.column(1))
    words = tk.Words(data, offsets)
    values, at = tk.shingles(words.hashes(), words.first, shingle)
    return tk.distinct_sorted(values.view(np.int64), at)


def sketch_rows(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, k: int = K) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, s1, s2, sketch): set size, 128-bit set signature, k smallest hashes."""
    for batch in tk.chunks(batches):
        values, at = _sets(batch, shingle)
        n = np.diff(at)
        u = values.view(np.uint64)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(u ^ salt), dtype=np.uint64)]) for salt in (np.uint64(1), np.uint64(2))]
        sig = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
        size = np.minimum(n, k)
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        pick = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], size)
        lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(values[pick], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig[0]), pa.array(sig[1]), lists], ["doc_id", "n", "s1", "s2", "sketch"])


def set_rows(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (node, hashes): the whole set as sorted 8-byte integers."""
    for batch in tk.chunks(batches):
        values, at = _sets(batch, shingle)
        blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), blob], ["node", "hashes"])


def value_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes) to (node, n, v): the sets' values one by one."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            size = np.fromiter((len(x.as_buffer()) // 8 for x in part.column(1)), np.int64, part.num_rows)
            values = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(values)], ["node", "n", "v"])


def verify_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.int64), np.frombuffer(y[i].as_buffer(), np.int64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * inter >= percent * (len(p) + len(q) - inter)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    return run


def _likely(a: str, b: str, percent: int) -> F.Column:
    """The union sketch's estimate is not below what a link can show."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return (F.col("__size") < K) & (100 * both >= percent * F.col("__size")) | (F.col("__size") >= K) & (both >= shared_least(percent))


def near_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = cut(docs.mapInArrow(partial(sketch_rows, shingle=shingle), "doc_id long, n long, s1 long, s2 long, sketch array<bigint>"))
    named = sketches.where("n > 0 AND doc_id IS NOT NULL")
    # the sketches of a class are equal: any of them stands for it
    classes = cut(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    members = cut(named.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep"))
    row_sizes = cut(sketches.select("doc_id", F.col("n").alias("n_shingles")))
    drop_cut(sketches)
    nodes = classes.select(F.col("rep").alias("node"), "n", "sketch")
    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    need = F.least(F.lit(shared_least(percent)), F.ceil(F.col("n") * percent / 100).cast("int"))
    shared = values.join(often.select("v"), "v").groupBy("node", "n").agg(F.count("*").alias("s"))
    near = cut(shared.where(F.col("s") >= need).select("node"))
    sketch_of = cut(nodes.join(near, "node", "left_semi").select("node", "sketch"))
    drop_cut(classes)
    sets = cut(bitmap.possible(docs, "doc_id", near, "node").join(near.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(partial(set_rows, shingle=shingle), "node long, hashes binary").dropDuplicates(["node", "hashes"]))
    # the same filter once more on the whole sets of those that passed, where it is exact and far sharper
    full = sets.mapInArrow(value_rows, "node long, n long, v long")
    often = full.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    order = Window.partitionBy("node").orderBy("df", "v")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # mid: how much of a class others share; the copy nearest to all others of its group leads the group's lists
    ranked = full.join(often, "v").select(
        F.col("v").alias("key"), "node", "n", F.count("*").over(whole).alias("s"), F.row_number().over(order).alias("i"), F.sum(F.log2(F.col("df").cast("double"))).over(whole).alias("mid")
    )
    index = ranked.where((F.col("s") >= need) & (F.col("i") <= F.col("s") - need + 1)).select("key", "node", "n", "s", "i", F.round(F.col("mid") / F.col("n"), 6).alias("mid"))
    index = cut(index)
    made = [near, sketch_of, sets, index]

    def linked(pairs: DataFrame) -> DataFrame:
        x = cut(pairs.distinct())
        x_sketches, y_sketches = (bitmap.possible(sketch_of, "node", x, side).select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}")) for side in "ab")
        likely = x.join(x_sketches, "a").join(y_sketches, "b")
        likely = cut(likely.withColumn("__size", F.least(F.size(F.array_union("sa", "sb")), F.lit(K))).where(_likely("sa", "sb", percent)).select("a", "b"))
        # whole sets travel only where a pair needs them
        x_sets, y_sets = (bitmap.possible(sets, "node", likely, side).select(F.col("node").alias(side), F.col("hashes").alias(to)) for side, to in ("ax", "by"))
        links = cut(likely.join(x_sets, "a").join(y_sets, "b").select("a", "b", "x", "y").mapInArrow(verify_rows(percent), "a long, b long"))
        drop_cut(x), drop_cut(likely)
        return links

    def may_link(x: str, y: str) -> F.Column:
        """Two members of a list can be linked at all: by their shared values, and by the place of this key among them."""
        n, s, i = ([F.col(f"{side}.{c}") for side in (x, y)] for c in "nsi")
        least = F.ceil((n[0] + n[1]) * percent / (100 + percent))  # values that linked sets of these sizes share
        return (F.least(*s) >= least) & (i[0] <= s[0] - least + 1) & (i[1] <= s[1] - least + 1) & (100 * F.least(*n) >= percent * F.greatest(*n))

    comp: DataFrame | None = None
    before: DataFrame | None = None
    own = ["key", "node", "n", "s", "i", "mid", "comp"]
    rows = index.withColumn("comp", F.col("node"))
    room = (100 + percent) * F.col("s") - percent * F.col("n")  # a member links with sets of room / percent values at most
    for turn in range(ROUNDS + 1):
        # one leader a list, the most shared class; it is compared with all others and retired
        lead = rows.groupBy("key").agg(
            F.max_by(F.struct("node", "n", "s", "i", "comp"), F.struct("mid", "node")).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min("n").alias("least_n"), F.max(room).alias("most_room"),
        )
        alive = (percent * F.col("least_n") <= room) & (percent * F.col("n") <= F.col("most_room"))
        state = cut(rows.join(lead.where("lo < hi"), "key").where(alive).select(*own, "l"))
        if before is not None:
            drop_cut(before)
        before = state
        sizes = state.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("comp") != F.col("l.comp")).alias("m")).where("m > 0")
        rest = sizes.agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("size")).alias("pairs")).first()
        if not rest["m"]:
            break
        others = state.where("comp <> l.comp")
        last = turn == ROUNDS or (turn > 0 and rest["pairs"] <= 4 * rest["m"] + 100_000)
        if last:  # few are outside their list's main component: pair those with all
            # a pair of many common keys is met in the list of the rarest one only; sets of very many keys meet in each
            keys = state.groupBy("node").agg(F.count("*").alias("__m"), F.sort_array(F.collect_list(F.struct("i", "key"))).alias("keys")).where(f"__m <= {KEYS}").select("node", "keys.key")
            keys = keys.withColumnRenamed("key", "keys")
            o, s = others.join(keys, "node", "left").alias("o"), state.join(keys, "node", "left").alias("s")
            apart = (F.col("o.comp") < F.col("s.comp")) | (F.col("s.comp") == F.col("s.l.comp")) & (F.col("o.comp") != F.col("s.comp"))
            once = F.coalesce(F.get(F.array_intersect("o.keys", "s.keys"), F.lit(0)) == F.col("o.key"), F.lit(True))
            met = o.join(s, (F.col("o.key") == F.col("s.key")) & apart & may_link("o", "s") & once).select(F.least("o.node", "s.node").alias("a"), F.greatest("o.node", "s.node").alias("b"))
        else:
            met = others.alias("o").where(may_link("o", "o.l")).select(F.least("o.node", "o.l.node").alias("a"), F.greatest("o.node", "o.l.node").alias("b"))
        links = linked(met)
        here = state
        if links.limit(1).count():
            at = comp if comp is not None else index.select("node", F.col("node").alias("label")).distinct()
            ends = links.join(at.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a").join(at.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b")
            moved = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            after = cut(at.alias("c").join(moved.alias("m"), F.col("c.label") == F.col("m.node"), "left").select("c.node", F.coalesce("m.label", "c.label").alias("label")))
            comp = after
            here = here.drop("comp").join(comp.select("node", F.col("label").alias("comp")), "node")
        drop_cut(links)
        if last:
            break
        rows = here.where("node <> l.node").select(*own)
    base = members.select("doc_id", "rep").distinct()
    if comp is not None:
        base = base.join(comp.select(F.col("node").alias("rep"), "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("c"))
    else:
        base = base.select("doc_id", F.col("rep").alias("c"))
    found = cut(base.groupBy("doc_id").agg(F.min("c").alias("c")))
    for x in [*made, before, members]:
        drop_cut(x)
    return row_sizes.alias("s").join(found.alias("f"), F.col("s.doc_id") == F.col("f.doc_id"), "left").select(
        "s.doc_id", "s.n_shingles", F.coalesce("f.c", "s.doc_id").alias("component_id"), F.coalesce(F.coalesce("f.c", "s.doc_id") == F.col("s.doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_copies(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns kept."""
    out = near_components(documents, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    out = cut(out)
    some, none = bitmap.split(documents, "doc_id", out, "__gone")
    return some.join(out, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti").unionByName(none)
