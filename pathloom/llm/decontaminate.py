r"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. An item's windows are its runs of ``WINDOW``
consecutive words; an item of fewer words, but not none, is one window. Of every window the smallest hash of its
``GRAM``-word grams is kept as fingerprint, on both sides by the same rule, so two equal windows always share one:
the join of fingerprints misses no shared span of ``WINDOW`` words. Items shorter than that are joined by their
whole word sequence, one length class at a time (at most ``WINDOW`` - 1 classes).

Two passes over the documents: the first keeps only fingerprints (no positions) and finds the rows that share any
with the benchmark; the second takes those rows alone, with positions, and extends every hit word by word to both
sides. A hit that reaches ``WINDOW`` words, or a short item's length, marks its words. Benchmark fingerprints are
broadcast only if their counted number is at most ``BROADCAST_ROWS``; beyond, the joins shuffle.

Defined results: null or wordless texts have no words and no hits; null or empty items match nothing; rows are
told apart by doc_id and text together, so repeated rows each get their result and a repeated doc_id with another
text is another document; a null doc_id is kept; item ids of items with equal words are all reported; an empty
benchmark leaves every document clean; other columns are ignored or, in ``drop_contaminated``, passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut

WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), "")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _grams(length: int, gram: int) -> Column:
    """Hashes of all gram-word runs, from the words' own hashes in column wh."""
    h = lambda x, i: F.xxhash64(F.lit(length), x, *[F.get("wh", i + j) for j in range(1, gram)])
    return F.transform(F.slice("wh", 1, F.greatest(F.col("n") - (gram - 1), F.lit(0))), h)


# explode_outer and a filter after it, not explode: from explode, the optimizer infers a filter on the array's size and
# pushes it to the scan with every lambda below it inlined, which makes the work quadratic in a text's length.
def _hashed(df: DataFrame, length: int, gram: int) -> DataFrame:
    return df.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("g", _grams(length, gram))


def _least(i: Column, x: Column, width: int) -> Column:
    return x if width == 1 else F.least(x, *[F.get("g", i + j) for j in range(1, width)])


def fingerprints(df: DataFrame, length: int, gram: int) -> DataFrame:
    """df (.., w, n): column f, the distinct smallest gram hashes of all windows of length words."""
    width = length - gram + 1
    windows = F.slice("g", 1, F.greatest(F.col("n") - (length - 1), F.lit(0)))
    return _hashed(df, length, gram).withColumn("f", F.array_distinct(F.transform(windows, lambda x, i: _least(i, x, width))))


def marks(df: DataFrame, length: int, gram: int, keep: list[str]) -> DataFrame:
    """keep, h, p and around: every selected gram with its word position and the words around it."""
    width = length - gram + 1
    windows = F.slice("g", 1, F.greatest(F.col("n") - (length - 1), F.lit(0)))
    df = _hashed(df, length, gram).withColumn("m", F.transform(windows, lambda x, i: _least(i, x, width)))
    # a window's selected gram is the first of its grams that holds the smallest hash
    first = F.coalesce(*[F.when(F.get("g", F.col("s") + j) == F.col("h"), F.col("s") + j) for j in range(width)])
    df = df.select(*keep, "w", "g", F.posexplode_outer("m").alias("s", "h")).where("h IS NOT NULL").select(*keep, "h", first.alias("p"), "w")
    around = F.array(*[F.get("w", F.col("p") + j) for j in range(-(length - gram), length)])
    return df.select(*keep, "h", "p", around.alias("around")).distinct()


def _reach(length: int, gram: int) -> tuple[Column, Column]:
    """Equal words to the left of the gram and from its start on, in the two contexts d and b."""
    left, right = length - gram, length
    same = lambda j: F.coalesce(F.get("d", F.lit(left + j)) == F.get("b", F.lit(left + j)), F.lit(False))

    def run(steps: list[int]) -> Column:
        out = F.lit(len(steps))
        for k in reversed(range(len(steps))):
            out = F.when(~same(steps[k]), F.lit(k)).otherwise(out)
        return out

    return run([-j for j in range(1, left + 1)]), run(list(range(right)))


def hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs (rk, w, n), bench (item_id, w, n): per contaminated rk the count of hit words and the sorted item ids."""
    classes = sorted({min(r[0], WINDOW) for r in bench.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect() if r[0]})
    found = None
    for length in classes:
        gram = GRAM if length == WINDOW else length
        items = bench.where(F.col("n") >= WINDOW if length == WINDOW else F.col("n") == length)
        seeds = cut(marks(items, length, gram, ["item_id"]).groupBy("h", F.col("around").alias("b")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items")))
        keys = _bounded(seeds.select("h").distinct())
        shared = fingerprints(docs, length, gram).select("rk", F.explode_outer("f").alias("h")).where("h IS NOT NULL").join(keys, "h", "left_semi").select("rk").distinct()
        shared = cut(shared)
        near = docs.join(_bounded(shared), "rk", "left_semi")
        own = marks(near, length, gram, ["rk"]).withColumnRenamed("around", "d")
        left, right = _reach(length, gram)
        met = own.join(_bounded(seeds), "h").select("rk", "p", "items", left.alias("l"), right.alias("r"))
        met = met.where((F.col("r") >= gram) & (F.col("l") + F.col("r") >= length))
        met = met.select("rk", (F.col("p") - F.col("l")).alias("a"), (F.col("p") + F.col("r")).alias("z"), "items")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.select("rk", F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    # one document's intervals at a time: bounded by the document's own length
    spans = found.groupBy("rk", "a").agg(F.max("z").alias("z"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    union = lambda s, x: F.struct((s["n"] + F.greatest(x["z"] - F.greatest(x["a"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["z"]).alias("to"))
    return spans.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select(
        "rk", F.aggregate("x", start, union)["n"].alias("n_hit"), "items"
    )


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: rk, doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = documents.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    bench = cut(benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0 AND item_id IS NOT NULL").distinct())
    found = hits(docs.select("rk", "w", "n"), bench)
    d, f = docs.select("rk", "doc_id", "n").alias("d"), found.alias("f")
    all_ = d.join(f, F.col("d.rk") == F.col("f.rk"), "left")
    n_hit = F.coalesce("f.n_hit", F.lit(0)).cast("long")
    items = F.coalesce("f.items", F.array().cast("array<string>"))
    return all_.select(
        "d.rk", "d.doc_id", F.col("d.n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all their columns kept."""
    keyed = documents.select(F.xxhash64("doc_id", "text").alias("rk"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    bench = cut(benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0 AND item_id IS NOT NULL").distinct())
    bad = _bounded(cut(hits(keyed, bench).select(F.col("rk").alias("__rk"))))
    return documents.join(bad, F.xxhash64(documents["doc_id"], documents["text"]) == bad["__rk"], "left_anti")
