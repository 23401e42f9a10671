r"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

The model reads a text as its token sequence: words ``[^\x20\x09-\x0D]+``, A-Z lower-cased, each followed by a space,
the last one by a line feed, which is the end token (an empty text is the end alone). Every byte is eight binary
choices; each choice has a Krichevsky-Trofimov estimate under the preceding 0 to ``DEPTH`` bytes, and the estimates of
all depths are mixed by their context-tree weights, learned from the training documents.

The counts of all training documents' (DEPTH + 1)-byte strings are aggregated, in each task before the shuffle, and
all of them are the tree: what is gathered grows with the corpus, no context is left out. The strings are dealt by the
last ``SUFFIX`` bytes of their context, so a task holds whole subtrees: it mixes them from the deepest contexts up
(``subtree_rows``). The tree above, contexts of ``TOP`` bytes and less, is at most 2^(8 TOP) contexts of 255 choices at
any input size and is made on the driver; with it the tasks go down again and give each string its probability
(``string_rows``). Strings that stand in held-out documents alone are counted with zero, so they get theirs as well: a
bit's estimate is that of the deepest context that training has seen, so the probabilities of all bytes after a context
sum to one. ``score`` is the log10 probability, ``bits_per_byte`` the code length.

A text is scored by adding up its strings. The strings and tokens of highest counts, ``COMMON`` rows at most, are
looked up in broadcast tables; all others are joined.

Defined results: null and empty texts are the end token; rows are told apart by doc_id and text, repeated rows get
equal scores; a row without doc_id is learned from; without training rows every bit costs one bit and the base is
that of zero counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import textkit as tk
from pathloom.session import cut, drop_cut

DEPTH = 6
TOP, SUFFIX = 2, 3
#: Strings of whole suffixes that a task works on at a time, more only if one suffix has more.
RUN = 200_000
GRAM, WORD = 0, 1
#: Rows at most of the broadcast tables.
COMMON = {GRAM: 2**21, WORD: 2**19}
#: The end token's key among word hashes.
END = 1
#: Distinct strings that a task holds before it merges its counts.
HELD = 4_000_000
#: Bytes of text that a worker works on at a time.
CHUNK = 1_000_000


def canonical(data: np.ndarray, w: tk.Words, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The token bytes of all rows, each row after depth line feeds, and the rows' offsets (padding included)."""
    rows = len(w.count)
    start, end, last = w.start, w.end, w.first[1:] - 1
    empty = w.count == 0
    if empty.any():  # an empty row is a word without letters
        at = w.first[:-1][empty]
        start, end = np.insert(start, at, 0), np.insert(end, at, 0)
        last = np.cumsum(np.maximum(w.count, 1)) - 1
    size = end - start + 1
    row = np.repeat(np.arange(rows), np.maximum(w.count, 1))
    to = np.cumsum(size) - size
    n = int(size.sum())
    out = np.full(n + depth * rows, 10, np.uint8)
    place = to + depth * (row + 1)
    src = np.arange(n) + np.repeat(start - to, size)
    dst = np.arange(n) + np.repeat(place - to, size)
    src[to + size - 1] = 0
    out[dst] = tk.LOWER[data[src]] if len(data) else 10
    out[place + size - 1] = 32
    out[(place + size - 1)[last]] = 10
    length = np.bincount(row, size, minlength=rows).astype(np.int64) + depth
    return out, np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])


def keys(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each byte and the depth before it as one integer, the byte itself lowest; starts at the depth-th byte."""
    n = len(text) - depth
    out = text[depth:].astype(np.int64)
    for j in range(1, depth + 1):
        out |= text[depth - j : depth - j + n].astype(np.int64) << (8 * j)
    return out


def _valid(offsets: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    """Which keys stand in a row, not in its padding."""
    ok = np.ones(n, bool)
    for j in range(depth):
        ok[(offsets[1:-1] - depth + j)[(offsets[1:-1] - depth + j) >= 0]] = False
    return ok


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    if not len(values):
        return values, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(np.append(at, len(values))) if weights is None else np.add.reduceat(weights, at)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, held) to (kind, key, n): a task's distinct byte strings and words with their counts; held texts count zero."""
    held: dict[int, list] = {GRAM: [], WORD: []}

    def flush(kind: int) -> pa.RecordBatch:
        k, n = _counted(np.concatenate([x[0] for x in held[kind]]), np.concatenate([x[1] for x in held[kind]]))
        held[kind] = [(k, n)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n)], ["kind", "key", "n"])

    for whole in tk.chunks(batches, limit=CHUNK):
        out = whole.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for counts, batch in ((1, whole.filter(pa.array(~out))), (0, whole.filter(pa.array(out)))):
            if not batch.num_rows:
                continue
            data, offsets = tk.text_bytes(batch.column(0))
            w = tk.Words(data, offsets)
            text, at = canonical(data, w)
            k = keys(text)
            for kind, found in ((GRAM, k[_valid(at, len(k))]), (WORD, np.append(w.hashes().view(np.int64), np.full(batch.num_rows, END)))):
                own, n = _counted(found)
                held[kind].append((own, n * counts))
        for kind in (GRAM, WORD):
            if sum(len(x[0]) for x in held[kind]) > HELD:
                full = flush(kind)
                if full.num_rows > HELD // 2:
                    yield full
                    held[kind] = []
    for kind in (GRAM, WORD):
        if held[kind]:
            yield flush(kind)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series after a shift by seven."""
    y = x + 7
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(low)


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def _below(ids: np.ndarray, d: int, bit: int) -> np.ndarray:
    """The node of d context bytes above each node of one byte more: the same choice, the oldest byte left out."""
    return ids & ((1 << (8 * d + bit)) - 1)


class Level:
    """The nodes of one depth and bit: id (context and the bits before), counts, weight of the own estimate, mixture."""

    def __init__(self, k: np.ndarray, n: np.ndarray, d: int, bit: int):
        self.ids, self.at = np.unique((k & ((1 << (8 * (d + 1))) - 1)) >> (8 - bit), return_inverse=True)
        self.ones = np.bincount(self.at, n * ((k >> (7 - bit)) & 1), minlength=len(self.ids))
        self.all = np.bincount(self.at, n, minlength=len(self.ids))
        self.own = _kt(self.all - self.ones, self.ones)
        self.p = (self.ones + 0.5) / (self.all + 1)

    def mix(self, below: np.ndarray | None) -> None:
        """below: log evidence of the children's mixtures, None for the deepest contexts."""
        if below is None:
            self.weight, self.mixed = np.ones(len(self.ids)), self.own
        else:
            self.weight = 1 / (1 + np.exp(np.clip(below - self.own, -700, 700)))
            self.mixed = np.logaddexp(self.own, below) - np.log(2)


def _levels(k: np.ndarray, n: np.ndarray, bit: int, first: int, last: int, deeper: tuple[np.ndarray, np.ndarray] | None = None) -> list[Level]:
    """The levels of depths first to last, mixed from the last up. deeper: ids of depth last and the evidence below them."""
    out: list[Level] = []
    for d in range(last, first - 1, -1):
        level = Level(k, n, d, bit)
        below = None
        if out:
            below = np.bincount(np.searchsorted(level.ids, _below(out[0].ids, d, bit)), out[0].mixed, minlength=len(level.ids))
        elif deeper is not None:
            below = np.zeros(len(level.ids))
            below[np.searchsorted(level.ids, deeper[0])] = deeper[1]
        level.mix(below)
        out.insert(0, level)
    return out


class Down:
    """From the root down: what the contexts so far predict (done), the weight that is left, and each string's own
    prediction by the deepest context that training has seen."""

    def __init__(self, n: int):
        self.done, self.left, self.value = np.zeros(n), np.ones(n), np.full(n, 0.5)

    def step(self, p: np.ndarray, weight: np.ndarray, seen: np.ndarray) -> None:
        self.value = np.where(seen, self.done + self.left * p, self.value)
        self.done, self.left = self.done + self.left * weight * p, self.left * (1 - weight)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, n), rows in order of their suffix, in runs of whole suffixes."""
    mask = (1 << (8 * SUFFIX)) - 1
    k, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        k, n = np.append(k, batch.column(0).to_numpy()), np.append(n, batch.column(1).to_numpy())
        if len(k) >= RUN:
            suffix = (k >> 8) & mask
            full = int(np.flatnonzero(suffix != suffix[-1])[-1]) + 1 if suffix[0] != suffix[-1] else 0
            if full:
                yield k[:full], n[:full]
                k, n = k[full:], n[full:]
    if len(k):
        yield k, n


def subtree_rows(depth: int = DEPTH):
    """(key, n) by suffix to (node, mixed): log evidence below each context of TOP bytes and choice; node ends in the bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _suffixes(batches):
            k, n = k[n > 0], n[n > 0]
            for bit in range(8):
                first = _levels(k, n, bit, TOP + 1, depth)[0]
                ids, at = np.unique(_below(first.ids, TOP, bit), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids << 3 | bit), pa.array(np.bincount(at, first.mixed, minlength=len(ids)))], ["node", "mixed"])

    return run


def top_tables(k: np.ndarray, n: np.ndarray, node: np.ndarray, mixed: np.ndarray) -> list[list[tuple[np.ndarray, ...]]]:
    """Per bit: of each depth up to TOP the node ids, what holds above them (done, left), their estimate and weight."""
    out = []
    for bit in range(8):
        own = (node & 7) == bit
        order = np.argsort(node[own])
        out.append([(x.ids, x.p, x.weight) for x in _levels(k, n, bit, 0, TOP, (node[own][order] >> 3, mixed[own][order]))])
    return out


def string_logs(k: np.ndarray, n: np.ndarray, top: list, depth: int = DEPTH) -> np.ndarray:
    """ln probability of each string's byte after its context; k holds whole suffixes."""
    logs = np.zeros(len(k))
    for bit in range(8):
        down = Down(len(k))
        for d, (ids, p, weight) in enumerate(top[bit]):
            if not len(ids):
                continue
            node = (k & ((1 << (8 * (d + 1))) - 1)) >> (8 - bit)
            at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
            seen = ids[at] == node
            down.step(np.where(seen, p[at], 0.5), np.where(seen, weight[at], 0.0), seen)
        for level in _levels(k, n, bit, TOP + 1, depth):
            seen = level.all[level.at] > 0
            down.step(level.p[level.at], np.where(seen, level.weight[level.at], 0.0), seen)
        logs += np.log(np.where((k >> (7 - bit)) & 1, down.value, 1 - down.value))
    return logs


def string_rows(top, depth: int = DEPTH):
    """(key, n) by suffix to (key, n, value): log10 probability of the byte after its context. top: a broadcast top_tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _suffixes(batches):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(string_logs(k, n, top.value, depth) / np.log(10))], ["key", "n", "value"])

    return run


class Lookup:
    """Values by 64-bit key: two tables addressed by hash, the few that collide in both by binary search."""

    def __init__(self, k: np.ndarray, values: np.ndarray):
        bits = max(int(np.ceil(np.log2(max(len(k), 1)))) + 1, 4)
        self.parts = []
        rest = np.arange(len(k))
        for shift, mult in ((64 - bits, tk.MIX1), (64 - bits + 2, tk.MIX2)):
            slot = self._slot(k[rest], mult, shift)
            owner = np.full(1 << (64 - shift), -1)
            owner[slot] = rest
            held = owner >= 0
            at, to = np.full(len(owner), np.iinfo(np.int64).min), np.zeros(len(owner))
            at[held], to[held] = k[owner[held]], values[owner[held]]
            self.parts.append((mult, shift, at, to))
            rest = rest[owner[slot] != rest]
        order = rest[np.argsort(k[rest])]
        self.rest = (k[order], values[order])

    @staticmethod
    def _slot(k: np.ndarray, mult: np.uint64, shift: int) -> np.ndarray:
        u = k.view(np.uint64) * tk.GOLDEN
        return (((u ^ (u >> np.uint64(32))) * mult) >> np.uint64(shift)).astype(np.int64)

    def __call__(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and the places of keys that have none."""
        mult, shift, at, to = self.parts[0]
        slot = self._slot(k, mult, shift)
        out = to[slot]
        missing = np.flatnonzero(at[slot] != k)
        mult, shift, at, to = self.parts[1]
        slot = self._slot(k[missing], mult, shift)
        out[missing] = to[slot]
        missing = missing[at[slot] != k[missing]]
        if len(self.rest[0]) and len(missing):
            i = np.minimum(np.searchsorted(self.rest[0], k[missing]), len(self.rest[0]) - 1)
            hit = self.rest[0][i] == k[missing]
            out[missing[hit]] = self.rest[1][i[hit]]
            missing = missing[~hit]
        return out, missing


def score_rows(common):
    """(rk, doc_id, text) to what the broadcast tables know of the text, and the keys of what they don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tokens = common.value
        for batch in tk.chunks(batches, limit=CHUNK):
            data, offsets = tk.text_bytes(batch.column(2))
            w = tk.Words(data, offsets)
            text, at = canonical(data, w)
            k = keys(text)
            ok = _valid(at, len(k))
            logs, gone = grams(k)
            gone = gone[ok[gone]]
            gone.sort()
            logs[~ok] = 0.0
            logs[gone] = 0.0
            words = np.insert(w.hashes().view(np.int64), w.first[1:], END)
            base, rare = tokens(words)
            rare.sort()
            base[rare] = 0.0
            row = np.repeat(np.arange(batch.num_rows), w.count + 1)
            lists = []
            for keys_, places, starts in ((words, rare, np.append(w.first[:-1] + np.arange(batch.num_rows), len(words))), (k, gone, np.append(at[:-1], len(k)))):
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(places, starts), pa.int32()), pa.array(keys_[places])))
            score = np.add.reduceat(logs, at[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(w.count + 1), pa.array(np.bincount(row, minlength=batch.num_rows) - np.bincount(row[rare], minlength=batch.num_rows)),
                 pa.array(np.bincount(row, base, minlength=batch.num_rows)), pa.array(score), pa.array(np.diff(at) - DEPTH), *lists],
                ["rk", "doc_id", "n_tokens", "n_common", "base_common", "score_common", "n_bytes", "rare", "open"],
            )

    return run


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got[n].combine_chunks().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, got[n].type.to_pandas_dtype()) for n in names]


def _step() -> F.Column:
    """Counts in whole steps of an eighth of a power of two."""
    return F.floor(8 * F.log2(F.greatest("n", F.lit(0.5))))


def _least(table: DataFrame, most: int) -> int:
    """The step from which on no more than most rows remain."""
    taken = 0
    for step, m in sorted(((r[0], r[1]) for r in table.groupBy(_step()).count().collect()), reverse=True):
        taken += m
        if taken > most:
            return step + 1
    return -9


def language_model_scores(documents: DataFrame, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    context = documents.sparkSession.sparkContext
    docs = documents.select(F.xxhash64("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    # the kernel has added up what a task can hold, so rows are dealt first and hashed once
    found = docs.select("text", held.alias("held")).mapInArrow(count_rows, "kind byte, key long, n long").repartition("kind", "key")
    counts = cut(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where(f"kind = {WORD}").select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    suffix = F.shiftright("key", 8).bitwiseAND((1 << (8 * SUFFIX)) - 1)
    strings = counts.where(f"kind = {GRAM}").select("key", "n", suffix.alias("suffix")).repartition("suffix").sortWithinPartitions("suffix").select("key", "n")
    node, mixed = _arrays(strings.mapInArrow(subtree_rows(), "node long, mixed double").groupBy("node").agg(F.sum("mixed").alias("mixed")), "node", "mixed")
    short = counts.where(f"kind = {GRAM} AND n > 0").groupBy(F.col("key").bitwiseAND((1 << (8 * (TOP + 1))) - 1).alias("key")).agg(F.sum("n").alias("n"))
    top = context.broadcast(top_tables(*_arrays(short, "key", "n"), node, mixed))
    logs = strings.mapInArrow(string_rows(top), "key long, n long, value double").select(F.lit(GRAM).cast("byte").alias("kind"), "key", "n", "value")
    floor = total + 0.5 * (kinds + 1)
    values = cut(logs.unionByName(words.select(F.lit(WORD).cast("byte").alias("kind"), "key", "n", F.log10((F.col("n") + 0.5) / F.lit(floor)).alias("value"))))
    drop_cut(counts)
    often = {GRAM: F.col("kind") == GRAM, WORD: (F.col("kind") == WORD) & (F.col("n") > 0)}
    often = {kind: own & (_step() >= _least(values.where(own), COMMON[kind])) for kind, own in often.items()}
    common = context.broadcast(tuple(Lookup(*_arrays(values.where(often[kind]), "key", "value")) for kind in (GRAM, WORD)))
    schema = "rk long, doc_id long, n_tokens long, n_common long, base_common double, score_common double, n_bytes long, rare array<bigint>, open array<bigint>"
    scored = cut(docs.select("rk", "doc_id", "text").mapInArrow(score_rows(common), schema))
    asked = [scored.select("rk", F.lit(kind).cast("byte").alias("kind"), F.explode(name).alias("key")) for kind, name in ((WORD, "rare"), (GRAM, "open"))]
    rest = values.where(~(often[GRAM] | often[WORD]))
    copies = scored.groupBy("rk").agg(F.count("*").alias("copies"))
    is_word = F.col("kind") == WORD
    found = asked[0].unionByName(asked[1]).join(rest, ["kind", "key"]).groupBy("rk").agg(
        F.sum(F.when(is_word, F.col("value"))).alias("base_rest"), F.sum(F.when(~is_word, F.col("value"))).alias("score_rest"), F.count_if(is_word & (F.col("n") > 0)).alias("n_rest")
    )
    # equal rows have asked for the same keys as often as they stand there
    found = found.join(copies, "rk").select("rk", *((F.col(c) / F.col("copies")).alias(c) for c in ("base_rest", "score_rest")), (F.col("n_rest") / F.col("copies")).cast("long").alias("n_rest"))
    out = scored.drop("rare", "open").join(found, "rk", "left")
    zero = F.lit(0)
    score = F.col("score_common") + F.coalesce("score_rest", F.lit(0.0))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_common") + F.coalesce("n_rest", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_common") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
