"""Best-fit packing of tokenized documents into sequences of a fixed length.

Tokenizing: the byte-level BPE file's pre-tokenizer is evaluated with array operations over code points, each distinct
piece of a slice is encoded once (and remembered by the worker, in a table of bounded size), and the ids are put
together by gathers. Texts with characters outside the ranges that the array form knows, and texts holding a special
token's string, go through the tokenizers library as they are; so does everything in the test that compares both.

Packing: bounded-space online best-fit. Each task keeps at most ``OPEN`` open bins in a bitset keyed by free space. A
piece goes to the open bin with the least space that holds it; if none does, a new bin is opened, for which, at the
bound, the fullest bin is closed first. A slice's pieces are taken longest first. Tasks pack what they read, without
a shuffle, so a hot source is no hot task and a lost task is packed again alike.

Defined results: a null or empty text is the end id alone; documents longer than a sequence are cut into full pieces
with a shorter first one; rows that repeat, or share or lack a doc_id, are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm import textkit as tk

LENGTH = 1024
OPEN = 512
END_ID = 2
#: Pieces that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: The White_Space characters, and the code points below which categories are long settled.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
KNOWN = 0x0530
#: The pre-tokenizer's contractions.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def _classes() -> np.ndarray:
    out = np.full(KNOWN + 1, UNKNOWN, np.uint8)
    for c in range(KNOWN):
        kind = unicodedata.category(chr(c))
        out[c] = SPACE if c in SPACES else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else UNKNOWN if kind == "Cn" else OTHER
    return out


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.classes, self.seeds, self.memory = _classes(), tk.mix(np.arange(KNOWN + 1, dtype=np.uint64)), {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts and the offsets of each text's ids; no end ids."""
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, KNOWN)
        kind = self.classes[points]
        odd = np.zeros(len(texts), bool)
        if (unknown := np.flatnonzero(kind == UNKNOWN)).size:
            odd[np.searchsorted(offsets, unknown, "right") - 1] = True
        for s in self.special:
            odd |= np.fromiter((s in t for t in texts), bool, len(texts))
        start = self._starts(points, kind, offsets)
        end = np.append(start[1:], len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.seeds[points] * tk.powers(tk._BASE, len(points)), out=sums[1:])
        key = tk.mix((sums[end] - sums[start]) * tk.powers(tk._BASE_INV, len(points) + 1)[start] + (end - start).astype(np.uint64) * tk.GOLDEN)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        whole, memory, pieces = "".join(texts), self.memory, []
        for h, a, b in zip(distinct.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            ids = memory.get(h)
            if ids is None:
                ids = memory[h] = self.core.encode_single_piece(whole[a:b].encode("utf-8", "surrogatepass"))
            pieces.append(ids)
        length = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
        flat = np.fromiter((i for p in pieces for i in p), np.uint32, at[-1])
        long = length[which]
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(long)])
        ids = flat[np.arange(to[-1]) + np.repeat(at[which] - to[:-1], long)]
        bounds = to[np.searchsorted(start, offsets)]
        if not odd.any():
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.slow.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])])

    def _starts(self, points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokenizer's pieces start."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)  # a text starts here
        edge[offsets] = True
        space = kind == SPACE
        run = np.ones(n, bool)
        run[1:] = kind[1:] != kind[:-1]
        run |= edge[:n]
        blank = np.zeros(n, bool)  # the character before is U+0020, in the same text
        blank[1:] = points[:-1] == 0x20
        blank &= ~edge[:n]
        follows = np.zeros(n, bool)  # the character after is no space, in the same text
        follows[:-1] = ~space[1:]
        follows &= ~edge[1:]
        begin = run & (space | ~blank) | space & follows
        mark = np.flatnonzero((points == 0x27) & run & ~blank & ~edge[1:])
        for c in CONTRACTIONS:
            tail = [ord(x) for x in c[1:]]
            here = mark[mark + len(tail) < n]
            for j, x in enumerate(tail):
                here = here[(points[here + 1 + j] == x) & ~edge[here + 1 + j]]
            begin[here + 1] = False
            after = here + 1 + len(tail)
            after = after[after < n]
            begin[after[(kind[after] == LETTER) & ~edge[after]]] = True
        return np.flatnonzero(begin)


class Bins:
    """Open bins by free space: a bitset of the spaces that any open bin has, and the bins of each space."""

    def __init__(self, length: int, bound: int, first: int):
        self.length, self.bound, self.next, self.open, self.bits = length, bound, first, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset for a piece of this size."""
        fit = self.bits >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            found = self._take(space)
        else:
            if self.open == self.bound:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
            space, found = self.length, self.next
            self.next += 1
        left = space - size
        if left:
            self.by_space[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.length - space

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_rows(path: str | None, length: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(path or _default_path())
        bins = Bins(length, bound, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        for batch in tk.chunks(batches):
            ids, at = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            ids = np.insert(ids, at[1:], END_ID)
            at = at + np.arange(len(at))
            total = np.diff(at)
            pieces = -(-total // length)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = total - (pieces - 1) * length
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * length)
            size = np.where(piece == 0, head[row], length)
            blob, from_ = memoryview(ids.astype("<u4").view(np.uint8)), (at[row] + start) * 4
            crc = [zlib.crc32(blob[a : a + 4 * n]) for a, n in zip(from_.tolist(), size.tolist(), strict=True)]
            where = np.empty((len(row), 2), np.int64)
            for i in np.argsort(-size, kind="stable").tolist():
                where[i] = bins.place(int(size[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(where[:, 0]), pa.array(where[:, 1])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(documents: DataFrame, path: str | None = None, length: int = LENGTH, bound: int = OPEN) -> DataFrame:
    """path: the tokenizer's file, readable by every executor; by default that of the installed public tokenizers."""
    return documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(pack_rows(path, length, bound), SCHEMA)
