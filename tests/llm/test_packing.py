"""Packing: the ids equal the tokenizers library's, pieces tile their documents, sequences are gapless and full."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pathloom.llm.packing import Bins, Encoder, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "Zs", "'s", "'re", "'ll", "'", "ve", " ", "  ", "\n", "\t", " ", " ", "1", "42", "é", "ß", "Ж", "!", "$$", "中", "\U0001f600", "<|endoftext|>", "\x1c", "\u0085", "²", "_"]


def test_encoder_equals_library():
    rng, fast, slow = random.Random(1), Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "a", "it's we're I'll '' 's's 'sure x's", *["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(1500)]]
    texts += ["".join(rng.choices(ALPHABET[:20], k=rng.randint(0, 60))) for _ in range(1500)]
    ids, at = fast.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_bins_take_the_tightest_fit_and_close_the_fullest():
    b = Bins(10, 2, 0)
    assert b.place(6) == (0, 0) and b.place(5) == (1, 0) and b.place(4) == (0, 6) and b.place(7) == (2, 0)
    assert b.place(8) == (3, 0)  # bins 1 (5 free) and 2 (3 free) were open: 2 was closed
    assert b.place(3) == (1, 5)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "hey", "x")] + [(i, "".join(rng.choices(ALPHABET, k=rng.choice([3, 300, 4000]))), "y") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = pack_documents(docs).toPandas()
    slow = Tokenizer.from_file(PATH)
    for doc, text, _ in rows[4:]:
        ids = np.array(slow.encode(text, add_special_tokens=False).ids + [2], "<u4")
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.start.iloc[0] == 0 and own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all() and (own.length <= 1024).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert len(got[got.doc_id == 2]) == 2 and got.doc_id.isna().sum() == 1
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset.values == np.concatenate([[0], np.cumsum(seq.length.values)[:-1]])).all() and seq.length.sum() <= 1024
    assert pack_documents(docs.limit(0)).count() == 0
