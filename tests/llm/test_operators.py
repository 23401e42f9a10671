"""Each operator against a plain version of itself on a small corpus with every odd row, and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def shingle_set(t):
    w = spaced(t)
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def test_near_components(spark, corpus, docs):
    from pathloom.llm.neardup import drop_near_copies, near_components

    sets = {i: shingle_set(t) for i, t in corpus if i is not None}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    got = near_components(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert near_components(docs.limit(0)).count() == 0


def test_sets_travel_only_where_a_pair_needs_them(spark, monkeypatch):
    from pathloom.llm import neardup

    rng, limited, possible = random.Random(12), set(), neardup.bitmap.possible
    text = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(0, " ".join(text)), (1, " ".join(text[:-1])), (2, " ".join(reversed(text)))]
    monkeypatch.setattr(neardup.bitmap, "possible", lambda x, key, ids, own: limited.add((x.columns[-1], own)) or possible(x, key, ids, own))
    got = {r.doc_id: r.component_id for r in neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    assert limited >= {("sketch", "a"), ("sketch", "b"), ("hashes", "a"), ("hashes", "b")}


def test_exact_repeats(docs, corpus):
    from pathloom.llm.suffix_dedup import remove_repeats

    raw = [(t or "").encode() for _, t in corpus]
    seen = Counter(b[j : j + 200] for b in raw for j in range(len(b) - 199))
    want = Counter()
    for (i, _), b in zip(corpus, raw, strict=True):
        cover = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                cover[j : j + 200] = True
        runs = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
        want[(i, len(b), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())] += 1
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == want
    assert remove_repeats(docs.limit(0)).count() == 0


def test_entries_are_dealt_once(docs, monkeypatch):
    from pathloom.llm import suffix_dedup as sd

    plans, cut = [], sd.cut
    monkeypatch.setattr(sd, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    assert sd.remove_repeats(docs).count() == docs.count()
    assert plans[0].count("Exchange hashpartitioning(g#") == 1


def test_places_beyond_24_bits():
    from pathloom.llm import substring_dedup, suffix_dedup

    rng = np.random.default_rng(2)
    text, own = rng.integers(0, 256, (1 << 24) + 5000, dtype=np.uint8), rng.integers(0, 256, 400, dtype=np.uint8)
    text[(1 << 24) + 1000 : (1 << 24) + 1400] = own
    at = np.array([0, len(text), len(text) + 400])
    row, lo, _, g, _ = suffix_dedup.entries(np.concatenate([text, own]), at)
    assert set(g[row == 1]) <= set(g[(row == 0) & (lo > (1 << 24) + 800)])
    # a small limit gives what no limit gives, slice by slice
    values = rng.integers(0, 2**63, 9000, dtype=np.uint64)
    a = rng.integers(0, 8000, 500)
    z = a + rng.integers(1, 900, 500)
    want = [i + int(np.argmin(values[i:j] >> np.uint64(24))) for i, j in zip(a, z, strict=True)]
    elected = [i + int(np.argmin(values[i : i + 121])) for i in range(9000 - 120)]
    for bits in (24, 12):
        for m in (suffix_dedup, substring_dedup):
            m._POS, was = bits, m._POS
            try:
                got = m._elected(values, 121) if m is suffix_dedup else m.RangeMin(values, 900)(a, z)
            finally:
                m._POS = was
            assert got.tolist() == (elected if m is suffix_dedup else want)


def test_passages(spark, docs, corpus):
    from pathloom.llm.substring_dedup import cut_repeats, passage_report

    first, covered = {}, {}
    for i, t in sorted((x for x in corpus if x[0] is not None), key=lambda x: x[0]):
        w, own = spaced(t), covered.setdefault(i, set())
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i:
                own |= set(range(j, j + 50))
    for r in passage_report(docs).collect():
        got = {k for s in r.spans for k in range(s.start, s.end)}
        assert covered.get(r.doc_id, set()) <= got and len(got) == r.n_removed
        if r.doc_id is not None and r.doc_id < 40:
            assert not got  # the first copies stay
    kept = cut_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert cut_repeats(docs.limit(0)).count() == 0


def test_similar_spans_bridge_small_edits():
    from pathloom.llm.substring_dedup import similar_spans

    a = np.arange(1000, dtype=np.uint32)
    b = np.concatenate([np.arange(5000, 5060, dtype=np.uint32), a[100:300], np.arange(6000, 6050, dtype=np.uint32)])
    b[150:155] = 9999
    assert similar_spans(a, b) == [(60, 264)]
    assert similar_spans(a, np.arange(7000, 7200, dtype=np.uint32)) == []


def test_dense_places_are_those_of_dense_intervals():
    from pathloom.llm.substring_dedup import _dense

    rng = np.random.default_rng(5)
    for _ in range(200):
        known, least = rng.random(int(rng.integers(0, 40))) < rng.random(), int(rng.integers(1, 12))
        plain = np.zeros(len(known), bool)
        for s in range(len(known)):
            for e in range(s + least, len(known) + 1):
                if 100 * known[s:e].sum() >= 80 * (e - s):
                    plain[s:e] = True
        assert (_dense(known, least, 80) == plain).all()


def test_similar_spans_find_passages_whose_parts_stand_earlier(monkeypatch):
    from pathloom.llm import substring_dedup as sd

    rng = np.random.default_rng(1)
    mk = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    for most in (sd.MATCHES, 0):
        monkeypatch.setattr(sd, "MATCHES", most)
        p, q = mk(56), mk(86)
        for earlier, own in (([p[:26]], p), ([p[20:28]], p), ([q[:41]], q), ([q[:45], mk(3), q[45:]], q)):
            a = np.concatenate([mk(20), *earlier, mk(20), own, mk(30)])
            assert sd.similar_spans(a, np.concatenate([mk(40), own, mk(7)])) == [(40, 44 + len(own))]
        x = np.tile(mk(3), 100)
        assert sd.similar_spans(x, x) == [(0, 304)]


def test_stretches_apart_are_judged_alone():
    """Spans of a text of several stretches are those of each stretch by itself; a text covered by whole runs needs no chain."""
    from pathloom.llm.substring_dedup import similar_spans

    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(1 << 20, 1 << 31, n).astype(np.uint32)
    a = fresh(400)
    whole, edited, short = a[20:90], a[150:260].copy(), a[300:330]
    edited[[30, 62]] = fresh(2)
    parts = [fresh(80), whole, fresh(80), edited, fresh(80), short, fresh(80)]
    b, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    alone = [[(s + at[k], e + at[k]) for s, e in similar_spans(a, parts[k])] for k in (1, 3, 5)]
    assert [len(x) for x in alone] == [1, 1, 0]
    assert similar_spans(a, b) == alone[0] + alone[1]
    assert similar_spans(a, np.concatenate([whole, fresh(80), a[150:260]])) == [(0, 74), (150, 264)]
    assert similar_spans(a, a[:0]) == similar_spans(a[:0], a) == []


def test_short_near_passages_are_met(spark):
    from pathloom.llm.substring_dedup import repeated_spans

    rng = random.Random(6)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(300):  # one word of 50 or 55 changed: a Jaccard index of 0.80 or 0.82
        p = own(50 + i % 2 * 5)
        q = [*p[:25], "changed", *p[26:]]
        rows += [(10 * i + k, " ".join(own(rng.randint(20, 90)) + x + own(rng.randint(20, 90)))) for k, x in enumerate((p, q))]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) >= 297 and all(r.doc % 10 == 1 for r in got)


def test_passages_whose_leaders_hold_too_little(spark):
    from pathloom.llm.substring_dedup import repeated_spans

    rng = random.Random(8)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(40):  # documents 1 and 2 of each ten have 48 words of a passage, 3 and 4 all 60
        p = own(60)
        rows += [(10 * i + k, " ".join(own(rng.randint(20, 90)) + x + own(rng.randint(20, 90)))) for k, x in enumerate((p[:48], p[-48:], p, p), 1)]
    got = {r.doc: sum(s.end - s.start for s in r.spans) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 * i + 4: 60 for i in range(40)}


def test_passages_beside_a_common_one_that_is_too_short(spark):
    from pathloom.llm.substring_dedup import repeated_spans

    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, rows, want = own(47), [], {}
    for i in range(150):  # 47 words that all share, and in every third document and the next one 12 words more
        more = own(12) if i % 3 < 2 else own(12)
        if i % 3 == 1:
            more = last
            want[i] = 59
        last = more
        rows.append((i, " ".join(own(rng.randint(30, 90)) + common + more + own(rng.randint(30, 90)))))
    got = {r.doc: sum(s.end - s.start for s in r.spans) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_passages_that_overlap_one_cut_already(spark, monkeypatch):
    from pathloom.llm.substring_dedup import repeated_spans

    rng = random.Random(10)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(40):  # 60 words of document 1 and 60 of document 2, of which 40 are the same
        x, p, y = own(20), own(40), own(20)
        rows += [(10 * i + k, " ".join(own(rng.randint(20, 90)) + w + own(rng.randint(20, 90)))) for k, w in enumerate((x + p, p + y, x + p + y), 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(documents), "first", None)  # the way is the same at any size: none is asked for
    got = {r.doc: [s.end - s.start for s in r.spans] for r in repeated_spans(documents).collect()}
    assert got == {10 * i + 3: [80] for i in range(40)}


def test_open_windows_travel_once_and_meet_as_compared_one_by_one():
    import numpy as np
    import pyarrow as pa

    from pathloom.llm import substring_dedup as sd

    rng = random.Random(11)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    box = [(60 << 16) | 60, (20 << 16) | 30]
    x = [[{"v": 5, "at": 100, "box": box[0], "part": 0, "parts": 1}, {"v": 6, "at": 100, "box": box[1], "part": 0, "parts": 1}]]
    kind = pa.list_(pa.struct([("v", pa.int64()), ("at", pa.int32()), ("box", pa.int32()), ("part", pa.int32()), ("parts", pa.int32())]))
    spans = pa.array([[{"start": 90, "end": 100}]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    got = pa.Table.from_batches(sd.near_rows(iter([pa.record_batch([pa.array([1]), pa.array([text]), pa.array(x, kind), spans], ["doc_id", "text", "x", "own"])])))
    assert [len(b) // 4 for b in got.column("near").to_pylist()] == [91, 51]  # a row a window, whatever its tokens
    assert [int((np.frombuffer(b, np.uint32) & 1).sum()) for b in got.column("near").to_pylist()] == [85, 45]

    met = 0
    for _ in range(60):
        common = [rng.randrange(4096) for _ in range(60)]
        rows = []
        for _ in range(30):  # near-copies of one sequence that are open in parts
            b = rng.randrange(20, 50), rng.randrange(20, 50)
            odd, news = rng.choice([0.0, 0.2, 0.5]), rng.choice([0, 0.1, 1])
            tokens = [rng.randrange(4096) if rng.random() < odd else common[k % 60] for k in range(min(b[0], 45) + min(b[1], 45) + 1)]
            rows.append((rng.randrange(3), rng.randrange(15), b[0] << 16 | b[1], [k << 1 | (rng.random() < news) for k in tokens]))
        rows.sort(key=lambda r: r[0])
        want = set()
        for v, a, e, p in rows:
            for w, b, f, q in rows:
                beside = min(e >> 16, f >> 16) + min(e & 0xFFFF, f & 0xFFFF) + 1 >= sd.LEAST
                both = {k >> 1 for k in p} & {k >> 1 for k in q}
                need = max(max(sd.LEAST - len(t) + len({k >> 1 for k in t}), 1) for t in (p, q))
                if v == w and a < b and beside and len(both) >= need and both & {k >> 1 for k in q if k & 1}:
                    want.add((a, b))
        met += len(want)
        v, doc, boxes = (np.array([r[k] for r in rows]) for k in range(3))
        at = np.cumsum([0, *(len(r[3]) for r in rows)])
        pairs = sd._meet(v, np.full(30, -1), doc, boxes, np.array([k for r in rows for k in r[3]], np.uint32), at)
        assert set(map(tuple, pairs.T.tolist())) == want
        # dealt in parts, a batch of seven rows at a time
        part, blobs, dealt = [rng.randrange(3) for _ in rows], [np.array(r[3], np.uint32).tobytes() for r in rows], []
        for r, k, blob in zip(rows, part, blobs, strict=True):
            dealt += [(r[0], min(k, o), max(k, o), -1 if k == o else int(k > o), r[1], r[2], blob) for o in range(3)]
        dealt.sort(key=lambda r: r[:3])
        schema = pa.schema([("v", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("doc", pa.int64()), ("box", pa.int32()), ("near", pa.binary())])
        batches = [pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*dealt[k : k + 7], strict=True), schema, strict=True)], schema=schema) for k in range(0, len(dealt), 7)]
        assert {(r["a"], r["b"]) for out in sd.meet_rows(iter(batches)) for r in out.to_pylist()} == want
    assert met > 500


def test_open_windows_are_looked_up_and_found_pairs_are_not_compared_again(monkeypatch):
    """A common stretch that is cut makes no window of a group be compared with all others; a pair of documents is found once."""
    from pathloom.llm import substring_dedup as sd

    rng = np.random.default_rng(12)
    n, compared = 600, []
    tokens = [np.concatenate([rng.integers(1000, 1 << 30, 25) << 1 | 1, np.arange(41) << 1, rng.integers(1000, 1 << 30, 25) << 1 | 1]) for _ in range(n)]
    for k in range(1, n, 2):  # each second one has some of the fresh tokens of the one before
        tokens[k][:25] = tokens[k - 1][:25]
    union = np.union1d
    monkeypatch.setattr(sd.np, "union1d", lambda x, y: compared.append(len(y)) or union(x, y))
    looked, isin = [], np.isin
    monkeypatch.setattr(sd.np, "isin", lambda x, y: looked.append(len(x)) or isin(x, y))
    doc, at = np.repeat(np.arange(n // 2), 2) * 2 + np.tile([0, 1], n // 2), np.arange(n + 1) * 91
    pairs = sd._meet(np.zeros(n, int), np.full(n, -1), doc, np.full(n, 45 << 16 | 45), np.concatenate(tokens).astype(np.uint32), at)
    assert pairs.T.tolist() == [[k, k + 1] for k in range(0, n, 2)]
    assert sum(compared) == n // 2 and 0 < sum(looked) < 10 * n  # of 179,700 pairs


def test_verification_passes_over_pairs_that_add_nothing(monkeypatch):
    import pyarrow as pa

    from pathloom.llm import substring_dedup as sd

    rng = np.random.default_rng(3)
    fresh = lambda k: rng.integers(0, 2**32, k, dtype=np.uint32)
    rows, want = [], set()
    for i in range(120):
        a = fresh(300)
        b = np.concatenate([fresh(60), a[50:130], fresh(60), a[200 : 200 + i % 60], fresh(30)])
        own = [{"start": 60, "end": [100, 144, 144][i % 3]}] if i % 4 else None
        known = set(range(60, own[0]["end"])) if own else set()
        found = {k for s, e in sd.similar_spans(a, b) for k in range(s, e)}
        want |= {(i, k) for k in found - known}
        rows.append((i, a.tobytes(), b.tobytes(), own))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), kind), strict=True)], ["doc", "x", "y", "spans"])
    done, plain = [], sd.similar_spans
    monkeypatch.setattr(sd, "similar_spans", lambda x, y: done.append(1) or plain(x, y))
    got = set()
    for out in sd.verify_rows(iter([batch])):
        got |= {(r["doc"], k) for r in out.to_pylist() for k in range(r["start"], r["end"])}
    cut_before = {(i, k) for i, _, _, own in rows for s in own or () for k in range(s["start"], s["end"])}
    assert got - cut_before == want and len(done) < 100


def test_verification_gives_memory_back(monkeypatch):
    from pathloom.llm import substring_dedup as sd

    given = []
    monkeypatch.setattr(sd.tk, "give_back", lambda: given.append(1))
    assert list(sd.verify_rows(iter([]))) == [] and given


def test_language_model(docs, corpus):
    from pathloom.llm.lm_scoring import language_model_scores

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, [*spaced(t), None]) for i, t in corpus]
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    rows = language_model_scores(docs).collect()
    got = sorted((r.doc_id is None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want and all(r.score < 0 for r in rows)
    assert language_model_scores(docs.limit(0)).count() == 0


def plain_context_tree(train: list[bytes], depth: int):
    """log10 probability of a byte string by the definition: a dictionary of nodes, mixed by recursion."""
    counts: dict = {}
    bits = lambda c: f"{c:08b}"
    for text in train:
        padded = b"\n" * depth + text
        for i in range(depth, len(padded)):
            for j, bit in enumerate(bits(padded[i])):
                for d in range(depth + 1):
                    counts.setdefault((padded[i - d : i], bits(padded[i])[:j]), [0, 0])[int(bit)] += 1
    below: dict = {}
    mixed: dict = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        z, o = counts[node]
        own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
        mixed[node] = own if len(node[0]) == depth else float(np.logaddexp(own, below[node]) - math.log(2))
        if node[0]:
            up = (node[0][1:], node[1])
            below[up] = below.get(up, 0.0) + mixed[node]
        counts[node].append(1.0 if len(node[0]) == depth else 1 / (1 + math.exp(min(700, max(-700, below[node] - own)))))

    def one(context: bytes, prefix: str) -> float:
        value, done, left = 0.5, 0.0, 1.0
        for d in range(depth + 1):
            node = counts.get((context[depth - d :], prefix))
            if node is None:
                break
            p = (node[1] + 0.5) / (node[0] + node[1] + 1)
            value, done, left = done + left * p, done + left * node[2] * p, left * (1 - node[2])
        return value

    def score(text: bytes) -> float:
        padded, total = b"\n" * depth + text, 0.0
        for i in range(depth, len(padded)):
            for j, bit in enumerate(bits(padded[i])):
                p = one(padded[i - depth : i], bits(padded[i])[:j])
                total += math.log10(p if bit == "1" else 1 - p)
        return total

    return score


@pytest.mark.parametrize("common", [None, {0: 64, 1: 8}])
def test_scores_equal_a_plain_context_tree(spark, monkeypatch, common):
    from tests.llm.conftest import prose

    from pathloom.llm import lm_scoring as lm

    if common:  # nearly all strings and tokens are joined
        monkeypatch.setattr(lm, "COMMON", common)
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(3, 25))) for i in range(60)] + [(61, None), (62, "Zed"), (63, "ünseen wörds 日本"), (64, " "), (64, " "), (None, "no id")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    assert {held(i) for i, _ in rows} == {True, False}
    plain = lambda t: (" ".join(spaced(t)) + "\n").encode()
    score = plain_context_tree([plain(t) for i, t in rows if not held(i)], lm.DEPTH)
    got = lm.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), round(score(plain(t)), 6)) for i, t in rows)
    assert all(abs(r.bits_per_byte - -r.score * math.log2(10) / len(plain(dict(rows)[r.doc_id]))) < 1e-9 for r in got)


def test_byte_probabilities_sum_to_one():
    from pathloom.llm import lm_scoring as lm

    rng = np.random.default_rng(0)
    text = rng.choice(np.frombuffer(b"abcde \n", np.uint8), 3000, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])
    k, n = lm._counted(lm.keys(text))
    every = np.unique(np.concatenate([int(x) >> 8 << 8 | np.arange(256, dtype=np.int64) for x in k[::100]]))
    k, n = lm._counted(np.append(k, every), np.append(n, np.zeros(len(every), np.int64)))
    suffix = np.argsort((k >> 8) & 0xFFFFFF, kind="stable")
    k, n = k[suffix], n[suffix]
    first = [x for batch in lm.subtree_rows()(iter([pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])])) for x in zip(*batch.to_pydict().values(), strict=True)]
    node, mixed = np.array([x[0] for x in first]), np.array([x[1] for x in first])
    short = lm._counted(k & 0xFFFFFF, n)
    logs = lm.string_logs(k, n, lm.top_tables(*(x[short[1] > 0] for x in short), node, mixed))
    own = np.isin(k, every)
    context, at = np.unique(k[own] >> 8, return_inverse=True)
    assert len(context) and np.allclose(np.bincount(at, np.exp(logs[own])), 1, atol=1e-9)
    x = np.array([0.5, 1.0, 7.5, 100.0])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-9)


def test_contamination(spark, docs, corpus):
    from pathloom.llm.decontaminate import contamination, drop_contaminated

    w = alnum(corpus[5][1])
    items = [(1, " ".join(w[2:17]).upper()), (2, "two, WORDS!"), (10, "no such words stand anywhere in this small corpus at all"), (11, None), (12, " "), (3, " ".join(w[2:17])), (3, " ".join(w[2:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        x = alnum(t)
        if x:
            for j in range(max(len(x) - 9, 1)):
                windows.setdefault(tuple(x[j : j + 10]), set()).add(str(i))
    want = Counter()
    for i, t in corpus:
        x, hit, found = alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(x) - n + 1):
                if (own := windows.get(tuple(x[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= own
        want[(i, len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter(tuple(r) for r in contamination(docs, bench).drop("rk").collect()) == want
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0 and contamination(docs.limit(0), bench).count() == 0


def test_chat(spark):
    from pathloom.llm.chat_format import conversation_digest, format_trees, read_back

    odd = r"<s>[INST] a\b [/INST]</s> [ROLE]\\<s>"
    rows = [(1, 0, "user", odd), (1, 2, "assistant", odd + "\n"), (1, 3, None, None), (1, 3, "sys[ROLE]", ""), (2, 0, "assistant", "é\U0001f600"), (2, 0, "assistant", "é\U0001f600"), (None, 0, "user", "x"), (3, None, "user", "late"), (3, None, "assistant", None)]
    rows += [(4, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(700)]
    got = {r.conv_id: r for r in conversation_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4}
    for c, r in got.items():
        own = sorted((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == c)
        said = "".join(x[2] for x in own if x[1] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    tree = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", "more", 2.0), ("t", 8, 9, "user", "loop", 1.0), ("t", 9, 8, "user", "loop", 1.0), ("u", 1, 7, "user", "orphan", None)]
    m = spark.createDataFrame(tree, "tree_id string, node long, parent long, role string, text string, score double")
    best = {(r.tree_id, r.branch_rank): [t.text for t in r.turns] for r in read_back(format_trees(m, 2)).collect()}
    assert best == {("t", 1): ["q", "good", "more"], ("t", 2): ["q", "bad"], ("u", 1): ["orphan"]}
    assert format_trees(m.limit(0)).count() == 0


def test_quality(spark, docs):
    from pathloom.llm.quality import keep_good, quality_scores

    rng = random.Random(3)
    from tests.llm.conftest import prose

    good = [(i, ". ".join(prose(rng, 8) + ", " + prose(rng, 5) for _ in range(9))) for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choice(["stone###", "river***", "amber$$$"]) for _ in range(100))) for i in range(20)] + [(2000 + i, "WORD WORD WORD " * 40) for i in range(20)]
    d = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (None, good[0][1])], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.accepted for r in quality_scores(d).collect()}
    assert np.mean([got[i] for i, _ in good]) > 0.95 and np.mean([got[i] for i, _ in bad]) < 0.05
    assert not got[5000] and not got[5001]
    assert keep_good(docs).columns == docs.columns and quality_scores(docs.limit(0)).count() == 0


def test_toxicity(spark):
    from pathloom.llm.toxicity import toxicity_scores

    rng = random.Random(4)
    from tests.llm.conftest import prose

    rows = [(i, prose(rng, 60) + (" you utter dimwit" + rng.choice(["ted", "s", "er"]) if i % 4 == 0 else "") + " " + prose(rng, 20)) for i in range(400)]
    d = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "dimwits")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(900, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(d, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    assert [r.score for r in toxicity_scores(d.limit(3), labels.limit(0)).collect()] == [0.5] * 3


def test_nearest(spark):
    from pathloom.llm.ann import nearest

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32) + 3 * rng.normal(size=(9, 16)).astype(np.float32)[np.arange(900) % 9]
    x[300:360] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [None] * 16), (None, x[0].tolist()), (40, x[40].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = nearest(e).toPandas()
    f, hits = x.astype(float), 0
    for q in range(0, 900, 20):
        score = f @ f[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(900), -score))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, f[own.vec_id] @ f[q])
        hits += len(set(own.vec_id) & set(want))
        if q == 20:
            assert own.vec_id.tolist() == want.tolist()
    assert hits / (45 * 20) >= 0.95 and set(got.query_id) == set(range(0, 900, 20))
    assert nearest(e.limit(0)).count() == 0


@pytest.mark.parametrize("width", [3, 5])
def test_shingles_match_words(width):
    from pathloom.llm import textkit as tk

    hashes = tk.mix(np.arange(20, dtype=np.uint64))
    first = np.array([0, 2, 2, 12, 20])
    got, at = tk.shingles(hashes, first, width)
    assert np.diff(at).tolist() == [1, 0, 10 - width + 1, 8 - width + 1]
    again, _ = tk.shingles(hashes[2:12], np.array([0, 10]), width)
    assert (got[at[2] : at[3]] == again).all()
