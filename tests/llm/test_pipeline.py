"""The pipeline's stages on the smallest tables: columns kept, each decision takes effect on what the stage before kept."""

import random
import re

DIR = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def test_stages(spark):
    import corpus_pipeline
    from pathloom.session import cut

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DIR))
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["quality"] >= ids["near_dedup"] == ids["substring_dedup"] >= ids["decontaminate"] == ids["pack"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids["quality"] for i in good) >= 0.95 * len(good)
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = alnum(r.text)
        windows |= {tuple(w[j : j + 10]) for j in range(max(len(w) - 9, 1))} if w else set()
    for r in seen["substring_dedup"]:
        w = alnum(r.text)
        dirty = any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))
        assert dirty == (r.doc_id not in ids["decontaminate"])
    assert all(r.length <= 1024 and r.offset + r.length <= 1024 for r in seen["pack"])


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))


def near_firsts(texts):
    """The smallest id of each component of 80 % or more on five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = spaced(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return {i for i, g in group.items() if i == g}


def test_run_against_plain_versions(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = spark.read.parquet(f"{DIR}/documents.parquet")
    good = rows.join(spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1"), "doc_id").select(rows.columns).collect()
    planted = []
    for i, r in enumerate(good[:20]):  # in two documents each, one of them otherwise unlike the other
        p = own(50 + i)
        planted += [(900000 + 10 * i + k, " ".join(own(80) + p + own(80))) for k in (0, 1)]
    rows = rows.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    seen, stages = {}, []
    for name, stage in corpus_pipeline.STAGES:

        def kept(s, d, path, name=name, stage=stage):
            if name == "quality":
                out = stage(s, d, path).unionByName(d.where("doc_id >= 900000")).dropDuplicates(["doc_id"])
            else:
                out = stage(s, d, path)
            seen[name] = out.collect()
            return out

        stages.append((name, kept))
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {n: {r.doc_id: r.text for r in seen[n]} for n in seen if n != "pack"}
    assert set(texts["near_dedup"]) == near_firsts(texts["quality"])
    first, covered = {}, {}
    for i in sorted(texts["near_dedup"]):
        w = spaced(texts["near_dedup"][i])
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i:
                covered.setdefault(i, set()).update(range(j, j + 50))
    assert sum(i >= 900000 for i in covered) == 20
    for i, t in texts["near_dedup"].items():
        assert len(spaced(texts["substring_dedup"][i])) <= len(spaced(t)) - len(covered.get(i, ()))
        if i >= 900000 and i % 10 == 0:
            assert texts["substring_dedup"][i] == t
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts["decontaminate"].items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens


def test_near_dedup_stage_takes_five_words_and_80_percent(spark):
    from pathloom.llm import stages
    from pathloom.llm.neardup import PERCENT, shared_least

    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for i in range(12):
        w = own(400)
        edited = list(w)
        for k in range(0, 400, 40):
            edited[k + i] = "edited"
        block, short = w + own(60 + 5 * i), own(3)
        texts |= {10 * i + k: " ".join(x) for k, x in enumerate((w, block, edited, short, short[:2] + own(1), w[: 340 - 5 * i]))}
    texts |= {500 + i: t for i, t in enumerate((None, "", "one", "one"))}
    firsts = near_firsts(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in stages.near_dedup(spark, docs, DIR).collect()} == firsts
    assert shared_least(PERCENT) == 26
