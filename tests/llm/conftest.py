import random

import pytest

WORDS = ["the", "of", "and", "river", "stone", "Light", "été", "über", "run", "fold", "amber", "quiet", "lattice", "meadow", "copper", "violet", "engine", "harbor", "signal", "willow", "cinder", "marble", "thread", "canyon"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near-copies, shared passages, null, empty, blank, long and repeated rows."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(20, 160)) for _ in range(40)]
    passage = prose(rng, 70)
    rows = list(enumerate(texts))
    rows += [(100 + i, texts[i]) for i in range(5)]
    for i in range(12):  # near-copies of one text, each with a few other words
        w = texts[0].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, texts[10 + i] + "\n" + passage + " " + texts[20 + i]) for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "one"), (404, "Two words"), (None, prose(rng, 30)), (405, "a " * 3000), (406, prose(rng, 3000))]
    rows += [rows[3], (403, "one")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns of clashing names beside doc_id and text."""
    rows = [(i, t, "x", 1, 2, "n") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n long, key long, rk string").repartition(3)
