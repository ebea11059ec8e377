import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hyperminhash as H
from tessera.llm.shingles import shingle_sets


def brute(texts, k, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO\twords", "a b c", "x y z w"]
    passage = [word() for _ in range(60)]
    for family in range(12):
        base = [word() for _ in range(rng.choice([5, 12, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.01, 0.03, 0.06, 0.1]))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(20)] + passage) for _ in range(25)]
    texts += ["same text again and again"] * 30 + ["long " + "w x y z " * 5000]
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, monkeypatch, k, percent):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(df, k, percent).collect()}
    assert got == brute(texts, k, percent)


def test_cells_of_large_buckets(spark, monkeypatch):
    """A family without a common source: no hub links it, so cells must; blocks of 2 members make many cells."""
    monkeypatch.setattr(H, "BLOCK", 2)
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(24):
        text = list(text)
        for _ in range(4):
            text[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        texts.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(texts, 3, 85)


def test_repeated_ids_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", "x"), (2, "p q r s t", "x"), (3, "p q r s t", None), (None, "a b c d e", None), (4, None, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in H.near_duplicates(spark.createDataFrame(rows, schema), 3, 85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (4, 4, True)}
    assert H.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    kept = H.drop_near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "a b c d e"), (1, "a b c d e"), (4, "")]


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((2000, 0.85), (300, 0.5), (100_000, 0.0), (40, 0.0)):
        both = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**64, n - len(both), dtype=np.uint64)))) for _ in range(2))
        true = len(both) / (2 * n - len(both))
        assert abs(H.estimate(H.sketch(a), H.sketch(b), len(a), len(b)) - true) < 0.2
    x = rng.integers(0, 2**64, 7, dtype=np.uint64)
    assert (H.sketch(np.sort(x)) == H.sketch(np.sort(x))).all()


def test_components_of_a_path(spark):
    from tessera.llm.common import Stages

    ids = [bytes([0, i]) for i in range(40)]
    order = list(range(39))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(ids[i + 1], ids[i]) for i in order] + [(b"\x09a", b"\x09b")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in H.components(edges, Stages(spark)).collect()}
    assert got == {i: ids[0] for i in ids[1:]} | {b"\x09b": b"\x09a"}


def test_shingles_lower_ascii_only():
    import pyarrow as pa

    from tessera.llm.common import utf8

    a, b, c, d = shingle_sets(*utf8(pa.array(["ÄB cd\x0bef GH", "Äb CD ef gh", "äb cd ef gh", "Äb cd ef\u00a0gh"])), 3)
    assert a.tolist() == b.tolist() != c.tolist()
    assert len(d) == 1
