"""The Merkle manifest, the filter audit and the I-Match fingerprints, against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, imatch, merkle
from tessera.llm.common import Stages

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, `index` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


# --- Merkle manifest


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(levels, i, node):
    """The siblings from place i of the lowest level upwards, and what node becomes."""
    proof = ""
    for nodes in levels[:-1]:
        run, slot = nodes[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        proof += "".join(run[:slot] + run[slot + 1 :])
        node, i = H(*run[:slot], node, *run[slot + 1 :]), i // 8
    return proof, node


def plain_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r[:5]))) for x in langs}
    levels = {x: levels_of([leaf_of(r[:5]) for r in trees[x]]) for x in langs}
    top = levels_of([levels[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf_of((*r[:4], r[4].translate(LOWER))) if bad else leaf_of(r[:5])
            low, node = climb(levels[x], i, node)
            high, node = climb(top, g, node)
            out.append((r[0], leaf_of(r[:5]), levels[x][-1][0], top[-1][0], H(low + high), node, node == top[-1][0]))
    return out


def proofs(spark, rows, parts=5):
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    return [tuple(r) for r in merkle.proof_digests(df).collect()]


def as_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("langs", [("en",), ("en", None, "", "z", "Z", "é"), tuple(f"l{i}" for i in range(75))])
def test_manifest_against_plain_trees(spark, langs):
    rng = random.Random(len(langs))
    rows = [(i * 7 - 40, rng.choice([None, "s", "ß"]), langs[min(int(rng.expovariate(0.2)), len(langs) - 1)], rng.choice([None, 3]), rng.choice([None, "", "Äb C", f"Text {i}"]), "x", 1) for i in range(330)]
    assert as_text(proofs(spark, rows)) == as_text(plain_manifest(rows))


def test_manifest_of_few_null_and_repeated_rows(spark):
    assert proofs(spark, []) == []
    one = [(5, None, None, None, None, None, None)]
    assert proofs(spark, one) == plain_manifest(one)
    assert proofs(spark, one)[0][1] == proofs(spark, one)[0][3]
    many = [(None, "s", "en", 1, "A", "x", 1)] * 9 + [(3, "s", "en", 1, "B" * 300_000, "x", 1)] * 20 + [(3, "s", "en", 1, "C", "x", 1)]
    assert as_text(proofs(spark, many)) == as_text(plain_manifest(many))


def test_manifest_joins_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.ranks.BROADCAST_MARKS", 0)
    monkeypatch.setattr(merkle, "BROADCAST_MARKS", 0)
    monkeypatch.setattr(merkle, "LEVEL_NODES", 5)  # many tasks a level
    rows = [(i, "s", "ab"[i % 2], 1, f"T{i}", "x", 1) for i in range(200)] + [(i, "s", f"c{i}", 1, "", "x", 1) for i in range(20)]
    assert as_text(proofs(spark, rows)) == as_text(plain_manifest(rows))


def test_a_lost_message_is_noticed():
    with pytest.raises(ValueError, match="lacks messages"):
        merkle._run(((0, 0), [(0, 3, b""), (2, 3, b"")]))


def test_verified_finds_what_was_changed(spark):
    rows = [(i, "s", "en", 1, f"t{i}", "x", 1) for i in range(70)]
    df = spark.createDataFrame(rows, DOCS)
    found = merkle.manifest(df.drop("leaf").withColumn("other", merkle.digest(*(F.when(F.col("doc_id") == 33, F.lit("?")).otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS))), carry=("other",))
    assert [r.doc_id for r in merkle.verified(found, "other").where("not verified").collect()] == [33]
    assert merkle.verified(found).where("not verified").count() == 0


# --- filter audit


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    flags = []
    for i, source, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        flags.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, removals = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, fails, g, x in flags:
            at = next((s for s, k in enumerate(order, 1) if k in fails), 6)
            for s, k in enumerate(order, 1):
                row = out.setdefault((part, order, s), [0] * 6)
                for n, v in enumerate((at > s, at == s, k in fails and at < s, fails == {k}, at == s and g, at == s and x)):
                    row[n] += v
                removals[part, k] = removals.get((part, k), 0) + (at == s)
    return {(*key, *row, removals[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def test_audit_against_a_plain_replay(spark):
    rng = random.Random(4)
    texts = [None, "", " \t", "A b", "x" * 100_000, "w " * 60, "Ä b " * 50, *(" ".join(rng.choice(["a", "B", "cc", "d|", f"u{rng.randrange(99)}", "É"]) for _ in range(rng.choice([5, 49, 50, 51, 90]))) for _ in range(60))]
    docs = [(rng.choice([None, *range(90)]), rng.choice([None, "", "a", "b", "hot", "hot", "hot"]), rng.choice(texts)) for _ in range(150)]
    docs += docs[:5]
    labels = [(rng.choice([None, *range(100)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, source string, text string, step int, part string").repartition(3)
    got = audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == plain_audit(docs, labels)
    assert audit.filter_audit(d.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_takes_other_filters(spark):
    flags = spark.createDataFrame([("p", 0b01, True, None), ("p", 0b11, None, True), ("p", 0, False, False)], "part string, fails int, good boolean, toxic boolean")
    got = {tuple(r) for r in audit.replay(flags, "xy").collect()}
    assert got == {("p", "xy", 1, 1, 2, 0, 1, 1, 1, 3), ("p", "xy", 2, 1, 0, 1, 0, 0, 0, 1), ("p", "yx", 1, 2, 1, 0, 0, 0, 1, 1), ("p", "yx", 2, 1, 1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError, match="at most"):
        audit.replay(flags, "abcdefg")


# --- fingerprints


def plain_edits(docs):
    """(id, text) -> (edited text, next text), for distinct rows."""
    rows = sorted({(i, t or "") for i, t in docs}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = {}
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out[i, t] = (t[: len(t) - half] + following[:half], following)
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "Ön", "on", "re", "ed", "st", "日本"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("repeat", [False, True])
def test_edited_texts_and_equal_fingerprints(spark, repeat, monkeypatch):
    monkeypatch.setattr(imatch, "LEAST_BLOCK", 3)
    rng = random.Random(11)
    texts = [None, "", "a", "?", *(prose(rng, rng.randint(1, 120)) for _ in range(60)), prose(rng, 40_000)]
    docs = [(n * 3 - 50 if n % 9 else None, rng.choice(texts)) for n in range(140)]
    docs = list({(i, t or ""): (i, t) for i, t in docs}.values()) + ([(1 << 62, "last")] if not repeat else [])
    docs += docs[:7] * 3 if repeat else []
    df = spark.createDataFrame([(i, t, 1, "k", True) for i, t in docs], "doc_id long, text string, block int, `key` string, ghost boolean").repartition(4)
    rows = imatch.edited_likeness(df).collect()
    edits = plain_edits(docs)
    want = sorted((i is not None, i or 0, len(t or ""), hashlib.sha256(edits[i, t or ""][0].encode()).hexdigest()) for i, t in docs)
    assert want == sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in rows)
    by_edit = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
        by_edit.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_edit.values())
    texts_of = {}
    own = {(r.doc_id, r.n_chars, r.edited_sha256): r.fingerprint for r in rows}
    for (i, t), (e, _) in edits.items():
        texts_of.setdefault(t, set()).add(own[i, len(t), hashlib.sha256(e.encode()).hexdigest()])
    assert all(len(v) == 1 for v in texts_of.values())


def plain_subsets(hashes):
    """The subsets of sorted hashes, level by level."""
    out, level = [], [hashes]
    for i, kept in enumerate(imatch.LEVELS):
        level = [[h for h in terms if (h % (1 << 64) >> 2 * i) & 3 == j] for terms in level for j in range(kept)]
        out += level
    return out


def test_signatures_against_plain_subsets(spark, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (3, 40, 300)] + ["x " * 5, "", "1,2;3"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hashes = {r.id: list(r.h) for r in df.select("id", imatch.term_hashes(F.col("text")).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert len(hashes[i]) == len(set(filter(None, re.split(imatch.BETWEEN, t.lower()))))
    everything = sorted({h for hs in hashes.values() for h in hs})
    chosen = set(rng.sample(everything, len(everything) * 2 // 3)) - set(hashes[3])
    band = spark.createDataFrame([(h,) for h in [*chosen, imatch.MARK]], "term long")
    got = {r.id: r for r in imatch.fingerprints(df, band, ["id"], ["text"], []).collect()}
    for i in hashes:
        kept = sorted(h for h in hashes[i] if h in chosen)
        flat = "".join(got[i].text_fingerprint.split(".")[1:])
        subsets = plain_subsets(kept)
        codes = [r.c for r in spark.createDataFrame([(n, s) for n, s in enumerate(subsets)], "n int, s array<long>").select("n", F.lower(F.lpad(F.hex(F.xxhash64("s").bitwiseAND(F.lit(0xFFFF))), 4, "0")).alias("c")).orderBy("n").collect()]
        assert flat == "".join(c if s else imatch.NOTHING for c, s in zip(codes, subsets, strict=True))
        assert got[i].text_fingerprint[0] == ("b" if kept else "w")


def test_lexicon_holds_the_band(spark):
    rows = [" ".join(f"t{k}" for k in range(1, 31) if i % k == 0) for i in range(300)]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = {r.term for r in imatch.lexicon(df, Stages(spark), min_idf=1.5, max_idf=3.0).collect()}
    names = {r.h: r.t for r in spark.createDataFrame([(f"t{k}",) for k in range(1, 31)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    assert {names[h] for h in got - {imatch.MARK}} == {f"t{k}" for k in range(1, 31) if 1.5 <= math.log(300 / -(-300 // k)) <= 3}


def test_likeness_of_near_copies_and_of_others(spark):
    rng = random.Random(9)
    docs = []
    for n in range(120):
        words = prose(rng, 250).split()
        near = [w if rng.random() > 0.02 else "changed" for w in words]
        docs += [" ".join(words), " ".join(near)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = {r.doc_id: r for r in imatch.edited_likeness(df).collect()}
    copies = [rows[i].near_next for i in range(0, 240, 2)]
    others = [rows[i].near_next for i in range(1, 240, 2)]
    assert sum(copies) / 120 > 0.7 and sum(others) / 120 < 0.5 and sum(a > b for a, b in zip(copies, others, strict=True)) > 110
    assert imatch.edited_likeness(df.where("false")).count() == 0
    one = imatch.edited_likeness(df.where("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_fingerprints_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(i, f"word{i} other{i % 7} text") for i in range(60)], "doc_id long, text string")
    plan = imatch.edited_likeness(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Cartesian", plan)
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("n", [1, 2, 9, 100])
def test_blocks_of_keys(spark, n):
    keys = sorted(f"{random.Random(n + i).randrange(1 << 40):012x}" for i in range(n))
    probes = sorted({*keys, *(k + "0" for k in keys)})
    got = spark.createDataFrame([(p,) for p in probes], "k string").select("k", imatch.blocks_of(keys)(F.col("k")).alias("b")).collect()
    assert all(r.b == sum(k <= r.k for k in keys) - 1 for r in got)
