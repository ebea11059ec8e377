"""Quality rules and their language models."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import charmodel, perplexity
from tessera.llm.common import Stages


def measures(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {j for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def prose(rng, n, parts=("an", "the", "er", "in", "on", "re", "ed", "st")):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")


def verdicts(spark, rows):
    return sorted(perplexity.quality(frame(spark, rows).repartition(3)).collect(), key=lambda r: r.doc_id)


def test_measures_and_verdicts(spark):
    rng = random.Random(1)
    texts = [prose(rng, 120) for _ in range(150)]
    bad = ["x#$%&*|<> " * 80, "".join(rng.choice("zqxjkvwyg") for _ in range(30)) + " " + " ".join("".join(rng.choice("zqxjkvwyg#%") for _ in range(9)) for _ in range(100))]
    odd = [None, "", " \n\t", "short text", "a b c a b c\na b c\n\n \na b c", "é😀 ü\x0b\x0c x\r\ny" * 40, ("same line here\n" * 60), "word " * 20_000]
    odd += ["\n".join(thue_morse(n)) for n in (1024, 2048, 4096)]  # lines that differ, and that polynomial hashes confuse
    every = texts + bad + odd
    df = spark.createDataFrame([(i, t, None if i % 50 == 0 else "en", 1) for i, t in enumerate(every)], "doc_id long, text string, lang string, n_words int").repartition(4)
    got = {r.doc_id: r for r in perplexity.quality(df).collect()}
    for i, t in enumerate(every):
        m = measures(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, (t or "")[:80]
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.base_failed and r.kept)
    assert sum(got[i].kept for i in range(150)) >= 147
    assert not got[150].kept and not got[151].kept
    kept = perplexity.keep_quality(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)
    assert perplexity.quality(df.where("doc_id < 0")).count() == 0


def test_clashing_names_repeated_rows_and_empty_tables(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 90), "en") for i in range(40)] + [(None, prose(rng, 90), None), (7, "short", "en"), (7, "short", "en")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in [*rows, rows[3]]], "doc_id long, text string, lang string, key int, `_key` int, _rejected_key int, row_key int, Name int")
    kept = perplexity.keep_quality(df)
    assert kept.columns == df.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got[3] == 2 and got[7] == 1 and got[None] == 1
    assert perplexity.keep_quality(df.where("false")).count() == 0


def probability(counts, discounts, after):
    def p(g, k):
        if k == 0:
            return 1 / charmodel.SYMBOLS
        g = g[-k:]
        low = p(g, k - 1)
        same = after[k].get(g[:-1])
        if not same:
            return low
        c, d = counts[k].get(g, 0), discounts[k]
        return max(c - d[min(c, 3)], 0) / sum(same) + sum(d[min(v, 3)] for v in same) / sum(same) * low

    return p


def plain_models(texts):
    """Bits a code point by language and fold, written from the definition."""
    order = charmodel.ORDER
    own = lambda t: [0] * (order - 1) + charmodel.symbols(np.array([ord(c) for c in t], np.uint32)).tolist()
    models = {}
    for key in {(lang, fold) for lang, fold, _ in texts}:
        counts = {order: Counter()}
        for lang, fold, t in texts:
            if (lang, fold) == key:
                s = own(t)
                counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        discounts, after = {}, {}
        for k, c in counts.items():
            n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
            if min(n) == 0:
                discounts[k] = [0, 0.5, 0.75, 0.9]
            else:
                y = n[0] / (n[0] + 2 * n[1])
                discounts[k] = [0] + [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]
            after[k] = defaultdict(list)
            for g, v in c.items():
                after[k][g[:-1]].append(v)

        models[key] = probability(counts, discounts, after)

    def entropy(lang, fold, t):
        if (lang, 1 - fold) not in models or not t:
            return None
        s = own(t)
        return -sum(math.log2(models[lang, 1 - fold](tuple(s[i : i + order]), order)) for i in range(len(s) - order + 1)) / len(t)

    return entropy


@pytest.mark.parametrize("shard", [10**6, 700])
def test_scores_equal_the_definition_whatever_the_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(charmodel, "SHARD_ENTRIES", shard)
    rng = random.Random(6)
    parts = [("an", "the", "er"), ("до", "ом", "не", "東", "京都")]
    docs = [(i, i % 3 // 2, i % 2, prose(rng, 12, parts[i % 3 // 2])) for i in range(16)] + [(90, 5, 1, "alone"), (91, 0, 1, ""), (92, 0, 0, "zz 9")]
    df = spark.createDataFrame(docs, "row_key long, lang_id long, fold long, text string").repartition(3)
    models = charmodel.CharModels(df, Stages(spark))
    assert (models.shards > 1) == (shard == 700)
    got = {r.row_key: r.entropy for r in models.score(df, "row_key long").collect()}
    entropy = plain_models([d[1:] for d in docs])
    for i, lang, fold, t in docs:
        assert got[i] == (None if entropy(lang, fold, t) is None else pytest.approx(entropy(lang, fold, t), rel=1e-4))
    other = {(r.row_key, r.by): r.entropy for r in models.score_by_all(df.where("row_key < 4"), [0, 1]).collect()}
    assert all(other[i, by] == pytest.approx(entropy(by, docs[i][2], docs[i][3]), rel=1e-4) for i in range(4) for by in (0, 1))


def plain_verdicts(spark, rows):
    """kept of every row, written from the definition: plain models, edges by length class, other languages' models above the edge."""
    folds = {r.doc_id: r.f for r in frame(spark, rows).select("doc_id", F.expr("xxhash64(coalesce(text, '')) & 1").alias("f")).collect()}
    texts = [(lang or "", folds[i], t or "") for i, (t, lang) in enumerate(rows)]
    entropy = plain_models(texts)
    size = lambda t: min(max(len(t).bit_length() - 1, perplexity.SHORTEST), perplexity.LONGEST)
    failed = [m[0] < 50 or 100 * m[4] > 50 * m[0] for m in (measures(t) for _, _, t in texts)]
    own = [entropy(*x) for x in texts]
    values = defaultdict(list)
    for (lang, _, t), e, f in zip(texts, own, failed, strict=True):
        if not f and e is not None:
            values[lang, size(t)].append(math.floor(e * 1000 + 1e-6))

    def edges(v, whole):
        weighted = [(y, 1) for y in v] + [(y, min(1, 50 / len(whole))) for y in whole]

        def middle(x):
            half, run = sum(w for _, w in x) / 2, 0
            for y, w in sorted(x):
                run += w
                if run >= half - 1e-9:
                    return y

        def up(x):
            m = middle(x)
            return (m + 1) / 1000 + 4 * (1 + 20 / sum(w for _, w in x)) * max(0.015, 1.4826 * middle([(y - m, w) for y, w in x if y >= m]) / 1000)

        return -up([(-y - 1, w) for y, w in weighted]), up(weighted)

    band = {k: edges(v, [y for (lang, _), more in values.items() if lang == k[0] for y in more]) for k, v in values.items()}
    out = []
    for (lang, fold, t), e, f in zip(texts, own, failed, strict=True):
        fits = e is None or f or band[lang, size(t)][0] <= e <= band[lang, size(t)][1]
        if not fits and e > band[lang, size(t)][1]:
            others = [(entropy(by, fold, t), band[by, s]) for by, s in band if s == size(t)]
            fits = any(x is not None and lo <= x <= hi for x, (lo, hi) in others)
        out.append(not f and fits)
    return out


def test_verdicts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    de = ("der", "die", "und", "ei", "sch", "en")
    rows = [(prose(rng, 90), "en") for _ in range(60)] + [(prose(rng, 90, de), "de") for _ in range(40)]
    rows += [(prose(rng, 90, de), "en"), (prose(rng, 90), "de"), (" ".join("".join(rng.choice("qxzjkvw") for _ in range(5)) for _ in range(90)), "en"), ("few words", "en"), (None, None)]
    rows += [(prose(rng, 60, ("an",)), "en"), (prose(rng, 300), "en"), rows[5]]
    want = plain_verdicts(spark, rows)
    assert [r.kept for r in verdicts(spark, rows)] == want and not all(want) and want[100]
    monkeypatch.setattr(charmodel, "SHARD_ENTRIES", 500)  # many passes, the same verdicts
    assert [r.kept for r in verdicts(spark, rows)] == want


def test_either_edge_rejects(spark):
    rng = random.Random(10)
    syllables = ["an"] * 6 + ["the", "er", "in", "on", "re", "ed", "st", "ou", "ly"]
    clean = [prose(rng, 300, syllables) for _ in range(150)]
    low = " ".join("an" * rng.randint(1, 40) for _ in range(60))
    high = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300))
    got = verdicts(spark, [(t, "en") for t in [*clean, low, high]])
    assert sum(r.kept for r in got[:150]) >= 147
    assert got[150].entropy < got[150].low and got[151].entropy > got[151].high
    assert not any(r.kept or r.base_failed for r in got[150:])


def test_gibberish_in_any_script_is_rejected(spark):
    rng = random.Random(12)
    russian, japanese = ("на", "по", "сто", "ере", "ни", "ко", "ал"), ("これ", "東京", "です", "の", "本", "ます", "人々")
    rows = [(prose(rng, 120, russian), "ru") for _ in range(80)] + [(prose(rng, 120, japanese), "ja") for _ in range(80)]
    rows += [(" ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(5)) for _ in range(120)), "ru"), (" ".join("".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(4)) for _ in range(120)), "ja")]
    got = verdicts(spark, rows)
    assert sum(r.kept for r in got[:160]) >= 156
    assert not got[160].kept and not got[161].kept and not got[160].base_failed


def test_what_the_model_gathers_grows(spark):
    rng = random.Random(13)
    parts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(200)]
    sizes = []
    for n in (10, 100):
        df = spark.createDataFrame([(0, i % 2, prose(rng, 100, parts)) for i in range(n)], "lang_id long, fold long, text string")
        sizes.append(charmodel.CharModels(df, Stages(spark)).grams.count())
    assert sizes[1] > 3 * sizes[0]
