"""URL rules, chat formatting, neighbours and the pipeline."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, permutation, queries, urlfilter


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "in", "on", "re", "ed", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


# --- URL rules


URLS = [None, "", "no scheme", "http://net", "http://net/", "HTTP://A.NET/x", "https://example.net/en/a", "https://www.Example.net/en/", "https://example.net/en", "https://badexample.net/en/x", "x://example.com/de/?q", "http://sub.example.com/de/y#z", "http://example.com/fr/", "http://org/fr/", "http://a.b.org/fr/x", "http://a.org?/fr/", "http://a.org#/fr/", "//net/x", "http://net/a://example.com/de/", "http:///x", "http://a..net/x", "http://example.net:80/en/"]


def rule_of(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [k for k, _ in urlfilter.RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    verdict = dict(urlfilter.RULES)
    out = urlfilter.judge(df)
    for r in out.collect():
        host, path, rule = rule_of(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict.get(rule, "allow")), URLS[r.page_id]
    assert urlfilter.judge(df.where("page_id < 0")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Join", plan)


def test_many_rules_and_long_hosts(spark, monkeypatch):
    rng = random.Random(8)
    rules = [(f"h{i}.{rng.choice(['com', 'net'])}/{'x/' * (i % 3)}", ["block", "allow", "ask"][i % 3]) for i in range(100_000)]
    verdict = dict(rules)
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(120_000)}.{rng.choice(['com', 'net'])}/{'x/' * rng.randrange(4)}y" for _ in range(3000)]
    urls += ["http://" + "a." * 10_000 + "h7.com/x/", "http://" + "." * 10_000, "http://h3.com/" + "x/" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    for r in urlfilter.judge(df, rules, default="none").collect():
        host, path = r.host.split("."), r.path
        keys = [f"{'.'.join(host[-2:])}{path[:n]}" for n in (5, 3, 1) if path[:n].endswith("/") and len(path) >= n]
        want = next((k for k in keys if k in verdict), None)
        assert (r.rule, r.verdict) == (want, verdict.get(want, "none")), urls[r.page_id][:60]
    monkeypatch.setattr(urlfilter, "MAX_BITS", 1 << 10)  # many shards
    some = urlfilter.judge(df, rules[:300], default="none")
    want = {i for i, u in enumerate(urls) if any(u.partition("://")[2].partition("/")[0].endswith(k.partition("/")[0]) and ("." + u.partition("://")[2].partition("/")[0]).endswith("." + k.partition("/")[0]) and ("/" + u.partition("://")[2].partition("/")[2]).startswith("/" + k.partition("/")[2]) for k, _ in rules[:300])}
    assert {r.page_id for r in some.collect() if r.rule} == want


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "FALSE_RATE", 0.3)
    keys = [f"k{i}" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = keys[::7] + ["elsewhere"]
    cascade = urlfilter.Cascade(spark, universe, listed)
    assert len(cascade.levels) > 2
    assert {r.key for r in universe.where(cascade.holds(F.col("key"))).collect()} == set(keys[::7])


def test_long_lists_take_several_cascades(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BITS", 64)
    rules = tuple((f"h{i}.com/a/", "block") for i in range(30))
    df = spark.createDataFrame([(i, f"http://x.h{i}.com/a/b") for i in range(40)], "page_id long, url string")
    assert sorted(r.page_id for r in urlfilter.judge(df, rules).where("verdict = 'block'").collect()) == list(range(30))


# --- chat


TALK = [(1, 0, "system", "\\\\### a: </turn>"), (1, 1, "user", "hi\n"), (1, 2, "assistant", "###\\"), (1, 2, "assistant", "###\\"), (2, 5, "assistant", "only ä"), (2, None, None, None), (None, 1, "user", "lost"), (3, 0, "us:er ### x", "####</turn</turn>"), *[(4, i, ("user", "assistant")[i % 2], f"turn {i} </turn> \\### {'x' * i}") for i in range(100)]]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, 1) for t in TALK], "conv_id long, turn long, role string, text string, place int").repartition(6)
    t = chat.TurnTemplate()
    made = chat.format_conversations(df, t)
    by = {}
    for c, n, r, x in sorted(TALK, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for r in sorted(made.collect(), key=lambda r: r.place):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.piece
    assert whole == {c: t.render(m) for c, m in by.items()}
    for r in chat.read_back(made, t).collect():
        m = by[r.conv_id]
        loss = "".join(x for role, x in m if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(m), len(loss), len(t.render(m)))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in m).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.where("conv_id < 0"), t).count() == 0


def test_templates_that_rewrite_history(spark):
    class Forgetful:
        """Drops thoughts from all assistant turns but the last, as some templates do."""

        def render(self, messages):
            last = max((i for i, (r, _) in enumerate(messages) if r == "assistant"), default=-1)
            return "".join(f"[{r}]{x if i >= last else re.sub('<think>.*?</think>', '', x)}\n" for i, (r, x) in enumerate(messages))

    talk = [("user", "a"), ("assistant", "<think>t</think>b"), ("user", "c"), ("assistant", "d")]
    out, spans, rewrites = chat.turn_spans(Forgetful(), talk)
    assert rewrites == [3] and out == "[user]a\n[assistant]b\n[user]c\n[assistant]d\n" and len(spans) == 4
    df = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(talk)] + [(2, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.place): (r.piece, r.rewrites) for r in chat.format_conversations(df, Forgetful()).collect()}
    assert got[1, 3] == (out, True) and got[2, 0] == ("[user]z\n", False)


def test_rewrites_that_only_some_conversations_show(spark):
    class LastTurns:
        """Keeps the last 24 turns only."""

        def render(self, messages):
            return "".join(f"[{r}]{x}\n" for r, x in messages[-24:])

    class NoToolJson:
        """Leaves out the tool's answers that look like JSON, once another turn follows."""

        def render(self, messages):
            return "".join(f"[{r}]{x}\n" for i, (r, x) in enumerate(messages) if i == len(messages) - 1 or not (r == "tool" and x.startswith("{")))

    class SaysLocal(LastTurns):
        lookback = 1

        def render(self, messages):
            return f"{len(messages)}:" + super().render(messages)

    long = [(1, i, "user", f"t{i}") for i in range(30)]
    df = spark.createDataFrame([*long, (2, 0, "user", "a"), (2, 1, "tool", "{}"), (2, 2, "assistant", "b"), (3, 0, "tool", "x"), (3, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    marks = lambda t: {(r.conv_id, r.place) for r in chat.format_conversations(df, t).collect() if r.rewrites}
    assert marks(LastTurns()) == {(1, i) for i in range(24, 30)}
    assert marks(NoToolJson()) == {(2, 2)}
    assert {c for c, _ in marks(SaysLocal())} >= {1, 2, 3}
    whole = {r.place: r.piece for r in chat.format_conversations(df, LastTurns()).where("conv_id = 1").collect()}
    assert whole[29] == LastTurns().render([(r, x) for _, _, r, x in long])


def test_declared_windows_give_what_prefixes_give(spark):
    class Prefixes(chat.TurnTemplate):
        lookback = None

    rows = [(i % 3, i, None if i % 11 == 0 else ["user", "assistant"][i % 2], f"x{i} ### \\ </turn>" if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, 1, None, None), (None, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = [sorted(chat.format_conversations(df, t).collect(), key=lambda r: (str(r.conv_id), r.place)) for t in (chat.TurnTemplate(), Prefixes())]
    assert got[0] == got[1] and not any(r.rewrites for r in got[0])


# --- neighbours


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[100]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None, *[0.0] * 6]), (None, [1.0] * 8), (904, [1.0, 2.0]), (1000, [float("inf")] * 8)]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, score string").repartition(5)
    monkeypatch.setattr(permutation, "BLOCK", 300)
    monkeypatch.setattr(permutation, "QUERY_BYTES", 3 * 8 * 8)  # several passes
    got = permutation.nearest(df, df.where("vec_id % 50 = 0"), 10).collect()
    hits = asked = 0
    y = x.astype(np.float64)
    for q in range(0, 700, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(700), d))[:10].tolist()
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == d[r.vec_id] for r in own)
        hits += len(set(true) & {r.vec_id for r in own})
        asked += 10
        if q in (100, 150):
            assert [r.vec_id for r in own] == true
    assert hits >= 0.9 * asked
    assert {r.query_id for r in got} == set(range(0, 700, 50))
    assert permutation.nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0
    few = permutation.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]


@pytest.mark.parametrize("dim,clusters", [(64, 0), (256, 0), (64, 40)])
def test_recall_at_production_settings(spark, dim, clusters):
    rng = np.random.default_rng(dim + clusters)
    x = rng.normal(size=(9000, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, 9000)] * 3 + x
    x[500:900] = x[500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in permutation.nearest(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, 9000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(9000), d))[:10].tolist()
        hits += len(set(true) & set(got[q]))
        assert all(got[q][v] == pytest.approx(d[v], abs=1e-12) for v in got[q])
    assert hits >= 0.9 * 900


def test_repeated_rows_are_no_hot_block(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])] * 20_000 + [(i, [float(i), 1.0]) for i in range(2, 30)], "vec_id long, embedding array<double>").repartition(3)
    got = permutation.nearest(df, df.where("vec_id = 2"), 10).collect()
    d = sorted([(math.hypot(2.0 - 1.0, 1.0 - 2.0), 1)] * 20_000 + [(abs(i - 2.0), i) for i in range(3, 30)])[:10]
    assert [(r.score, r.vec_id) for r in got] == d


def test_footrule_is_what_inverted_files_save():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(50, 4)), rng.normal(size=(12, 4))
    perm = permutation.permutations(x, pivots, 5)
    files = permutation.inverted_files(perm, 12)
    place = lambda p, row: row.index(p) if p in row else 5
    lists = perm.tolist()
    for q in range(5):
        saved = np.zeros(50, int)
        for i, p in enumerate(lists[q]):
            where, places = files[p]
            saved[where] += 5 - np.maximum(i, places)
        plain = [sum(abs(place(p, lists[q]) - place(p, row)) for p in range(12)) for row in lists]
        assert (2 * 15 - 2 * saved).tolist() == plain


# --- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    rel = con.execute(queries.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, rel.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    good = [prose(rng, 90) + " mail x.y@z.org now" * (i % 3 == 0) for i in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[0], "en", "s", 1), (101, good[1] + " inst", "en", "s", 1), (102, "junk", "en", "s", 4), (103, None, None, None, None), (104, prose(rng, 80) + " mail x.y@z.org now", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        kept.append({r.doc_id for r in docs.collect()})
    refused = {*range(60), 100, 101, 104} - kept[0]
    assert len(refused) <= 1 and kept[0] <= {*range(60), 100, 101, 104}  # the model's edges may refuse one
    assert kept[1] == kept[2] == {*range(60), 104} - refused
    assert {r.text[-12:] for r in docs.where("doc_id = 104").collect()} == {"<EMAIL> now"[-12:].rjust(12)}
    last = p.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in last.collect()} == kept[-1]


def test_pipeline_run_on_files(spark, tmp_path):
    """run() over files gives what the stages give, with columns that clash with helpers', and over an empty table nothing."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    rng = random.Random(5)
    rows = [(i, prose(rng, 90) + " mail x.y@z.org now" * (i % 3 == 0), "en", "s", 9, 1, 2, 3) for i in range(40)] + [(90, "few", "en", "s", 3, 1, 2, 3), (91, None, None, None, None, None, None, None)]
    rows += [(92, rows[3][1], "en", "s", 9, 1, 2, 3), (93, prose(rng, 80) + " mail x.y@z.org now", "en", "s", 9, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, spans int, _pii_spans int")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.where("false").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    got = p.run(spark, str(tmp_path / "a")).collect()
    texts = {}
    lib = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    for r in sorted(got, key=lambda r: r.start):
        texts[r.doc_id] = texts.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    want = {r[0]: r[1].replace("x.y@z.org", "<EMAIL>") for r in rows if r[0] not in (90, 91, 92)}
    missing = {i for i in want if i not in texts}
    assert len(missing) <= 1 and 93 not in missing  # the model's edges may refuse one of forty
    assert {i: x[:-1] for i, x in texts.items()} == {i: lib.encode(t, add_special_tokens=False).ids for i, t in want.items() if i not in missing}
    assert p.run(spark, str(tmp_path / "b")).count() == 0


def test_queries_run_over_the_small_tables(spark):
    """The registered queries themselves, each checked against what its contract says of every row."""
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op1_hyperminhash", "op2_pii", "op4_bpe", "op5_pfor", "op6_perplexity"):
        rows = queries.QUERIES[name](spark, folder).collect()
        assert len(rows) == n and len({r.doc_id for r in rows}) == n
    ids = {r.doc_id: r.n_tokens for r in queries.op5_pfor(spark, folder).collect()}
    pieces = queries.op8_packing(spark, folder).collect()
    sums = {}
    for r in pieces:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == ids and "ids" not in pieces[0]
    assert sum(r.n_docs for r in queries.op9_lengths(spark, folder).collect()) == n
    found = queries.op10_permutation(spark, folder).collect()
    assert {r.query_id for r in found} <= set(range(0, 10**6, 100)) and all(r.rank <= 10 for r in found)
