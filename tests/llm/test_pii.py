import hashlib
import random
import re

from tessera.llm.pii import masked, pii_digest, pii_spans, redact, spans_text
from pyspark.sql import functions as F


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]
BITS = ["1", "2", ".", "@", "a", "b.c", "+", "-", " ", "4111", "555", "é", "😀", "(", ")", "\n", "255", "x@y.z", "%", "_", "0", "9.9.9.9", "+1 ", "4111 1111 1111 1111", "007.1.2.3"]


def brute(t):
    found, counts = [], []
    for k, (kind, pattern, good) in enumerate(KINDS):
        hits = [m for m in re.finditer(pattern, t or "") if good(m.group())]
        counts.append(len(hits))
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in hits]
    return (*counts, hashlib.sha256(",".join(x for _, _, x in sorted(found)).encode()).hexdigest())


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "1" * 30_000, "a" * 30_000 + "@", "1 " * 20_000, "+1" + "(" * 20_000, "a@b" + ".c" * 10_000, "a.b@c.d " * 2000, "@" * 1000, "1." * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii_digest(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t or "")[:200]


def spans(spark, t):
    return spark.createDataFrame([(t,)], "t string").select(spans_text(pii_spans(F.col("t"))).alias("s")).first()["s"]


def test_checksums_and_context(spark):
    assert spans(spark, "GB82 WEST 1234 5698 7654 32 x") == "iban:0:27"
    assert spans(spark, "GB83 WEST 1234 5698 7654 32 x") == ""
    assert spans(spark, "my ssn 123-45-6789 z") == "ssn:7:18"
    assert spans(spark, "part 123-45-6789 z") == ""
    assert spans(spark, "password=b7db7aa4a5fcc78305 end") == "secret:9:27"
    assert spans(spark, "number b7db7aa4a5fcc78305 end") == ""


def test_masking(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4; +1 (555) 123-4567!", 0, "k"), (2, None, 3, None), (3, "", 0, None), (4, "4111 1111 1111 1111" * 1, 0, None)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: (r.text, r.n_chars) for r in redact(df).collect()}
    assert got[1] == ("é <EMAIL>, <IP>; <PHONE>!", 25)
    assert got[2] == (None, None) and got[3] == ("", 0) and got[4] == ("<CARD>", 6)
    assert redact(df).columns == df.columns
    assert redact(df.where("doc_id < 0")).count() == 0
    over = spark.createDataFrame([("+1.2.3.4 55555 z",)], "t string").select(masked(F.col("t"), pii_spans(F.col("t"))).alias("m")).first()["m"]
    assert over == "<PHONE> z"


def test_native(spark):
    plan = pii_digest(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_account_numbers_end_where_their_country_says(spark):
    assert spans(spark, "IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB") == "iban:5:34"
    assert spans(spark, "AT61 1904 3002 3457 3201 BIC BKAUATWW") == "iban:0:24"
    assert spans(spark, "PAY BE68 5390 0754 7034 KBC NOW") == "iban:4:23"
    assert spans(spark, "DE89370400440532013000 AND GB82 WEST 1234 5698 7654 32 ALSO") == "iban:0:22,iban:27:54"


def test_context_reaches_over_other_spans_and_follows(spark):
    assert spans(spark, "SSN: 123-45-6789, 223-45-6789, 323-45-6789.") == "ssn:5:16,ssn:18:29,ssn:31:42"
    assert spans(spark, "123-45-6789 is the ssn") == "ssn:0:11"
    assert spans(spark, "123-45-6789 " + "x" * 48 + " ssn") == ""
    assert spans(spark, "ssn " + "x" * 48 + " 123-45-6789") == ""


def test_secrets_are_masked_to_their_end(spark):
    tail = "a1" * 100
    assert spans(spark, f"password={tail} end") == "secret:9:209"
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIi.SflK-xw_RJSM="
    assert spans(spark, f"token: {token}. Then") == f"secret:7:{7 + len(token)}"
