"""Code point n-gram models by language: modified Kneser-Ney, counted and built by Spark, kept as sorted hash arrays, scored by shards.

A symbol has 12 bits: code points below U+0800 (Latin, Greek, Cyrillic, Hebrew, Arabic and others) are symbols of their own, the rest are
hashed to the other half, and 0 stands before a text. An n-gram of ORDER symbols fits a 64-bit integer, so shorter ones are masks and shifts
of it, and the number of n-grams grows with the corpus. Texts are dealt into two folds by a hash of the text, and a text is scored
with the counts of the other fold, so that no text vouches for itself, nor for its exact copies.

A log probability is a sum of table entries: for each order the context's back-off weight, and what a known n-gram has beyond backing
off; an absent entry adds 0. So the entries can be cut by their hashes into shards of about SHARD_ENTRIES, each is broadcast in a
pass over the texts, and the passes' sums add up to the same score, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, chunks, tidy, utf8
from .shingles import U, mix

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: Bytes of text that are counted or scored at a time: a dozen arrays of 8 bytes a code point are made of them.
WORK_BYTES = 1 << 18
#: Entries of one broadcast shard (16 bytes each), and distinct n-grams that a counting task holds.
SHARD_ENTRIES, HELD = 4_000_000, 2_000_000
#: N-grams that a Python worker remembers (16 bytes each).
KNOWN = 2_000_000
GRAM, BACKOFF = 1, 2
_OWN = 0x800


def symbols(cps: np.ndarray) -> np.ndarray:
    """12-bit symbols of code points."""
    far = mix(cps.astype(U)) & U(_OWN - 1) | U(_OWN)
    return np.where(cps < _OWN, np.maximum(cps, 1), far).astype(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each code point, texts being preceded by zeros; and where each text's begin."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    sym = symbols(cps)
    code = sym.copy()
    for k in range(1, ORDER):
        code[k:] |= sym[:-k] << (k * BITS)
    full = at[:-1][np.diff(at) > 0]
    for k in range(ORDER - 1):  # the first ones of a text have no symbols of the text before
        here = full + k
        here = here[here < np.append(full[1:], len(sym))]
        code[here] &= (1 << (k + 1) * BITS) - 1
    return code, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang_id, fold, text -> lang_id, gram, n0, n1: the counts of one partition, at most about HELD n-grams being held."""
    held: dict[tuple[int, int], list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, fold), parts in held.items():
            k, n = _summed(parts)
            for i in range(0, len(k), 1 << 16):
                some, none = n[i : i + (1 << 16)], np.zeros(len(n[i : i + (1 << 16)]), np.int64)
                by = (some, none) if fold == 0 else (none, some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), lang)), pa.array(k[i : i + (1 << 16)]), *map(pa.array, by)], ["lang_id", "gram", "n0", "n1"])
        held.clear()

    for batch in tidy(batches):
        langs, folds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, off = utf8(batch.column(2))
        for i, j in chunks(off, WORK_BYTES):
            code, at = grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for lang, fold, own in groups(langs[i:j], folds[i:j], at):
                k, c = np.unique(code[own], return_counts=True)
                held.setdefault((lang, fold), []).append((k, c))
                size += len(k)
            if size > HELD:
                for g, parts in held.items():
                    held[g] = [_summed(parts)]
                size = sum(len(p[0][0]) for p in held.values())
                if size > 3 * HELD // 4:
                    yield from flush()
                    size = 0
    yield from flush()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    k, inv = np.unique(keys, return_inverse=True)
    return k, np.bincount(inv, counts, len(k)).astype(np.int64)


def groups(langs: np.ndarray, folds: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Language, fold, and which positions belong to their texts."""
    n = np.diff(at)
    for lang in np.unique(langs).tolist():
        for fold in (0, 1):
            mine = (langs == lang) & (folds == fold)
            if n[mine].any():
                yield lang, fold, np.repeat(mine, n)


def _mask(order: int) -> int:
    return (1 << BITS * order) - 1


def ngram_counts(texts: DataFrame, stages: Stages) -> DataFrame:
    """lang_id, ord, gram, n0, n1 by fold: counts of the highest order; below, the number of distinct symbols in front."""
    found = texts.select("lang_id", "fold", "text").mapInArrow(_count, "lang_id long, gram long, n0 long, n1 long")
    above = stages.keep(found.groupBy("lang_id", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "ngrams")
    out = above.withColumn("ord", F.lit(ORDER))
    seen = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
    for order in range(ORDER - 1, 0, -1):
        above = above.groupBy("lang_id", F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")).agg(seen("n0"), seen("n1"))
        out = out.union(above.withColumn("ord", F.lit(order)))
    return out.select("lang_id", "ord", "gram", "n0", "n1")


def _discounts(counts: DataFrame) -> DataFrame:
    """lang_id, ord, and d{fold}{x} for counts x of 1, 2, 3 and more, from the numbers of n-grams with counts 1 to 4."""
    n = lambda f, x: F.col(f"c{f}{x}")
    of = counts.groupBy("lang_id", "ord").agg(*(F.sum((F.col(f"n{f}") == x).cast("long")).alias(f"c{f}{x}") for f in (0, 1) for x in (1, 2, 3, 4)))
    out = []
    for f in (0, 1):
        y = n(f, 1) / (n(f, 1) + 2 * n(f, 2))
        some = F.least(*(n(f, x) for x in (1, 2, 3, 4))) > 0
        for x, plain in ((1, 0.5), (2, 0.75), (3, 0.9)):
            d = F.greatest(F.lit(0.05), F.least(F.lit(x - 0.05), x - (x + 1) * y * n(f, x + 1) / n(f, x)))
            out.append(F.when(some, d).otherwise(plain).alias(f"d{f}{x}"))
    return of.select("lang_id", "ord", *out)


def build(counts: DataFrame, stages: Stages) -> DataFrame:
    """lang_id, kind, ord, gram, v0, v1: the entries of all models. A back-off entry's gram is the context."""
    rows = counts.join(F.broadcast(_discounts(counts)), ["lang_id", "ord"])
    off = lambda f: F.when(F.col(f"n{f}") == 0, 0.0).when(F.col(f"n{f}") == 1, F.col(f"d{f}1")).when(F.col(f"n{f}") == 2, F.col(f"d{f}2")).otherwise(F.col(f"d{f}3"))
    rows = rows.select("lang_id", "ord", "gram", F.shiftright("gram", BITS).alias("ctx"), "n0", "n1", off(0).alias("e0"), off(1).alias("e1"))
    sums = rows.groupBy("lang_id", "ord", "ctx").agg(*(F.sum(c).alias(f"s{c}") for c in ("n0", "n1", "e0", "e1")))
    weight = lambda f: F.when(F.col(f"sn{f}") > 0, F.col(f"se{f}") / F.col(f"sn{f}")).otherwise(1.0)
    sums = stages.keep(sums.select("lang_id", "ord", "ctx", "sn0", "sn1", weight(0).alias("w0"), weight(1).alias("w1")), "contexts")
    direct = lambda f: F.when(F.col(f"n{f}") > 0, (F.col(f"n{f}") - F.col(f"e{f}")) / F.col(f"sn{f}")).otherwise(0.0)
    rows = rows.join(sums, ["lang_id", "ord", "ctx"]).select("lang_id", "ord", "gram", "n0", "n1", "w0", "w1", direct(0).alias("a0"), direct(1).alias("a1"))
    rows = stages.keep(rows, "shares")
    beyond = lambda f: F.when(F.col(f"n{f}") > 0, F.log2(F.col(f"p{f}") / (F.col(f"w{f}") * F.col(f"q{f}")))).otherwise(0.0).cast("float").alias(f"v{f}")
    out = sums.select("lang_id", F.lit(BACKOFF).alias("kind"), "ord", F.col("ctx").alias("gram"), *(F.log2(f"w{f}").cast("float").alias(f"v{f}") for f in (0, 1)))
    lower = None
    for order in range(1, ORDER + 1):
        own = rows.where(F.col("ord") == order)
        if lower is None:
            own = own.withColumn("q0", F.lit(1 / SYMBOLS)).withColumn("q1", F.lit(1 / SYMBOLS))
        else:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(order - 1)))).join(lower, ["lang_id", "suffix"])
        own = own.withColumn("p0", F.col("a0") + F.col("w0") * F.col("q0")).withColumn("p1", F.col("a1") + F.col("w1") * F.col("q1"))
        own = stages.keep(own.select("lang_id", F.lit(GRAM).alias("kind"), "ord", "gram", beyond(0), beyond(1), "p0", "p1"), "order")
        lower = own.select("lang_id", F.col("gram").alias("suffix"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        out = out.union(own.drop("p0", "p1"))
    out = stages.keep(out, "entries")
    stages.drop(rows)
    return out


def entry_hash(lang: np.ndarray | int, kind: np.ndarray | int, order: np.ndarray | int, gram: np.ndarray) -> np.ndarray:
    lang, kind, order = (np.atleast_1d(np.asarray(x, np.int64)).view(U) for x in (lang, kind, order))
    return mix(mix(gram.view(U) + (kind * U(8) + order) * U(0x9E3779B97F4A7C15)) ^ lang)


def in_shard(h: np.ndarray, shard: int, shards: int) -> np.ndarray:
    return h % U(shards) == U(shard)


def _entries(shard: int, shards: int):
    """lang_id, kind, ord, gram, v0, v1 -> h, v0, v1 of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            lang, kind, order, gram = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            h = entry_hash(lang, kind, order, gram)
            mine = in_shard(h, shard, shards)
            yield pa.RecordBatch.from_arrays([pa.array(h[mine].view(np.int64)), *(batch.column(k).filter(pa.array(mine)) for k in (4, 5))], ["h", "v0", "v1"])

    return run


class Shard:
    """Entries as a sorted hash array beside the values by fold."""

    def __init__(self, t: pa.Table):
        h = t["h"].to_numpy().view(U)
        o = np.argsort(h)
        self.keys, self.values = h[o], np.stack([t["v0"].to_numpy()[o], t["v1"].to_numpy()[o]])
        #: By language and fold the n-grams that this Python worker has looked up, ascending, and their bits.
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def value(self, fold: int, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.float32)
        o = np.argsort(h)  # neighbouring searches touch neighbouring memory
        at = np.empty(len(h), np.int64)
        at[o] = np.minimum(np.searchsorted(self.keys, h[o]), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[fold][at], 0)

    def all_bits(self, lang: int, fold: int, gram: np.ndarray, shard: int, shards: int) -> np.ndarray:
        """bits() of n-grams that may repeat; those looked up before are remembered, up to KNOWN at a time."""
        keys, bits = self.known.get((lang, fold), (np.zeros(0, np.int64), np.zeros(0)))
        out = np.zeros(len(gram))
        new = np.ones(len(gram), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            new = keys[at] != gram
            out = bits[at]
        if new.any():
            fresh = gram[new]
            more = np.unique(fresh)
            found = self.bits(lang, fold, more, shard, shards)
            out[new] = found[np.searchsorted(more, fresh)]
            if sum(len(k) for k, _ in self.known.values()) + len(more) > KNOWN:
                self.known.clear()
                keys, bits = np.zeros(0, np.int64), np.zeros(0)
            where = np.searchsorted(keys, more)
            self.known[lang, fold] = np.insert(keys, where, more), np.insert(bits, where, found)
        return out

    def bits(self, lang: int, fold: int, gram: np.ndarray, shard: int, shards: int) -> np.ndarray:
        """The shard's share of the log probability of the last symbol of each of ascending, distinct n-grams."""
        out = np.zeros(len(gram))
        for order in range(ORDER, 0, -1):
            g = gram & _mask(order)
            g, inv = (g, None) if order == ORDER else np.unique(g, return_inverse=True)
            both = np.zeros(len(g))
            for h in (entry_hash(lang, GRAM, order, g), entry_hash(lang, BACKOFF, order, g >> BITS)):
                if shards == 1:
                    both += self.value(fold, h)
                else:
                    mine = in_shard(h, shard, shards)
                    both[mine] += self.value(fold, h[mine])
            out += both if inv is None else both[inv]
        return out


def _score(model, shard: int, shards: int, extra):
    """lang_id, fold, text, ids ... -> ids ..., n, bits: code points, and the shard's share of the log probability by the other fold's counts.

    extra(data, offsets) gives more columns from a chunk of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            langs, folds = (np.array(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
            data, off = utf8(batch.column(2))
            for i, j in chunks(off, WORK_BYTES):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                code, at = grams(d, o)
                bits = np.zeros(len(code))
                for lang, fold, own in groups(langs[i:j], folds[i:j], at):
                    bits[own] = model.value.all_bits(lang, 1 - fold, code[own], shard, shards)
                cum = np.concatenate((np.zeros(1), np.cumsum(bits)))
                cols = {batch.schema.names[c]: batch.column(c).slice(i, j - i) for c in range(3, batch.num_columns)}
                cols |= {"n": pa.array(np.diff(at).astype(np.int64)), "bits": pa.array(cum[at[1:]] - cum[at[:-1]])} | (extra(d, o) if extra else {})
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _by_all(model, shard: int, shards: int, langs: list[int]):
    """row_key, fold, text -> row_key, by, n, bits for each language by: both folds' mean for texts that may be of another language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            folds = batch.column(1).to_numpy(zero_copy_only=False)
            data, off = utf8(batch.column(2))
            for i, j in chunks(off, WORK_BYTES):
                code, at = grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                seen, inv = np.unique(code, return_inverse=True)
                fold = np.repeat(folds[i:j], np.diff(at))
                for lang in langs:
                    by = np.stack([model.value.bits(lang, 1 - f, seen, shard, shards) for f in (0, 1)])
                    cum = np.concatenate((np.zeros(1), np.cumsum(by[fold, inv])))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, lang)), pa.array(np.diff(at).astype(np.int64)), pa.array(cum[at[1:]] - cum[at[:-1]])], ["row_key", "by", "n", "bits"])

    return run


def _bits_of(total: Column, n: Column) -> Column:
    """Null for an empty text, and without counts in the other fold."""
    return F.when((n > 0) & (total != 0), BITS - total / n)


class CharModels:
    """The models of all languages of texts (lang_id, fold, text)."""

    def __init__(self, texts: DataFrame, stages: Stages):
        self.stages = stages
        counts = stages.keep(ngram_counts(texts, stages), "orders")
        self.entries = build(counts, stages)
        self.grams = counts.where(F.col("ord") == ORDER).select("lang_id", "gram", "n0", "n1")
        self.shards = max(1, -(-self.entries.count() // SHARD_ENTRIES))

    def _shard(self, s: int):
        t = self.entries.mapInArrow(_entries(s, self.shards), "h long, v0 float, v1 float").toArrow()
        return self.entries.sparkSession.sparkContext.broadcast(Shard(t))

    def _passes(self, keys: list[str], one) -> DataFrame:
        """The sum over all shards of one(shard's broadcast, shard) by keys; other columns come from the first pass."""
        first, others = None, []
        for s in range(self.shards):
            model = self._shard(s)
            part = self.stages.keep(one(model, s), "bits")
            model.destroy()
            if first is None:
                first = part
            else:  # equal rows of a key have equal sums
                others.append(part.groupBy(*keys).agg(F.max("bits").alias("more")))
        if not others:
            return first
        more = reduce(DataFrame.union, others).groupBy(*keys).agg(F.sum("more").alias("more"))
        return first.join(more, keys).withColumn("bits", F.col("bits") + F.col("more")).drop("more")

    def score(self, texts: DataFrame, ids: str, extra=None, more: str = "") -> DataFrame:
        """The columns ids (a schema; its first is a key, hashed from id, language and text) of texts, more of extra, n, and entropy in bits a code point (null for an empty text)."""
        names = [c.split()[0] for c in ids.split(",")]
        schema = f"{ids}, n long, bits double{more}"
        rows = texts.select("lang_id", "fold", "text", *names)
        one = lambda model, s: rows.mapInArrow(_score(model, s, self.shards, extra if s == 0 else None), schema if s == 0 else f"{ids}, n long, bits double")
        out = self._passes(names[:1], one)
        return out.withColumn("entropy", _bits_of(F.col("bits"), F.col("n"))).drop("bits")

    def score_by_all(self, texts: DataFrame, langs: list[int]) -> DataFrame:
        """row_key, by, entropy of texts (row_key, fold, text) by the models of langs."""
        one = lambda model, s: texts.select("row_key", "fold", "text").mapInArrow(_by_all(model, s, self.shards, langs), "row_key long, by long, n long, bits double")
        return self._passes(["row_key", "by"], one).select("row_key", "by", _bits_of(F.col("bits"), F.col("n")).alias("entropy"))
