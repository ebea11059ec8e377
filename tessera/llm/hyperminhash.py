"""Near-duplicate documents by HyperMinHash.

Each text becomes the set of its k-word shingles. A set is sketched into 128 buckets; a bucket keeps its smallest hash
in 16 bits, as a leading-zero count (6 bits) and the mantissa bits after the leading one (10 bits). Buckets that a small
set leaves empty borrow the register of the first filled bucket in a fixed order of probes, so that small sets band as
well as large ones. Bands of 5 registers propose links, the share of equal registers, corrected for chance collisions,
drops proposals far below the threshold, and the rest is confirmed on the full sets of 64-bit shingle hashes.

Scale: equal sets are first merged into one node (partial aggregation, so a hot group of copies never meets in a
task). In a band bucket the members are compared with one hub: the node that shares most buckets, which in a family of
copies is the text they come from. That finds nearly every component. What remains are buckets whose other members still lie in several
components; there every two members of different components are compared, each pair in the first bucket they share only. Members
are classed by set size in steps of the threshold, as only sets of one class or of neighbouring ones can be linked. The members of a class and bucket
are cut into blocks of CELL_BYTES of sets and BLOCK members at most, and a task compares two blocks: it holds their sets, and emits the links it
confirms, not the pairs. So no link is lost, and no task grows with a bucket or with the texts in it, but for the one set that a block has at least. Components come from alternating large-star and small-star steps. Every
step's result is a table in the shared folder; the driver sees counts only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Stages, chunks, fresh, tidy, utf8
from .shingles import U, mix, shingle_sets

BUCKETS, ROWS_PER_BAND = 128, 5
BANDS = BUCKETS // ROWS_PER_BAND
MANTISSA = 10
#: Standard errors by which an estimate may fall short.
ERRORS = 4.5
#: Up to so many ids of 8 bytes are broadcast; more are shuffled.
BROADCAST_IDS = 4_000_000
#: Members of a bucket that a task holds at once, twice, and the bytes of their sets.
BLOCK, CELL_BYTES = 2048, 8 << 20
_BELOW = 57  # bits of a hash below the 7 that choose the bucket
_PROBES = np.stack([np.random.default_rng(b + 1).permutation(BUCKETS) for b in range(BUCKETS)])
_EDGES = np.arange(BUCKETS, dtype=U) << U(_BELOW)


def sketch(x: np.ndarray) -> np.ndarray:
    """The 128 registers (uint16) of a sorted, non-empty array of distinct hashes."""
    at = np.searchsorted(x, _EDGES)
    value = x[np.minimum(at, len(x) - 1)]
    filled = (at < len(x)) & (value >> U(_BELOW) == np.arange(BUCKETS, dtype=U))
    low = (value & U((1 << _BELOW) - 1)) | U(1 << 10)  # a floor of 2 ** 10 keeps the float exact below
    zeros = _BELOW - np.frexp((low >> U(10)).astype(np.float64))[1] - 10
    rest = (low << (zeros + 1).astype(U)) & U((1 << _BELOW) - 1)
    reg = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (rest >> U(_BELOW - MANTISSA)).astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        donor = _PROBES[empty, filled[_PROBES[empty]].argmax(1)]
        reg[empty] = reg[donor]
    return reg


def chance(n: float, m: float) -> float:
    """Probability that two registers of disjoint sets of n and m hashes are equal: the sum over cells of both minima's odds."""
    return _chance(round(math.log2(max(n, 1)) * 4), round(math.log2(max(m, 1)) * 4))


_CHANCE: dict[tuple[int, int], float] = {}


def _chance(a: int, b: int) -> float:
    if (a, b) not in _CHANCE:
        cells = 2.0 ** -np.arange(0, 48)[:, None] * (1 + np.arange(2**MANTISSA + 1)[None, :] / 2**MANTISSA) / 2  # cell edges
        prob = [-np.diff(np.exp(np.log1p(-np.minimum(cells, 1 - 1e-16)) * max(2 ** (v / 4) / BUCKETS, 1)), axis=1) for v in (a, b)]
        _CHANCE[a, b] = float((prob[0] * prob[1]).sum())
    return _CHANCE[a, b]


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from registers, without the matches to be expected by chance."""
    c = chance(n, m)
    return max(0.0, (float((a == b).mean()) - c) / (1 - c))


def worth(est: float, n: int, m: int, t: float) -> bool:
    """False where the estimate is over ERRORS standard errors below t, or the sizes alone rule t out."""
    if min(n, m) < t * max(n, m) - 1e-9:
        return False
    seen = BUCKETS * (1 - (1 - 1 / BUCKETS) ** min(n, m))
    return est >= t - ERRORS * math.sqrt(t * (1 - t) / max(1.0, seen))


def _scan(k: int, full: bool):
    """A function for mapInArrow: doc_id and text -> a row for each document; full: with the whole set, else with registers and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            ids = batch.column(0)
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, CHUNK_BYTES):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                node = [hashlib.blake2b(x, digest_size=16).digest() if len(x) else None for x in sets]
                n = pa.array([len(x) for x in sets], pa.int64())
                last = [x.tobytes() if len(x) else None for x in sets] if full else [sketch(x).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), n, pa.array(node, pa.binary()), pa.array(last, pa.binary())], ["doc_id", "n_shingles", "node", "set" if full else "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, sketch -> node, its band keys of 64 bits (the band's number goes into the key) and the band."""
    mul = np.random.default_rng(7).integers(1 << 32, 1 << 63, (BANDS, ROWS_PER_BAND)).astype(U) * U(2) + U(1)
    for batch in batches:
        if batch.num_rows:
            reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : BANDS * ROWS_PER_BAND].reshape(-1, BANDS, ROWS_PER_BAND)
            key = mix(mix((reg.astype(U) * mul).sum(2, dtype=U)) + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(key), dtype=np.int32), BANDS)), batch.column(0)).dictionary_decode(), pa.array(key.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(key)))], ["node", "key", "band"])


def _likely(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (c.to_pylist() for c in batch.columns[4:])
            keep = [worth(estimate(np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16), v, w), v, w, t) for v, w, p, q in zip(n, m, x, y, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_pylist() for c in batch.columns[2:])
            keep = []
            for p, q in zip(x, y, strict=True):
                v, w = np.frombuffer(p, U), np.frombuffer(q, U)
                if len(v) > len(w):
                    v, w = w, v
                at = np.minimum(np.searchsorted(w, v), len(w) - 1)
                both = int((w[at] == v).sum())
                keep.append(100 * both >= percent * (len(v) + len(w) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1]).rename_columns(["a", "b"])

    return run


def _within(percent: int):
    """key, band, cls, kind, lo, hi, side, comp, n, sketch, set, sorted by bucket and cell -> the confirmed links between components of each cell.

    side: 0 and 1 are compared with each other, 2 among themselves.
    """
    t = percent / 100

    def cell(rows: list[tuple]) -> set[tuple[bytes, bytes]]:
        band = rows[0][1]
        comps, number = [r[7] for r in rows], {}
        comp = np.array([number.setdefault(c, len(number)) for c in comps])
        if len(number) < 2:
            return set()
        n = np.array([r[8] for r in rows], np.int64)
        reg = np.frombuffer(b"".join(r[9] for r in rows), np.uint16).reshape(-1, BUCKETS)
        side = np.array([r[6] for r in rows])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        may = comp[left][:, None] != comp[right][None, :]
        small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
        i, j = np.nonzero(may & (100 * small >= percent * large))
        i, j = left[i], right[j]
        if side[0] == 2:
            i, j = i[i < j], j[i < j]
        bands = reg[:, : BANDS * ROWS_PER_BAND].reshape(-1, BANDS, ROWS_PER_BAND)
        found, joined = set(), {}
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            earlier = (bands[x, :band] == bands[y, :band]).all(2).any(1)  # those pairs belong to that bucket
            x, y = x[~earlier], y[~earlier]
            same = (reg[x] == reg[y]).mean(1)
            for u, v, e in zip(x.tolist(), y.tolist(), same.tolist(), strict=True):
                c = chance(n[u], n[v])
                if worth((e - c) / (1 - c), n[u], n[v], t):
                    joined.setdefault(u, []).append(v)
        sets = {}
        get = lambda u: sets[u] if u in sets else sets.setdefault(u, np.frombuffer(rows[u][10], U))
        for u, vs in joined.items():
            own, others = get(u), [get(v) for v in vs]
            flat = np.concatenate(others)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum([len(o) for o in others])[:-1])), dtype=np.int64)
            found |= {(comps[u], comps[v]) for v, k, o in zip(vs, both.tolist(), others, strict=True) if 100 * k >= percent * (len(own) + len(o) - k)}
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: set) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

        held: list[tuple] = []
        links: set = set()
        for batch in tidy(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:6] != held[0][:6]:
                    links |= cell(held)
                    held = []
                held.append(row)
            if len(links) > 10_000:
                yield out(links)
                links = set()
        if held:
            links |= cell(held)
        yield out(links)

    return run


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node reachable. Alternates large-star and small-star until the edges are stars around roots."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        out = both.join(low, "a")
        hooked = out.where("b > a" if large else "b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            hooked = hooked.union(low.select("a", F.col("low").alias("b")))
        return hooked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def settled(e: DataFrame) -> bool:
        """Every node has one edge, to a node that has none."""
        marks = e.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("b", F.lit(0), F.lit(1)))
        return marks.groupBy("a").agg(F.sum("out").alias("o"), F.max("in").alias("i")).where("o > 1 or (o > 0 and i > 0)").isEmpty()

    e = stages.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not settled(e):
        nxt = stages.keep(star(star(e, True), False), "edges")
        stages.drop(e)
        e = nxt
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _labelled(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    """df with comp: the component of its node so far, which is the node itself where no link is known."""
    if roots is None:
        return df.withColumn("comp", F.col("node"))
    return df.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _merge(roots: DataFrame | None, links: DataFrame, stages: Stages) -> DataFrame | None:
    """roots after links (a, b) between components; both map nodes other than roots to their roots."""
    if links.isEmpty():
        return roots
    new = components(links, stages)
    if roots is None:
        return new
    moved = roots.join(new.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stages.keep(moved.union(new), "roots")


def _step(percent: int) -> float:
    """The width of a size class on a logarithmic scale: sets that can be linked lie one class apart at most."""
    return math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / _step(percent)).cast("long")


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """members (key, cls, ...) with at: each of the cells in which they are compared (cls, kind, lo, hi, side)."""
    largest = F.exp((F.col("cls") + 1) * _step(percent)) * 8
    each = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(CELL_BYTES / largest)))
    blocks = members.groupBy("key", "cls").agg(F.ceil(F.count(F.lit(1)) / F.max(each)).cast("int").alias("blocks"))
    above = blocks.select("key", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("above"))
    below = blocks.select("key", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("below"))
    numbers = blocks.join(above, ["key", "cls"], "left").join(below, ["key", "cls"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def places(count: str, place) -> Column:
        n = F.coalesce(F.col(count), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), place)).otherwise(F.array().cast("array<struct<cls:bigint,kind:int,lo:int,hi:int,side:int>>"))

    at = lambda cls, kind, lo, hi, side: F.struct(cls.alias("cls"), F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    cls = F.col("cls")
    same = places("blocks", lambda j: at(cls, 0, F.least(F.col("own"), j), F.greatest(F.col("own"), j), F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1)))
    up = places("above", lambda j: at(cls, 1, F.col("own"), j, F.lit(0)))
    down = places("below", lambda j: at(cls - 1, 1, j, F.col("own"), F.lit(1)))
    dealt = members.join(numbers, ["key", "cls"]).withColumn("own", own)
    return dealt.withColumn("at", F.explode(F.concat(same, up, down))).drop("cls", "blocks", "above", "below", "own")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", stages: Stages | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Rows are linked when 100 * |A and B| >= percent * |A or B| on their distinct k-word shingles; component_id is the smallest
    doc_id reachable over links, kept says that it is the row's own. A null text, or one without words, has no shingles
    and links with nothing. Rows that share a doc_id count as one document. A row without doc_id
    links with nothing: it is kept and has a null component_id. Other columns of docs are ignored;
    an empty table gives an empty result.
    """
    t = percent / 100
    stages = stages or Stages(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stages.keep(texts.mapInArrow(_scan(k, False), "doc_id long, n_shingles long, node binary, sketch binary").withColumn("node", F.expr("if(doc_id is null, null, node)")), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stages.keep(nodes, "nodes")

    bands = nodes.select("node", "sketch").mapInArrow(_bands, "node binary, key long, band int")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stages.keep(bands.join(shared, "key").select("key", "band", "node", "c"), "members")
    wanted = stages.keep(members.select("node").distinct().join(nodes, "node").select("node", "rep"), "wanted")
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    sets = texts.join(ids, "doc_id", "left_semi").mapInArrow(_scan(k, True), "doc_id long, n_shingles long, node binary, set binary")
    sets = sets.where("node is not null").join(wanted.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    sets = stages.keep(sets.select("node", "set"), "sets")

    twice = rows.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_distinct("node").alias("c")).where("c > 1")
    again = rows.where("node is not null").join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    roots = _merge(None, stages.keep(again.where("a <> b").distinct(), "links"), stages)

    info = nodes.select("node", "n", "sketch")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(a, b, ca, cb), nodes and their components -> (a, b), the components that a link joins."""
        likely = pairs.join(info.toDF("a", "n", "x"), "a").join(info.toDF("b", "m", "y"), "b").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
        likely = likely.select("ca", "cb", "a", "b", "n", "m", "x", "y").mapInArrow(_likely(t), "ca binary, cb binary, a binary, b binary")
        both = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return both.select("ca", "cb", "x", "y").mapInArrow(_confirm(percent), "a binary, b binary").distinct()

    degree = members.groupBy("node").agg(F.sum("c").alias("degree"))
    hubs = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))
    members = stages.keep(members.join(hubs, "key").where("node <> hub").select("key", "band", "node", "hub"), "members")
    pairs = members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = _labelled(pairs.withColumnRenamed("a", "node"), roots).toDF("a", "b", "ca")
    pairs = _labelled(pairs.withColumnRenamed("b", "node"), roots).select("a", F.col("node").alias("b"), "ca", F.col("comp").alias("cb"))
    roots = _merge(roots, stages.keep(confirmed(pairs), "links"), stages)

    m = _labelled(members.select("key", "band", "node"), roots)
    open_keys = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = stages.keep(m.join(open_keys, "key", "left_semi").join(info.select("node", "n"), "node").withColumn("cls", _size_class(F.col("n"), percent)), "open")
    if not left.isEmpty():
        cells = _cells(left.select("key", "band", "cls", "comp", "node"), percent).join(info.join(sets, "node"), "node")
        cells = cells.select("key", "band", "at.*", "comp", "n", "sketch", "set").repartition("key", "cls", "kind", "lo", "hi").sortWithinPartitions("key", "cls", "kind", "lo", "hi")
        links = cells.mapInArrow(_within(percent), "a binary, b binary").distinct()
        roots = _merge(roots, stages.keep(links, "links"), stages)

    final = _labelled(nodes.select("node", "rep"), roots)
    smallest = final.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = stages.keep(final.join(smallest, "comp").select("node", "component_id"), "components")
    stages.clear(rows, named)
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row for each near-duplicate component: that of the smallest doc_id, with all columns.

    Rows that repeat this doc_id stay, and so do rows without a doc_id, and null or empty texts, which link with nothing. An empty table stays empty.
    """
    stages = Stages(docs.sparkSession)
    verdict = near_duplicates(docs, k, percent, stages=stages).where("not kept and doc_id is not null").select("doc_id").distinct()
    verdict = stages.keep(verdict, "dropped")
    stages.clear(verdict)
    name = fresh(docs, "dropped")
    return docs.join(verdict.withColumnRenamed("doc_id", name), F.col("doc_id").cast("long") == F.col(name), "left_anti")
