"""Merkle manifest of a dataset, built and proved in supersteps over RDDs.

A row's leaf is a digest of its fields. The leaves of a part (say, a language) are numbered by id; FAN consecutive nodes are the
children of one parent, level by level, until one node remains: the part's subroot. The subroots, ordered by part, form a tree of
the same kind, whose last node is the root of the dataset.

Upwards, each superstep sends every node's digest to its parent; a parent that has all its children hashes them and forwards its
digest in the next one. Downwards, the supersteps run in reverse: a parent hands each child the path it was given itself, preceded by
what the child's siblings contribute. The path of a run of leaves travels once for the whole run, and a leaf adds its own siblings
when it meets its run. Levels are checkpointed, so a lost executor costs one superstep.

Scale: texts are read once and only digests move. Numbers come from a range partitioning by (part, id), where a part of any size spreads
over as many partitions as it needs; no group is larger than FAN, and the number of supersteps is the height of the tree. The driver
sees the size of the largest part and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, shared_dir
from .ranks import BROADCAST_MARKS, numbered

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a level for each task, at least: a level with no more is one task's.
LEVEL_NODES = 16_384
PATH = "array<struct<slot:int,siblings:string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values after one another: `-` for a null, else the UTF-8 byte count, a colon and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(part(v.cast("string")) for v in values)), 256)


def proof_text(path: Column) -> Column:
    """The siblings' digests along a path as one hex text, left to right, level by level."""
    return F.array_join(F.transform(path, lambda step: step["siblings"]), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to: at each level the node takes its slot among its siblings and the run is hashed."""

    def up(node: Column, step: Column) -> Column:
        before, siblings = step["slot"] * 64, step["siblings"]
        return F.sha2(F.concat(F.substring(siblings, F.lit(1), before), node, F.substring(siblings, before + 1, F.length(siblings))), 256)

    return F.aggregate(path, leaf, up)


def _hash(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


def _run(key_and_messages: tuple) -> tuple:
    """A parent with all its messages: its key, the number of nodes on its children's level, and the children's digests in order."""
    (group, index), messages = key_and_messages
    got = sorted(messages)
    n = got[0][1]
    if [slot for slot, _, _ in got] != list(range(min(FAN, n - FAN * index))):
        raise ValueError(f"node {index} of part {group} lacks messages of its children")
    return (group, index), (n, b"".join(d for _, _, d in got))


def _to_parent(node: tuple) -> tuple:
    (group, index), (n, own) = node
    return (group, index // FAN), (index % FAN, n, own)


def _forward(run: tuple) -> tuple:
    key, (n, children) = run
    return key, (-(-n // FAN), _hash(children))


def _step(slot: int, children: bytes) -> bytes:
    """A path's entry: the slot and the siblings' digests."""
    return bytes([slot]) + children[: 32 * slot] + children[32 * slot + 32 :]


def _to_children(met: tuple) -> Iterable[tuple]:
    (group, index), ((_, children), path) = met
    for slot in range(len(children) // 32):
        yield (group, index * FAN + slot), [_step(slot, children), *path]


def _gathered(pairs: Iterable[tuple]) -> Iterable[tuple]:
    """Key and values of a task that has all pairs."""
    found: dict = {}
    for key, value in pairs:
        found.setdefault(key, []).append(value)
    return found.items()


def _meet(of_key: tuple) -> Iterable[tuple]:
    key, values = of_key
    ours, theirs = ([v for mine, v in values if mine == side] for side in (0, 1))
    return [(key, (a, b)) for a in ours for b in theirs]  # one of each


class Supersteps:
    """The tree's levels as RDDs of runs: (group, index of the parent) -> (nodes on the children's level, children's digests)."""

    def __init__(self, spark: SparkSession, partitions: int, nodes: list[int]):
        """nodes: how many nodes all groups together have on each level. A level of at most LEVEL_NODES is worked on by one task, others by up to partitions tasks."""
        shared_dir(spark)  # names a checkpoint folder where the session has none
        self.parts, self._held = [min(partitions, -(-n // LEVEL_NODES)) for n in nodes], []

    def keep(self, rdd: RDD) -> RDD:
        rdd = rdd.persist(StorageLevel.DISK_ONLY)
        rdd.checkpoint()
        rdd.count()
        self._held.append(rdd)
        return rdd

    def release(self) -> None:
        """Frees the copies on executors; the checkpoints stay."""
        for rdd in self._held:
            rdd.unpersist()
        self._held = []

    def grouped(self, pairs: RDD, level: int) -> RDD:
        parts = self.parts[min(level, len(self.parts) - 1)]
        return pairs.groupByKey(parts) if parts > 1 else pairs.coalesce(1).mapPartitions(_gathered)

    def ascend(self, nodes: RDD, height: int) -> tuple[list[RDD], RDD]:
        """The runs of each level, leaves first, and what remains of each group: group -> (level, digest)."""
        tiers, tops = [], []
        for level in range(height + 1):
            tops.append(nodes.filter(lambda node: node[1][0] == 1).map(lambda node, level=level: (node[0][0], (level, node[1][1]))))
            if level < height:
                tiers.append(self.keep(self.grouped(nodes.filter(lambda node: node[1][0] > 1).map(_to_parent), level).map(_run)))
                nodes = tiers[-1].map(_forward)
        return tiers, reduce(RDD.union, tops)

    def met(self, ours: RDD, theirs: RDD, level: int) -> RDD:
        """key -> (ours, theirs) where both have the key; each has it once."""
        return self.grouped(ours.mapValues(lambda v: (0, v)).union(theirs.mapValues(lambda v: (1, v))), level).flatMap(_meet)

    def descend(self, tiers: list[RDD], seeds: RDD) -> RDD:
        """The runs of leaves with the path from their parent upwards; seeds: group -> (level of its top, path of its top)."""
        paths = None
        for level in range(len(tiers), 0, -1):
            begin = seeds.filter(lambda s, level=level: s[1][0] == level).map(lambda s: ((s[0], 0), s[1][1]))
            paths = begin if paths is None else paths.union(begin)
            runs = self.met(tiers[level - 1], paths, level - 1)
            if level == 1:
                return runs
            paths = self.keep(runs.flatMap(_to_children))
        return seeds.context.emptyRDD()


def _height(n: int) -> int:
    h = 0
    while FAN**h < n:
        h += 1
    return h


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, part: str = "lang", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, leaf, subroot, root, path and the carried columns for each row; path: (slot, siblings as hex text) from the leaf to the root.

    A null part is a part of its own, before the others; null ids come before the others. Rows that repeat an id are ordered by their
    leaves, repeated rows are leaves like others. A part of one row has its leaf as subroot; a single part's subroot is the root.
    Null fields are marked in the leaf, an empty text differs from them; columns that are neither fields nor carried are ignored,
    whatever their names. An empty table has no leaves, and an empty result. Texts of any length are hashed whole.
    """
    spark = rows.sparkSession
    stages = Stages(spark)
    cols = [F.col(part).cast("string").alias("part"), F.col(id_col).cast("long").alias("id"), digest(*(F.col(c) for c in fields)).alias("leaf")]
    leaves = stages.keep(rows.select(*cols, *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry))), "leaves")
    placed = stages.keep(numbered(leaves, stages, "part", ["id", "leaf"], ("group", "index", "size")), "placed")
    stages.drop(leaves)
    parts = placed.where("index = 0").agg(F.max("size"), F.count("*")).first()
    height, groups = _height(parts[0] or 0), parts[1]
    on_level = lambda k: F.sum(F.when(F.col("size") > FAN ** max(0, k - 1), F.ceil(F.col("size") / FAN**k)).otherwise(0))
    nodes_of = [n or 0 for n in placed.where("index = 0").agg(*map(on_level, range(height + 1))).first()]
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = Supersteps(spark, partitions, nodes_of)
    crown = Supersteps(spark, partitions, [-(-groups // FAN**k) for k in range(_height(groups) + 1)])
    nodes = placed.select("group", "index", "size", F.unhex("leaf").alias("leaf")).rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]))))
    tiers, tops = steps.ascend(nodes, height)
    tops = steps.keep(tops)
    upper, last = crown.ascend(tops.map(lambda t: ((0, t[0]), (groups, t[1][1]))), _height(groups))
    last = last.take(1)  # one node
    root = last[0][1][1] if last else b""
    if groups == 1:
        heads = spark.sparkContext.parallelize([(0, [])], 1)
    else:
        heads = crown.descend(upper, spark.sparkContext.parallelize([(0, (_height(groups), []))], 1)).flatMap(_to_children).map(lambda x: (x[0][1], x[1]))
    heads = crown.keep(crown.met(tops, heads, 0))  # group -> ((level, subroot), path above)
    runs = steps.descend(tiers, heads.mapValues(lambda v: (v[0][0], v[1])))
    of_runs = spark.createDataFrame(runs.map(lambda r: (r[0][0], r[0][1], r[1][0][1], r[1][1])), "run_group long, run long, children binary, above array<binary>", verifySchema=False)
    of_parts = spark.createDataFrame(heads.map(lambda h: (h[0], h[1][0][1], h[1][1] if h[1][0][0] == 0 else [])), "part_group long, subroot binary, head array<binary>", verifySchema=False)
    out = stages.keep(_with_paths(placed, stages.keep(of_runs, "runs"), stages.keep(of_parts, "subroots"), root), "manifest")
    steps.release()
    crown.release()
    stages.clear(out)
    return out.withColumnsRenamed({"id": id_col} | {f"carried_{i}": c for i, c in enumerate(carry)})


def _with_paths(placed: DataFrame, runs: DataFrame, parts: DataFrame, root: bytes) -> DataFrame:
    """The leaves with their paths: their own siblings from their run, then the run's path; a lone leaf has its part's."""
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_MARKS else parts
    slot = F.pmod("index", F.lit(FAN)).cast("int")
    joined = placed.withColumn("slot", slot).join(parts, F.col("group") == F.col("part_group"))
    joined = joined.join(runs, (F.col("group") == F.col("run_group")) & (F.floor(F.col("index") / FAN) == F.col("run")), "left")
    hexed = lambda b: F.lower(F.hex(b))
    own = F.struct(F.col("slot"), hexed(F.concat(F.substring("children", F.lit(1), F.col("slot") * 32), F.substring("children", F.col("slot") * 32 + 33, F.lit(32 * FAN)))).alias("siblings"))
    step = lambda b: F.struct(F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int").alias("slot"), hexed(F.substring(b, F.lit(2), F.length(b))).alias("siblings"))
    path = F.when(F.col("run").isNull(), F.transform("head", step)).otherwise(F.concat(F.array(own), F.transform("above", step)))
    carried = [c for c in placed.columns if c.startswith("carried_")]
    return joined.select("id", "leaf", hexed(F.col("subroot")).alias("subroot"), F.lit(root.hex()).alias("root"), path.cast(PATH).alias("path"), *carried)


def verified(rows: DataFrame, leaf: str = "leaf", id_col: str = "doc_id") -> DataFrame:
    """rows with folded_root, the root that column leaf and the row's path give, and verified, whether it is the manifest's root.

    Takes the rows of manifest; leaf may be a carried column with digests of other contents. A null leaf is never verified. An empty table stays empty.
    """
    return rows.withColumn("folded_root", fold(F.col(leaf), F.col("path"))).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))


def tampered(documents: DataFrame, altered: Callable[[Column], Column]) -> Column:
    """The leaf that a document has after altered(text), where 3 divides the crc32 of its decimal id; else its own. Null ids and texts stay as they are."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return digest(*(F.when(hit, altered(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in FIELDS))


def proof_digests(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each document's proof held against contents of which a third are lower-cased.

    Null, empty and repeated rows and empty tables as in manifest; columns of documents besides the five fields are ignored.
    """
    lowered = lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = documents.select(*FIELDS)
    found = verified(manifest(docs.withColumn("tampered_leaf", tampered(docs, lowered)), carry=("tampered_leaf",)), "tampered_leaf")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")
