"""Document fingerprints by I-Match over randomised lexicons, with DataFrame functions only.

The lexicon holds the terms whose inverse document frequency ln(documents / df) lies in a band: neither the words of every text nor the
typing errors of one. A document's terms in the lexicon, distinct and sorted, are hashed once for the whole lexicon and once for each of
several random subsets of it. An edit leaves the signatures of all subsets that hold none of the changed terms as they were, so the
share of equal signatures tells how alike two documents are. The subsets come in levels of finer and finer shares of the lexicon, as
a short document needs larger subsets than a long one; the bits of a term's hash deal it to one subset of each level at most, inside that of the level before.

Scale: a term occurs in the band only if at least exp(-MAX_IDF) of all documents hold it, so the lexicon has at most exp(MAX_IDF)
times as many terms as a document has on average, however large the corpus is; it is broadcast after a check of its size. Terms are 64-bit
hashes, exploded and looked up inside the task that holds the text. Comparing each document with its successor needs texts side by side: rows are numbered by id,
the first id of every block becomes a bound (MAX_BLOCKS at most), each text goes to its block in the one shuffle of texts, and a block's first
text to the block before it, too. All that follows stays in the block's task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages
from .pii import let
from .ranks import numbered

#: The band of ln(documents / document frequency): terms of more than a fifth of the documents, or of fewer than one in 2,981, say nothing.
MIN_IDF, MAX_IDF = math.log(5), 8.0
#: Every subset of a level (first of the whole lexicon) is dealt into SPLIT parts, of which so many are subsets of the next level.
SPLIT, LEVELS = 4, (4, 4, 2, 2, 1)
#: So many subsets with terms must a level have to tell how alike two documents are.
LEAST_SUBSETS = 12
MAX_LEXICON = 4_000_000
MAX_BLOCKS, LEAST_BLOCK = 65_536, 32
NOTHING = "----"
#: What parts terms: ASCII other than letters and digits, one by one, since the pattern looks single characters up in a table but tries ranges in turn.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: In every lexicon, so that documents without any of its terms keep a row.
MARK = 0


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes in no order; letter case does not count. A null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, stages: Stages, text: str = "text", min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """term for each term in the band, over all rows of texts, and the mark. An empty table has the mark only."""
    n = texts.count()
    df = texts.select(F.explode(term_hashes(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = df.where(F.log(F.lit(float(max(n, 1))) / F.col("df")).between(min_idf, max_idf)).select("term")
    mark = texts.sparkSession.range(1).select(F.lit(MARK).cast("long").alias("term"))
    kept = stages.keep(kept.where(F.col("term") != MARK).unionByName(mark), "lexicon")
    return F.broadcast(kept) if kept.count() <= MAX_LEXICON else kept


def _signature(terms: Column) -> Column:
    code = F.lower(F.lpad(F.hex(F.xxhash64(terms).bitwiseAND(F.lit(0xFFFF))), 4, "0"))
    return F.when(F.size(terms) == 0, F.lit(NOTHING)).otherwise(code)


def _split(subsets: Column, level: int) -> Column:
    """The subsets of a level, out of those of the level before."""
    part = lambda t: F.shiftrightunsigned(t, level * (SPLIT.bit_length() - 1)).bitwiseAND(F.lit(SPLIT - 1))
    numbers = F.array(*(F.lit(j).cast("long") for j in range(LEVELS[level])))
    return F.flatten(F.transform(subsets, lambda terms: F.transform(numbers, lambda j: F.filter(terms, lambda t: part(t) == j))))


def with_fingerprint(rows: DataFrame, terms: str, whole: Column, name: str) -> DataFrame:
    """rows with a fingerprint of column terms, which are sorted and distinct: a signature of all, then 4 hex digits for each subset, level by level.

    whole is a hash of all terms of the text; it stands for the lexicon's where the text has none of its terms. Subsets without terms are NOTHING. Each level
    is a column of its own, so that none is worked out twice.
    """
    level = lambda i: f"{terms}_level_{i}"
    out = rows.withColumn(level(0), F.array(terms))
    for i in range(len(LEVELS)):
        out = out.withColumn(level(i + 1), _split(F.col(level(i)), i))
    all_of = F.lower(F.lpad(F.hex(F.when(F.size(terms) == 0, whole).otherwise(F.xxhash64(terms))), 16, "0"))
    texts = [F.array_join(F.transform(level(i + 1), _signature), "") for i in range(len(LEVELS))]
    first = F.concat(F.when(F.size(terms) == 0, F.lit("w")).otherwise(F.lit("b")), all_of)
    return out.withColumn(name, F.concat_ws(".", first, *texts)).drop(*(level(i) for i in range(len(LEVELS) + 1)))


def _share(a: Column, b: Column, level: int, least: int) -> Column:
    """The share of equal signatures among a level's subsets with terms of either fingerprint; null where those are fewer than least."""
    subsets, begin = math.prod(LEVELS[: level + 1]), 18 + sum(4 * math.prod(LEVELS[: i + 1]) + 1 for i in range(level))
    nothing = F.lit(bytearray(NOTHING, "ascii"))

    def shares(x: Column, y: Column) -> Column:
        at = lambda s, i: F.substring(s, i * 4 + begin + 1, F.lit(4))  # noqa: E731  of bytes, which needs no count of characters
        pairs = F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda i: F.struct(at(x, i).alias("x"), at(y, i).alias("y")))
        filled = F.filter(pairs, lambda p: (p["x"] != nothing) | (p["y"] != nothing))
        return let(filled, lambda f: F.when(F.size(f) >= least, F.size(F.filter(f, lambda p: p["x"] == p["y"])) / F.size(f)))

    return let(F.struct(a.cast("binary").alias("x"), b.cast("binary").alias("y")), lambda t: shares(t["x"], t["y"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures, from 0 to 1: 1 for equal fingerprints, else on the finest level where LEAST_SUBSETS subsets have terms of either document, or on the coarsest level."""
    finer = [_share(a, b, level, LEAST_SUBSETS) for level in range(len(LEVELS) - 1, 0, -1)]
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(*finer, _share(a, b, 0, 1), F.lit(0.0)))


def fingerprints(rows: DataFrame, lexicon: DataFrame, by: list[str], texts: list[str], keep: list[str]) -> DataFrame:
    """by, keep and a column <text>_fingerprint for each of the columns texts; by must name each row of rows uniquely.

    Equal texts have equal fingerprints, and null texts are empty. The terms of all columns are exploded together; if rows are partitioned by a column
    of by, nothing is shuffled.
    """
    hashed = rows.select(*by, *keep, *(term_hashes(F.col(t)).alias(f"hashes_{i}") for i, t in enumerate(texts)))
    tag = lambda i: lambda h: F.struct(h.alias("term"), F.lit(i).alias("of"))
    marked = [F.transform(f"hashes_{i}", tag(i)) for i in range(len(texts))]
    wholes = [F.xxhash64(F.sort_array(f"hashes_{i}")).alias(f"whole_{i}") for i in range(len(texts))]
    mark = F.array(F.struct(F.lit(MARK).cast("long").alias("term"), F.lit(-1).alias("of")))
    held = hashed.select(*by, F.struct(*keep, *wholes).alias("held"), F.concat(*marked, mark).alias("terms"))
    each = held.select(*by, "held", F.explode("terms").alias("t")).select(*by, "held", F.col("t.term").alias("term"), F.col("t.of").alias("of"))
    each = each.join(lexicon, "term").select(*by, "term", "of", F.when(F.col("of") < 0, F.col("held")).alias("held"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("of") == i, F.col("term")))).alias(f"terms_{i}") for i in range(len(texts))]
    found = each.groupBy(*by).agg(F.first("held", ignorenulls=True).alias("held"), *lists)
    for i, t in enumerate(texts):
        found = with_fingerprint(found, f"terms_{i}", F.col(f"held.whole_{i}"), f"{t}_fingerprint")
    return found.select(*by, *(f"held.{c}" for c in keep), *(f"{t}_fingerprint" for t in texts))


def document_key(doc_id: Column, text: Column) -> Column:
    """A text that orders documents by id, null first, then by the digest of their text."""
    unsigned = F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63))))
    return F.concat(F.coalesce(F.concat(F.lit("1"), F.lpad(unsigned, 16, "0")), F.lit("0")), F.md5(text))


def blocks_of(bounds: list[str]) -> Callable[[Column], Column]:
    """The number of the block that a key falls into, given the sorted first keys of the blocks; the lookup goes through every width-th bound first."""
    width = max(1, math.isqrt(len(bounds)))
    listed = lambda keys: F.split(F.lit(",".join(keys)), ",")  # noqa: E731  a constant of the plan

    def block(key: Column) -> Column:
        upto = lambda keys: F.size(F.filter(keys, lambda b: b <= key))
        return let(upto(listed(bounds[::width])), lambda c: (c - 1) * width + upto(F.slice(listed(bounds), (c - 1) * width + 1, F.lit(width))) - 1)

    return block


def in_blocks(docs: DataFrame, keys: DataFrame, stages: Stages) -> DataFrame:
    """docs (key, id, text) with block and ghost, partitioned by block: consecutive keys lie in one block, and a block ends with the next block's first document as a ghost."""
    placed = numbered(keys.withColumn("part", F.lit("")), stages, "part", ["key"], ("group", "index", "size"))
    placed = stages.keep(placed.select("key", "index"), "places")
    size = max(LEAST_BLOCK, -(-placed.count() // MAX_BLOCKS))
    bounds = sorted(r["key"] for r in placed.where(F.col("index") % size == 0).select("key").collect())  # MAX_BLOCKS at most
    if not bounds:
        return docs.withColumns({"block": F.lit(0), "ghost": F.lit(False)})
    n, block_of = len(bounds), blocks_of(bounds)
    first = F.col("key") == F.element_at(F.split(F.lit(",".join(bounds)), ","), F.col("its") + 1)
    here = F.struct(F.col("its").alias("block"), F.lit(False).alias("ghost"))
    before = F.struct(F.pmod(F.col("its") - 1, F.lit(n)).alias("block"), F.lit(True).alias("ghost"))
    dealt = docs.withColumn("its", block_of(F.col("key")).cast("int"))
    dealt = dealt.withColumn("at", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))))
    return dealt.select("key", "id", "text", "at.block", "at.ghost")


def edited_likeness(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The edited text has its last n_chars // 2 code points replaced by the first as many (or all) of the next document's, by ascending
    id; the last document's next is the first. A null text is empty. Null ids come first; documents of one id follow each other
    by the digests of their texts; rows that repeat an id with its text are one document, whose result is repeated. A single document is its own
    next. Texts without a lexicon term, empty ones included, are compared by all their terms. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    stages = Stages(documents.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("key", document_key(F.col("id"), F.col("text")))
    times = stages.keep(docs.groupBy("key").agg(F.count("*").alias("times")), "keys")
    repeated = (times.agg(F.max("times")).first()[0] or 1) > 1
    once = docs.groupBy("key").agg(F.any_value("id").alias("id"), F.any_value("text").alias("text")) if repeated else docs
    terms = lexicon(docs, stages)
    blocks = in_blocks(once, times.select("key"), stages)
    order = Window.partitionBy("block").orderBy("ghost", "key")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(order), F.lit(1), half))
    pairs = blocks.select("block", F.row_number().over(order).alias("at"), "key", "id", "ghost", "text", edited.alias("edited"))
    pairs = pairs.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited"), 256)})
    prints = fingerprints(pairs, terms, ["block", "at"], ["text", "edited"], ["key", "id", "ghost", "n_chars", "edited_sha256"])
    following = F.lead("text_fingerprint").over(Window.partitionBy("block").orderBy("at"))
    out = prints.withColumn("following", following).where(~F.col("ghost"))
    if repeated:
        out = out.join(times, "key").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    mine, changed = F.col("text_fingerprint"), F.col("edited_fingerprint")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", mine.alias("fingerprint"), changed.alias("edited_fingerprint"),
        likeness(mine, changed).alias("near_edited"), likeness(mine, F.col("following")).alias("near_next"),
    )
