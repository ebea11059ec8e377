"""Quality rules: plain text measures, and n-gram perplexity with bands for each language.

The model is charmodel.py's: modified Kneser-Ney over code points, counted by Spark from every text, each text being scored by the
counts of the other half of the texts. A document's cross entropy in bits a code point must lie between its language's edges: the
median less LOW_WIDTH, or plus HIGH_WIDTH, robust deviations of the scores on that side, from an exact histogram of all documents in steps of 1 / 1000
bit. Short texts vary more, so there are edges for each language and class of length. Rubbish is seldom as predictable as prose: lists of
words and signs learnt from their likes fall under the lower edge, unlikely texts lie above the upper one. A text above its
language's upper edge may only be labelled wrongly; it is scored by all languages' models, and stays if one finds it ordinary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charmodel import CharModels
from .common import Stages, fresh
from .shingles import U, mix, span_hashes, word_spans

#: How far the upper and the lower edge lie from the median in robust standard deviations of their half, and the least of those, in bits.
HIGH_WIDTH, LOW_WIDTH, LEAST_SPREAD = 4.0, 4.0, 0.015
#: Classes of length, by the power of two below the number of code points: the first and the last.
SHORTEST, LONGEST = 9, 13
#: To each class so many documents of the whole language are added at most, so that a class of few texts is not its own measure.
PRIOR = 50
#: Base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Up to so many keys of 16 bytes are broadcast; more are shuffled.
BROADCAST_KEYS = 4_000_000
_BLANK = b" \t\n\v\f\r"
_SPACES = np.isin(np.arange(256), list(_BLANK))
_SIGNS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text, all on its bytes: words are runs of bytes that are not ASCII white space. Lines are compared themselves, word windows by 64-bit hashes."""
    n = len(offsets) - 1
    cum = lambda x: np.concatenate(([0], np.cumsum(x)))
    by_row = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    start, end, at = word_spans(data, offsets)
    word = span_hashes(data, start, end)[0]
    window = mix(word[:-2] * U(3) + word[1:-1] * U(0xD6E8FEB86659FD93) + word[2:] * U(0xA0761D6478BD642F)) if len(word) > 2 else np.zeros(0, U)
    repeated, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a > 3:
            w = window[a : b - 2]
            order = np.argsort(w)
            s = w[order]
            same = s[1:] == s[:-1]
            if same.any():
                hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
                cover = np.zeros(b - a, bool)
                places = order[hit]
                cover[places] = cover[places + 1] = cover[places + 2] = True
                repeated[i] = cover.sum()
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(_BLANK)]
        dup[i] = len(lines) - len(set(lines))
    inside = ~_SPACES[data]
    return {"n_words": np.diff(at), "word_chars": by_row(cum(inside & ((data & 0xC0) != 0x80))), "n_symbols": by_row(cum(_SIGNS[data])), "n_dup_lines": dup, "n_repeat_words": repeated}


def _columns(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    return {k: pa.array(v.astype(np.int64)) for k, v in measures(data, offsets).items()}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", high_width: float = HIGH_WIDTH, low_width: float = LOW_WIDTH, stages: Stages | None = None) -> DataFrame:
    """row_key, doc_id, lang, the measures, entropy, edges low and high, base_failed and kept, for each row of docs.

    base_failed: under MIN_WORDS words, or over half of the words lie in 3-word windows that occur twice or more. kept: not base_failed, and the
    entropy lies between its language's edges, or by another language's model between that one's, as where a language label is wrong. A null
    text is empty (no words, so base_failed, entropy null). Entropy is null, too, where the other half has no text of the language;
    such texts stay. A null language is a language of its own, named ''. Repeated rows get the same verdict. row_key is a hash
    of id, language and text. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    stages = stages or Stages(spark)
    id_c, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    texts = docs.select(row_key(id_c, lang, text).alias("row_key"), id_c.alias("doc_id"), lang.alias("lang"), F.xxhash64(lang).alias("lang_id"), F.xxhash64(text).bitwiseAND(1).cast("long").alias("fold"), text.alias("text"))
    models = CharModels(texts, stages)
    more = "".join(f", {c} long" for c in MEASURES)
    scored = scored_table = stages.keep(models.score(texts, "row_key long, doc_id long, lang string", _columns, more), "scores")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words")
    scored = scored.withColumn("base_failed", failed).withColumn("size", _length_class(F.col("n")))
    bands = F.broadcast(spark.createDataFrame(_bands(scored.where("not base_failed"), high_width, low_width), "lang string, size int, low double, high double"))
    out = scored.join(bands, ["lang", "size"], "left")
    flagged = stages.keep(out.where("not base_failed and entropy > high").select("row_key", "size").distinct(), "flagged")
    langs = [r[0] for r in bands.select(F.xxhash64("lang")).distinct().collect()]
    again = texts.select("row_key", "fold", "text").join(_small(flagged.select("row_key")), "row_key", "left_semi").dropDuplicates(["row_key"])
    other = models.score_by_all(again, langs).join(flagged, "row_key").join(bands.withColumn("by", F.xxhash64("lang")).drop("lang"), ["by", "size"])
    fits = other.where("entropy between low and high").select("row_key", F.lit(True).alias("elsewhere")).distinct()
    fits = stages.keep(fits, "second-look")
    stages.clear(scored_table, fits)
    own = F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True))
    out = out.join(_small(fits), "row_key", "left").withColumn("kept", ~F.col("base_failed") & (own | F.coalesce("elsewhere", F.lit(False))))
    return out.select("row_key", "doc_id", "lang", *MEASURES, "entropy", "low", "high", "base_failed", "kept")


def row_key(doc_id: Column, lang: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, lang, text)


def _small(keys: DataFrame) -> DataFrame:
    """keys, broadcast if their number is below the bound."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _length_class(n: Column) -> Column:
    return sum(((n >= 1 << k).cast("int") for k in range(SHORTEST + 1, LONGEST + 1)), F.lit(SHORTEST)).cast("int")


def _bands(scored: DataFrame, high_width: float, low_width: float) -> list[tuple[str, int, float, float]]:
    """(lang, size, low, high) from the histogram; its length is the number of languages times the bins that occur, which entropy bounds."""
    rows: dict[tuple, list] = {}
    for r in scored.where("entropy is not null").groupBy("lang", "size", F.floor(F.col("entropy") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        rows.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    of: dict[str, dict[int, int]] = {}
    for (lang, _), x in rows.items():
        for b, c in x:
            of.setdefault(lang, {})[b] = of.get(lang, {}).get(b, 0) + c
    share = {lang: min(1.0, PRIOR / sum(h.values())) for lang, h in of.items()}
    return [(*k, *band([*x, *((b, c * share[k[0]]) for b, c in of[k[0]].items())], high_width, low_width)) for k, x in rows.items()]


def _middle(pairs: list[tuple[float, int]]) -> float:
    half, run = sum(c for _, c in pairs) / 2, 0
    for v, c in sorted(pairs):
        run += c
        if run >= half:
            return v
    return 0.0


def upper_edge(histogram: list[tuple[int, int]], width: float) -> float:
    """The median plus width robust deviations of the upper half, in bits; wider for few texts, whose spread is not known well."""
    m, n = _middle(histogram), sum(c for _, c in histogram)
    spread = max(LEAST_SPREAD, 1.4826 * _middle([(v - m, c) for v, c in histogram if v >= m]) / 1000)
    return (m + 1) / 1000 + width * (1 + 20 / n) * spread


def band(histogram: list[tuple[int, int]], high_width: float = HIGH_WIDTH, low_width: float = LOW_WIDTH) -> tuple[float, float]:
    """Lower and upper edge from (bin, count) pairs in 1 / 1000 bit."""
    return -upper_edge([(-v - 1, c) for v, c in histogram], low_width), upper_edge(histogram, high_width)


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever their names.

    Null texts go (they have no words), null ids and languages are judged like others, repeated rows stay or go together, an empty table stays empty.
    """
    stages = Stages(docs.sparkSession)
    rejected = stages.keep(quality(docs, stages=stages).where("not kept").select("row_key", "doc_id").distinct(), "rejected")
    stages.clear(rejected)
    key, name = fresh(docs, "key"), fresh(docs, "name")
    keyed = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rejected = _small(rejected).toDF(key, name)
    same = (keyed[key] == rejected[key]) & keyed["doc_id"].cast("long").eqNullSafe(rejected[name])
    return keyed.join(rejected, same, "left_anti").drop(key)
