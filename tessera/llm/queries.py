"""The queries of the text operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import filter_audit
from .chat import TurnTemplate, format_conversations, read_back
from .hyperminhash import near_duplicates
from .idfiles import through_files
from .imatch import edited_likeness
from .lengths import token_counts
from .merkle import proof_digests
from .packing import pack
from .permutation import nearest
from .pii import pii_digest
from .perplexity import MEASURES, quality

from .urlfilter import judge
from .wordbpe import encode_texts


def vocabulary(name: str) -> str:
    """Where the box keeps a public vocabulary file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates over all documents; see near_duplicates for nulls, ties and empty tables."""
    return near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdicts of all documents; see quality for nulls, ties and empty tables."""
    return quality(_read(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", "lang", "entropy", "low", "high")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; see pii_digest: a null text is empty, repeated rows stay, an empty table gives an empty result."""
    return pii_digest(_read(spark, sf_dir, "documents"))


def op7_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages by the production rules; see judge for nulls, repeated rows and empty tables."""
    return judge(_read(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the checksum of their ids; see pack for nulls, long texts and empty tables."""
    return pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written id files say of all documents; see through_files. A null text has the end id alone."""
    return through_files(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents as digests; see encode_texts for nulls and empty tables."""
    return encode_texts(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


#: A conversation besides those of the table, whose texts hold the template's own marks.
MARKED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a marked one, formatted and read back; see format_conversations and read_back. A null text is empty."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string"))
    template = TurnTemplate()
    return read_back(format_conversations(turns, template), template)


def op9_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents for every context limit; see token_counts for nulls and empty tables."""
    return token_counts(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ten of every hundredth vector among all; see nearest for vectors that take no part."""
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against contents of which a third are altered; see proof_digests for nulls, ties and empty tables."""
    return proof_digests(_read(spark, sf_dir, "documents"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in all 120 orders; see failing and replay for nulls, ties and empty tables."""
    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; see edited_likeness for nulls, ties and empty tables."""
    return edited_likeness(_read(spark, sf_dir, "documents"))


_ALL = (
    op1_hyperminhash, op2_pii, op3_chat, op4_bpe, op5_pfor, op6_perplexity, op7_bloom_cascade, op8_packing, op9_lengths, op10_permutation,
    op11_merkle, op12_audit, op13_imatch,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op3_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, role || chr(10) || text || chr(10) AS line,
    15 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""".replace("\\\\", "\\"),
    "op7_bloom_cascade": r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
    "op11_merkle": r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars, text,
    CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered
  FROM (
    SELECT *, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y // 2, 3988292384 * (y % 2))))) AS crc
    FROM documents)),
leaves AS (
  SELECT r, doc_id, lang, sha256(concat(id, src, lng, chars, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(id, src, lng, chars, coalesce(strlen(altered) || ':' || altered, '-'))) AS altered_leaf
  FROM (
    SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS id, coalesce(strlen(source) || ':' || source, '-') AS src,
      coalesce(strlen(lang) || ':' || lang, '-') AS lng, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars
    FROM texts)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM leaves),
tree AS (
  SELECT 0 AS level, g, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY level, g, i // 8, n),
subroots AS (SELECT g, level AS top, h, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, g AS i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY level, i // 8, n),
runs AS (
  SELECT level, g, i // 8 AS p, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY level, g, i // 8
  UNION ALL
  SELECT top + level, g, p, hs FROM (
    SELECT c.level, c.i // 8 AS p, list(c.h ORDER BY c.i) AS hs FROM crown c WHERE c.n > 1 GROUP BY c.level, c.i // 8) u
  JOIN (SELECT g, top, unnest(range(20)) AS at, g // CAST(power(8, unnest(range(20))) AS BIGINT) AS i FROM subroots) s ON s.at = u.level AND s.i // 8 = u.p),
walk AS (
  SELECT r, g, 0 AS level, i, top, '' AS proof, altered_leaf AS h FROM placed JOIN subroots USING (g)
  UNION ALL
  SELECT w.r, w.g, w.level + 1, CASE WHEN w.level + 1 = w.top THEN w.g ELSE w.i // 8 END, w.top,
    w.proof || array_to_string(hs[1 : w.i % 8] || hs[w.i % 8 + 2 :], ''),
    sha256(array_to_string(hs[1 : w.i % 8] || [w.h] || hs[w.i % 8 + 2 :], ''))
  FROM (SELECT * REPLACE (CASE WHEN level = 0 AND top = 0 THEN g ELSE i END AS i) FROM walk) w
  JOIN runs ON runs.g = w.g AND runs.level = w.level AND runs.p = w.i // 8),
root AS (SELECT h AS root FROM crown WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM placed p JOIN subroots s USING (g) CROSS JOIN root JOIN (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1) w ON w.r = p.r
""",
    "op12_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
flags AS (
  SELECT part,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM texts LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS way
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
replayed AS (
  SELECT part, filter_order, way, fails, good, toxic, coalesce(list_position(list_transform(way, lambda k: fails[k]), true), 6) AS first FROM flags, orders),
counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (fails[way[step]] AND first < step) AS redundant, count(*) FILTER (fails[way[step]] AND len(list_filter(fails, lambda f: f)) = 1) AS unique_fails,
    count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM replayed, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
""",
}
