"""Queries that apply each corpus operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import align_recordings, fingerprint_audio, render_tones, with_echoes
from .collocations import collocations
from .conversation_trie import conversation_trie
from .fingerprints import as_hex, fingerprint_documents
from .lm_scoring import lm_scores
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pieces import decode_pieces, encode_pieces
from .quality import quality
from .sharding import shard_rows
from .substring_dedup import remove_repeats
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle_words=2, percent=80)


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), min_words=13, digest=True)


@_query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(_documents(spark, sf_dir), "doc_id", 24)
    text = F.coalesce("record.text", F.lit(""))
    return placed.select("record.doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).drop("copies")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@_query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), length=1024, end_id=2, digest=True)


@_query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint_documents(_documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), as_hex(F.col("packed")).alias("fingerprint"), as_hex(F.col("edited_packed")).alias("edited_fingerprint"), "near_edited", "near_next")


@_query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = lm_scores(_documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    judged = quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return judged.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", "keep")


@_query
def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of rest 7 by 20 is a cut, shifted and noisy copy of the query seven before it."""
    vectors = with_echoes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    audio = render_tones(vectors, "id", "v", noisy="noisy")
    return align_recordings(fingerprint_audio(audio, "id", "audio"), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


@_query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir), max_words=3, min_count=10, inside_percent=50, top=2000)


@_query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decode_pieces(encode_pieces(_documents(spark, sf_dir), packed=True))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("position", "end_position")


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op1_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.c, d.doc_id)) AS component_id, d.doc_id <= coalesce(r.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) r USING (doc_id)
"""

ORACLES["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM w)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM win JOIN first USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS t, count(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos WHERE gone.pos IS NULL GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k))),
f AS (SELECT lang, k, g, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING f >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
cuts AS (SELECT c.lang, c.k, c.g, c.f AS a, j, l.f AS l, r.f AS r, (c.f::HUGEINT * c.f * 1000000 // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
longer AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM f WHERE k = 3),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = best.lang AND longer.g = best.g AND 100 * longer.f >= 50 * best.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

#: CRC-32 of a decimal number s, a bit at a time.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ord(s[i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)))"

ORACLES["op13_conversation_trie"] = f"""
WITH t AS (SELECT conv_id, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key, length(coalesce(text, '')) AS len, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'key': key, 'len': len}} ORDER BY turn NULLS FIRST, key) AS own FROM t GROUP BY 1),
h AS (SELECT o.conv_id AS c, o.own, b.own AS start, {_CRC} % 6 AS h FROM (SELECT *, conv_id::VARCHAR AS s FROM o) o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
r AS (SELECT c, list_concat(CASE WHEN h > 0 THEN coalesce(start, [])[1:h] ELSE [] END, own[h + 1:]) AS turns FROM h),
walks AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
nodes AS (SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM walks GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * CASE WHEN depth > 0 THEN path[depth].len ELSE 0 END AS saved FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT path[1:d] AS path, (n_children = 0)::INT AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own)) GROUP BY path)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
FROM own JOIN sums ON sums.path = own.path LEFT JOIN nodes up ON own.depth > 0 AND up.path = own.path[1:own.depth - 1]
"""
