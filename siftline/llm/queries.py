"""Registered queries of the operators for training data, with their check SQL where SQL can express it.

Each query applies its operator with production parameters to the whole table and derives the contract's columns from what
the operator returns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import checkpoint_root, materialize

from . import licences, merkle, toxicity
from .alignment import align_corpus
from .bpe import encode
from .decontaminate import find_leaks
from .html_extract import extract
from .jaccard import near_duplicates
from .packing import pack
from .quality import quality
from .sharding import assign, even_tree, grown
from .substring import drop_repeated
from .token_counts import TokenRollup, deleted, inserted, piece_count, revised, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


#: A document's words, in SQL.
SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after repeated windows of 50 words are taken out."""
    found = drop_repeated(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


CHECKS["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {SQL_WORDS.format(text="text")} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)
),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
flagged AS (SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (win) WHERE doc_id > first_doc),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
marked AS (
  SELECT q.doc_id, q.word, q.p,
         coalesce(max(f.i) OVER (PARTITION BY q.doc_id ORDER BY q.p ROWS UNBOUNDED PRECEDING), -100) >= q.p - 49 AS gone
  FROM places q LEFT JOIN flagged f ON f.doc_id = q.doc_id AND f.i = q.p
),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document by links of Jaccard similarity 0.8 over five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=80)


CHECKS["op3_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {SQL_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)
),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.doc_id
)
SELECT documents.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.doc_id = documents.doc_id GROUP BY documents.doc_id
"""


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, and digests of its ids and of the bytes they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode(docs, ranks, public_tokenizers.PATTERN, bytes_col="decoded", cached=400_000)
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in a tree of 16 shards, and its shard in a tree of 17."""
    tree = even_tree(16)
    return assign(table(spark, sf_dir, "documents"), tree, grown(tree, 16))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, posterior quality and verdict of every document."""
    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; a quarter of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    field = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    found = toxicity.score(docs, field)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans")
    )


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches; a document without id is no copy.

    All documents come in; exact copies of an earlier document go, and that batch is delivered twice; counts outside English are revised,
    without runs of symbols; English moves to another version of the tokenizer.
    """
    text = F.col("text")
    docs = materialize(table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", word_count(text).alias("words"), piece_count(text).alias("pieces"),
        F.coalesce(F.regexp_count(text, F.lit("[#*$%&]{3}")), F.lit(0)).cast("bigint").alias("symbols"),
        F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest"),
    ), "counted")
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marked = docs.join(first, "digest").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    kept, english = marked.where("not copy"), F.coalesce(F.col("lang") == "en", F.lit(False))
    words, pieces = F.col("words"), F.col("pieces")
    rollup = TokenRollup(spark, f"{checkpoint_root(spark)}/siftline/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", inserted(docs, "words-1", words))
    copies = deleted(marked.where("copy"), "words-1", words)
    rollup.commit("copies", copies)
    rollup.commit("copies", copies)
    rollup.compact()
    rollup.commit("symbols", revised(kept.where(~english), "words-1", words, words - F.col("symbols")))
    rollup.commit("version", deleted(kept.where(english), "words-1", words).unionByName(inserted(kept.where(english), "pieces-1", pieces)))
    return rollup.totals()


CHECKS["op4_token_counts"] = r"""
WITH counted AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[.,;:!?]')) AS marks,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&]{3}')) AS symbols
  FROM documents
),
kept AS (SELECT * FROM counted QUALIFY doc_id IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY t))
SELECT source, lang, CASE WHEN lang = 'en' THEN 'pieces-1' ELSE 'words-1' END AS tokenizer, count(*) AS n_docs,
       sum(CASE WHEN lang = 'en' THEN words + marks ELSE words - symbols END)::BIGINT AS n_tokens
FROM kept GROUP BY ALL
"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every document, with its probability and whether a template confirms it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.fit(docs))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in a document, within a tenth of its length in edits: one row per place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.start", "m.end", "m.distance")


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of byte-level and word-piece tokens of every document, with corpus-wide counts of linked pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query
def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in windows of 2048 tokens at the sources' shares of all tokens."""
    found = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)
    return found.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; a seventh of the ids claims one more character."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(table(spark, sf_dir, "documents"), claims=claims)
    folded = found.withColumn("folded_root", merkle.fold(F.col("claimed_leaf"), F.col("steps")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: A leaf's digest in SQL; {n} is the number of characters.
SQL_LEAF = "sha256(concat(" + ", ".join(
    f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "{n}", "text")
) + "))"

CHECKS["op13_merkle_manifest"] = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
marked AS (
  SELECT documents.*, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc_table
),
leaves AS (
  SELECT doc_id, lang, {SQL_LEAF.format(n="n_chars")} AS leaf,
         {SQL_LEAF.format(n="CASE WHEN tampered THEN n_chars + 1 ELSE n_chars END")} AS claimed
  FROM marked
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
),
nodes AS (
  SELECT lang AS tree, 0 AS level, place, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1
  GROUP BY tree, level, place // 2
),
parts AS (
  SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
),
upper_nodes AS (
  SELECT 0 AS level, place, n, h FROM parts
  UNION ALL
  SELECT level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM upper_nodes WHERE n > 1 GROUP BY level, place // 2
),
top AS (SELECT level AS top_height, h AS root FROM upper_nodes WHERE n = 1),
docs AS (
  SELECT p.doc_id, p.leaf, p.claimed, p.lang, p.place, parts.height, parts.place AS part, parts.h AS subroot, top.top_height, top.root
  FROM placed p JOIN parts ON parts.tree IS NOT DISTINCT FROM p.lang, top
),
steps AS (
  SELECT d.doc_id, d.level, d.place >> d.level & 1 AS slot, s.h
  FROM (SELECT *, unnest(range(height)) AS level FROM docs) d
  LEFT JOIN nodes s ON s.tree IS NOT DISTINCT FROM d.lang AND s.level = d.level AND s.place = xor(d.place >> d.level, 1)
  UNION ALL
  SELECT d.doc_id, d.height + d.level, d.part >> d.level & 1, s.h
  FROM (SELECT *, unnest(range(top_height)) AS level FROM docs) d
  LEFT JOIN upper_nodes s ON s.level = d.level AND s.place = xor(d.part >> d.level, 1)
),
folded AS (
  SELECT doc_id, 0::BIGINT AS level, claimed AS h FROM docs
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(CASE WHEN s.slot = 1 THEN concat(s.h, f.h) ELSE concat(f.h, s.h) END)
  FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level
),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT d.doc_id, d.leaf, d.subroot, d.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = d.root AS verified
FROM docs d LEFT JOIN proofs USING (doc_id) JOIN folded f ON f.doc_id = d.doc_id AND f.level = d.height + d.top_height
"""
