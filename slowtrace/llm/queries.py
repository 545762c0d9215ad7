"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slowtrace.llm import (
    contamination, digest_index, hilbert, lines, minhash, packing, phrases, pseudonyms, quality, rendering, sequence_files, substrings,
    whitening,
)
from slowtrace.plans.registry import Query
from slowtrace.session import scratch_path

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For tables without real people in them only: whoever knows the key can undo the pseudonyms.
TEST_KEY = "op4 production key"


@query("op4_pseudonyms")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with keyed pseudonyms in place of personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.slowtrace.pseudonymKey", TEST_KEY)
    done = pseudonyms.pseudonymise(docs, key=key.encode())
    return done.withColumn("n_findings", F.size("findings"))


@query("op6_rendering")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out."""
    return rendering.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


@query("op7_hilbert")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards along a Hilbert curve."""
    placed = hilbert.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


_LOWERED = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@query("op10_digest_index", f"""
WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each text stays, by an index built for this run."""
    index = digest_index.DigestIndex(spark, scratch_path(spark, "digests"))
    prints = digest_index.fingerprints(table(spark, sf_dir, "documents"))
    groups = digest_index.exact_groups(prints, index)
    index.close()
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_substrings")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document when windows of 50 words seen in a smaller doc_id go."""
    cut = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash.near_groups(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op8_lines")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document are fuzzy repeats of lines elsewhere."""
    return lines.repeated_lines(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op9_contamination", """
WITH w(kind, id, ws) AS (
  SELECT 'd', doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
      FROM w WHERE len(ws) > 0),
n AS (SELECT id, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n_shingles, count(*) AS n_found
FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n_shingles HAVING 100 * count(*) >= 75 * n.n_shingles
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination.contained_items(docs, items).drop("text_hash")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens in sequences of 1024."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary))


@query("op11_phrases", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, cast(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ws
      FROM (SELECT *, unnest(range(1, 5)) AS k FROM w) WHERE len(ws) >= k),
f AS (SELECT lang, k, ws, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
h AS (SELECT lang, ws, a, cut, ws[1:cut] AS head, ws[cut + 1:k] AS rest
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
c AS (SELECT h.lang, h.ws, h.a, cut, x.a AS l, y.a AS r, (2000000 * h.a::HUGEINT) // (x.a + y.a)::HUGEINT AS score
      FROM h JOIN f x ON x.lang = h.lang AND x.ws = h.head JOIN f y ON y.lang = h.lang AND y.ws = h.rest),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
i AS (SELECT lang, a, ws, k, m, unnest(range(1, k - m + 2)) AS first
      FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)),
o AS (SELECT lang, ws[first:first + m - 1] AS ws, max(a) AS outer_a FROM i GROUP BY ALL),
s AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN o USING (lang, ws)
      WHERE outer_a IS NULL OR 100 * outer_a::HUGEINT < 80 * b.a::HUGEINT)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       cast(score AS BIGINT) AS score
FROM s JOIN t USING (lang) QUALIFY rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))


@query("op12_sequence_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in Arrow stream files, read back."""
    folder = scratch_path(spark, "sequences")
    sequence_files.write_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return sequence_files.read_documents(spark, folder)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
