"""Line dedup: drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

#: The characters stripped from a key, and the letters that are lower-cased.
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Common hashes that are broadcast at most, 16 bytes each; more of them meet the lines by a shuffle.
SMALL = 100_000


def fold(c: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the faster lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(STRIPPED))


def _hash(c: Column) -> list[Column]:
    """128 bits of a string as two longs."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def line_dedup(df: DataFrame, text: str = "text", id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, salts: int = 16) -> DataFrame:
    """The rows of df with `text` rid of lines found in at least min_docs documents, and n_lines, n_dropped (long).

    Lines are split at \\n; a line's key is the line stripped of ASCII white
    space at both ends, A-Z lower-cased. Keys under min_chars code points
    never count. Every occurrence of a common key goes, in every document;
    the other lines stay in their order, joined by \\n.

    A null or empty text is one empty line, and an empty text comes back.
    Each row is a document, so repeated rows count as several; rows that
    share an id (null too) are told apart by their texts. Other columns pass
    through; n_lines and n_dropped replace columns of that name.

    Lines are exploded once, with their positions and the hashes of their
    keys, and written. Counting takes each row's distinct hashes, partly
    summed before each shuffle. Up to SMALL common hashes are broadcast to
    the lines; more meet them by hash and a salt of `salts` values, so one
    line of many documents is no single task's. Only the positions of dropped lines go back to the texts, each
    text cut between them. Time and memory of a text are in proportion to it
    but for the sorting of its dropped positions.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    whole = dict(zip(("__t1", "__t2"), _hash(said)))
    rows = df.select(F.col(id).alias("__id"), *(c.alias(k) for k, c in whole.items()), F.monotonically_increasing_id().alias("row"), said.alias("said"))
    keys = rows.select("__id", "__t1", "__t2", "row", F.posexplode(F.split("said", "\n", -1)).alias("at", "line")).withColumn("key", line_key(F.col("line")))
    hashes = dict(zip(("a", "b"), _hash(fold(F.col("key")))))
    lines = cut(keys.filter(F.char_length("key") >= min_chars).select("__id", "__t1", "__t2", "row", "at", *(c.alias(k) for k, c in hashes.items())))
    common = cut(lines.groupBy("a", "b").agg(F.count_distinct("row").alias("n")).filter(F.col("n") >= min_docs).select("a", "b"))
    if common.count() <= SMALL:
        hits = lines.join(F.broadcast(common), ["a", "b"])
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        hits = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))).join(salted.hint("merge"), ["a", "b", "salt"])
    gone = hits.groupBy("__id", "__t1", "__t2").agg(F.array_sort(F.collect_set("at")).alias("__gone"))

    same = F.col(id).eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__t1")) & (F.col("__h2") == F.col("__t2"))
    met = df.withColumns({"__h1": whole["__t1"], "__h2": whole["__t2"]}).join(gone, same, "left").drop("__id", "__t1", "__t2", "__h1", "__h2")
    met = met.withColumn("__lines", F.split(said, "\n", -1))
    # what lies between a dropped line and the next
    after = F.concat(F.array(F.lit(-1)), F.col("__gone"))
    upto = F.concat(F.col("__gone"), F.array(F.size("__lines")))
    left = F.flatten(F.zip_with(after, upto, lambda p, q: F.slice("__lines", p + 2, q - p - 1)))
    return met.withColumns(
        {
            text: F.when(F.col("__gone").isNull(), said).otherwise(F.array_join(left, "\n")),
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        }
    ).drop("__lines", "__gone")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key
GROUP BY k.doc_id
"""
