"""Operator 7, line dedup: explode normalised lines, hash, count distinct
documents per hash, drop lines over the threshold, reassemble by position.

Results in unusual cases:

* null or empty text: one empty line, nothing dropped;
* null ``doc_id``: such rows count as one document with the smallest id;
* repeated rows (one ``doc_id`` more than once): one document when counted;
  every row of the keeping id keeps its lines;
* a line repeated inside a document counts its document once; the keeper keeps
  every repeat, the others lose every repeat;
* empty table: empty result; further columns pass through untouched.

Scale: only 24-byte (hash, id) pairs are counted, distinct inside a document
before they leave the scan. The count is two-staged (by hash and id, then by
hash), so a line that a third of all documents hold meets in one task only as
partial sums. Texts are shuffled at most once, by id.
"""

from __future__ import annotations


import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, id_key, map_batches, raw_texts, settle, table

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The hash of a line's key, or None where the key is too short to count."""
    key = line.strip(WHITE)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line_hash, doc, part): each counted key once per document row. ``part``
    deals the rows without an id, which count as one document, over many keys."""

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owners, parts = [], [], []
        columns = (batch.column("doc").to_pylist(), batch.column("part").to_pylist(), raw_texts(batch.column("text")))
        for doc, part, text in zip(*columns, strict=True):
            found = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
            hashes += found
            owners += [doc] * len(found)
            parts += [part] * len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.binary()), pa.array(owners, pa.int64()), pa.array(parts, pa.int64())], ["line_hash", "doc", "part"]
        )

    return map_batches(docs.select(*owner(), "text"), pairs, "line_hash binary, doc long, part long")


def owner() -> list[Column]:
    """The key of a row's dropped lines."""
    part = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    return [id_key(F.col("doc_id")).alias("doc"), part.cast("long").alias("part")]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (its rows as ``row``, without the text) with ``text`` (what is
    kept), ``n_lines`` (before dropping) and ``n_dropped``."""
    pairs = settle(line_pairs(docs, min_chars))
    # Written down, so that the join below has two plain exchanges and the rows
    # of a very common line are split between tasks.
    shared = settle(
        pairs.groupBy("line_hash")
        .agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("line_hash", "keeper")
    )
    drops = (
        pairs.join(shared, "line_hash")
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc", "part")
        .agg(F.collect_set("line_hash").alias("dropped"))  # lines of a text at most
    )
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text", *owner()
    ).join(drops, ["doc", "part"], "left")

    def reassemble(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, lines, dropped = [], [], []
        for text, out in zip(raw_texts(batch.column("text")), batch.column("dropped").to_pylist(), strict=True):
            parts = text.split(b"\n")
            stay = parts
            if out:
                out = set(out)
                stay = [x for x in parts if line_key(x, min_chars) not in out]
            kept.append(text if stay is parts else b"\n".join(stay))
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(lines, pa.int64()),
                pa.array(dropped, pa.int64()),
            ],
            ["row", "text", "n_lines", "n_dropped"],
        )

    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )
    return map_batches(rows.select("row", "text", "dropped"), reassemble, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, (shared.k IS NOT NULL AND doc_id <> keeper) AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {"op7_line_dedup": OP7_SQL}
