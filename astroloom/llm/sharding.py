"""Operator 8, sharding by Karmarkar-Karp differencing (law ``bytes``).

Documents with equal texts form one indivisible group. Groups that weigh a
``HEAVY``-th of a shard or more (at most shards x HEAVY of them, whatever the
corpus) are items of their own. All others fall by their text's hash into
``BUCKETS`` x ``LEVELS`` fixed bins; level i takes 2^-(i+1) of the hashes, so
the bins' sizes form a geometric scale from large to very small. The driver
then differences at most shards x HEAVY + BUCKETS x LEVELS items: it repeatedly
combines the two partial partitions with the largest spread, oppositely
ordered. Small bins close what gaps the large ones leave, which brings the
shards' bytes close together. The same path serves every corpus size; with few
documents most bins hold one group.

Slots: rows are numbered inside (shard, part), parts being fixed hash parts of
the ids, and shifted by the counts of the parts before. No task sees a whole
shard.

Results in unusual cases: null text weighs 0 (plus 16) and is one group with the
empty text; repeated rows stay together, each with its own slot; a null
``doc_id`` is a valid id; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import settle, table, text_key

SHARDS = 40
OVERHEAD = 16
HEAVY = 64
BUCKETS = 256
LEVELS = 16
PARTS = 1024


def differencing(sizes: list[int], k: int) -> list[int]:
    """The shard (0 to k-1) of each size, by k-way Karmarkar-Karp."""
    serial = itertools.count()
    heap = []
    for i, s in enumerate(sizes):
        slots = [(0, ())] * (k - 1) + [(s, (i,))]
        heap.append((-s, next(serial), slots))
    heapq.heapify(heap)
    # A slot is (sum, tree); a tree is (item,) or (left tree, right tree) or ().
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        met = [
            (x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1])
            for x, y in zip(a, reversed(b), strict=True)
        ]
        met.sort(key=lambda slot: slot[0])
        heapq.heappush(heap, (met[0][0] - met[-1][0], next(serial), met))
    out = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if len(node) == 1:
                out[node[0]] = shard
            else:
                stack += [x for x in node if x]
    return out


def weighed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h1, h2): all that sharding needs of a row."""
    text = F.coalesce("text", F.lit(""))
    h1, h2 = text_key(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        h1.alias("h1"),
        h2.alias("h2"),
    )


def _bin(df: DataFrame) -> DataFrame:
    low = F.col("h2").bitwiseAND(F.lit((1 << (LEVELS - 1)) - 1)).bitwiseOR(F.lit(1 << (LEVELS - 1)))
    level = F.bit_count(low.bitwiseXOR(low - 1)) - 1  # the trailing zeros
    return df.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)).cast("int")).withColumn("level", level.cast("int"))


def shard_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    rows = settle(weighed(docs))
    groups = settle(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    least = max(1, total // (shards * HEAVY))
    heavy = groups.where(F.col("bytes") >= least).orderBy("h1", "h2").collect()  # shards x HEAVY at most
    bins = (
        _bin(groups.where(F.col("bytes") < least))
        .groupBy("bucket", "level")
        .agg(F.sum("bytes").alias("bytes"))
        .orderBy("bucket", "level")
        .collect()  # BUCKETS x LEVELS at most
    )
    dealt = differencing([r.bytes for r in heavy] + [r.bytes for r in bins], shards)
    own = spark.createDataFrame(
        [(r.h1, r.h2, s) for r, s in zip(heavy, dealt, strict=False)], "h1 long, h2 long, own int"
    )
    binned = spark.createDataFrame(
        [(r.bucket, r.level, s) for r, s in zip(bins, dealt[len(heavy) :], strict=True)],
        "bucket int, level int, binned int",
    )
    placed = (
        _bin(rows)
        .join(F.broadcast(own), ["h1", "h2"], "left")
        .join(F.broadcast(binned), ["bucket", "level"], "left")
        .select("doc_id", "size", "text_crc32", "h1", "h2", F.coalesce("own", "binned").alias("shard"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "h1", "h2"), F.lit(PARTS)).cast("int"))
    )
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "h1", "h2")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "part"])  # shards x PARTS rows at most
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
SQL: dict[str, str] = {}
