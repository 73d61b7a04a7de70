"""Operator 10, SimHash near-dedup with pigeonring filtering.

A fingerprint has a bit set where over half of the text's shingle hashes have
it. Two fingerprints link at ``max_bits`` (2) or fewer differing bits, and a
component is what links reach.

Candidates: the 64 bits form a ring of ``SEGMENTS`` = 8 segments of 8 bits. By
the pigeonring principle, fingerprints within distance t have a segment from
which every chain of l consecutive segments differs in at most l*t/8 bits; for
t = 2 the first three segments of that chain are equal. Those 24 bits are the
join key (one for each of the eight starts), the rest of the chain's budgets
prune, and the full distance is checked last.

Copies collapse first: everything after the fingerprints works on distinct
fingerprints. A key that more than ``DENSE`` distinct fingerprints share (a
large group of near copies) is not paired: two fingerprints differ in at most
two bits exactly if some value is within one bit of both, so the members of
such keys send their 65 nearby values, and those that meet at a value (65 at
most, by construction) link to its smallest. That is exact, with no pairs of a
group. Components come from alternating large-star and small-star steps with
partial minima, checkpointed between rounds.

Results in unusual cases: null and empty texts have fingerprint zero and link
like any other; a text of fewer than three words is one shingle; repeated rows
stay, each with its component; a null ``doc_id`` is the smallest id; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, map_batches, raw_texts, settle, table, text_key

WIDTH = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 8
SEGMENT_BITS = 64 // SEGMENTS
DENSE = 48
SALTS = 16


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text's word shingles (signed)."""
    ws = raw.lower().split()
    if not ws:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(ws) <= width:
        return int(np.uint64(digest(b" ".join(ws), SEED)).astype(np.int64))
    counts = np.zeros(64, dtype=np.int64)
    n = len(ws) - width + 1
    for lo in range(0, n, 65536):  # whole text, in blocks of bounded memory
        part = ws[lo : min(n, lo + 65536) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = len(part) - width + 1
        h = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[width - 1 :].tolist(), strict=True)),
            np.uint64,
            m,
        )
        counts += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text; long columns ``carried``
    stay beside it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t) for t in raw_texts(batch.column("text"))]
        more = [batch.column(c) for c in carried]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64()), *more], ["doc_id", "fp", *carried])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    return map_batches(own, run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def _rotated(fp: Column, by: int) -> Column:
    """``fp`` turned so that segment ``by`` comes lowest."""
    if not by:
        return fp
    bits = by * SEGMENT_BITS
    return F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits))


def _mask(segments: int) -> Column:
    bits = segments * SEGMENT_BITS
    return F.lit(-1 if bits >= 64 else (1 << bits) - 1).cast("long")


def run_length(max_bits: int) -> int:
    """Equal consecutive segments that the pigeonring principle assures."""
    return max(n for n in range(SEGMENTS) if n * max_bits < SEGMENTS) if max_bits else SEGMENTS


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """(u, v), u < v: links that connect the same components as all pairs of
    distinct ``fp`` within ``max_bits`` (at most 2) do."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    run = run_length(max_bits)
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[_rotated(F.col("fp"), s).bitwiseAND(_mask(run)) for s in range(SEGMENTS)])).alias(
            "start", "key"
        ),
    )
    # Written down, so that both sides of the join are plain exchanges and a
    # key with very many fingerprints is split between tasks.
    sizes = settle(keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sized = keyed.join(sizes, ["start", "key"])
    few = sized.where(F.col("n") <= dense).select("start", "key", "fp")
    a, b = few.alias("a"), few.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # The chain budgets beyond the equal run, for the start the key stands for.
    chains = F.lit(False)
    for s in range(SEGMENTS):
        turned = _rotated(differ, s)
        within = F.lit(True)
        for n in range(run + 1, SEGMENTS):
            within = within & (F.bit_count(turned.bitwiseAND(_mask(n))) <= n * max_bits // SEGMENTS)
        chains = chains | ((F.col("a.start") == s) & within)
    pairs = (
        a.join(b, ["start", "key"])
        .where(F.col("a.fp") < F.col("b.fp"))
        .where(chains)
        .where(F.bit_count(differ) <= max_bits)
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    crowded = sized.where(F.col("n") > dense).select("fp").distinct()
    if max_bits == 2:
        ball = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)]
    else:  # one bit apart: the value with the differing bit cleared, and which bit it is
        ball = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i))).cast("long"))) for i in range(64)]
    met = (
        crowded.select("fp", F.explode(F.array(*ball)).alias("near"))
        .groupBy("near")
        .agg(F.collect_set("fp").alias("members"))  # 65 at most: the values within one bit
        .where(F.size("members") > 1)
    )
    stars = (
        met.select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
        .where("u < v")
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    )
    return pairs.union(stars).distinct()


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their ``u``; a node with very many links is
    dealt out by a salt from its other end."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a link.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    round is a partial-minimum aggregation and a join on the node, and the
    number of links never grows.
    """
    edges = settle(links.select("u", "v"))
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least)
        edges = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        # As longs that wrap: an exact sum is not needed, only a sign of change.
        after = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _rooted(first: DataFrame, max_bits: int, dense: int) -> DataFrame:
    """(fp, least, root) of distinct fingerprints."""
    found = components(near_links(first.select("fp"), max_bits, dense))
    return first.join(found, first.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def survivors(docs: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """(id, k1, k2) of one row of each component: the smallest id, of rows with
    that id the smallest text key. Rows with one text have one component, so
    the three name a row's component even where ids are null or repeat."""
    k1, k2 = text_key(F.col("text"))
    fps = settle(fingerprints(docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2")), "k1", "k2"))
    own = F.struct(id_key(F.col("doc_id")).alias("id"), "k1", "k2")
    first = settle(fps.groupBy("fp").agg(F.min(own).alias("least")))
    named = _rooted(first, max_bits, dense)
    return named.groupBy("root").agg(F.min("least").alias("least")).select("least.*")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    fps = settle(fingerprints(docs))
    first = fps.groupBy("fp").agg(F.min(id_key(F.col("doc_id"))).alias("least"))
    # A component's id: the least id of its members, roots included.
    named = _rooted(settle(first), max_bits, dense)
    ids = settle(named.groupBy("root").agg(F.min("least").alias("component")))
    labels = named.join(ids, "root").select("fp", "component")
    return fps.join(labels, "fp").select(
        "doc_id",
        "fp",
        F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}
