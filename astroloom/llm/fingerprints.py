"""Operator 1, document fingerprints: prefix polynomial hashes.

A text of n code points has, for each of two primes, the array of its n + 1
prefix sums of (code point + 1) * base^i. Any two spans are compared with four
look-ups, so longest common extensions from the front and from the back come by
binary search. A fingerprint is the length and both whole-text residues (62
bits). The likeness of two texts is the part of the longer one that their
longest common extensions from both ends cover: 1 for equal texts, 0 for texts
that share neither a beginning nor an end. An edited text's hashes come from
its two source texts by composition, without hashing it again.

Neighbours: rows are cut at approximate quantiles of the ids into ranges; each
quantile is an id that exists, so it heads its range, and its rows are copied
to the range before as lookahead. Texts are shuffled once; one pass in id order
keeps two texts at a time.

Results in unusual cases: null text is empty; the edited text of an empty text
is empty; repeated ids follow each other in the order of their texts; null ids
come last; the only row of a table follows itself; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read. Memory: some 20 bytes for
each code point of two texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import bounded_batches, ship
from .common import raw_texts, table

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)


class _Powers:
    """base^0, base^1, ... modulo each prime, doubled on demand."""

    def __init__(self) -> None:
        self.tables = [np.ones(1, dtype=np.int64) for _ in PRIMES]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) <= n:
            for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
                t = self.tables[k]
                self.tables[k] = np.concatenate([t, t * pow(b, len(t), p) % p])
        return self.tables


POWERS = _Powers()


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) + 1
        self.n = n = len(points)
        self.sums = []
        for p, powers in zip(PRIMES, POWERS.upto(n), strict=True):
            sums = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(points * powers[:n] % p, out=sums[1:])
            self.sums.append(sums)

    def prefix(self, k: int, end: int) -> int:
        return int(self.sums[k][end]) % PRIMES[k]


class Spliced:
    """``head[:cut] + tail[:take]``, hashed by composition."""

    def __init__(self, head: PrefixHashes, cut: int, tail: PrefixHashes, take: int) -> None:
        self.head, self.cut, self.tail, self.n = head, cut, tail, cut + take
        POWERS.upto(self.n)

    def prefix(self, k: int, end: int) -> int:
        if end <= self.cut:
            return self.head.prefix(k, end)
        p = PRIMES[k]
        return (self.head.prefix(k, self.cut) + int(POWERS.tables[k][self.cut]) * self.tail.prefix(k, end - self.cut)) % p


def spans_equal(x, i: int, y, j: int, n: int) -> bool:
    """Whether x[i:i+n] and y[j:j+n] have equal hashes modulo both primes."""
    for k, p in enumerate(PRIMES):
        a = (x.prefix(k, i + n) - x.prefix(k, i)) * int(POWERS.tables[k][j])
        b = (y.prefix(k, j + n) - y.prefix(k, j)) * int(POWERS.tables[k][i])
        if (a - b) % p:
            return False
    return True


def common_prefix(x, y, known: int = 0) -> int:
    lo, hi = known, min(x.n, y.n)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if spans_equal(x, 0, y, 0, mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_suffix(x, y, most: int) -> int:
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if spans_equal(x, x.n - mid, y, y.n - mid, mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def likeness(x, y, known: int = 0) -> float:
    longest = max(x.n, y.n)
    if not longest:
        return 1.0
    front = common_prefix(x, y, known)
    return (front + common_suffix(x, y, min(x.n, y.n) - front)) / longest


def fingerprint(x) -> str:
    return f"{x.n:08x}" + "".join(f"{x.prefix(k, x.n):08x}" for k in range(len(PRIMES)))


def compare(x: PrefixHashes, following: PrefixHashes) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    replaced = x.n // 3
    cut, take = x.n - replaced, min(replaced, following.n)
    edited = Spliced(x, cut, following, take)
    text = x.text[:cut] + following.text[:take]
    return (
        x.n,
        hashlib.sha256(text.encode()).hexdigest(),
        fingerprint(x),
        fingerprint(edited),
        likeness(x, edited, cut),
        likeness(x, following),
    )


COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order; lookahead rows come last."""
    before = None
    for batch in batches:
        out = []
        for doc_id, raw, ahead in zip(
            batch.column("doc_id").to_pylist(),
            raw_texts(batch.column("text")),
            batch.column("ahead").to_pylist(),
            strict=True,
        ):
            if ahead and before is None:
                continue
            now = PrefixHashes(raw.decode())
            if before is not None:
                out.append((before[0], *compare(before[1], now)))
            before = None if ahead else (doc_id, now)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)], names
            )


def fingerprint_documents(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The fingerprints and likenesses of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    # One id for each range; no more ever reaches the driver.
    cuts = docs.agg(
        F.max("doc_id").alias("first"),
        F.percentile_approx("doc_id", shares or [0.5], 50 * max(ranges, 200)).alias("cuts"),
    ).first()
    heads = sorted({cuts["first"], *(cuts["cuts"] or [])} - {None}, reverse=True)
    if len(heads) > 1 and not shares:
        heads = heads[:1]
    n = max(1, len(heads))
    doc_id = F.col("doc_id")
    at = F.lit(n - 1)
    if heads:
        # heads are in descending order; range j holds heads[j] >= id > heads[j + 1].
        # Every step-th bound first, then the bounds of one step: not all of them.
        bounds = heads[1:]
        step = max(1, math.isqrt(len(bounds)))

        def literal(ids: list[int]):
            return F.array(*[F.lit(h).cast("long") for h in ids]) if ids else F.array().cast("array<long>")

        coarse = F.size(F.filter(literal(bounds[::step]), lambda h: h >= doc_id))
        steps = F.slice(literal(bounds), F.greatest((coarse - 1) * step, F.lit(0)) + 1, F.lit(step))
        passed = F.when(coarse == 0, F.lit(0)).otherwise(
            (coarse - 1) * step + F.size(F.filter(steps, lambda h: h >= doc_id))
        )
        at = F.when(doc_id.isNull(), n - 1).otherwise(passed)
    is_head = doc_id.isin(heads) if heads else F.lit(True)
    placed = docs.select("doc_id", "text", at.cast("int").alias("place"), is_head.alias("is_head"))
    own = F.struct(F.col("place").alias("at"), F.lit(False).alias("ahead"))
    copy = F.struct(F.pmod(F.col("place") - 1, F.lit(n)).cast("int").alias("at"), F.lit(True).alias("ahead"))
    to = F.explode_outer(F.when(F.col("is_head"), F.array(own, copy)).otherwise(F.array(own)))
    dealt = placed.select("doc_id", "text", to.alias("to")).select("doc_id", "text", "to.at", "to.ahead")
    ship(spark)
    bounded_batches(spark)
    return (
        dealt.repartitionById(n, F.col("at"))
        .sortWithinPartitions("ahead", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))
        .drop("at")
        .mapInArrow(_walk, COLUMNS)
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
SQL: dict[str, str] = {}
