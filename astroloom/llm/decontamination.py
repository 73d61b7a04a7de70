"""Operator 4, benchmark decontamination: prefix-filtered set join.

Every benchmark item gives its windows of ``WINDOW`` consecutive words (all its
words, if it has fewer). A window occurs where all its words stand in a row:
containment 1 over an item-sized window of the document, so a window's
necessary prefix is its single rarest word. Rarity is the number of documents
that hold the word, counted over the whole corpus (benchmark words only). A
document word that is the rarest word of some window yields, by the word's
offset in the window (positional filter) and the words left on either side
(length filter), the one place where that window could stand; the place is then
verified word by word.

A benchmark whose measured texts are under ``BROADCAST_BYTES`` is broadcast as
an index by rarest word. A larger one stays distributed: rarity is counted once,
each window's rarest word and offset go into a bit filter of fixed size (2 MB),
documents yield the windows that the filter lets through, and those meet the
benchmark's windows by an equi-join on the whole window, which is the exact test.
The hits return to their texts by a 128-bit key.

Results in unusual cases: null or empty texts have no words (0, 0, 0, digest of
the empty string, false); null or empty items have no window; items with equal
texts all count; repeated item rows with one ``item_id`` count once; the windows
of an item without ``item_id`` are hit, but there is no id to list or count;
repeated documents rows stay; tables may be empty; only ``doc_id``/``item_id``
and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, raw_texts, settle, table, text_key, words

WINDOW = 10
BROADCAST_BYTES = 8_000_000
#: Bits of the filter, and of one row of it.
FILTER_BITS, ROW_BITS = 1 << 24, 1 << 15
#: Words that a worker remembers.
KEPT = 150_000


def text_windows(text: bytes, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    ws = words(text)
    return [tuple(ws[i : i + window]) for i in range(max(1, len(ws) - window + 1) if ws else 0)]


def item_windows(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window with the ids of the items that have it."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item_id, text in items:
        for w in text_windows(text, window):
            found[w].update([item_id] if item_id is not None else [])
    return {w: sorted(ids) for w, ids in found.items()}


def prefix_index(windows: dict[tuple[bytes, ...], list[str]], rarity: dict[bytes, int]) -> dict:
    """rarest word -> [(its offset, the window, item ids)]."""
    index: dict[bytes, list] = defaultdict(list)
    for w, ids in sorted(windows.items()):
        at = min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i))
        index[w[at]].append((at, list(w), ids))
    return dict(index)


def hits(ws: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """(start, end) of every occurrence of a window, and the items they are of."""
    spans, items, n = [], set(), len(ws)
    for p, word in enumerate(ws):
        for at, window, ids in index.get(word, ()):
            lo = p - at
            hi = lo + len(window)
            if lo >= 0 and hi <= n and ws[lo:hi] == window:
                spans.append((lo, hi))
                items.update(ids)
    return spans, items


def word_rarity(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """(word, n): how many documents hold each word (of ``vocabulary``)."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for text in raw_texts(batch.column("text")):
            own = words(text)
            n.update(set(own) if known is None else known.value.intersection(own))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"]
        )

    partial = map_batches(docs.select("text"), count, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _named(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")


def _bytes(benchmark: DataFrame) -> int:
    return _named(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` (its rows as ``row``, without the text) with ``text``,
    ``n_words``, ``n_hit`` (words inside an occurrence of a window) and
    ``items`` (sorted ids of the items that occur)."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    small = _bytes(benchmark) <= broadcast_bytes
    return (_by_broadcast if small else _by_shuffle)(rows, benchmark, window)


def _by_broadcast(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    windows = item_windows([(r.item_id, r.text.encode()) for r in _named(benchmark).toLocalIterator()], window)
    vocabulary = {w for x in windows for w in x}
    rarity = {bytes(r.word): r.n for r in word_rarity(rows, vocabulary).collect()} if windows else {}
    index = rows.sparkSession.sparkContext.broadcast(prefix_index(windows, rarity))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, items = [], [], []
        for text in raw_texts(batch.column("text")):
            ws = words(text)
            spans, found = hits(ws, index.value)
            n_words.append(len(ws))
            n_hit.append(sum(hi - lo for lo, hi in merged(spans)))
            items.append(sorted(found))
        out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *out], ["row", "text", "n_words", "n_hit", "items"])

    added = T._parse_datatype_string("n_words long, n_hit long, items array<string>").fields
    return map_batches(rows, find, T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), *added]))


def filter_key(word: bytes, at: int, n: int) -> bytes:
    return word + b" %d %d" % (at, n)


def _by_shuffle(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    spark = rows.sparkSession

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for item_id, text in zip(batch.column("item_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
            for w in text_windows(text, window):
                ids.append(item_id)
                found.append(b" ".join(w))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item_id", "window"])

    items = settle(map_batches(_named(benchmark), cut, "item_id string, window binary").distinct())
    parts = F.split(F.col("window").cast("string"), " ")
    places = items.select("window").distinct().select("window", F.size(parts).alias("n"), F.posexplode(parts).alias("at", "w"))
    rarity = word_rarity(rows)
    prefixes = (
        places.join(rarity.select(F.col("word").cast("string").alias("w"), F.col("n").alias("docs")), "w", "left")
        .groupBy("window", "n")
        .agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "w", "at")).alias("rarest"))
        .select("window", "n", F.col("rarest.w").alias("w"), F.col("rarest.at").alias("at"))
    )
    prefixes = settle(prefixes)
    bit = F.pmod(F.crc32(F.concat_ws(" ", "w", "at", "n")), F.lit(FILTER_BITS))
    bits = prefixes.select(F.floor(bit / ROW_BITS).cast("int").alias("row"), (bit % ROW_BITS).alias("bit"))
    bits = bits.groupBy("row").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    passed = {r.row: bytes(r.bits) for r in bits.collect()}  # FILTER_BITS at most
    lengths = sorted(r.n for r in prefixes.select("n").distinct().collect())  # WINDOW lengths at most
    shared = spark.sparkContext.broadcast(passed)

    def lets(word: bytes) -> tuple[tuple[int, int], ...]:
        """The offsets and lengths of windows that the word may be rarest in."""
        out = []
        for n in lengths:
            for at in range(n):
                row, rest = divmod(zlib.crc32(filter_key(word, at, n)) % FILTER_BITS, ROW_BITS)
                line = shared.value.get(row)
                if line and line[rest >> 3] >> (rest & 7) & 1:
                    out.append((at, n))
        return tuple(out)

    def candidates(batch: pa.RecordBatch, known: dict = {}) -> pa.RecordBatch:  # noqa: B006  one for each task
        at_row, los, his, found = [], [], [], []
        for r, text in enumerate(raw_texts(batch.column("text"))):
            ws = words(text)
            for p, word in enumerate(ws):
                places = known.get(word)
                if places is None:
                    places = lets(word)
                    if len(known) < KEPT:
                        known[word] = places
                for at, n in places:
                    if p >= at and p - at + n <= len(ws):
                        at_row.append(r)
                        los.append(p - at)
                        his.append(p - at + n)
                        found.append(b" ".join(ws[p - at : p - at + n]))
        keys = pa.array(at_row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("k1").take(keys), batch.column("k2").take(keys), pa.array(los, pa.int64()), pa.array(his, pa.int64()), pa.array(found, pa.binary())],
            ["k1", "k2", "lo", "hi", "window"],
        )

    k1, k2 = text_key(F.col("text"))
    keyed = rows.select("row", "text", k1.alias("k1"), k2.alias("k2"))
    met = map_batches(keyed.select("k1", "k2", "text"), candidates, "k1 long, k2 long, lo long, hi long, window binary")
    # Every window of an item is in items; a hit text's spans and ids are no more than it and the items that it holds.
    met = settle(met.join(items.select("window").distinct(), "window", "left_semi"))
    spans = met.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    ids = met.select("k1", "k2", "window").distinct().join(items.where("item_id IS NOT NULL"), "window")
    ids = ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(a["end"], x["lo"]))).alias("n"), F.greatest(a["end"], x["hi"]).alias("end")
        ),
        lambda a: a["n"],
    )
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))
    joined = keyed.join(spans, ["k1", "k2"], "left").join(ids, ["k1", "k2"], "left")
    return joined.select(
        "row",
        "text",
        n_words.cast("long").alias("n_words"),
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE text IS NOT NULL),
item_at AS (
  SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0),
windows AS (
  SELECT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS s, least(len(w), 10) AS n FROM item_at),
lengths AS (SELECT DISTINCT n FROM windows),
doc_at AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n),
doc_windows AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM doc_at),
found AS (
  SELECT d.doc_id, d.i, d.n, w.item_id FROM doc_windows d JOIN windows w ON d.s = w.s AND d.n = w.n),
places AS (SELECT DISTINCT doc_id, i, n FROM found),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM places) x GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit,
       coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

QUERIES = {"op4_decontamination": op4_decontamination}
SQL = {"op4_decontamination": OP4_SQL}
