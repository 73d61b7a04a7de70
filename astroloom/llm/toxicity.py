"""Operator 3, toxicity: a counterfactual-regularised classifier.

Features of a text are the presence of its words and of word beginnings of four
to six characters, so that a stem counts in forms never seen. The features
that the training labels mark most clearly (chi-square) enter a logistic
regression. For every training text that mentions an identity group, the same
text with the terms swapped (for other groups' and for a neutral word) gives a
difference of features d; the fit penalises ``FAIRNESS`` * (w . d)^2, so that a
group's mention moves no score. The unit is the labelled text, not the sentence:
labels mark whole texts, and a word's presence in one sentence changes a text's
features only where no other sentence has it.

Bounds: the fit takes at most ``FIT_ROWS`` labelled texts, those with the
smallest hash of their id (a documented sample; only rows whose crc32(doc_id)
mod 3 is not 1). Their hashed features and the distinct differences d with their
numbers, and nothing else of the corpus, reach the driver. The fitted model has at most ``SELECTED`` features. Scoring is one
narrow pass over all rows. labels, lang, source and doc_id are never inputs.

Results in unusual cases: null and empty texts score the base value; null
labels and labels without a text are not used; a doc_id labelled twice takes
its highest label; with no labelled rows, or labels of one kind, every score is
the smoothed base rate; repeated rows stay; an empty table gives an empty
result; a null ``doc_id`` is never held out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, raw_texts, table, words

FIT_ROWS = 8000
SELECTED = 768
LEAST_CHI2 = 10.0
RIDGE = 0.3
FAIRNESS = 20.0
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: Caches of a worker, in words.
KEPT = 150_000

NEUTRAL = "people"
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "juden", "muslime", "christen"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos"),
)
SWAPS = {t.encode(): [o.encode() for o in g if o != t] + [NEUTRAL.encode()] for g in IDENTITY_GROUPS for t in g}


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, as signed 32-bit numbers."""
    text = word.decode("utf-8", "replace")
    out = [zlib.crc32(b"w" + word) - (1 << 31)]
    for n in PREFIXES:
        if len(text) > n:
            out.append(zlib.crc32(f"{n}{text[:n]}".encode()) - (1 << 31))
    return tuple(out)


def features(ws: set[bytes]) -> set[int]:
    return {f for w in ws for f in word_features(w)}


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def score(self, logit: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + logit, -40, 40))))


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, text): the documented, bounded sample."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # limit rows of an id and a label: small by definition
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def swaps(ws: set[bytes]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each version of a text with one identity term swapped, the features
    that go and those that come."""
    out = []
    for term in sorted(ws & SWAPS.keys()):
        rest = ws - {term}
        # Few words share a feature with the term: its word beginnings.
        beginning = term.decode()[: min(PREFIXES)]
        like = features({w for w in rest if w.decode("utf-8", "replace").startswith(beginning)})
        for other in SWAPS[term]:
            near = other.decode()[: min(PREFIXES)]
            there = features({w for w in rest if w.decode("utf-8", "replace").startswith(near)})
            old, new = set(word_features(term)), set(word_features(other))
            gone, come = old - like - new, new - there - old
            if gone or come:
                out.append((tuple(sorted(gone)), tuple(sorted(come))))
    return out


def collect_features(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray, Counter]:
    """Hashed features and label of each row, and how often each change of
    features comes from swapping an identity term. Features come as Arrow
    columns, four bytes each; changes are counted on the executors, so that the
    driver gets each distinct one once, however many texts and terms there are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, changes = [], Counter()
        for text in raw_texts(batch.column("text")):
            ws = set(words(text))
            own.append(sorted(features(ws)))
            changes.update(swaps(ws))
        listed = [[[list(gone), list(come), [n]] for (gone, come), n in sorted(changes.items())]]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("toxic"),
                pa.array(own, pa.list_(pa.int32())),
                pa.array(listed + [None] * (batch.num_rows - 1), pa.list_(pa.list_(pa.list_(pa.int32())))),
            ],
            ["doc_id", "toxic", "own", "changes"],
        )

    found = map_batches(
        rows.select("doc_id", "text", "toxic"),
        run,
        "doc_id bigint, toxic int, own array<int>, changes array<array<array<int>>>",
    ).toArrow()
    own, y, ids = [], [], []
    changes: Counter = Counter()
    for batch in found.to_batches():
        column = batch.column("own")
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        own += [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        for listed in batch.column("changes").drop_null().to_pylist():
            for gone, come, (n,) in listed:
                changes[tuple(gone), tuple(come)] += n
        y += batch.column("toxic").to_pylist()
        ids += batch.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], len(own[i]), own[i].tobytes()))
    return [own[i] for i in order], np.array([1.0 if y[i] else 0.0 for i in order]), changes


def fit(own: list[np.ndarray], y: np.ndarray, changes: Counter, fairness: float = FAIRNESS) -> Model:
    """``own``: sorted feature hashes of each row; ``changes``: see ``collect_features``."""
    n, pos = len(y), float(y.sum()) if len(y) else 0.0
    if not 0 < pos < n:
        rate = (pos + 0.5) / (n + 1.0)
        return Model(float(np.log(rate / (1 - rate))), {})
    names, with_f = np.unique(np.concatenate(own), return_counts=True)
    own_names, own_counts = np.unique(np.concatenate([x for x, t in zip(own, y, strict=True) if t]), return_counts=True)
    a = np.zeros(len(names))
    a[np.searchsorted(names, own_names)] = own_counts
    b = with_f - a
    c, d = pos - a, (n - pos) - b
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * pos * (n - pos), 1e-9)
    order = np.lexsort((names, -chi2))[:SELECTED]
    chosen = np.sort(names[order[chi2[order] >= LEAST_CHI2]])
    k = len(chosen)

    def row(features: np.ndarray) -> np.ndarray:
        out = np.zeros(k + 1, dtype=np.float32)
        out[-1] = 1.0
        if k:
            at = np.minimum(np.searchsorted(chosen, features), k - 1)
            out[at[chosen[at] == features]] = 1.0
        return out

    x = np.zeros((n, k + 1), dtype=np.float32)
    for i, features in enumerate(own):
        x[i] = row(features)
    place = {int(f): j for j, f in enumerate(chosen)}
    gaps: Counter = Counter()
    for (gone, come), count in changes.items():
        gap = tuple((place[f], -1.0) for f in gone if f in place) + tuple((place[f], 1.0) for f in come if f in place)
        if gap:
            gaps[gap] += count
    ridge = np.full(k + 1, RIDGE)
    ridge[-1] = 1e-3
    # Both kinds weigh the same half of n, softened towards the base rate.
    weight = np.where(y > 0, 0.5 * (1 + 0.5 * n / pos), 1.0)
    w = np.zeros(k + 1)
    w[-1] = np.log(pos / (n - pos))
    penalty = np.diag(ridge)
    for gap, count in sorted(gaps.items()):  # the sum of the changes' squares, a few entries each
        at, sign = np.array([j for j, _ in gap]), np.array([v for _, v in gap])
        penalty[np.ix_(at, at)] += fairness * count * np.outer(sign, sign)
    for _ in range(30):  # Newton steps
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        grad = x.T @ (weight * (p - y)) + penalty @ w
        scale = np.sqrt(weight * p * (1 - p) + 1e-6).astype(np.float32)
        scaled = x * scale[:, None]
        step = np.linalg.solve((scaled.T @ scaled).astype(np.float64) + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return Model(float(w[-1]), {int(f): float(w[j]) for j, f in enumerate(chosen)})


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, fairness: float = FAIRNESS) -> Model:
    return fit(*collect_features(training_rows(docs, labels, limit)), fairness)


class _Scorer:
    """Remembers which chosen features a word has."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, {}

    def __call__(self, text: bytes) -> float:
        known, weights, found = self.words, self.model.weights, set()
        for w in set(words(text)):
            f = known.get(w)
            if f is None:
                f = tuple(x for x in word_features(w) if x in weights)
                if len(known) < KEPT:
                    known[w] = f
            if f:
                found.update(f)
        return self.model.score(sum(weights[f] for f in sorted(found)))


def score_column(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` (its rows as ``row``) with the score of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SELECTED weights at most
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batch: pa.RecordBatch, own: list = []) -> pa.RecordBatch:  # noqa: B006  one scorer for each task
        if not own:
            own.append(_Scorer(shared.value))
        scorer, row = own[0], batch.column("row")
        scores = [scorer(t) for t in raw_texts(row.field("text"))]
        return pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], ["row", name])

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    return map_batches(rows, run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_column(docs, model)
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
