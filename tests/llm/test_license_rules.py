"""Operator 2 against a plain version and its SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from astroloom.llm import licenses
from astroloom.llm.common import settle, words

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "b c"), (5, " é日本 😀 \x00 x"), (6, "word " * 30000)]


def plain(text):
    ws = [w.decode() for w in words((text or "").encode())]
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        for i in range(len(ws)):
            if ws[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    more, best = set(labels), 0.0
    for label, must, notice in licenses.TEMPLATES:
        t = [w.decode() for w in words(notice.encode())]
        stride = next(s for s in licenses.STRIDES if s >= len(t))
        pairs = set(zip(t, t[1:]))
        for lo in range(0, len(ws), stride):
            block = ws[lo : lo + 2 * stride]
            common = (Counter(t) & Counter(block)).total()
            ordered = len(pairs & set(zip(block, block[1:])))
            if common >= math.ceil(0.8 * len(t) - 1e-9) and ordered >= math.ceil(0.6 * len(pairs) - 1e-9) and set(must.split()) <= set(block):
                more.add(label)
                best = max(best, common / len(t))
    first, last = (min(places), max(places)) if places else (None, None)
    return (len(ws), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if places else best)


def rows_of(seed):
    rng = random.Random(seed)
    notices = [t for _, _, t in licenses.TEMPLATES]
    pool = sorted({w for t in notices for w in licenses.plain_words(t)}) + "cc by Über the and x y z".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    for i, t in enumerate(notices):
        ws = t.split()
        rows.append((100 + i, f"Some words before. {t.upper()}!\nMore"))
        # Words replaced, dropped and put in: some noise leaves a notice one.
        for k, noise in enumerate((0.05, 0.15, 0.25)):
            noisy = [rng.choice(pool) if rng.random() < noise else w for w in ws if rng.random() > noise / 4]
            rows.append((200 + 10 * i + k, "filler " * rng.randint(0, 40) + " ".join(noisy) + " filler" * rng.randint(0, 40)))
        rows.append((500 + i, " ".join(rng.sample(ws, len(ws)))))  # the words without their order
        rows.append((600 + i, " ".join(ws[: len(ws) // 2])))
    rows += [(700, "CC BY-NC 4.0 cc-by cc by"), (701, "\u212a cc\u212a by \u0130 ALL rights-Reserved K"), (702, "x " * 70 + "licensed under the Apache License")]
    return rows + [(None, notices[0]), (None, notices[0]), (None, notices[1])]


def scanned(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("words", "held", "block", "id", "label", "row"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in licenses.op2_licenses(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("seed", [3, 4])
def test_brute_force(spark, tmp_path, seed):
    rows = rows_of(seed) + ODD
    assert sorted(map(repr, scanned(spark, tmp_path, rows))) == sorted(repr((i, *plain(t))) for i, t in rows)


def test_sql(spark, tmp_path):
    rows = [r for r in rows_of(5) if r[0] is not None] + [(1, None), (2, "")]
    got = scanned(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, con.execute(licenses.SQL["op2_licenses"]).fetchall())) == sorted(map(repr, got))


def test_every_notice_is_found_whole():
    for label, _, t in licenses.TEMPLATES:
        found = plain("words before it " * 9 + t)[5].split(",")
        assert label in found, (label, found)


@pytest.mark.parametrize(
    "text",
    [
        "The word was released last year under a new name. The mit group holds a license for cars.",
        "Roads are subject to the terms of the public works act, and a license is needed.",
        "The commons debated creative work and its attribution; a fee is licensed under the law.",
        "Diese Arbeit mit dem Text wird hier mit allen Namen verteilt und mit der Zeit besser.",
        "The public domain of the city is free for anyone, and software was released into schools.",
        "Permission to use the copy room for any purpose is granted by the notice on the door.",
    ],
)
def test_common_words_are_no_notice(text):
    assert plain(text)[5:] == ("", 0.0)


def test_german_prepositions_are_no_mit():
    text = "Ein Werk mit Text. Licensed under the Apache License, Version 2.0. Mit Dank an alle, mit Gruß."
    assert plain(text)[5] == "apache"


def test_all_stages_are_native(spark, monkeypatch):
    """Also what a checkpoint cuts off the plan."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        return settle(df)

    monkeypatch.setattr(licenses, "settle", noted)
    out = licenses.scan(spark.createDataFrame([(1, licenses.TEMPLATES[0][2])], SCHEMA))
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) == 2
    assert not any(w in p for p in plans for w in ("Python", "Pandas", "MapInArrow", "ArrowEval"))
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []
