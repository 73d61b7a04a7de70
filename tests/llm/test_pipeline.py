"""The pipeline, stage by stage, against brute force; queries against SQL."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from astroloom.llm import pieces, toxicity
from astroloom.llm.registry import QUERIES, SQL

from .test_text_operators import ODD, plain_components, plain_hits, plain_line_dedup, plain_simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the small documents and odd rows."""
    if not Path(DATA).exists():
        pytest.skip("no driver tables")
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None if i is None else i + 100_000, t) for i, t in ODD], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("n_words", F.lit(7))
    docs.write.parquet(str(folder / "in"))
    at, out = spark.read.parquet(str(folder / "in")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, DATA).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out[name] = (at, after)
        at = after
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns
        assert [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    score = toxicity._Scorer(model)
    expected = [(i, t) for i, t in rows(before) if score((t or "").encode()) < 0.7]
    assert sorted(map(repr, rows(after))) == sorted(map(repr, expected)) and 0 < len(expected) <= before.count()


def test_lines(stages):
    before, after = stages["line_dedup"]
    got = sorted(repr((r.doc_id, r.text)) for r in after.collect())
    import ast

    expected = []
    for x in plain_line_dedup(rows(before)):
        i, text, *_ = ast.literal_eval(x)
        expected.append(repr((i, text)))
    assert [g.replace("None)", "'')") for g in got] == sorted(expected)


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash_near_dedup"]
    own = rows(before)
    groups = plain_components(own, [plain_simhash(t) for _, t in own])
    kept = {-(2**63) if i is None else i for i, _ in rows(after)}
    assert kept == set(groups) and after.count() == len(kept)


def test_rows_that_share_an_id_or_have_none(spark):
    """Rows are decided by their component, not by their id."""
    texts = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(30)]
    own = [(None, t) for t in texts] + [(None, texts[0]), (None, None), (None, "")]
    own += [(1, "alpha beta gamma delta epsilon"), (5, "ALPHA beta gamma delta epsilon"), (5, "nothing else has these words"), (5, "nothing else has these words")]
    docs = spark.createDataFrame(own, "doc_id long, text string").withColumn("row", F.lit("x"))
    fps = [plain_simhash(t) for _, t in own]
    # Components by index: no two rows have one "id".
    groups = plain_components([(k, t) for k, (_, t) in enumerate(own)], fps)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()]
    assert len(got) == len(set(groups))
    assert sorted(groups[own.index(r)] for r in got) == sorted(set(groups))
    assert {t for i, t in got if i is None and t} == set(texts)
    assert sorted(r for r in got if r[0]) == [(1, "alpha beta gamma delta epsilon"), (5, "nothing else has these words")]


def test_contaminated_documents_go(spark, stages):
    before, after = stages["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    expected = [(i, t) for i, t in rows(before) if not plain_hits(t, items)[1]]
    assert sorted(map(repr, rows(after))) == sorted(map(repr, expected))


def test_encoding(stages):
    import hashlib

    import sentencepiece

    before, after = stages["sentencepiece_encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = {r.doc_id: r for r in after.collect()}
    for i, t in rows(before):
        ids = library.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_run(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert 0 < corpus_pipeline.run(spark, DATA).count() < 200


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = c.sql(SQL[name])
    assert sorted(expected.columns) == columns
    expected = c.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]}) q").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, expected))
