"""Raking against a plain loop, the pipeline against its operators, registered queries."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegate.llm import mixing, queries, toxicity
from tidegate.plans import catalog

from . import samples

SF = "/root/testdata/sf0.001"


def plain_rake(frame, margins, targets, rounds=200):
    weight = np.ones(len(frame))
    for _ in range(rounds):
        for name in margins:
            for value, wanted in targets[name].items():
                some = (frame[name] == value).to_numpy()
                have = (weight[some] * frame.tokens[some]).sum()
                if have > 0:
                    weight[some] *= wanted / have
    return weight


@pytest.mark.parametrize("few", [0, mixing.MOST_BROADCAST])
def test_weights_meet_the_targets(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", few)  # 0: as for more cells than fit one task
    documents = samples.documents(spark)
    found = mixing.mixed(documents, rounds=15).toPandas().sort_values("doc_id").reset_index(drop=True)
    total = found.tokens.sum()
    targets = {}
    for name in mixing.MARGINS:
        share = found.groupby(name).tokens.sum().astype(float) ** mixing.FLATTEN
        targets[name] = (share / share.sum() * total).to_dict()
    expected = plain_rake(found, mixing.MARGINS, targets)
    some = found.tokens > 0
    assert np.allclose(found.weight[some], expected[some], rtol=1e-3)
    cells = found[some].weight
    assert np.allclose(found.probability, np.minimum(1, found.weight / cells.max()), rtol=1e-6)
    assert (found.sampled == (found.probability >= 1) | found.sampled).all()


def test_given_targets_and_budget(spark):
    documents = samples.documents(spark)
    targets = {"source": spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("other", 9.0)], "value string, weight double")}
    found = mixing.mixed(documents, ("source",), targets, budget=4000).toPandas()
    expected = (found.probability * found.tokens).groupby(found.source).sum()
    assert np.isclose(expected["s0"] / expected["s1"], 3.0, rtol=1e-3) and np.isclose(expected.sum(), 4000, rtol=1e-3)
    one = {"source": spark.createDataFrame([("s1", 1.0)], "value string, weight double")}
    kept = mixing.mixed(documents, ("source",), one).toPandas()
    assert kept[kept.source == "s0"].probability.max() == 0 and kept[kept.source == "s1"].sampled.all()


def test_draws_follow_the_probabilities(spark):
    rows = spark.range(20_000).selectExpr(
        "id as doc_id", "'some text' as text", "if(id % 4 = 0, 'small', 'large') as source", "'en' as lang"
    )
    found = mixing.mixed(rows, flatten=0.0)
    share = found.groupBy("source").agg(F.avg(F.col("sampled").cast("int")).alias("drawn"), F.max("probability").alias("p"))
    for r in share.collect():
        assert abs(r.drawn - r.p) < 0.02 and np.isclose(r.p, 1.0 if r.source == "small" else 1 / 3, rtol=1e-6)


def test_mixing_of_odd_tables(spark):
    for frame in (samples.odd_rows(spark), samples.documents(spark, extra=True), samples.empty(spark)):
        kept = mixing.sampled(frame)
        assert kept.dtypes == frame.dtypes and kept.count() <= frame.count()
    assert mixing.mixed(samples.odd_rows(spark)).count() == 8


def test_native_operators_run_no_python(spark):
    documents = samples.documents(spark)
    for frame in (queries.sanitise.find_personal(documents), mixing.mixed(documents)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_stages_take_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == columns
        docs = queries.exact_dedup.stored(new, "stage")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= kept and len(ids) == docs.count(), name
        kept = ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == kept


def test_stages_with_no_documents(spark):
    docs = samples.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, SF)
    expected = tables.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = sorted(tuple(r[c] for c in expected.columns) for r in found.collect())
    assert rows == sorted(expected.fetchall())


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14)) and not set(queries.QUERIES) & set(catalog.QUERIES)
    assert toxicity.FOLDS == 5
