"""The registered queries of the training-data operators against their SQL; the others run over their whole tables."""

import os

import pytest

from corpusmill.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert oracle.same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_has_a_row_a_document(spark, name):
    docs = spark.read.parquet(f"{oracle.FOLDER}/documents.parquet")
    got = queries.QUERIES[name](spark, oracle.FOLDER)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_language_is_predicted_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op4_langid"](spark, oracle.FOLDER).filter("held_out").join(docs, "doc_id").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet(f"{oracle.FOLDER}/labels.parquet")
    got = queries.QUERIES["op7_quality"](spark, oracle.FOLDER).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"]], [r["kept"] for r in got if not r["quality"]]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)
