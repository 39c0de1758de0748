"""Every registered query of the library proper against its SQL, and the registry itself."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from corpusmill import plans
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, name):
    assert oracle.same(spark, plans.QUERIES[name], plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = plans.QUERIES[name](spark, oracle.FOLDER)
    assert df.columns and df.count() == spark.read.parquet(f"{oracle.FOLDER}/embeddings.parquet").count()


def test_whole_replies_have_long_answers_of_many_lines(spark):
    answers = [r["answer"] for r in plans.QUERIES["q23_curated_pairs"](spark, oracle.FOLDER).collect()]
    assert max(map(len, answers)) > 1000 and any("\n" in a[60:] for a in answers)


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(plans.QUERIES) <= set(queries)


#: Texts without words, or with white space and marks that a heading drops or that only one engine splits at.
ODD = ["", " \n", None, "　", "\x85 \x85", "?! ...", "a\x0bb c", "　wide space", "x\n# heading\ny", "# \nz", "plain words here", "word \x1c zorbium"]


@pytest.fixture()
def odd(tmp_path, monkeypatch):
    """A folder whose documents have each odd text under ids of every remainder of 7; the other tables are those of the tests."""
    texts = [text for text in ODD for _ in range(8)]
    own = {"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["web", "news"] * (len(texts) // 2), "n_chars": [len(text or "") for text in texts]}
    pq.write_table(pa.table({k: pa.array(v, pa.string() if k in ("text", "lang", "source") else pa.int64()) for k, v in own.items()}), tmp_path / "documents.parquet")
    for table in oracle.TABLES:
        if table != "documents":
            (tmp_path / f"{table}.parquet").symlink_to(f"{oracle.FOLDER}/{table}.parquet")
    monkeypatch.setattr(oracle, "FOLDER", str(tmp_path))


@pytest.mark.parametrize("name", ["q15_doc_title_id_kind", "q16_graph_nodes", "q17_graph_edges", "q44_missing_documents", "q45_node_sources"])
def test_titles_of_odd_texts_equal_sql(spark, odd, name):
    assert oracle.same(spark, plans.QUERIES[name], plans.ORACLE[name])
