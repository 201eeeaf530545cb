"""Every registered query against its SQL, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from corpusloom import constants, session
from corpusloom.stopwords import WORDS

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set memory_limit = '4GB'")
    for table in ("documents", "labels", "benchmark"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def by_name(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in places) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    expected = duck.sql(SQL[name])
    types = {c: TYPES[str(t)] for c, t in zip(expected.columns, expected.types)}
    assert {f.name: f.dataType.simpleString() for f in df.schema} == types
    assert by_name(df.collect(), df.columns) == by_name(expected.fetchall(), expected.columns)


def test_only_model_fits_lack_sql():
    lacking = {n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"}
    assert lacking == {"lda_topics", "lda_topic_terms", "lda_doc_topics", "lda_topic_trend", "lda_research_gap",
                       "topic_count_sweep"}


def test_fitted_study(spark):
    share = QUERIES["lda_doc_topics"](spark, SF).groupBy("doc_id").agg({"gamma": "sum"}).collect()
    assert share and all(abs(r[1] - 1) < 1e-6 for r in share)
    gaps = QUERIES["lda_research_gap"](spark, SF).collect()
    assert len(gaps) == 13 * 12 // 2 and all(0 <= r["gap"] <= 1 for r in gaps)
    trend = QUERIES["lda_topic_trend"](spark, SF).collect()
    assert sorted(r["topic"] for r in trend) == list(range(1, 14))


def test_online_fit(spark):
    """A fit has no SQL: shares add up, rows are those of the matrix, reruns agree."""
    runs = [{(r["doc_id"], r["topic"]): r["gamma"] for r in QUERIES["lda_online_doc_topics"](spark, SF).collect()}
            for _ in range(2)]
    assert runs[0].keys() == runs[1].keys() and all(abs(runs[0][k] - runs[1][k]) < 1e-9 for k in runs[0])
    shares = {}
    for (doc, _), gamma in runs[0].items():
        shares.setdefault(doc, []).append(gamma)
    assert all(len(v) == 13 and abs(sum(v) - 1) < 1e-6 and min(v) >= 0 for v in shares.values())
    matrix = {r["doc_id"] for r in QUERIES["lda_doc_topics"](spark, SF).select("doc_id").distinct().collect()}
    assert set(shares) == matrix
    top = QUERIES["lda_online_topics"](spark, SF).collect()
    assert {r["topic"] for r in top} == set(range(1, 14)) and all(0 < r["beta"] <= 1 for r in top)


def test_import_needs_no_jars_and_no_session():
    code = (
        "import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'\n"
        "import __spark_entry__ as e; from pyspark.sql import SparkSession\n"
        "assert len(e.oracle_sql()) >= 78 and SparkSession.getActiveSession() is None"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry_module.__file__))


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    for language, words in WORDS.items():
        assert set(words) == set(StopWordsRemover.loadDefaultStopWords(language)) - {""}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


def test_fixed_values_written_out():
    """The SQL shares these with the engine, so they are pinned here."""
    edges = {s: [y for y, _ in rows] for s, rows in constants.PERIOD_SCHEMES.items()}
    assert edges == {
        "a": [1975, 1980, 1985, 1990, 1995, 2000, 2005, 2010, 2015, 2021],
        "b": [1976, 1981, 1986, 1991, 1996, 2001, 2006, 2011, 2016, 2021],
        "c": [1994, 1999, 2004, 2009, 2014, 2019],
    }
    assert constants.OPENING_PERIOD_D == (1994, "1981-1994")
    assert constants.DF_BOUNDS == {"reviewed": (8, 203), "combined": (6, 300), "full": (8, 400)}
    assert len(constants.PUBLISHER_WORDS) == 17 and constants.PUBLISHER_WORDS_COMBINED[17:] == ("australia",)
    assert (constants.BIGRAM_T, constants.TRIGRAM_T, constants.ALPHA_TOTAL, constants.DELTA) == (1.6, 1.4, 50.0, 0.1)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["term", "df"] and df.count() > 0
