"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry_module
from corpusloom.operators import distances, models, ranking, terms
from verification import tables

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def raw(spark):
    """Documents as a plain scan, not redistributed."""
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_document_statistics_need_no_shuffle(raw):
    words = terms.with_words(raw, ["the"], stem=False)
    for df in (terms.doc_terms(words), terms.collocations(terms.doc_terms(words), 3), terms.term_counts(words)):
        text = plan(df)
        assert "Exchange" not in text and "Join" not in text
        assert text.count("regexp_extract_all(") == 1


@pytest.mark.parametrize("name", ["unigram_vocab", "bigram_collocations", "doc_topics", "topic_generality",
                                  "topic_doc_dissimilarity", "popularity_by_period_b", "token_counts"])
def test_text_is_tokenised_once(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("regexp_extract_all(") == 1


def test_python_runs_only_for_stems(spark):
    assert "Python" not in plan(QUERIES["bigram_collocations"](spark, SF))
    assert plan(QUERIES["stemmed_vocab"](spark, SF)).count("ArrowEvalPython") == 1


def test_unused_columns_are_not_computed(raw):
    per_doc = terms.doc_terms(terms.with_words(raw, ["the"], stem=False))
    assert "w3" not in plan(terms.unigrams(per_doc))


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["pubs_per_year"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_top_n_is_cut_before_the_shuffle(spark):
    text = plan(ranking.top_docs(models.long_gamma(tables.mixtures(spark, SF, 4)), 20))
    assert text.count("WindowGroupLimit") == 2


def test_pair_sums_are_preaggregated(spark):
    text = plan(distances.bray_curtis(tables.mixtures(spark, SF, 4)))
    assert "partial_sum" in text


def test_pairs_of_topics_are_formed_once(spark):
    text = plan(distances.bray_curtis(tables.mixtures(spark, SF, 4)))
    assert text.count("Generate ") == 2  # the documents' counts and the pairs


def test_label_combinations_need_one_scan(spark):
    text = plan(QUERIES["label_combos"](spark, SF))
    assert text.count("FileScan") == 1 and "Join" not in text
