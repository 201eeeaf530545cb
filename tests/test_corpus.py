import pytest
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.operators import corpus
from corpusloom.sources import files


def papers_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, title string, abstract string, year int")


def test_with_abstract_drops_null_and_empty(spark):
    df = papers_of(spark, [(1, "a", "x", 1), (2, "b", "", 1), (3, "c", None, 1)])
    assert [r["doc_id"] for r in corpus.with_abstract(df).collect()] == [1]


@pytest.mark.parametrize("before,after", [
    ("Good. © 2010 Elsevier\nAll rights", "Good. "), ("A Crown Copyright 2009", "A "),
    ("B Copyright me", "B "), ("C (C) 2010 x", "C "), ("D (c) 2010 x", "D "),
    ("E (C) no year", "E (C) no year"), ("[No abstract available]", ""), ("F from Authors.", "F ."),
])
def test_clean_abstract(spark, before, after):
    df = papers_of(spark, [(1, "t", before, 1)])
    assert corpus.clean_abstract(df).first()["abstract"] == after


def test_text(spark):
    df = papers_of(spark, [(1, "T", "A b", 1), (2, None, "A", 1)])
    assert [r["text"] for r in corpus.with_text(df).orderBy("doc_id").collect()] == ["T A b", "A"]


def test_dense_numbers_follow_the_key(spark):
    keys = [7, -3, 100, 5_000_000_000, 12, 13, 14, 0]
    df = spark.createDataFrame([(k,) for k in keys], "source_row bigint").repartition(3)
    got = {r["source_row"]: r["doc_id"] for r in corpus.with_doc_id(df, "source_row", parts=4).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), start=1)}


def test_first_per_key_with_a_hot_key(spark):
    # one title holds a third of the rows
    df = spark.range(3000).select(
        (F.col("id") % 2).cast("int").alias("source_ord"), F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("title"),
    )
    got = {(r["title"], r["source_ord"], r["doc_id"]) for r in corpus.distinct_by_title(df).collect()}
    best = {}
    for r in df.collect():
        k = (r["source_ord"], r["doc_id"])
        best[r["title"]] = min(best.get(r["title"], k), k)
    assert got == {(t, *k) for t, k in best.items()}


def test_first_per_key_negative_ids(spark):
    df = spark.createDataFrame([(2, -5, "a"), (1, 9, "a"), (1, -9, "a")], "source_ord int, doc_id bigint, title string")
    assert [tuple(r) for r in corpus.distinct_by_title(df).collect()] == [(1, -9, "a")]


def test_merge_sources(spark):
    reviewed = papers_of(spark, [(1, "A", "x", 2000), (2, "B", "", 2001), (3, "C", "z", 2002)])
    recent = papers_of(spark, [(4, "C", "late", 2015), (5, "D", "d1", 2016), (6, "D", "d2", 2017),
                               (7, "E", None, 2018), (8, "F", "f", 2019)])
    wanted = spark.createDataFrame([("C",), ("D",), ("E",), ("Z",)], schema.TITLES)
    got = corpus.merge_sources(reviewed, recent, wanted).orderBy("doc_id").collect()
    assert [(r["source_ord"], r["doc_id"], r["title"]) for r in got] == [(1, 1, "A"), (1, 3, "C"), (2, 5, "D")]
    missing = corpus.match_titles(wanted, recent).filter("doc_id is null").collect()
    assert [r["title"] for r in missing] == ["Z"]


# --- files --------------------------------------------------------------------

def test_reviewed_list_with_banner(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        'Table S1: reviewed papers,,,,\n'
        'Associated search(es),Id,Title,Abstract,Publication year\n'
        '"Fish, Assessment",1,First,"Line one\nline ""two"", three",1999\n'
        'Fish,2,Second,,2001\n', encoding="utf-8")
    rows = files.read_papers_csv(spark, str(tmp_path / "p.csv")).orderBy("source_id").collect()
    assert [(r["labels"], r["title"], r["abstract"], r["year"]) for r in rows] == [
        ("Fish, Assessment", "First", 'Line one\nline "two", three', 1999), ("Fish", "Second", None, 2001)]


def test_recent_files_by_pattern(spark, tmp_path):
    (tmp_path / "a_2014-2019.csv").write_text("Title,Extra,Abstract,Year\nÉtude,x,abs,2015\n", encoding="utf-8")
    (tmp_path / "b_2014-2019.csv").write_text("Title,Extra,Abstract,Year\nB,y,,2016\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("Title,Extra,Abstract,Year\nNo,z,abs,2015\n", encoding="utf-8")
    rows = files.read_papers_glob(spark, str(tmp_path)).orderBy("year").collect()
    assert [(r["title"], r["abstract"], r["year"]) for r in rows] == [("Étude", "abs", 2015), ("B", None, 2016)]


def test_columns_are_picked_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "a_2014-2019.csv").write_text("Title,Abstract,Year\nA,abs,2015\n")
    (tmp_path / "b_2014-2019.csv").write_text("Abstract,Extra, TITLE ,Year\nabs,e,B,2016\n")
    rows = files.read_papers_glob(spark, str(tmp_path)).orderBy("year").collect()
    assert [(r["title"], r["abstract"], r["year"]) for r in rows] == [("A", "abs", 2015), ("B", "abs", 2016)]
    (tmp_path / "c_2014-2019.csv").write_text("Abstract,Year\nabs,2016\n")
    with pytest.raises(Exception, match="no column title"):
        files.read_papers_glob(spark, str(tmp_path)).collect()


def test_first_records_are_skipped_by_position_not_by_content(spark, tmp_path):
    header = "Associated search(es),Id,Title,Abstract,Publication year\n"
    (tmp_path / "a.csv").write_text(
        f'"A banner, with",commas,title,abs,1999\n{header}Fish,1,Title,abs,2001\nFish,2,,,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(f"Banner\n{header}Fish,3,C,abs,2002\n", encoding="utf-8")
    rows = files.read_papers_csv(spark, str(tmp_path)).orderBy("source_id").collect()
    assert [(r["source_id"], r["title"], r["year"]) for r in rows] == [("1", "Title", 2001), ("2", None, None), ("3", "C", 2002)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, '7. Say "hi", \nthere'), (2, None)], schema.TOPIC_NAMES)
    files.write_table(df, str(tmp_path / "names"), "csv")
    back = files.read_csv(spark, str(tmp_path / "names"), schema.TOPIC_NAMES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    wide = schema.gamma_wide(2)
    g = spark.createDataFrame([(1, 0.25, 0.75)], wide)
    files.write_table(g, str(tmp_path / "gamma"))
    assert files.read_papers(spark, str(tmp_path / "gamma"), columns=wide).first() == g.first()


def test_reviewed_files_follow_the_partitions(spark, tmp_path, monkeypatch):
    from verification import queries

    papers = spark.createDataFrame(
        [(i, f"t{i}", "a,\nb", 2000, "x") for i in range(40)],
        "doc_id bigint, title string, abstract string, year int, labels string",
    ).repartition(7)
    monkeypatch.setattr(queries.t, "papers", lambda *_: papers)
    monkeypatch.setattr(queries, "new_folder", lambda *_: str(tmp_path / "csv"))
    assert queries.reviewed_papers_csv(spark, "").count() == 40
    assert len(list((tmp_path / "csv").glob("part-*"))) == 7
