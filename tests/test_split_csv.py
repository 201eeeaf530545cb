"""CSV files cut anywhere."""

import csv
import io
import random

import pyarrow as pa
import pytest

from corpusloom.sources import files, split_csv

ROWS = [["banner, with a comma"], ["labels", "title", "abstract", "year"], ["a, b", "two\nlines", 'He said "no"', "1999"],
        ["", "", "", ""], ["c", '"', "x\r\ny\n\nz", "2001"], ["", "\n", '""\n,"', "7"], ["d", "é中" * 5, "plain", "2"],
        ["e", "a long one\n" * 30, "end", "3"]]


def written(path, rows, end="\r\n", blank=""):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes((out.getvalue() + blank).encode())


@pytest.fixture
def cut(spark):
    """Reads with splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def read(size, path, pattern=None):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        return split_csv.records(spark, str(path), pattern)

    yield read
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def parsed(text):
    return next(csv.reader(io.StringIO(text, newline="")), [])


@pytest.mark.parametrize("end,blank", [("\r\n", ""), ("\n", "\n\n")])
def test_records_of_files_cut_anywhere(spark, cut, tmp_path, end, blank):
    written(tmp_path / "a.csv", ROWS, end, blank)
    written(tmp_path / "b.csv", ROWS[::-1], end, blank)
    (tmp_path / "empty.csv").write_bytes(b"")
    want = {"a.csv": ROWS, "b.csv": ROWS[::-1]}
    for size in (17, 10_000):
        frame = cut(size, tmp_path)
        if size == 17:
            assert frame.select("text").rdd.getNumPartitions() > 20  # many tasks to a file
        rows = frame.orderBy("source_row").collect()
        assert len({r.source_row for r in rows}) == len(rows)
        for name, expected in want.items():
            own = [r for r in rows if r.source_file.endswith(name)]
            assert [r.place for r in own] == list(range(len(expected))), size
            assert [parsed(r.text) for r in own] == [[f.replace("\r\n", "\n") for f in x] for x in expected], size


def test_every_byte_offset(tmp_path):
    """The steps of a split by hand, for two cuts at any places of a file."""
    written(tmp_path / "a.csv", ROWS)
    data = (tmp_path / "a.csv").read_bytes()
    rng = random.Random(3)
    for first in range(1, len(data)):
        edges = [0, first, min(first + rng.randint(0, 40), len(data))]
        lines, at = [], 0
        for line in data.removesuffix(b"\n").split(b"\n"):
            lines.append(("f", max(e for e in edges if e <= at), line.decode()))
            at += len(line) + 1

        def batch(rows, *more):
            names = ["file", "split", "value", "inside", "before"][: 3 + len(more)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

        starts, quotes, before = {}, 0, 0
        for r in (r for b in split_csv._counted([batch(lines[:3]), batch(lines[3:])]) for r in b.to_pylist()):
            starts[r["split"]] = (quotes % 2 == 1, before)
            before += r["odd"] if quotes % 2 else r["even"]
            quotes += r["quotes"]
        dealt = [(*x, *starts[x[1]]) for x in lines]
        out = [r for b in split_csv._cut([batch(dealt[:5], 1, 1), batch(dealt[5:], 1, 1)]) for r in b.to_pylist()]
        found, place = {}, None
        for r in sorted(out, key=lambda r: (r["split"], -r["kind"] if r["kind"] == split_csv.FIRST else 0, r["place"] or 0)):
            place = place if r["kind"] == split_csv.FIRST else r["place"]
            found.setdefault(place, []).append(r["text"])
        assert [parsed("\n".join(found[p]).removesuffix("\r")) for p in sorted(found)] == ROWS, first


def test_random_files_equal_the_reader_of_whole_files(spark, cut, tmp_path):
    rng = random.Random(8)
    rows = [["".join(rng.choices('ab,"\n\r é', k=rng.randint(0, 9))).replace("\r", "\r\n") for _ in range(3)] for _ in range(60)]
    rows = [["x" + r[0], *r[1:]] for r in rows]
    written(tmp_path / "r.csv", rows)
    whole = spark.read.schema("a string, b string, c string").options(**files._CSV).csv(str(tmp_path))
    want = [tuple(r) for r in whole.collect()]
    for size in rng.sample(range(20, 400), 2):
        cut(size, tmp_path)
        got = files.numbered_records(spark, str(tmp_path), 3).orderBy("source_row").collect()
        assert [tuple(r.cells) for r in got] == want, size


def test_quotes_inside_unquoted_fields_stop_the_query(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,5" pipe,b\nc,d,e\n')
    with pytest.raises(Exception, match="unquoted field"):
        split_csv.records(spark, str(tmp_path)).collect()


def test_workers_hold_a_slice_of_a_batch(monkeypatch):
    """Python objects of LINES lines live at a time; state goes on from slice to slice."""
    monkeypatch.setattr(split_csv, "LINES", 2)
    lines = ['"a","1"', '"b', 'c","2"', '"d","3"', '"e","4"']
    counted = pa.RecordBatch.from_pydict({"file": ["f"] * 5, "split": [0] * 5, "value": lines})
    assert [b.to_pylist() for b in split_csv._counted([counted])] == [
        [{"file": "f", "split": 0, "quotes": 16, "even": 4, "odd": 1}]]
    begins = pa.array([False] * 5)
    given = pa.RecordBatch.from_arrays([*counted.columns, begins, pa.array([7] * 5)], ["file", "split", "value", "inside", "before"])
    cut = list(split_csv._cut([given]))
    assert max(b.num_rows for b in cut) <= 2
    assert [(r["place"], r["text"]) for b in cut for r in b.to_pylist()] == [
        (7, lines[0]), (8, '"b\nc","2"'), (9, lines[3]), (10, lines[4])]
