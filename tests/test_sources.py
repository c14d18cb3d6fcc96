"""CSV encodings, errors and report sinks."""

import pytest

from tabulyze.sources.csv_files import detect_encoding, read_csv
from tabulyze.sources.sinks import write_report

TEXT = "name,price\ncafé,1.5\nthé,2\n"


@pytest.mark.parametrize("encoding, found", [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("latin-1", "ISO-8859-1")])
def test_encodings(spark, tmp_path, encoding, found):
    path = tmp_path / "t.csv"
    path.write_bytes(TEXT.encode(encoding))
    assert detect_encoding(spark, str(path)) == found
    df = read_csv(spark, str(path))
    assert df.columns == ["name", "price"]
    assert [tuple(r) for r in df.collect()] == [("café", 1.5), ("thé", 2.0)]


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"x ""y"", z",1\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).collect()] == [('x "y", z', 1)]


def test_empty_and_absent_files_are_readable_errors(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        read_csv(spark, str(path))
    with pytest.raises(ValueError, match="cannot read"):
        read_csv(spark, str(tmp_path / "absent.csv"))


def test_report_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    paths = write_report({"one": df, "two": df}, str(tmp_path), fmt="json")
    assert [spark.read.json(p).count() for p in paths] == [1, 1]
    with pytest.raises(ValueError):
        write_report({"one": df}, str(tmp_path), fmt="xls")


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect()) == [(1, "x\ny"), (2, "z")]


def test_files_of_a_folder_keep_their_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n,v\ncafé,1\n".encode())
    (tmp_path / "b c.csv").write_bytes("n,v\nthé,2.5\n".encode("latin-1"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect()) == [("café", 1.0), ("thé", 2.5)]
