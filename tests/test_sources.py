"""Readers, writers, casts, comparison."""

from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pytest

from quillframe.config import Options
from quillframe.functions import casts
from quillframe.operators.frame import Frame
from quillframe.sources import Reader, Writer, equal_groups, equal_records, equal_structs, read_columns, read_csv, read_dataclasses, read_json, read_matrix, read_parquet, read_records, read_series, to_dataclasses, to_json, to_records, to_rows, write_csv, write_mock_csv, write_parquet
from quillframe.sources.writers import equal_frames


def test_records(spark):
    f = read_records(spark, [["a", "b"], ["1", "x"], ["2", "(null)"]], label_levels=1)
    assert f.rows() == [("1", "x"), ("2", None)] and to_records(f) == [["a", "b"], ["1", "x"], ["2", "(null)"]]
    assert to_records(f, labels=False, by_column=True) == [["b", "x", "(null)"]] and to_rows(f)[2] == ["2", None]
    by = read_records(spark, [["a", "1", "2"], ["b", "x", "y"]], by_column=True)
    assert by.list_col_names() == ["a", "b"] and by.rows(False) == [("1", "x"), ("2", "y")]
    two = read_records(spark, [["", "p", "p"], ["k", "q", "r"], ["1", "2", "3"]], header_rows=2, label_levels=1)
    assert two.list_col_names() == ["p|q", "p|r"] and two.list_label_names() == ["k"] and to_records(two)[0] == ["", "p", "p"]
    none = read_records(spark, [["1", "2"]], header_rows=0)
    assert none.list_col_names() == ["0", "1"]
    assert read_records(spark, [["a"], [""]], blank_as_null=True).rows(False) == [(None,)] and read_records(spark, [["a"], [""]]).rows(False) == [("",)]
    with pytest.raises(ValueError):
        read_records(spark, [["a", "b"], ["1"]])


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("name,score\nfoo,1\nbar,\n")
    f = read_csv(spark, str(p), infer_types=True)
    assert f.rows() == [(0, "foo", 1.0), (1, "bar", None)]
    assert read_csv(spark, str(p)).rows(False) == [("foo", "1"), ("bar", "")] and read_csv(spark, str(p), blank_as_null=True).rows(False)[1] == ("bar", None)
    (tmp_path / "bad.csv").write_text("a,b\n1\n2,3\n")
    with pytest.raises(Exception, match="another length"):
        read_csv(spark, str(tmp_path / "bad.csv")).rows()
    (tmp_path / "semi.csv").write_text("# no\na; b\n1; 2\n")
    assert read_csv(spark, str(tmp_path / "semi.csv"), separator=";", comment="#", trim=True).rows(False) == [("1", "2")]
    write_csv(f, str(tmp_path / "out"), labels=False)
    assert read_csv(spark, str(tmp_path / "out")).rows(False) == [("foo", "1"), ("bar", "(null)"[:0] or None)]


def test_json_and_parquet(spark, tmp_path):
    f = read_columns(spark, {"k": [1, 2], "d": [1.5, None], "t": [datetime(2020, 1, 1), None], "a": [["x"], ["y", "z"]], "s": ['q"', "é"]}, 1, "n")
    assert equal_frames(read_json(spark, to_json(f)), f)
    write_parquet(f, str(tmp_path / "p"))
    assert read_parquet(spark, str(tmp_path / "p"), ["k"], ["k"]).rows() == f.rows()


@dataclass
class Row:
    name: str
    score: int


def test_dataclasses(spark):
    items = [Row("a", 1), Row("b", 2)]
    f = read_dataclasses(spark, items, [[False, False], [False, True]])
    assert f.rows(False) == [("a", 1), ("b", None)]
    assert to_dataclasses(f, Row) == ([Row("a", 1), Row("b", 0)], [[False, False], [False, True]])
    assert equal_structs(read_dataclasses(spark, items), items) == (True, "") and not equal_structs(f, items)[0]
    with pytest.raises(TypeError):
        to_dataclasses(read_dataclasses(spark, items).cast({"score": casts.FLOAT}), Row)
    with pytest.raises(ValueError):
        to_dataclasses(f.with_col("x", [1, 2]), Row, strict=True)


def test_matrix(spark):
    assert read_matrix(spark, np.array([[1, 2], [3, np.nan]])).rows(False) == [(1.0, 2.0), (3.0, None)]


def test_equal_records(spark):
    f = read_columns(spark, {"a": [1, 2]}, 0)
    assert equal_records(f, "a\n1\n2\n", labels=False) == (True, [])
    assert equal_records(f, "a\n1\n3\n", labels=False) == (False, [(2, 0, "2", "3")])


def test_casts(spark):
    f = read_columns(spark, {"s": ["1", " 5", "1d", "x", "1e3", "NaN", "2020-01-02", "2020-01-02 03:00:00"]}, 0)
    assert f.cast({"s": casts.FLOAT})["s"].get_values() == [1.0, None, None, None, 1000.0, None, None, None]
    assert f.cast({"s": casts.DATETIME})["s"].get_values()[6:] == [datetime(2020, 1, 2), datetime(2020, 1, 2, 3)]
    assert f.cast({"s": casts.DATE})["s"].get_values()[7] == date(2020, 1, 2)
    g = read_columns(spark, {"d": [2018.0, 0.5], "b": [True, False], "t": [datetime(2020, 1, 1, 5), None]}, 0)
    assert g.cast({"d": casts.STRING})["d"].get_values() == ["2018", "0.5"] and g["b"].get_values_as_float() == [1.0, 0.0]
    assert g["t"].get_values_as_string() == ["2020-01-01T05:00:00Z", None] and g["t"].get_values_as_float() == [None, None]
    assert g["t"].get_nulls() == [False, True]
    with pytest.raises(ValueError):
        g.cast({"d": "nope"})


def test_inference():
    assert [casts.infer([x]) for x in ("1.5", "foo", "2020-01-01 03:00:00 +0000 UTC", "2020-01-01", "1:00pm")] == ["float", "string", "datetime", "date", "time"]
    assert casts.infer(["1", "2", "x"]) == "float" and casts.infer([]) == "string"


def test_mock(spark, tmp_path):
    write_mock_csv(spark, "foo,bar\n10,fred\n100,corge\n", str(tmp_path / "m"), 50)
    f = read_csv(spark, str(tmp_path / "m"), blank_as_null=True, infer_types=True)
    assert len(f) == 50 and f.kind("foo").simpleString() == "double" and f.kind("bar").simpleString() == "string"


def test_default_time_formats(spark):
    texts = ["2020-01-02", "01-02-2020", "01/02/2020", "1/2/20", "2020-01-02 15:04:05 -0700 MST", "3:04pm", "2020-01-02T15:04:05+07:00", "2020-01-02T15:04:05.123Z", "02 Jan 95 15:04 UTC", "nope", None]
    d = datetime(2020, 1, 2)
    want = [d, d, d, d, datetime(2020, 1, 2, 22, 4, 5), datetime(1970, 1, 1, 15, 4), datetime(2020, 1, 2, 8, 4, 5), datetime(2020, 1, 2, 15, 4, 5, 123000), datetime(1995, 1, 2, 15, 4), None, None]
    assert read_columns(spark, {"t": texts}, 0).cast({"t": casts.DATETIME}).rows(False) == [(x,) for x in want]
    assert [casts.infer([t]) for t in texts[:-1]] == ["date"] * 4 + ["datetime", "time"] + ["datetime"] * 3 + ["string"]


def test_warnings_can_be_switched_on(spark):
    on = Options(warnings=True)
    with pytest.warns(UserWarning, match="1 values of 'a'"):
        read_columns(spark, {"a": ["1", "x"]}, 0, options=on).cast({"a": casts.FLOAT})


def test_protocols_and_series(spark):
    class Two:
        def read(self, spark):
            return read_columns(spark, {"a": [1, 2]}, 0)

    kept = []

    class Keep:
        def write(self, frame):
            kept.append(frame.rows(False))

    f = Frame.read(spark, Two())
    f.write(Keep())
    assert kept == [[(1,), (2,)]] and f.write(Writer(to_records, labels=False)) == [["a"], ["1"], ["2"]]
    assert equal_frames(Frame.read(spark, Reader(read_json, f.write(Writer(to_json)))), f)
    s = read_series(spark, [1.5, None], {"k": ["x", "y"]}, "v")
    assert s.rows() == [("x", 1.5), ("y", None)] and s.name == "v" and read_series(spark, [1]).get_labels() == [[0]]
    assert f.unpack_ids("a") == f.unpack_ids() == f.ids(False)


def test_equal_groups(spark):
    a, b = (read_columns(spark, {"k": ["x", "y", "x"], "v": [1, 2, w]}, 1) for w in (3, 4))
    assert equal_groups(a.group_by(), a.group_by()) and not equal_groups(a.group_by(), b.group_by())
