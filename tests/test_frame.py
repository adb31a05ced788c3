"""Frames: names, projection, rows, nulls, order."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions import casts
from quillframe.operators.frame import Frame, NullFiller, Sorter, concat_series, make_multi_level_labels, opaque, unique_names
from quillframe.sources import read_columns, read_records, read_rows


def make(spark, labels=1, **columns):
    return read_columns(spark, columns, labels)


def test_names_and_getters(spark):
    f = make(spark, a=[1, 2], b=[1.5, None], c=["x", "y"]).set_name("t")
    assert (f.list_label_names(), f.list_col_names(), len(f), f.num_columns, f.num_levels) == (["a"], ["b", "c"], 2, 2, 1)
    assert f.has_type("double") == ([], [0]) and f.index_of("c") == 1 and f.index_of("z") == -1
    assert f.at(1, 1) == "y" and f.at(5, 0) is None and f.at(0, 9) is None
    assert f.get_labels() == [[1, 2]] and f.name_of_col(1) == "c" and f.name_of_col(7) == "-out of range-"
    assert f.select(f.ids(False)[1]).list_col_names() == ["c"]
    with pytest.raises(KeyError):
        f.has_cols("nope")
    with pytest.raises(ValueError):
        f.set_col_names(["only one"])
    assert "(null)" in str(f) and "name: t" in str(f)


def test_unique_names():
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert unique_names(["a", "a_1", "a"]) == ["a", "a_1", "a_2"]
    assert make_multi_level_labels([["a", "b"], [1, 2]]) == [["a", "a", "b", "b"], [1, 2, 1, 2]]


def test_projection(spark):
    f = make(spark, 2, a=[1, 2], b=["p", "q"], c=[1.0, 2.0], d=[3.0, 4.0])
    assert f.select("d").rows() == [(1, "p", 3.0), (2, "q", 4.0)]
    assert f.swap_labels("a", "b").rows()[0] == ("p", 1, 1.0, 3.0)
    assert f.reorder_cols(["d", "c"]).rows()[1] == (2, "q", 4.0, 2.0)
    assert f.subset_cols([1]).list_col_names() == ["d"] and f.subset_labels([1]).list_label_names() == ["b"]
    assert f.filter_cols(lambda n: n == "c").list_col_names() == ["c"]
    assert f.drop_col("c").drop_labels("a").rows() == [("p", 3.0), ("q", 4.0)]
    assert f.with_col("c", "e").list_col_names() == ["e", "d"]
    assert f.with_col("s", lambda c: c["c"] + c["d"]).select("s").rows(False) == [(4.0,), (6.0,)]
    assert f.with_col("v", [7, 8]).select("v").rows(False) == [(7,), (8,)]
    with pytest.raises(ValueError):
        f.with_col("v", [7])
    with pytest.raises(ValueError):
        f.select("c").drop_col("c")
    assert f.set_as_labels("c").list_label_names() == ["a", "b", "c"]
    g = f.reset_labels()
    assert g.list_col_names() == ["c", "d", "a", "b"] and g.get_labels() == [[0, 1]]
    assert f.relabel().get_labels() == [[0, 1]]


def test_rows(spark):
    f = make(spark, a=[0, 1, 2, 3], b=["w", "x", "y", "z"])
    assert f.subset([3, 0, 3]).rows() == [(3, "z"), (0, "w"), (3, "z")]
    assert f.head(2).rows() == [(0, "w"), (1, "x")] and f.tail(2).rows() == [(2, "y"), (3, "z")] and len(f.head(9)) == 4
    assert f.range(1, 3).rows() == [(1, "x"), (2, "y")] and f.drop_row(1).rows() == [(0, "w"), (2, "y"), (3, "z")]
    with pytest.raises(IndexError):
        f.range(1, 9)
    with pytest.raises(IndexError):
        f.subset([4])
    assert sorted(f.shuffle(3).rows()) == f.rows() and f.shuffle(3).rows() == f.shuffle(3).rows()


def test_filters(spark):
    f = make(spark, qux=[0, 1, 2], v=["foo", "bar", "baz"])
    tests = {"qux": lambda c: c > 1, "v": lambda c: c.contains("ba")}
    assert f.filter(tests).rows() == [(2, "baz")] and f.filter({}) is f
    assert f.filter({"v": opaque(lambda s: s.str.startswith("b"))}).rows() == [(1, "bar"), (2, "baz")]
    assert f.filter_index("qux", lambda c: c > 0) == [1, 2]
    assert f.filter_by_value({"qux": "1"}).rows() == [(1, "bar")] and f.filter_by_value({"qux": 1.0, "v": "foo"}).rows() == []
    assert f.where(tests, "yes", "0").get_values() == ["0", "0", "yes"]
    assert f.where({"qux": lambda c: c > 1}, "yes", 0).get_values() == ["0", "0", "yes"]
    g = make(spark, qux=[0, 1], v=[None, "bar"])
    assert g.where({"v": lambda c: c == "bar"}, 1, 0).get_values() == [None, 1]
    assert f["v"].filter(lambda c: c == "foo").get_values() == ["foo"]


def test_nulls(spark):
    f = make(spark, label=[0, 1, 2], a=[None, 1.0, 2.0], b=["foo", None, "bar"])
    assert f.drop_null().rows() == [(2, 2.0, "bar")] and [r[0] for r in f.drop_null("a").rows()] == [1, 2]
    assert [r[0] for r in f.is_null().rows()] == [0, 1] and [r[0] for r in f.is_null("b").rows()] == [1]
    s = make(spark, l=[0, 1, 2, 3, 4], v=[None, 1, None, 2, None])["v"]
    fill = lambda **k: s.fill_null(NullFiller(**k)).get_values()
    assert fill(forward=True) == [0, 1, 1, 2, 2] and fill(backward=True) == [1, 1, 2, 2, 0]
    assert fill(zero=True) == [0, 1, 0, 2, 0] and fill() == [0.0, 1.0, 0.0, 2.0, 0.0] and fill(value=9.0)[0] == 9.0
    assert f.set_nulls("b", [True, False, False])["b"].get_values() == [None, None, "bar"]


def test_nan_sentinels_and_empty_arrays(spark):
    f = read_columns(spark, {"d": [0.0, float("nan")], "s": ["", "(null)"], "a": [["x"], []]}, 0)
    assert f.rows(False) == [(0.0, "", ["x"]), (None, None, None)]


def test_sort(spark):
    f = make(spark, 0, foo=[10.0, 2.0, 2.0, 1.0], bar=["d", "b", "c", "a"])
    assert f.sort(Sorter("foo", casts.FLOAT), Sorter("bar", descending=True))["bar"].get_values() == ["a", "c", "b", "d"]
    assert f.sort("foo")["bar"].get_values() == ["a", "d", "b", "c"]  # as text
    g = make(spark, 0, v=[None, 1.0, 3.0, 1.0], k=[0, 1, 2, 3])
    assert g.sort(Sorter("v", casts.FLOAT, True))["k"].get_values() == [2, 1, 3, 0]  # stable, null last
    with pytest.raises(ValueError):
        f.sort()
    assert f["foo"].sort().get_values() == [1.0, 2.0, 2.0, 10.0]
    assert f.sort(Sorter("bar", descending=True)).relabel().head(1)["bar"].get_values() == ["d"]


def test_append(spark):
    a, b = make(spark, l=[0], v=[1]), make(spark, l=[1], v=["x"])
    assert a.append(b).rows() == [(0, "1"), (1, "x")] and a.append(a).rows() == [(0, 1), (0, 1)]
    with pytest.raises(ValueError):
        a.append(make(spark, 0, v=[1]).with_col("w", [1]))


def test_apply_and_set_rows(spark):
    f = make(spark, 0, v=[1.0, 2.0, None])
    assert f.apply({"v": lambda c: c * 2})["v"].get_values() == [2.0, 4.0, None]
    assert f.apply({"v": opaque(lambda s: s + 1)})["v"].get_values() == [2.0, 3.0, None]
    assert f.set_rows(lambda c: F.lit(9.0), "v", [1])["v"].get_values() == [1.0, 9.0, None]


def test_merge_and_lookup(spark):
    left = make(spark, k=[0, 1], foo=["a", "b"])
    right = make(spark, k=[1], bar=["c"])
    assert left.merge(right).rows() == [(0, "a", None), (1, "b", "c")]
    assert left.merge(right, "right").rows() == [(1, "c", "b")] and left.merge(right, "inner").rows() == [(1, "b", "c")]
    with pytest.raises(ValueError):
        left.merge(make(spark, z=[1], bar=["c"]))
    with pytest.raises(ValueError):
        left.merge(right, "outer")
    a = make(spark, foo=["bar", "baz"], waldo=[1.0, 2.0])
    b = make(spark, foo=["qux", "quux", "bar"], corge=[10.0, 20.0, 30.0])
    assert a.lookup(b).rows() == [("bar", 30.0), ("baz", None)]
    assert a.lookup(b, "right").rows() == [("qux", None), ("quux", None), ("bar", 1.0)]
    c = read_columns(spark, {"a": ["foo", "bar"], "b": [1, 1], "0": [1.0, 2.0]}, 2)
    d = read_columns(spark, {"a": [9, 9], "b": ["qux", "bar"], "0": [4.0, 5.0]}, 2)
    m = c.merge(d, "inner", ["a"], ["b"])
    assert m.list_col_names() == ["0", "0_1"] and m.rows(False) == [(2.0, 5.0)]


def test_first_match_and_null_keys(spark):
    left = make(spark, k=["a", None], v=[1, 2])
    right = make(spark, k=["a", "a", None], w=[10, 20, 30])
    assert left.merge(right).rows() == [("a", 1, 10), (None, 2, 30)]
    assert left.merge(right.sort(Sorter("w", casts.FLOAT, True))).rows()[0] == ("a", 1, 20)
    x = make(spark, k=["1"], v=[5])
    assert x.merge(make(spark, k=[1], w=[6])).rows() == [("1", 5, 6)]  # compared as text


def test_arithmetic(spark):
    a = make(spark, k=[0, 1, 2], v=[6.0, None, 4.0])["v"]
    b = make(spark, k=[0, 1, 3], w=[2.0, 5.0, 1.0])["w"]
    assert a.add(b).get_values() == [8.0, None, None] and a.subtract(b, True).get_values() == [4.0, 5.0, 4.0]
    assert a.multiply(b, True).get_values() == [12.0, 5.0, 4.0] and a.divide(b).get_values() == [3.0, None, None]
    z = make(spark, k=[0], w=[0.0])["w"]
    assert a.divide(z).get_values() == [None, None, None]


def test_concat_series(spark):
    foo = make(spark, l=["a", "b"], foo=[0, 1])["foo"]
    qux = make(spark, l=["a"], qux=[3])["qux"]
    assert concat_series(foo, qux).rows() == [("a", 0, 3), ("b", 1, None)]


def test_in_place(spark):
    m = make(spark, 0, v=[3, 1, 2]).in_place()
    m.filter({"v": lambda c: c > 1}).sort(Sorter("v", casts.FLOAT))
    assert m.result["v"].get_values() == [2, 3]


def test_iteration(spark):
    f = make(spark, l=[0, 1], v=["a", None])
    assert list(f) == [{"l": 0, "v": "a"}, {"l": 1, "v": None}]


def test_from_spark_keeps_order_columns(spark):
    sdf = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "i int, s string")
    f = Frame.from_spark(sdf, ["i"], ["i"])
    assert f.rows() == [(1, "a"), (2, "b"), (3, "c")]
    assert f.cast({"i": casts.STRING}).rows() == [("1", "a"), ("2", "b"), ("3", "c")]


def test_pipeline(spark):
    rows = [["name", "score"], ["joe", ""], ["joe doe", "-100"], ["jane doe", "1000"], ["john doe", "6"], ["jane doe", "8"], ["john doe", "4"], ["jane doe", "10"]]
    f = read_records(spark, rows).cast({"score": casts.FLOAT}).drop_null().filter({"score": lambda c: (c > 0) & (c < 100)}).sort("name")
    out = f.group_by("name").mean("score")
    assert (out.list_label_names(), out.list_col_names()) == (["name"], ["mean_score"]) and out.rows() == [("jane doe", 9.0), ("john doe", 5.0)]


def test_rows_of_values(spark):
    f = read_rows(spark, [["a", "b"], [1, "x"], [2, None]])
    assert f.list_col_names() == ["a", "b"] and f.rows(False) == [(1, "x"), (2, None)]


def test_the_first_error_is_kept(spark):
    f = make(spark, a=[1, 2], b=[3.0, None])
    fine = f.attempt().drop_null("b").sum()
    assert fine.err() is None and fine.result.rows() == [("b", 3.0)]
    bad = f.attempt().head(1).select("z").group_by("a").sum()
    assert isinstance(bad.err(), KeyError) and bad.result.rows() == [(1, 3.0)]
    assert isinstance(f.group_by("a").frame.attempt().group_by("q").err(), KeyError)
