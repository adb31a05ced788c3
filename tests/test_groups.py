"""Groups, rolling windows, analytic operators, reshaping."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions.resample import Resampler
from quillframe.operators import blocks as B
from quillframe.operators.frame import NullFiller, opaque
from quillframe.sources import read_columns


def make(spark, labels=1, **columns):
    return read_columns(spark, columns, labels)


@pytest.fixture(scope="module")
def scores(spark):
    return make(spark, baz=[0, 1, 0, 1, 2], foo=[1.0, 2.0, 3.0, 4.0, None], s=["a", "b", "a", "c", None])


def test_reductions(scores):
    g = scores.group_by("baz")
    assert g.sum("foo").rows() == [(0, 4.0), (1, 6.0), (2, None)] and g.mean("foo").list_col_names() == ["mean_foo"]
    assert g.median("foo").rows()[:2] == [(0, 2.0), (1, 3.0)] and g.std("foo").rows()[:2] == [(0, 1.0), (1, 1.0)]
    assert g.min("foo").rows()[1] == (1, 2.0) and g.max("foo").rows()[1] == (1, 4.0)
    assert g.count().rows() == [(0, 2, 2), (1, 2, 2), (2, None, None)] and g.nunique("s").rows() == [(0, 1), (1, 2), (2, None)]
    assert g.sum("s").rows()[0] == (0, None)  # texts that are no numbers
    assert g.first().rows()[2] == (2, None, None) and g.last("foo").rows()[0] == (0, 3.0)
    assert g.nth(1, "foo").rows() == [(0, 3.0), (1, 4.0), (2, None)] and g.nth(-2, "foo").rows()[0] == (0, 1.0)
    with pytest.raises(KeyError):
        g.sum("nope")


def test_align_and_nulls(spark, scores):
    assert scores["foo"].group_by("baz").mean().rows() == [(0, 2.0), (1, 3.0), (2, None)]
    s = make(spark, k=[0, 0, 1], v=[None, 2.0, 3.0])["v"].group_by().align()
    assert s.first().rows() == [(0, None), (0, None), (1, 3.0)] and s.sum().rows() == [(0, 2.0), (0, 2.0), (1, 3.0)]
    assert s.nth(1).rows() == [(0, 2.0), (0, 2.0), (1, None)]


def test_having_order_and_groups(spark):
    f = make(spark, k=["foo", "bar", "bar", "bar"], v=[1, 2, 3, 4])
    g = f.group_by("k").having_count(lambda n: n > 2)
    assert g.list_groups() == ["bar"] and len(g) == 1 and g.sum().rows() == [("bar", 9.0)]
    assert f.group_by().list_groups() == ["foo", "bar"] and f.group_by().get_group("bar").rows() == [("bar", 2), ("bar", 3), ("bar", 4)]
    assert g.align().sum().rows()[0] == ("foo", None)
    h = make(spark, k=[1, 2, 1], v=["x", "y", "z"]).group_by()
    assert h.to_frame().rows() == [(1, "x"), (1, "z"), (2, "y")] and [x.rows() for x in h] == [[(1, "x"), (1, "z")], [(2, "y")]]
    assert h.get_labels() == [[1, 2]]


def test_null_is_one_group(spark):
    f = make(spark, k=[None, "", None], v=[1, 2, 3])
    assert f.group_by().sum().rows() == [(None, 4.0), ("", 2.0)]


def test_reduce_and_apply(spark, scores):
    g = scores.group_by("baz")
    assert g.reduce("spread", lambda c: F.max(c) - F.min(c), "foo").rows()[:2] == [(0, 2.0), (1, 2.0)]
    assert g.reduce("spread", opaque(lambda v: float(v.max() - v.min())), "foo").rows()[:2] == [(0, 2.0), (1, 2.0)]
    assert g.apply(lambda c, w: c - F.min(c).over(w), "foo").frame["foo"].get_values() == [0.0, 0.0, 2.0, 2.0, None]
    assert g.apply(opaque(lambda v: v.cumsum()), "foo").frame["foo"].get_values() == [1.0, 2.0, 4.0, 6.0, None]


def test_forms_without_a_group_in_one_task(spark):
    f = make(spark, k=["a", "b", "a", "a", None, "b", "c", None], v=[3.0, 1.0, 1.0, 8.0, 5.0, 2.0, None, 7.0])
    g = f.group_by("k")
    assert g.median("v", spread=True).rows() == g.median("v").rows() == [("a", 3.0), ("b", 1.5), (None, 6.0), ("c", None)]
    assert g.align().median("v", spread=True)["median_v"].get_values() == g.align().median("v")["median_v"].get_values()
    less = g.apply(lambda c, of: c - of["low"], "v", of_group={"low": F.min}).frame
    assert less["v"].get_values() == [2.0, 0.0, 0.0, 7.0, 0.0, 1.0, None, 2.0]
    few = g.having_count(lambda n: n > 2).apply(lambda c, of: c - of["low"], "v", of_group={"low": F.min}).frame
    assert few["v"].get_values() == [2.0, 0.0, 7.0]


def test_blocks_are_dealt_once_and_hold_what_is_needed(spark):
    f = make(spark, 1, k=list(range(40)), a=[float(x) for x in range(40)], b=["x"] * 40)["a"]
    b = f._positions()
    assert f._positions() is b and "b" not in [x.name for x in f.fields] and len(b.df.columns) == 6  # label, value, order, block, row, position
    assert f.shift(7).get_values() == [None] * 7 + [float(x) for x in range(33)] and f.shift(-39).get_values() == [39.0] + [None] * 39
    assert f.shift(100).get_values() == [None] * 40 and f.shift(0).get_values() == f.get_values()
    B.FEW, keep = 0, B.FEW  # no broadcasts
    try:
        assert f.shift(7).get_values() == [None] * 7 + [float(x) for x in range(33)]
        assert f.shift(-7).get_values() == [float(x) for x in range(7, 40)] + [None] * 7
        assert f.rank().get_values() == [float(x + 1) for x in range(40)]
    finally:
        B.FEW = keep


def test_frame_reductions(scores):
    assert scores.select("foo").sum().rows() == [("foo", 10.0)] and scores["foo"].std() == pytest.approx(1.118034)
    assert scores["foo"].count() == 4 and scores["s"].nunique() == 3 and scores["s"].value_counts() == {"a": 2, "b": 1, "c": 1}
    assert scores.select("foo").reduce("n", lambda c: F.count(c)).rows() == [("foo", 4)]


def test_unique(spark):
    s = make(spark, qux=[0, 1, 2, 3], foo=[1.0, 1.0, 2.0, 1.0])["foo"]
    assert s.unique().rows() == [(0, 1.0), (2, 2.0)] and len(s.unique(labels=True)) == 4


def test_rolling(spark):
    roll = lambda v, n: make(spark, 0, v=v)["v"].rolling_n(n)
    assert roll([1, 2, 3, 4], 2).sum().get_values() == [3.0, 5.0, 7.0, 7.0]
    assert roll([1.0, None, None, 4.0], 2).sum().get_values() == [1.0, None, 4.0, 4.0]
    assert roll([1, 2, 3], 4).sum().get_values() == [None, None, None]
    assert roll([1, 5, 3, 3], 3).median().get_values() == [3.0, 3.0, 3.0, 3.0] and roll([1, 1, 2], 2).nunique().get_values() == [1, 2, 2]
    r = make(spark, 0, v=[1, None, 3, 4])["v"].rolling_n(2)
    assert r.nth(1).get_values() == [None, 3, 4, 4] and r.nth(-2).get_values() == [1, None, 3, 3] and r.reduce("spread", lambda c, w: F.max(c).over(w) - F.min(c).over(w)).get_values() == [0, 0, 1, 1]
    d = datetime(2020, 1, 1)
    s = make(spark, 0, t=[d, d + timedelta(3), d + timedelta(4), d + timedelta(9)])["t"].rolling_duration(timedelta(5))
    assert s.count().get_values() == [3, 2, 1, 1] and s.latest().get_values()[0] == d + timedelta(4)
    t = make(spark, 0, t=[d, d, d + timedelta(1)])["t"]
    assert t.rolling_duration(timedelta(2)).count().get_values() == [3, 2, 1] and t.rolling_duration(timedelta(0)).count().get_values()[2] == 1
    with pytest.raises(ValueError):
        t.rolling_duration(timedelta(microseconds=-1))


def brute_windows(values, windows, function, having=lambda n: True):
    """Each row's entry of ``function`` of the last window, of those kept, that holds it."""
    out = [None] * len(values)
    for w in windows:
        if w and having(len(w)):
            got = function([values[i] for i in w])
            for place, i in enumerate(w):
                out[i] = got[place] if isinstance(got, list) else got
    return out


def test_rolling_as_groups(spark):
    v, n = [4, 1, None, 7, 2, 9, 9], 3
    rows = [list(range(i, i + n)) if i + n <= len(v) else [] for i in range(len(v))]
    r = make(spark, 0, v=v)["v"].rolling_n(n)
    assert [list(w) for w in r] == [[v[i] for i in w] for w in rows if w] and len(r) == 5
    total = lambda w: float(sum(x for x in w if x is not None))
    assert r.having_count(lambda k: k == 3).sum().get_values() == brute_windows(v, rows, total)
    assert r.having_count(lambda k: k > 3).sum().get_values() == [None] * 7 and list(r.having_count(lambda k: k > 3)) == []
    assert r.reduce("n", opaque(lambda w: float(len(w)))).get_values() == [3.0] * 7
    back = lambda w: w[::-1]
    assert r.apply(F.reverse)._windows().get_values()[0] is not None
    turned = brute_windows(v, rows, back)
    assert r.apply(F.reverse).nth(0).get_values() == [turned[w[0]] if w else turned[4] for w in rows]
    assert r.apply(opaque(lambda s: s.fillna(0) * 2, "double")).sum().get_values()[0] == 10.0

    d = datetime(2020, 1, 1)
    for days, spans in (([0, 3, 4, 9], (5,)), ([0, 0, 1, 1, 1, 5, 6, 6, 7, 20], (2, 30))):
        t = [d + timedelta(k) for k in days]
        for span in spans:
            wins = [[j for j in range(i, len(t)) if t[j] - t[i] < timedelta(span)] for i in range(len(t))]
            r = make(spark, 0, t=t)["t"].rolling_duration(timedelta(span))
            assert r.count().get_values() == [len(w) for w in wins] and r.nunique().get_values() == [len({t[j] for j in w}) for w in wins]
            assert r.nth(1).get_values() == [t[w[1]] if len(w) > 1 else None for w in wins] and r.first().get_values() == t
            assert r.last().get_values() == r.latest().get_values() == [t[w[-1]] for w in wins] and r.earliest().get_values() == t
            kept = lambda n: n >= 2
            assert r.having_count(kept).last().get_values() == brute_windows(t, wins, lambda w: w[-1], kept)
            assert [list(w) for w in r.having_count(kept)] == [[t[j] for j in w] for w in wins if len(w) > 1]
            assert r.reduce("n", F.size).get_values() == [len(w) for w in wins]
            assert r.apply(F.reverse).first().get_values() == brute_windows(t, wins, back) == r.apply(opaque(lambda s: s[::-1], "timestamp_ntz")).nth(0).get_values()


def test_keys_of_several_parts_stay_apart(spark):
    f = make(spark, 2, a=["a|b", "a", "x"], b=["c", "b|c", "y"], v=[1, 2, 3])
    g = f.group_by("a", "b")
    assert g.get_group(("a|b", "c")).rows() == [("a|b", "c", 1)] and g.get_group(("a", "b|c")).rows() == [("a", "b|c", 2)]
    assert g.get_group("x|y").rows() == [("x", "y", 3)] and [x.rows() for x in g] == [[("a|b", "c", 1)], [("a", "b|c", 2)], [("x", "y", 3)]]
    with pytest.raises(ValueError):
        g.get_group("a|b|c")


def test_analytic(spark):
    s = make(spark, 0, v=[3.0, 2.0, None, 4.0, 1.0, 3.0])["v"]
    assert s.rank().get_values() == [3.0, 2.0, None, 4.0, 1.0, 3.0]
    assert make(spark, 0, v=[3.0, 2.0, None])["v"].cumsum().get_values() == [3.0, 5.0, 5.0]
    p = make(spark, 0, v=[1, 2, 3, 4, 5, 6, 7, 8, 10, 9])["v"].percentile().get_values()
    assert p == pytest.approx([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9, 0.8])
    b = make(spark, 0, v=[5, None, 6, 7, 7, 7, 8])["v"].percentile_bin([0, 0.2, 0.4, 0.6, 0.8, 1])
    assert b.get_values() == ["0-0.2", None, "0-0.2", "0.2-0.4", "0.2-0.4", "0.2-0.4", "0.8-1"]
    assert make(spark, 0, v=[1, 2, 3, 4])["v"].bin([1, 2, 3], True, True).get_values() == ["<=1", "1-2", "2-3", ">3"]
    assert s.shift(1).get_values() == [None, 3.0, 2.0, None, 4.0, 1.0] and s.shift(-5).get_values() == [3.0, None, None, None, None, None]
    with pytest.raises(ValueError):
        s.bin([1, 2], names=["a", "b"])
    with pytest.raises(ValueError):
        s.percentile_bin([0, 2])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(v=st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float)), min_size=1, max_size=14), n=st.integers(1, 4))
def test_against_a_model(spark, v, n):
    s = read_columns(spark, {"v": v}, 0, kinds=["double"])["v"]
    some = sorted({x for x in v if x is not None})
    assert s.rank().get_values() == [None if x is None else some.index(x) + 1.0 for x in v]
    total, want = 0.0, []
    for x in v:
        total += x or 0
        want.append(total)
    assert s.cumsum().get_values() == want
    starts = [min(i, len(v) - n) for i in range(len(v))]
    windows = [[x for x in v[i : i + n] if x is not None] for i in starts] if n <= len(v) else [[]] * len(v)
    assert s.rolling_n(n).sum().get_values() == [sum(w) if w else None for w in windows]


def test_pivot_promote_transpose(spark):
    f = make(spark, 0, amount=[1.0, 2.0, 3.0, 4.0], year=[2018.0, 2018.0, 2019.0, 2019.0], type=["A", "B", "B", "B"])
    p = f.pivot_table("type", "year", "amount", "sum")
    assert p.list_col_names() == ["2018", "2019"] and p.rows() == [("A", 1.0, None), ("B", 2.0, 7.0)]
    assert f.pivot_table("type", "year", "amount", "count").rows() == [("A", 1, None), ("B", 1, 2)]
    assert f.pivot_table("type", "year", "amount", "stdDev").rows()[1] == ("B", 0.0, 0.5)
    with pytest.raises(ValueError):
        f.pivot_table("type", "year", "amount", "nope")
    g = make(spark, 2, bar=["A", "B", "B", "C"], year=[2018, 2018, 2019, 2019], foo=[1, 2, 3, 4]).promote_to_col_level("year")
    assert g.list_col_names() == ["2018|foo", "2019|foo"] and g.rows() == [("A", 1, None), ("B", 2, 3), ("C", None, 4)]
    assert g.list_col_names_at_level(0) == ["2018", "2019"] and g.filter_cols(lambda n: n == "2019", 0).list_col_names() == ["2019|foo"]
    t = make(spark, foo=["bar", "baz"], waldo=[1.0, None], fred=[3, 4]).transpose()
    assert t.list_col_names() == ["bar", "baz"] and t.rows() == [("waldo", "1", None), ("fred", "3", "4")]


def test_resample(spark):
    d = datetime(2020, 2, 2, 12, 30, 45)
    s = make(spark, 0, t=[d, None])["t"]
    one = lambda **k: s.resample(Resampler(**k)).get_values()[0]
    assert one(by_year=True) == datetime(2020, 1, 1) and one(by_month=True) == datetime(2020, 2, 1) and one(by_day=True) == datetime(2020, 2, 2)
    assert one(by_week=True) == datetime(2020, 2, 2) and one(by_week=True, start_of_week=1) == datetime(2020, 1, 27)
    assert one(by_duration=timedelta(hours=1)) == datetime(2020, 2, 2, 12) and one(by_duration=timedelta(0)) == d and one() == d
    assert one(by_day=True, time_zone="Pacific/Auckland") == datetime(2020, 2, 3)


def test_fill_backward_reads_a_block_once_f10(spark):
    v = [None, 3.0, None, None, 1.0, None] * 20 + [None]
    f = make(spark, 0, v=v)
    got = f.fill_null({"v": NullFiller(backward=True)})
    assert got["v"].get_values() == [3.0, 3.0, 1.0, 1.0, 1.0, 3.0] * 19 + [3.0, 3.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    # a frame from the row to the end of its block is worked out anew for each row
    assert "unboundedfollowing" not in got._sdf._jdf.queryExecution().analyzed().toString().lower()


def test_large_groups_stay_where_they_are_f12(spark, monkeypatch):
    import quillframe.operators.grouped as G

    k = ["b", None, "a", "b", "b", "c", None, "a", "b", None]
    want = [("b", [0, 3, 4, 8]), (None, [1, 6, 9]), ("a", [2, 7]), ("c", [5])]
    f = make(spark, 1, k=k, v=list(range(10)))
    for most in (0, 2, 3, 100):
        monkeypatch.setattr(G, "LOCAL", most)
        got = list(f.group_by("k"))
        assert [x.rows() for x in got] == [[(key, v) for v in rows] for key, rows in want] and [len(x) for x in got] == [4, 3, 2, 1]
        assert ["LeftSemi" in x._sdf._jdf.queryExecution().analyzed().toString() for x in got] == [len(rows) > most for _, rows in want]
        assert [x.rows() for x in f.group_by("k").having_count(lambda n: n < 3)] == [[("a", 2), ("a", 7)], [("c", 5)]]
        assert [len(x) for x in f.group_by("k").align()] == [2, 4, 1, 3]
