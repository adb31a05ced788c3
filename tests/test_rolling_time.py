"""Windows of time by position: results against brute force over ties, gaps and nulls, and plans that read no window."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_groups import brute_windows, make

HOUR = timedelta(hours=1)


@pytest.fixture(scope="module")
def timed(spark):
    """A rolling hour over the times, the times, and the rows of each row's window."""
    r, d = random.Random(7), datetime(2024, 1, 1)
    t = sorted(d + timedelta(seconds=r.choice([r.randrange(9000), 5000, 20000 + r.randrange(40), 60000 + 600 * r.randrange(9)])) for _ in range(300))
    t[20] = t[299] = None
    windows = [[j for j in range(i, len(t)) if t[i] and t[j] and t[j] - t[i] < HOUR] for i in range(len(t))]
    return make(spark, 0, t=t)["t"].rolling_duration(HOUR), t, windows


def of_each(t, windows, function):
    return [function([t[j] for j in w]) if w else None for w in windows]


def values(s):
    """The values, once the plan is seen to neither copy rows to windows nor gather windows."""
    plan = s._sdf._jdf.queryExecution().analyzed().toString().lower()
    assert not [x for x in ("collect_list", "explode", "rangeframe") if x in plan]
    return s.get_values()


def test_apply_f1(timed):
    r, t, windows = timed
    assert values(r.apply(F.reverse).first()) == brute_windows(t, windows, lambda w: w[::-1])
    few = lambda n: (n > 2) & (n < 60)
    turned = brute_windows(t, windows, lambda w: w[::-1], few)
    kept = r.having_count(few)
    assert values(kept.apply(F.reverse).first()) == brute_windows(turned, windows, lambda w: w[0], few)
    assert len(kept) == sum(few(len(w)) for w in windows) and values(kept.apply(F.reverse).count()) == brute_windows(turned, windows, lambda w: sum(x is not None for x in w) or None, few)


def test_first_f2(timed):
    r, t, windows = timed
    assert values(r.first()) == t == values(r.nth(0))


def test_having_f3(timed):
    r, t, windows = timed
    for kept in (lambda n: n > 2, lambda n: n == 1, lambda n: n > 40, lambda n: n > 1000):
        got = r.having_count(kept)
        assert values(got.last()) == brute_windows(t, windows, lambda w: w[-1], kept) and values(got.nth(1)) == brute_windows(t, windows, lambda w: w[1] if len(w) > 1 else None, kept)


def test_nth_f4(timed):
    r, t, windows = timed
    for n in (1, 5, 70, -2, -70):
        assert values(r.nth(n)) == of_each(t, windows, lambda w: w[n] if -len(w) <= n < len(w) else None)  # noqa: B023


def test_nunique_f5(timed):
    r, t, windows = timed
    assert values(r.nunique()) == of_each(t, windows, lambda w: len(set(w)))
    kept = lambda n: n > 2
    assert values(r.having_count(kept).nunique()) == brute_windows(t, windows, lambda w: len(set(w)), kept)


def test_reduce_f6(timed):
    r, t, windows = timed
    assert values(r.reduce("n", lambda a: F.size(a).cast("long") * 2 + 1)) == of_each(t, windows, lambda w: 2 * len(w) + 1)
    assert values(r.reduce("x", lambda a: F.coalesce(F.get(F.reverse(a), F.size(a) - 3), F.get(a, F.lit(0))))) == of_each(t, windows, lambda w: w[2] if len(w) > 2 else w[0])
    # what reads the whole window still gets it
    assert r.reduce("m", lambda a: F.array_max(F.slice(a, 1, 3))).get_values() == of_each(t, windows, lambda w: max(w[:3]))


def test_earliest_f7(timed):
    r, t, windows = timed
    assert values(r.earliest()) == t


def test_last_f8(timed):
    r, t, windows = timed
    assert values(r.last()) == of_each(t, windows, lambda w: w[-1])


def test_latest_f9(timed):
    r, t, windows = timed
    assert values(r.latest()) == of_each(t, windows, lambda w: w[-1])


def test_count_f11(timed):
    r, t, windows = timed
    assert values(r.count()) == of_each(t, windows, len)
    kept = lambda n: n > 2
    assert values(r.having_count(kept).count()) == brute_windows(t, windows, len, kept)
