"""Every rule on arguments; none needs a job."""

import math

import pytest

from climekin.plans.spec import Mode, SearchSpec, Weight

make = SearchSpec.make


def test_defaults():
    s = make()
    assert (s.mode, s.k, s.weight, s.report_dist) == (Mode.KNN_CLIM, 1, None, True)
    assert make("sum").weight is Weight.UNIFORM


@pytest.mark.parametrize("bad", [
    {"mode": "nearest"}, {"coord_type": "polar"}, {"k": 0}, {"k": 0.5}, {"k": [1, 2]}, {"k": float("nan")}, {"k": "3"},
    {"weight": "uniform"}, {"theta": 1.0}, {"mode": "all", "k": 2}, {"mode": "count", "k": 2}, {"mode": "sum", "k": 1}, {"mode": "mean", "k": 1},
    {"mode": "all", "weight": "uniform"}, {"mode": "count", "theta": 1.0}, {"mode": "sum", "weight": "gaussian"},
    {"mode": "sum", "theta": 1.0}, {"mode": "sum", "weight": "inverse_clim", "theta": 0}, {"mode": "mean", "weight": "inverse_geog", "theta": -1},
    {"mode": "sum", "weight": "inverse_clim", "theta": "x"}, {"mode": "sum", "weight": "inverse_clim", "theta": float("nan")},
])
def test_rejected(bad):
    with pytest.raises(ValueError):
        make(**bad)


def test_k_is_truncated():
    assert make(k=2.9).k == 2 and make(k=[3]).k == 3


def test_epsilon():
    assert make("sum", weight="inverse_clim").epsilon == 1e-12
    assert make("sum", weight="inverse_geog").epsilon == 1e-6
    assert make("sum", weight="inverse_geog", theta=math.inf).epsilon == 1e-6
    assert make("sum", weight="inverse_geog", theta=2).epsilon == 2


def test_thresholds():
    assert make(max_clim=math.inf).max_clim is None and make(max_geog=float("nan")).max_geog is None
    assert make(max_geog=[5, 6]).max_geog == 5 and make(max_clim=[2]).max_clim == 2
    assert make(max_clim=(1, math.inf)).bands(2) == [1, None]
    assert make(max_clim=-1).nothing and make(max_clim=(1, -math.inf)).nothing and not make(max_clim=0).nothing


def test_arity():
    with pytest.raises(ValueError):
        make().check_arity(2, 3)
    with pytest.raises(ValueError):
        make(max_clim=(1, 2)).check_arity(3, 3)
    make(max_clim=[1]).check_arity(3, 3)


def test_tables(spark):
    import pandas as pd

    from climekin.sources.points import normalise

    for bad in (pd.DataFrame({"x": [1.0]}), pd.DataFrame({"x": [1.0], "y": [1.0]})):
        with pytest.raises(ValueError):
            normalise(bad)
    for bad in ("text", [1, 2], None):
        with pytest.raises(TypeError):
            normalise(bad)
    with pytest.raises(ValueError):
        normalise(pd.DataFrame({"x": [1.0], "y": [1.0], "c": [1.0]}), "id")
