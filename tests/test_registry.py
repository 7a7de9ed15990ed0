from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart.models import forecast, registry
from tidemart.models.registry import ModelRegistry

FIRST = dt.date(2023, 1, 2)


def daily(spark, y, start=FIRST, key="s"):
    rows = [(key, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def wave(n, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 200 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, n)


def test_models_by_name(spark, tmp_path, monkeypatch):
    models = ModelRegistry(spark, str(tmp_path))
    assert models.current().isEmpty() and models.versions("sales") == []
    with pytest.raises(KeyError):
        models.load("sales")
    old, new = (forecast.fit(daily(spark, wave(80, s))) for s in (1, 2))
    assert models.save("sales", "forecast", old) == 1 and models.save("sales", "forecast", new) == 2
    ahead = lambda m: [tuple(r) for r in forecast.forecast(m, 5).orderBy("ds").collect()]
    assert ahead(models.load("sales")) == ahead(new) and ahead(models.load("sales", 1)) == ahead(old)
    with pytest.raises(KeyError):
        models.save("sales", "oracle", new)
    with pytest.raises(KeyError):
        models.load("sales", 3)

    def fails(model, path):
        model.write.parquet(path)
        raise RuntimeError("crash")

    monkeypatch.setitem(registry.KINDS, "forecast", (fails, forecast.load))
    with pytest.raises(RuntimeError):
        models.save("sales", "forecast", old)
    assert models.versions("sales") == [1, 2] and ahead(models.load("sales")) == ahead(new)
    assert [(r.name, r.version, r.kind) for r in models.current().collect()] == [("sales", 2, "forecast")]


def test_a_known_holiday_effect_is_recovered(spark):
    y = wave(200)
    dates = [FIRST + dt.timedelta(days=i) for i in range(230)]
    fair, sale = [20, 61, 103, 150, 170, 211], [35, 90, 133, 160, 215]
    for i in fair:
        if i < 200:
            y[i] += 90
    for i in sale:
        if i < 200:
            y[i] -= 60
    rows = [(dates[i], "fair") for i in fair] + [(dates[i], "sale") for i in sale] + [(dates[35], "zzz twice")]
    holidays = spark.createDataFrame(rows, "date date, holiday string")
    series = daily(spark, y)
    models = forecast.fit(series, holidays)
    row = models.first()
    effects = dict(zip(row.holidays, row.holiday_effects))
    assert set(effects) == {"fair", "sale"}
    assert abs(effects["fair"] - 90) < 3 and abs(effects["sale"] + 60) < 3
    plain = forecast.fit(series).first()
    assert row.resid_std < plain.resid_std / 3
    on, off = ({r.ds: r.value for r in forecast.forecast(models, 30, holidays=h).collect()} for h in (holidays, None))
    for i in range(200, 230):
        wanted = effects["fair"] if i in fair else effects["sale"] if i in sale else 0
        assert abs(on[dates[i]] - off[dates[i]] - wanted) < 1e-6


def test_without_holidays_nothing_changes(spark):
    series = daily(spark, wave(100))
    elsewhere = spark.createDataFrame([(dt.date(1999, 1, 1),)], "date date")
    a, b = forecast.fit(series).first(), forecast.fit(series, elsewhere).first()
    assert a == b and a.holidays == [] and a.holiday_effects == []
    ahead = [[tuple(r) for r in forecast.forecast(forecast.fit(series), 9, holidays=h).orderBy("ds").collect()] for h in (None, elsewhere)]
    assert ahead[0] == ahead[1]
    state = forecast.smooth(wave(60))
    assert np.allclose(forecast.project(state, 5), forecast.project(state, 5, np.zeros((5, 0))))


def test_a_holiday_in_the_held_out_days_only(spark):
    day = FIRST + dt.timedelta(days=95)
    models = forecast.fit(daily(spark, wave(100)), spark.createDataFrame([(day,)], "date date"))
    assert models.select(F.size("holidays")).first()[0] == 1 and np.isfinite(models.first().mae)
