"""Registered intervals take the draws of the reference, in the code and in their SQL."""

import inspect

from pyspark.sql import functions as F

import __spark_entry__ as entry
from hourgrain.operators import resampling as B
from hourgrain.plans import q_scores, q_studies


def asked(monkeypatch, module, operator, query):
    """The arguments with which a query calls an operator."""
    signature, seen = inspect.signature(getattr(module, operator)), []
    monkeypatch.setattr(module, operator, lambda *a, **k: seen.append(signature.bind(*a, **k)))
    for plans in {q_scores, inspect.getmodule(query.__wrapped__)}:
        monkeypatch.setattr(plans, "events", lambda t: None)
        monkeypatch.setattr(plans, "rounded", lambda df, *skip: df)
    query.__wrapped__(None)
    seen[0].apply_defaults()
    return seen[0].arguments


def test_budget_interval_takes_all_draws(monkeypatch):
    assert asked(monkeypatch, q_scores.B, "budget_interval", q_scores.budget_interval)["draws"] == 1000
    assert "range(1000)" in entry.oracle_sql()["bst06_budget_interval"]


def test_month_contrast_interval_takes_all_draws(monkeypatch):
    assert asked(monkeypatch, q_scores.B, "selection_contrast_interval", q_scores.month_contrast_interval)["draws"] == 1000
    assert "range(1000)" in entry.oracle_sql()["bst08_month_contrast_interval"]


def test_month_selection_takes_all_draws(monkeypatch):
    assert asked(monkeypatch, q_studies.ST, "month_selection", q_studies.month_selection)["draws"] == 1000
    assert entry.oracle_sql()["pip07_month_selection"].count("range(1000)") == 2


def test_model_benchmark_takes_all_draws(monkeypatch):
    monkeypatch.setattr(q_studies, "benchmark_rows", lambda t: None)
    monkeypatch.setattr(q_studies, "feature_column", lambda *a: None)
    monkeypatch.setattr(q_studies, "out", lambda *a, **k: None)
    assert asked(monkeypatch, q_studies.ST, "model_benchmark", q_studies.model_benchmark)["draws"] == 1000


def test_ends_of_intervals_round_as_in_sql(spark):
    """The 97.5 percentile of 1,000 draws is 37.9993505, which a weighted mean of the two draws around it misses by one place."""
    value = F.when(F.col("id") < 975, 37.99894).otherwise(38.015359999999994)
    draws = spark.range(1010).select(F.lit("a").alias("site"), F.when(F.col("id") < 1000, value).alias("v"), F.lit(None).cast("double").alias("none"))
    got = B.interval(draws, ["site"], ["v", "none"]).first()
    assert round(got.v_hi95, 9) == 37.9993505 and draws.sparkSession.createDataFrame([(got.v_hi95,)], "x double").select(F.round("x", 6)).first()[0] == 37.999351
    assert (got.v_lo95, got.v_valid_draws, got.none_lo95, got.none_valid_draws) == (37.99894, 1000, None, 0)
