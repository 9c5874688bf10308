"""Queries whose results are estimates or simulations: no SQL form, tested against second implementations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import candles, garch, positions, sequential
from riskloom.plans import dependence, laboratories, panels, power, rules, studies
from riskloom.plans.risk_queries import _losses
from riskloom.plans.tidy import tidy
from riskloom.sources import adapters

SMALL = panels.PanelSettings(n_days=520, n_coins=4, burn=200)


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return candles.log_returns(adapters.daily(spark, sf))


def garch_fit(spark, sf):
    return tidy(garch.next_day(_returns(spark, sf)), 4)


def garch_forecast(spark, sf):
    return tidy(garch.var_es(garch.walk_forward_forecasts(_returns(spark, sf)), 0.05), 4)


def risk_table(spark, sf):
    return tidy(positions.risk_table(garch.next_day(_returns(spark, sf)).withColumn("sigma", F.col("sigma") / 20)), 4)


def bootstrap_power(spark, sf):
    d = _losses(spark, sf).withColumn("d", F.col("q_a") - F.col("q_b"))
    return tidy(power.criterion_power(spark, power.wide(d, "d"), np.linspace(0, 0.5, 11), 60, 30, 2101))


def power_mde(spark, sf):
    return tidy(power.mde(bootstrap_power(spark, sf), "delta", "power_one"))


def lab_rates(spark, sf):
    study = studies.estimated_study(spark, SMALL, 4, 11, boot=99, names=("oracle_t5", "under30", "ewma94_t5", "garch_tnu", "garch_tnu_under10"))
    return tidy(studies.rates(study), 4)


def lab_comparisons(spark, sf):
    return tidy(studies.dm_rates(studies.comparison_to_dm(studies.comparison_study(spark, panels.PanelSettings(n_days=530, n_coins=4, rho=0.0, burn=200), 6, 5))), 4)


def z2_null(spark, sf):
    null = studies.z2_null(spark, 500, 0.05, 5.0, 1000, 3)
    return tidy(null.agg(F.count(F.lit(1)).alias("n"), F.avg("z2").alias("mean"), F.percentile("z2", F.lit(0.05)).alias("p5")), 4)


def evidence_rates(spark, sf):
    leg = sequential.LEGS[0]
    return tidy(studies.evidence_study(spark, leg, "t3", leg.daily_mu, leg.daily_mu, -1, 1000, 365, 7), 4)


def negative_control(spark, sf):
    d = studies.control_study(spark, 8, 600)
    return tidy(d.groupBy("rule", "peek").agg(F.count(F.lit(1)).alias("seeds"), F.avg("t").alias("mean_t"), F.count_if(F.abs("t") > 1.959964).alias("rejections")), 4)


def panel_pilot(spark, sf):
    return tidy(studies.rates(studies.pilot(spark, panels.PanelSettings(n_days=460, n_coins=3, burn=200, amplitude=0.5, shock_rho=0.3), 4, 9)), 4)


def simulated_panel(spark, sf):
    return tidy(panels.panels(spark, panels.PanelSettings(n_days=30, n_coins=3, burn=50), 3, 1))


def rule_example(spark, sf):
    """Verdicts of the absolute rule on a study's rates, as (code, value, ok, near, verdict) rows."""
    study = studies.estimated_study(spark, SMALL, 4, 11, boot=99, names=("oracle_t5", "under30", "ewma94_t5", "garch_tnu", "garch_tnu_under10"))
    r = {(x.cell, x.forecast, x.stat): (x["mean"], x["se"]) for x in studies.rates(study.where("p = 0.05 or cell = 'estimator'")).collect()}
    k7 = {k: r["estimator", "garch", k] for k in ("nu", "persistence", "not_converged", "boundary")}
    v = rules.absolute_rule({"k1": r["days", "oracle_t5", "rej"], "k2": r["days", "under30", "rej"], "ka": r["days", "garch_tnu", "rej"], "kb": r["days", "garch_tnu_under10", "rej"], "k7": k7})
    rows = [(x.code, float(x.value), x.ok, x.near, v.verdict) for x in (*v.controls, *v.criteria)]
    return tidy(spark.createDataFrame(rows, "code string, value double, ok boolean, near boolean, verdict string"), 4)


def hit_dependence(spark, sf):
    """Hit correlation of the walk-forward forecasts, by block length of its bootstrap."""
    return tidy(dependence.hit_dependence(spark, _returns(spark, sf), boot=500), 4)


def dependence_control(spark, sf):
    small = panels.PanelSettings(n_days=520, n_coins=4, burn=200)
    parts = [dependence.dependence_control(spark, small, rho, 4, 13) for rho in (0.8, 0.0)]
    return tidy(parts[0].unionByName(parts[1]), 4)


def series_control(spark, sf):
    """Rates of the four series tests for four forecasts on independent series."""
    return tidy(studies.rates(laboratories.series_control(spark, 4, 1000, 10, 17, 2000)), 4)


def _rule_rows(spark, verdicts):
    rows = [(*key, x.code, float(x.value), x.ok, x.near, v.verdict) for key, v in verdicts.items() for x in (*v.controls, *v.criteria, *v.notes)]
    return tidy(spark.createDataFrame(rows, "cell string, p double, code string, value double, ok boolean, near boolean, verdict string"), 4)


def power_laboratory(spark, sf):
    """Verdicts of the pooled rule by correlation, sample length and level, with every control and criterion."""
    rate = laboratories.rates_by(laboratories.power_laboratory(spark, panels.PanelSettings(n_coins=5, burn=200), (0.8, 0.4), (250, 500), 4, 19, 99, 1000))
    cells = sorted({(c, p) for c, p, _, _ in rate})
    return _rule_rows(spark, {(c, p): rules.pooled_rule(laboratories.pooled_numbers(rate, c, p), p, c.startswith("0.8")) for c, p in cells})


def comparative_example(spark, sf):
    """Verdict of the comparative rule on a study of all forecasts."""
    study = studies.estimated_study(spark, panels.PanelSettings(n_days=520, n_coins=2, burn=200), 3, 23, boot=49, levels=(0.05,))
    share, rate = laboratories.dm_shares(study), laboratories.rates_by(study.where("cell <> 'dm'"))
    return _rule_rows(spark, {("comparisons", 0.05): rules.comparative_rule(laboratories.comparative_numbers(share, rate, 0.05))})


def cell_example(spark, sf):
    """Verdict of the cell rule on the plain cell and on one with variance regimes."""
    base = panels.PanelSettings(n_days=520, n_coins=3, burn=200)
    regimes = panels.PanelSettings(n_days=520, n_coins=3, burn=200, amplitude=0.5, shock_rho=0.3)
    cells = {"A0": {"settings": base, "full": True, "goal": None, "window": None}, "B1": {"settings": regimes, "full": False, "goal": 1.717, "window": (0.413, 0.613)}}
    return _rule_rows(spark, {(name, 0.05): c["verdict"] for name, c in laboratories.run_cells(spark, cells, 3, 29, boot=99).items()})


QUERIES = {
    f.__name__: (f, None)
    for f in (hit_dependence, dependence_control, series_control, power_laboratory, comparative_example, cell_example, garch_fit, garch_forecast, risk_table, bootstrap_power, power_mde, lab_rates, lab_comparisons, z2_null, evidence_rates, negative_control, panel_pilot, simulated_panel, rule_example)
}
