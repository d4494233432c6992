"""The linear models of all folds against Spark ML's, and prices scored from what no price changes."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quotelab.operators import features, linear, prefix, training
from quotelab.operators.training import LOGISTIC, Sizes
from quotelab.plans import train

KEY, LABEL = "request_event_id", "target_signed"


def quotes(spark, n=500):
    rng, rows = np.random.default_rng(8), []
    for i in range(n):
        gross, price = float(rng.integers(400, 1500)), float(rng.integers(300, 1600)) / 7
        city = None if i % 17 == 0 else f"c{rng.integers(0, 30)}" if i % 50 else f"once{i}"
        signed = int(rng.random() < 1 / (1 + np.exp(3 * (7 * price / gross - 1) - (city == "c3"))))
        rows.append((i, gross, price, None if i % 3 == 0 else float(i % 5), 4.25, city, signed))
    return spark.createDataFrame(rows, f"{KEY} long, price_catalog_gross double, price_proposed double, venue_rating double, option_count double, event_city string, {LABEL} int")


NUMBERS = ["option_count", "price_catalog_gross", "price_proposed", "venue_rating"]


def test_all_folds_equal_spark_ml_in_one_series_of_passes(spark, monkeypatch):
    rows, passes, sizes = quotes(spark), [], Sizes()
    monkeypatch.setattr(linear, "_added", lambda *a, f=linear._added: passes.append(1) or f(*a))
    prepared = training.prepare_folds(rows, NUMBERS, ["event_city"], 42, 3, KEY, LABEL, sizes)
    model = training.fit_calibrated(rows, NUMBERS, ["event_city"], LOGISTIC, prepared=prepared)
    margins = {r[KEY]: list(r["m"]) for r in model.margins(rows, "m").collect()}
    steps = []
    for i in range(3):
        learned, n = training.balanced(prepared.rows.where(F.col("_fold") != i), LABEL)
        pipeline = training.preparation(learned, NUMBERS, prepared.encoding, sizes, i, numbers=prepared.numbers)
        fit = LogisticRegression(labelCol=LABEL, weightCol="_weight", maxIter=3000, regParam=1 / (0.7 * n), standardization=False, tol=1e-6)
        fitted = fit.fit(pipeline.transform(learned))
        steps.append(fitted.summary.totalIterations)
        scored = fitted.transform(pipeline.transform(prepared.rows)).select(KEY, vector_to_array("rawPrediction")[1].alias("m")).collect()
        assert [margins[r[KEY]][i] for r in scored] == pytest.approx([r["m"] for r in scored], rel=1e-6, abs=1e-8)
    assert max(steps) <= len(passes) < 1.5 * max(steps) + 5


@pytest.mark.parametrize("few", [True, False])
def test_sums_are_the_same_wherever_they_are_added(spark, few):
    rows = quotes(spark, 90)
    prepared = training.prepare_folds(rows, NUMBERS, ["event_city"], 42, 2, KEY, LABEL, Sizes())
    blocks = linear.packed(prepared.rows, NUMBERS, ["_s0_event_city", "_s1_event_city"], LABEL, np.array([0, 900, 0, 2.0]), 3, KEY)
    given = rows.collect()
    made = linear._added(blocks, 4, lambda b: [b.x.sum(axis=0), np.bincount(b.lacking, b.gap.sum(axis=0), 4), np.array([b.y.sum(), len(b.y)])], few)
    shift = [0, 900, 0, 2.0]
    assert made[0] == pytest.approx([sum(r[c] - s for r in given if r[c] is not None) for c, s in zip(NUMBERS, shift, strict=True)])
    assert made[1].tolist() == [0, 0, 0, 30] and made[2].tolist() == [sum(r[LABEL] for r in given), 90]


def test_medians_and_gaps_of_members(spark):
    rows = [(0, 1.0, None), (0, 3.0, None), (1, 10.0, float("nan")), (1, None, 2.0), (2, 4.0, 5.0), (2, 4.0, -0.0)]
    df = spark.createDataFrame(rows, "f int, x double, y double")
    medians, gaps = prefix.medians_of_members(df, ["x", "y"], [F.col("f") != i for i in range(3)], target_rows=2)
    assert medians == [{"x": 4.0, "y": 2.0}, {"x": 3.5, "y": 2.5}, {"x": 3.0, "y": 2.0}]
    assert gaps == [{"x", "y"}, {"y"}, {"x", "y"}]


def test_prices_move_only_what_depends_on_them(spark, tmp_path):
    rows = quotes(spark, 300)
    fitted = training.fit_calibrated(features.prices(rows), [*NUMBERS, "price_proposed_to_gross_ratio"], ["event_city"], LOGISTIC, folds=2)
    fitted.save(str(tmp_path / "m"))
    for model in (fitted, training.CalibratedModel.load(spark, str(tmp_path / "m"))):
        scorer = train.Bundle(model, model, {}).price_scorer
        asked = rows.select(KEY, "price_catalog_gross", "venue_rating", "event_city").where(F.col(KEY) < 60)

        def candidates(requests):
            priced = requests.withColumn("price_proposed", F.explode(F.array(F.lit(80.5), F.lit(200.0), F.lit(None))))
            return features.prices(priced)

        once = scorer(candidates(scorer.before(asked)))
        plan = once._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Generate explode(")]
        assert "Join" not in above and "ArrowEvalPython" not in above and "Join" in plan
        of = lambda df: {(r[KEY], r["price_proposed"]): r["raw_probability"] for r in df.collect()}
        got, want = of(once), of(scorer(candidates(asked)))
        assert len(got) == 180 and got == pytest.approx(want, abs=1e-12)
