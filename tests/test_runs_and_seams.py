"""Configuration, stage bookkeeping and model seams."""

import pandas as pd
import pytest

from courtflow.operators import seams
from courtflow.plans import runs


def test_config_reports_all_errors():
    c = runs.load_config(runs.merged({"smoothing": {"window": 3}}, {"smoothing": {"alpha": 1}, "events": {"turn_angle": 45}}))
    assert (c.smoothing.window, c.smoothing.alpha, c.smoothing.max_gap_frames, c.events.turn_angle) == (3, 1.0, 4, 45.0)
    with pytest.raises(ValueError) as e:
        runs.load_config({"smoothing": {"window": 2.5, "alpha": 7, "colour": 1}, "events": 3, "extra": {}, "segments": {"threshold": True}})
    for part in ("smoothing.window", "smoothing.alpha", "smoothing.colour: unknown", "events", "extra: unknown", "segments.threshold"):
        assert part in str(e.value)


def test_runs_stop_resume_and_report(spark):
    kept = {}

    def write(name, df):
        if df is not None:
            kept[name] = df.collect()
        return spark.createDataFrame(kept[name], "n bigint")

    stages = [("a", lambda d: d.where("n > 1")), ("b", lambda d: d.where("n > 2")), ("c", lambda d: d.where("n > 99")), ("d", lambda d: d)]
    run = runs.Run("r", "s", runs.Config())
    runs.run_stages(run, spark.createDataFrame([(i,) for i in range(5)], "n bigint"), stages, write, stop_after="b")
    assert [(r.stage, r.status, r.rows) for r in run.reports] == [("a", "success", 3), ("b", "success", 2)]
    again = runs.Run("r", "s", runs.Config())
    assert again.resumed(run.manifest()) == 2
    runs.run_stages(again, spark.createDataFrame([], "n bigint"), stages, write)
    assert [(r.stage, r.status) for r in again.reports] == [("a", "success"), ("b", "success"), ("c", "empty")]
    assert again.table(spark).count() == 3
    with pytest.raises(ValueError):
        runs.Run("r", "other", runs.Config()).resumed(run.manifest())
    with pytest.raises(ZeroDivisionError):
        with again.stage("x"):
            1 / 0
    assert again.reports[-1].status == "failed" and "ZeroDivisionError" in again.reports[-1].detail


def test_models_are_seams(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(6)], "id bigint, v double")

    def load():
        return lambda batch: pd.DataFrame({"twice": batch["v"] * 2, "name": "m"})

    assert sorted(map(tuple, seams.with_model(rows, load, "twice double, name string", ["v"]).collect()))[3] == (3, 3.0, 6.0, "m")
    assert seams.without_model(rows, "twice double", "runtime missing").first()["model_reject_reason"] == "runtime missing"


def test_persistent_changes(spark):
    bits = lambda n: [int(i < n) for i in range(100)]
    levels = [5, 5, 5, 7, 7, 7, 60, 60, 60, 62, 9, 62, 62, 62]
    df = spark.createDataFrame([("v", i, bits(x)) for i, x in enumerate(levels)] + [("w", 10 * i, bits(3 * (i > 2))) for i in range(6)], "k string, frame_id bigint, b array<int>")
    got = [(r["k"], r["frame_id"], round(r["change"], 3)) for r in seams.persistent_changes(df, "k", "b", 5.0).collect()]
    # the middle of three equal ones; a jump to another layout only renews the reference; w's samples are too far apart
    assert got == [("v", 4, 0.02), ("v", 12, 0.02)]
