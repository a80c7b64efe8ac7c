"""Nested JSON, callers' prediction functions and medians of whole columns."""

import json
import random

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gridlark.functions import jsontree, quantiles
from gridlark.operators import caller, models


def test_walk_keeps_order_and_repeats(spark):
    text = '{"b": [1, {"a/b": "x", "a/b": null}], "a": {"b": true, "c~d": -1.50e3}}'
    rows = jsontree.walk(spark.createDataFrame([(1, text), (2, "{"), (3, None), (4, "7")], "id int, body string"), "body", ["id"]).collect()
    found = [(r["path"], r["key"], r["position"], r["depth"], r["kind"], r["value"]) for r in rows if r["id"] == 1]
    assert found == [
        ("", None, 0, 0, "object", None), ("/b", "b", 0, 1, "array", None), ("/b/0", None, 0, 2, "number", "1"), ("/b/1", None, 1, 2, "object", None),
        ("/b/1/a~1b", "a/b", 0, 3, "string", "x"), ("/b/1/a~1b", "a/b", 1, 3, "null", "null"), ("/a", "a", 1, 1, "object", None),
        ("/a/b", "b", 0, 2, "boolean", "true"), ("/a/c~0d", "c~d", 1, 2, "number", "-1.50e3"),
    ]
    assert [(r["id"], r["kind"]) for r in rows if r["id"] > 1] == [(2, "malformed"), (3, "malformed"), (4, "number")]


def test_repeated_keys_at_every_depth(spark):
    texts = ['{"k": 1}', '{"k": 1, "k": 2}', '{"a": [{"b": {"k": 1, "j": 0, "k": 1}}]}', '{"a": {"k": 1}, "b": {"k": 1}}', "[" * 100_000, '{"k": ']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    assert [r["v"] for r in df.select("id", jsontree.shape(F.col("body")).alias("v")).orderBy("id").collect()] == [
        "OK", "KEY_REPEATED", "KEY_REPEATED", "OK", "MALFORMED", "MALFORMED"]
    found = jsontree.repeated_keys(df, "body", ["id"]).collect()
    assert sorted(map(tuple, found)) == [(1, "", "k", 2), (2, "/a/0/b", "k", 2)]
    assert jsontree.walk(df.limit(0), "body", ["id"]).count() == 0


def test_redaction_reaches_every_depth(spark):
    payload = {
        "list": [{"deep": {"API-Key": {"inner": 1}, "note": "mail a.b@mail.example.org now"}}, "Authorization: Bearer abc.def", 3.5, None, True],
        "session_token": "t", "long": "x" * 600, "lines": "a\n" * 5, "kept": "short",
    }
    safe = json.loads(spark.createDataFrame([(json.dumps(payload),)], "body string").select(jsontree.redact_json(F.col("body"))).first()[0])
    inner = safe["list"][0]["deep"]
    assert inner["API-Key"] == "[REDACTED]" and inner["note"] == "mail [REDACTED_EMAIL] now"
    assert "abc.def" not in safe["list"][1] and safe["list"][2:] == [3.5, None, True]
    assert safe["session_token"] == "[REDACTED]" and safe["kept"] == "short"
    assert safe["long"].startswith("[REDACTED_TEXT sha256=") and safe["lines"].startswith("[REDACTED_TEXT sha256=")
    assert jsontree.redacted_text("{") is None and jsontree.redacted_text(None) is None
    assert jsontree.redacted_text('{"b": 1.0, "a": 10000000000000000000001}') == '{"a":10000000000000000000001,"b":1.0}'


def test_a_caller_scores_like_the_fitted_model(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, float(np.exp(0.3 * a + 0.1 * b))) for i, a, b in rows], "id int, a double, b double, target double")
    fitted = models.fit(models.Candidate("t", "tweedie", {"alpha": 0.01}), df, None, ["a", "b"])
    glm, scaler = fitted.model.stages[-1], fitted.model.stages[-3]
    weights, shift, mean, std = np.array(glm.coefficients), glm.intercept, np.array(scaler.mean), np.array(scaler.std)

    def predict(batch):
        x = np.stack([batch["a"].to_numpy(), batch["b"].to_numpy()], axis=1)
        return np.exp((x - mean) / std @ weights + shift)

    own = {r["id"]: r["forecast"] for r in fitted.score(df).collect()}
    scored = caller.score_with(df, ["a", "b"], predict, rows_at_once=37)
    assert scored.columns == [*df.columns, "forecast", "forecast_valid"]
    assert all(r["forecast"] == pytest.approx(own[r["id"]], rel=1e-9) and r["forecast_valid"] for r in scored.collect())


def test_answers_are_checked(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, None)], "id int, x double").coalesce(1)
    scored = {r["id"]: (r["y"], r["y_valid"]) for r in caller.score_with(df, ["x"], lambda b: 1 / b["x"].to_numpy(zero_copy_only=False), "y").collect()}
    assert scored == {1: (0.5, True), 2: (None, False), 3: (None, False)}
    for wrong, words in ((lambda b: [1.0], "answers of shape"), (lambda b: ["x"] * b.num_rows, "no number")):
        with pytest.raises(Exception, match=words):
            caller.score_with(df, ["x"], wrong).collect()
    for columns in (["z"], ["x", "x"]):
        with pytest.raises(caller.PredictionError):
            caller.score_with(df, columns, lambda b: pc.add(b["x"], 1))
    with pytest.raises(caller.PredictionError, match="type"):
        caller.score_with(df.withColumn("l", F.array("x")), ["l"], lambda b: [0.0])
    assert caller.score_with(df.limit(0), ["x"], lambda b: b["x"].to_numpy()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 30_000])
def test_whole_median(spark, n):
    rng = np.random.default_rng(n)
    values = np.exp(rng.normal(0, 40, n)) * np.where(rng.random(n) < 0.5, -1, 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert quantiles.whole_median(df, "v") == float(np.median(values))


def test_whole_median_of_very_many_values(spark):
    n = 1_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7_919, F.lit(n)) * 0.25 - 1000).alias("v"))
    assert quantiles.whole_median(df, "v") == float(np.median(np.arange(n) * 0.25 - 1000))
    ranks = [1, 2, n // 3, n - 1, n]
    assert quantiles.nth_values(df, "v", ranks) == [(r - 1) * 0.25 - 1000 for r in ranks]
    tied = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("v"))
    assert quantiles.whole_median(tied, "v") == float(np.median([5.0 if i % 3 == 0 else float(i) for i in range(200_000)]))
    assert quantiles.whole_median(tied.limit(0), "v") is None
