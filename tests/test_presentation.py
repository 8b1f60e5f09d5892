"""Layouts, envelopes, colours."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import presentation as P


def test_squarified_fills_the_box():
    boxes = P.squarified([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert sum(w * h for *_, w, h in boxes) == pytest.approx(24)
    assert [round(w * h, 6) for *_, w, h in boxes] == [6, 6, 4, 3, 2, 2, 1]
    assert all(0 <= x and x + w <= 6 + 1e-9 and 0 <= y and y + h <= 4 + 1e-9 for x, y, w, h in boxes)
    assert boxes[0] == pytest.approx((0, 0, 3, 2)) and P.squarified([], 0, 0, 1, 1) == []


def test_treemap_and_envelope(spark):
    rows = spark.createDataFrame([("g", "a", 3), ("g", "b", 1), ("h", "c", 2), ("h", "d", 0)], "grp string, node string, v long")
    boxes = {r.node: r.w * r.h for r in P.treemap(rows, "grp", "node", "v", 4.0, 2.0).collect()}
    assert boxes == pytest.approx({"a": 6, "b": 2, "c": 8})
    e = P.envelope(rows, ["node", "v"], [F.col("v").desc(), "node"], 2).first()
    assert (e.ok, e.total, e.truncated) == (True, 4, True) and json.loads(e.results) == [{"node": "a", "v": 3}, {"node": "c", "v": 2}]
    assert P.follow_ups("impact", 3) and P.follow_ups("other", 0)
    assert spark.range(1).select(P.lerp_colour((0, 0, 0), (255, 128, 0), F.lit(0.5)).alias("c")).first().c == "#804000"
