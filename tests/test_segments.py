"""Cuts of samples into trips, at their limits."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadlens.operators import segments as S

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, o long, ts timestamp, speed double, trip_distance double"


def samples(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], SCHEMA)


def sizes(df):
    return [r["n_rows"] for r in S.sized(df, ["user_id"]).orderBy("trip_index").collect()]


def timed(*minutes):
    return [(None if m is None else START + timedelta(minutes=m), 50.0, 1.0) for m in minutes]


@pytest.mark.parametrize("minutes, want", [((0, 30), [2]), ((0, 30.02), [1, 1]), ((0, None, 10), [3]), ((0, None, 50), [3]), ((0, 1, 40, 41), [2, 2])])
def test_gap(spark, minutes, want):
    assert sizes(S.by_gap(samples(spark, timed(*minutes)), ["user_id"], ["o"])) == want


def moving(*runs):
    return [(None, 50.0 if move else 0.0, 1.0) for move, n in runs for _ in range(n)]


@pytest.mark.parametrize(
    "runs, want",
    [
        (((1, 10), (0, 50), (1, 10)), [70]),  # a stop of 50 stays
        (((1, 10), (0, 51), (1, 10)), [10, 9]),  # 51 cut; the first moving row goes too
        (((0, 60), (1, 10)), [70]),  # a stop that opens the file cuts nothing
        (((1, 10), (0, 51)), [61]),  # the last row of an open stop does not count
        (((1, 10), (0, 53)), [10]),
        (((1, 10), (0, 60), (1, 2), (0, 60), (1, 10)), [10, 9]),  # a trip of one row goes
    ],
)
def test_stop(spark, runs, want):
    assert sizes(S.by_stop(samples(spark, moving(*runs)), ["user_id"], ["o"])) == want


@pytest.mark.parametrize("distances, want", [((5, 4), [2]), ((5, 3.9), [1, 1]), ((5, None, 6), [1, 2])])
def test_reset(spark, distances, want):
    assert sizes(S.by_reset(samples(spark, [(None, None, None if d is None else float(d)) for d in distances]), ["user_id"], ["o"])) == want


def test_cascade(spark):
    rows = [(u, k, *r) for u, rs in ((1, timed(0, 31.0, 32)), (2, moving((1, 5), (0, 60), (1, 5))), (3, [(None, None, 5.0), (None, None, 1.0)]), (4, [(None, None, None)] * 3)) for k, r in enumerate(rs)]
    out = S.automatic(spark.createDataFrame(rows, SCHEMA), ["user_id"], ["o"])
    got = {(r["user_id"], r["method"]): r["n"] for r in out.groupBy("user_id", "method").agg(F.countDistinct("trip_index").alias("n")).collect()}
    assert got == {(1, "gap"): 2, (2, "stop"): 2, (3, "reset"): 2, (4, "whole"): 1}
