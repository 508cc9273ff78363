from decimal import Decimal

from pyspark.sql import functions as F

from framequarry.functions.text import exact_sum, printed


def test_printed_as_c_does(spark):
    values = [0.125, 0.375, 1.005, 2767.55, 799.85, 1234.25, -0.25, -1.35, 0.0, 7.0, 123456789.05, 0.05, 0.15, 0.25, 99.95, 1e17, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2):
        for r in df.select("x", printed(F.col("x"), digits).alias("t")).collect():
            assert r.t == (None if r.x is None else f"%.{digits}f" % r.x)


def test_exact_sum_in_any_order(spark):
    prices = [Decimal(k * 7919 % 1000003) / 100 for k in range(1, 400)]
    rows = [(float(p),) for p in prices]
    want = float(sum(prices))
    for part in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(part, "x double").repartition(5)
        assert df.agg(exact_sum(F.col("x")).alias("s")).first().s == want
    assert spark.createDataFrame([(1e300,), (1.0,), (None,)], "x double").agg(exact_sum(F.col("x")).alias("s")).first().s == 1e300


def test_release_notes_on_a_tie(spark, tmp_path):
    from datetime import datetime

    from framequarry import plans

    prices = [199039.44, 194003.65, 132070.14, 217149.58, 87.19]  # their plain sum in this order falls short of the tie
    spark.createDataFrame([(k, 1, "O", p, datetime(2024, 1, 1), "1") for k, p in enumerate(prices)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert plans.queries()["release_notes"](spark, str(tmp_path)).first().line == "burst_1      5 frames       742.4 kB"


def test_steady_sum(spark):
    from functools import reduce

    from framequarry.functions.text import steady_sum

    plain = lambda v: reduce(lambda a, b: a + b, v)
    one = lambda v: spark.createDataFrame([(k,) for k in v], "x double").coalesce(1).agg(steady_sum(F.col("x")).alias("s")).first().s
    x = [0.1] * 10
    assert one(x) == 1.0 != plain(x) and one([*x, None]) == 1.0 and one([None]) is None
    assert one([*x, 1e300]) == 1e300 and one([1.0, float("nan")]) != one([1.0, float("nan")])


def test_length_of_a_curve_near_a_tie(spark, tmp_path):
    """The exact length of these steps is 5099.860118500001052...; added one after the other as doubles they end just below the tie."""
    from framequarry import plans

    ids = "0 2581 5510 6241 9155 9335 11208 12393 15044 18963 19097 20618 20753 21586 22759 24157 25908 29231 30070 32049 32310 35114 35290 36921 38626 39458 39524 40712 40973 41009 42135 42261 42335 42628 43921 44935 45513 46783 48121 48772 48851 49177 49241 50589 51193 51496 51835 53137 53359 55013 55218 56527 62318 63859 65618 65841 66140 68050 69385 74898 75830 75848 76156 77618 78401 78447 80114 81075 82524 86603 86724 87664 88514 89154 90613 90970 96308"
    values = "18.15 39.59 49.11 4.24 116.14 23.39 21.3 73.87 96.45 121.06 103.12 18.0 78.86 68.94 19.25 4.7 6.08 7.53 1.78 106.85 18.3 29.23 18.7 4.56 5.8 80.54 125.18 23.61 87.34 40.55 32.32 20.42 52.4 108.97 65.76 20.88 43.14 89.11 155.22 266.74 110.07 11.34 39.66 102.5 152.92 1.31 81.82 80.15 11.77 18.64 168.56 150.39 4.08 3.88 6.22 40.36 16.78 14.96 40.32 24.98 25.89 63.95 33.68 42.95 44.75 53.83 263.29 11.89 5.48 29.19 180.21 165.69 131.94 67.69 21.49 16.94 22.38"
    rows = [(402686 + int(k), 1, float(v), "view", None) for k, v in zip(ids.split(), values.split(), strict=True)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double, event_type string, props string").withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert plans.queries()["tortuosity_metrics"](spark, str(tmp_path)).first().length == 5099.860119
