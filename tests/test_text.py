from pyspark.sql import functions as F

from voltrace.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_alert_words(spark):
    kinds = [("battery_soc", "critical", 8.4), ("battery_soc", "warning", 18.6), ("battery_temp", "critical", 45.04)]
    got = [(one(spark, X.alert_title(F.lit(k), F.lit(s))), one(spark, X.alert_detail(F.lit(k), F.lit(v)))) for k, s, v in kinds]
    assert got == [("Battery critically low", "8% state of charge"), ("Low battery", "19% state of charge"), ("Battery overheating", "45.0 °C")]
    assert one(spark, X.dismiss_label(F.lit("onIt"))) == "I am on it"


def test_ages_and_durations(spark):
    ages = {0: "just now", 4: "just now", 5: "5s ago", 59: "59s ago", 60: "1m ago", 3599: "59m ago", 3600: "1h 0m ago", 90000: "1d ago"}
    assert {k: one(spark, X.age_text(F.lit(k))) for k in ages} == ages
    assert one(spark, X.age_text(F.lit(None).cast("long"))) == "never"
    assert [one(spark, X.duration_text(F.lit(k))) for k in (59, 3540, 7260)] == ["0m", "59m", "2h 1m"]
    assert one(spark, X.duration_text(F.lit(None).cast("long"))) == X.NOTHING


def test_values(spark):
    assert [one(spark, X.value_text(F.lit(v), u)) for v, u in ((5.0, "%"), (5.25, "km"), (120000.0, "km"), (1.0, ""))] == ["5 %", "5.3 km", "120000.0 km", "1"]
    assert one(spark, X.clock_text(F.lit("2024-06-01 07:05:00").cast("timestamp_ntz"))) == "01/06 07:05"
    assert [one(spark, X.nearest_rank(F.array(*map(F.lit, range(10))), p)) for p in (0, 50, 95, 100)] == [0, 5, 9, 9]
