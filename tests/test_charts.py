"""Chart files: well-formed SVG with as many marks as the data has."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tidemark.plans import charts

NS = "{http://www.w3.org/2000/svg}"


def test_four_charts(spark, tmp_path):
    days = spark.range(50).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("v"))
    frames = {
        "equity_curves": days.select(F.lit("a&b").alias("strategy"), F.lit("x").alias("series_id"), "date", (1 + F.col("v") / 100).alias("equity")),
        "regime_spans": spark.sql("select 'x' series_id, 1 run, 2 value, date'2020-01-01' first, date'2020-01-09' last, 9L length"),
        "cost_heatmap": spark.createDataFrame([("x", 0.5, 0.0, 1.0), ("x", 0.6, 0.0, -2.0)], "series_id string, threshold double, cost double, annualised_sharpe double"),
        "scree": spark.createDataFrame([(0, 3.0, 0.75, True), (1, 1.0, 0.25, False)], "k int, eigenvalue double, share double, signal boolean"),
    }
    paths = charts.write_figures(frames, days.select(F.lit("x").alias("series_id"), "date", F.col("v").alias("price")), str(tmp_path / "figures"))
    roots = {p.rsplit("/", 1)[1]: ET.parse(p).getroot() for p in paths}
    assert set(roots) == {"equity_curves.svg", "regime_spans.svg", "cost_heatmap.svg", "scree.svg"}
    assert len(roots["equity_curves.svg"].find(f"{NS}polyline").get("points").split()) == 50
    assert [len(roots[f"{n}.svg"].findall(f"{NS}rect")) for n in ("regime_spans", "cost_heatmap", "scree")] == [2, 3, 3]


def test_thinned_rows_and_empty_charts(spark):
    df = spark.range(1000).select(F.lit("x").alias("k"), "id")
    assert 90 <= charts.thinned(df, ["k"], "id", 100).count() <= 100 and charts.thinned(df.where("id < 5"), ["k"], "id", 100).count() == 5
    assert all("<svg" in s for s in (charts.lines("t", {}), charts.cells("t", {}), charts.bars("t", [], [])))
