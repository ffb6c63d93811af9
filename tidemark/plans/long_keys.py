"""Queries of the block operators: keys that are larger than a task, each with the oracle of its plain namesake.

The test series have some thousand rows, so blocks have a few hundred here; the
number of rows of a block is a parameter and changes no result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import block_em, blocks, regimes, shared_boosting, shared_folds, spread
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import statistics as st
from tidemark.plans import catalogue as plain
from tidemark.sources import market, store
from tidemark.streaming import online

query, r, ORACLES = plain.query, plain.r, plain.ORACLES
BLOCK_ROWS = 400


@query(ORACLES["features_all"])
def features_in_blocks(spark, sf_dir):
    """The features of a series dealt to blocks: frames look back over 62 rows and ahead over one."""
    reach = max(ft.WINDOWS) + 2
    made = blocks.windowed(market.daily_series(spark, sf_dir), ft.build_features, reach, 1, block_rows=BLOCK_ROWS)
    return plain.rounded(made.drop(blocks.POS, blocks.BLOCK))


@query(ORACLES["signal_momentum"])
def signal_in_blocks(spark, sf_dir):
    """A z-score over 250 rows of a change over 60, one row late."""
    made = blocks.windowed(market.daily_series(spark, sf_dir), lambda f, by, place: ft.momentum_signal(f, by=by, order=place), 312, block_rows=BLOCK_ROWS)
    return plain.rounded(made.select("series_id", "date", "alpha_momentum"))


@query(ORACLES["backtest_ledger"])
def ledger_in_blocks(spark, sf_dir):
    """Compounded equity and its peak by two-level running totals."""
    made = spread.run_backtest(plain._predictions(spark, sf_dir), block_rows=BLOCK_ROWS)
    return plain.rounded_ledger(made, ["series_id", "date", "probability", "position", "turnover", "strategy_return"])


@query(ORACLES["regime_spans"])
def regime_spans_in_blocks(spark, sf_dir):
    return spread.runs(plain._hourly_regimes(spark, sf_dir), "regime", block_rows=100)


@query(ORACLES["ic_full"])
def ic_by_position(spark, sf_dir):
    return plain.rounded(spread.information_coefficient(plain._long(spark, sf_dir), block_rows=BLOCK_ROWS))


@query(ORACLES["quantile_returns"])
def quantile_returns_by_position(spark, sf_dir):
    return plain.rounded(spread.quantile_returns(plain._long(spark, sf_dir)))


@query(ORACLES["auc_rank"])
def auc_by_position(spark, sf_dir):
    scores = market.label_scores(spark, sf_dir).withColumn("label", F.lit("quality")).withColumn("tie", F.col("doc_id"))
    return plain.rounded(spread.auc(scores, "score", "target", ["label"], ["tie"], block_rows=100))


@query(ORACLES["quantile_ls_weights"])
def long_short_by_position(spark, sf_dir):
    return plain.rounded(spread.quantile_long_short(market.brand_panel(spark, sf_dir), "return", ["date"], "series_id").select("series_id", "date", "weight"))


@query(ORACLES["hamilton_filter"])
def filter_in_blocks(spark, sf_dir):
    """One series filtered by several tasks, from products of its blocks' matrices."""
    made = regimes.hamilton_filter_in_blocks(market.daily_series(spark, sf_dir), plain.simulate.TRANSITION, plain._MEANS, plain._STDS, block_rows=BLOCK_ROWS)
    return plain.rounded(made.select("series_id", "date", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)], F.round("log_likelihood", 5).alias("log_likelihood")), 7)


@query(ORACLES["bootstrap_ci"])
def bootstrap_ci_in_blocks(spark, sf_dir):
    """Resamples of a series whose running sums are made in blocks."""
    ledger = plain.bt.run_backtest(plain._predictions(spark, sf_dir))
    return plain.rounded(st.block_bootstrap_ci(ledger, "strategy_return", st.sharpe_of, block_rows=BLOCK_ROWS), 6)


@query(ORACLES["ic_rolling"])
def ic_rolling_in_blocks(spark, sf_dir):
    return plain.rounded(ev.rolling_ic(plain._long(spark, sf_dir), block_rows=BLOCK_ROWS))


@query(f"""WITH {plain.LONG}, {plain.PAIRS}, {plain._ROLLING.replace("59", "499").replace(">= 60", ">= 500")} SELECT 'ALL' AS series_id, signal, {plain._TSTAT} FROM rolling GROUP BY signal""")
def ic_rolling_wide(spark, sf_dir):
    """Windows of 500 pairs."""
    return plain.rounded(ev.ic_t_stat(ev.rolling_ic(plain._long(spark, sf_dir), 500)).withColumn("t_stat", F.round("t_stat", 6)))


_OFFSETS = "e AS (SELECT *, lag(regime) OVER (ORDER BY date) AS seen FROM states), s AS (SELECT * FROM e WHERE seen IS NOT NULL), c AS (SELECT regime, seen, count(*) AS n FROM s GROUP BY 1, 2)"
_WAYS = ", ".join(f"[{a}, {b}, {c}]" for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)))


@query(f"""WITH {plain.HOURLY}, {_OFFSETS}, ways AS (SELECT unnest([{_WAYS}]) AS way), totals AS (SELECT way, sum(n) FILTER (regime = way[1 + seen]) AS agreed FROM ways, c GROUP BY way)
SELECT 'EVENTS' AS series_id, max(agreed)::BIGINT AS agreed, {r("max(agreed) / (SELECT sum(n) FROM c)::DOUBLE", "accuracy")} FROM totals""")
def state_assignment(spark, sf_dir):
    """States named by the hour before are given the labels that agree most with the hour's own, out of all ways to give them."""
    rows = plain._hourly_regimes(spark, sf_dir).withColumn("state", F.lag("regime").over(plain.ts.spec())).where("state is not null")
    return plain.rounded(regimes.aligned_agreement(rows, 3))


@query()
def hmm_in_blocks(spark, sf_dir):
    """Ten rounds of EM over the blocks of one series: states by ascending mean."""
    return plain.rounded(block_em.fit(market.daily_series(spark, sf_dir), block_rows=BLOCK_ROWS, rounds=10).select("series_id", F.posexplode(F.arrays_zip("means", "stds")).alias("state", "_s")).select("series_id", "state", F.col("_s.means").alias("mean"), F.col("_s.stds").alias("std")))


@query()
def walk_forward_shared(spark, sf_dir):
    """All folds' logistic models in shared passes; the rows of ``walk_forward_logit``."""
    return shared_folds.walk_forward_predictions(ft.build_features(market.daily_series(spark, sf_dir)), plain.FEATURE_NAMES, block_rows=BLOCK_ROWS)


@query()
def walk_forward_histograms(spark, sf_dir):
    """Boosting of all folds in shared passes, 80 trees of depth 2 on 64 bins; the test rows of ``walk_forward_boosting``."""
    return shared_boosting.walk_forward_predictions(ft.build_features(market.daily_series(spark, sf_dir)), plain.FEATURE_NAMES, block_rows=BLOCK_ROWS)


@query(f"""WITH {plain.BRANDS}, two AS (SELECT 'before' AS seen, series_id, date, 2 * price AS price FROM bp WHERE date < DATE '1996-01-01' UNION ALL SELECT 'after', series_id, date, price FROM bp),
q AS (SELECT *, price / nullif(lag(price) OVER (PARTITION BY seen, series_id ORDER BY date), 0) - 1 AS ret FROM two) SELECT seen, series_id, date, price, {r('ret', 'return')} FROM q WHERE ret IS NOT NULL""")
def panel_versions(spark, sf_dir):
    """A panel of all series as one scan; a frame planned before a refresh keeps the version that it began with."""
    root = market.scratch_dir(spark)
    prices = market.brand_prices(spark, sf_dir)
    market.publish_panel(prices.where("date < '1996-01-01'").withColumn("price", F.col("price") * 2), root)
    before = market.read_panel(spark, root)
    market.publish_panel(prices, root)
    both = before.withColumn("seen", F.lit("before")).unionByName(market.read_panel(spark, root).withColumn("seen", F.lit("after")))
    return plain.rounded(both.select("seen", "series_id", "date", "price", "return"))


_EVENT_LAW = ([0.2, 0.5, 0.8], [0.2, 0.3, 0.2])
_EVENT_START = [float(x) for x in regimes.stationary_distribution(plain.simulate.TRANSITION)]
_EVENT_LIKE = ", ".join(f"exp(-0.5 * ((value - ({m!r}::DOUBLE)) / {v!r}::DOUBLE) ** 2) / ({v!r}::DOUBLE * sqrt(2 * pi())) AS l{k}" for k, (m, v) in enumerate(zip(*_EVENT_LAW, strict=True)))
_EVENT_FILTER = f"""WITH RECURSIVE likes AS MATERIALIZED (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS t, {_EVENT_LIKE} FROM events WHERE value IS NOT NULL),
f AS (SELECT event_type, 0::BIGINT AS t, NULL::TIMESTAMP AS ts, {", ".join(f"{x!r}::DOUBLE AS p{k}" for k, x in enumerate(_EVENT_START))} FROM (SELECT DISTINCT event_type FROM likes)
  UNION ALL SELECT event_type, t, ts, j0 / m, j1 / m, j2 / m FROM (SELECT *, greatest(j0 + j1 + j2, 1e-300::DOUBLE) AS m FROM (SELECT f.event_type, likes.t, likes.ts, {plain._MOVE} FROM f JOIN likes ON likes.event_type = f.event_type AND likes.t = f.t + 1)))
SELECT event_type, epoch_us(ts) AS at, {", ".join(r(f"p{k}", f"p{k}", 7) for k in range(3))} FROM f WHERE t > 0"""


@query(_EVENT_FILTER)
def event_time_filter(spark, sf_dir):
    """The filter over a stream of ``events``: six files in a shuffled order, rows up to six days late, timers and watermark."""
    folder, out = store.new_path(spark, "events"), store.new_path(spark, "filtered-events")
    events = market.table(spark, sf_dir, "events").where("value is not null").select("event_type", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"), "value")
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    # Events of any five days are dealt to neighbouring files; each file is one step of the stream.
    day = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span["low"]))) / (5 * 86_400_000_000))
    part = F.greatest(F.lit(0), day - F.pmod(F.xxhash64("ts"), F.lit(2))).cast("int")
    dealt = store.written(events.withColumn("part", part), "dealt-events")
    last = dealt.agg(F.max("part")).first()[0] or 0
    ends = spark.createDataFrame([("", span["high"])], "event_type string, ts timestamp").select("event_type", (F.col("ts") + F.expr("interval 7 days")).alias("ts"), F.lit(0.0).alias("value"))
    for k in range(last + 2):  # the last file only moves the watermark past every event
        (dealt.where(F.col("part") == k).drop("part") if k <= last else ends).coalesce(1).write.mode("append").parquet(folder)
    stream = online.state_session(spark).readStream.schema(dealt.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    made = online.filter_stream_by_time(stream, plain.simulate.TRANSITION, *_EVENT_LAW, key="event_type", late="6 days", silence_ms=10 * 86_400_000)
    made.writeStream.format("parquet").option("checkpointLocation", store.new_path(spark, "stream-state")).trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.schema(made.schema).parquet(out)
    # The time as a number by the clock that the table has, whatever the session's zone.
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return plain.rounded(found.select("event_type", at.alias("at"), *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)]), 7)
