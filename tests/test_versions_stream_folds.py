"""Published versions, the filter by event time, and folds in shared passes."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, regimes, shared_folds, simulate
from tidemark.sources import market, store, versions
from tidemark.streaming import online


def test_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "table")
    assert versions.current(spark, root) is None
    versions.publish(spark.range(5), root)
    old = spark.read.parquet(versions.current(spark, root))
    versions.publish(spark.range(7), root)
    assert old.count() == 5 and spark.read.parquet(versions.current(spark, root)).count() == 7
    versions.publish(spark.range(9), root)
    versions.prune(spark, root, 1)
    assert len(versions.published(spark, root)) == 1 and spark.read.parquet(versions.current(spark, root)).count() == 9


def test_a_refresh_during_a_read(spark, tmp_path):
    days = lambda n: spark.createDataFrame([(d.date(), 10.0 + k) for k, d in enumerate(pd.bdate_range("2020-01-01", periods=n))], "date date, price double")
    where = str(tmp_path / "cache")
    held = market.load_series(spark, "X", where, lambda _: days(20))
    assert market.load_series(spark, "X", where, lambda _: days(30), refresh=True).count() == 29
    assert held.count() == 19


def test_panel_is_one_scan(spark, tmp_path):
    """The plan of many series is as large as that of two; a filter reads its series' folder only."""
    sizes = {}
    for n in (2, 40):
        rows = [(f"00{k}/=é {k}", f"2020-01-{d:02}", 1.0 + d) for k in range(n) for d in range(1, 6)]
        root = str(tmp_path / f"panel{n}")
        market.publish_panel(spark.createDataFrame([*rows, (None, "2020-01-01", 1.0)], "series_id string, date string, price double"), root)
        panel = market.read_panel(spark, root)
        assert panel.count() == 4 * n and panel.select("series_id").distinct().count() == n
        plan = panel._jdf.queryExecution().executedPlan().toString()
        sizes[n] = plan.count("FileScan"), len(plan.splitlines())
        one = market.read_panel(spark, root).where("series_id = '001/=é 1'")
        assert one.count() == 4 and "PartitionFilters: [isnotnull(series_id" in one._jdf.queryExecution().executedPlan().toString()
    assert sizes[2] == sizes[40]
    with pytest.raises(market.EmptySource):
        market.read_panel(spark, str(tmp_path / "nothing"))


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("S", (), {"master": "local-cluster[2,1,1024]", "applicationId": "a"})

    with pytest.raises(ValueError, match="checkpoint"):
        store.folder(Session)
    Session.sparkContext.master = "local[2]"
    found = store.folder(Session)
    assert found == store.folder(Session) and "tidemark-" in found


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_rows_out_of_order_give_the_batch_filter(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rng = np.random.default_rng(4)
        start = datetime(2024, 3, 1)
        rows = [(k, start + timedelta(minutes=17 * t + j), float(v)) for j, k in enumerate(("a", "b")) for t, v in enumerate(rng.normal(0, 0.2, 120))]
        rows = [r for r in rows if r[0] == "a" or r[1] < start + timedelta(hours=6)]  # the second key falls silent
        rows.append(("c", start, None))
        order = sorted(range(len(rows)), key=lambda i: rows[i][1] + timedelta(minutes=float(rng.uniform(0, 170))))
        schema = "series_id string, ts timestamp, value double"
        folder = str(tmp_path / "in")
        for part in [*np.array_split(order, 6), None]:
            mine = [("end", start + timedelta(days=30), 0.0)] if part is None else [rows[i] for i in part]
            spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        law = (simulate.TRANSITION, [0.0, 0.1, -0.1], [0.1, 0.2, 0.3])
        made = online.filter_stream_by_time(stream, *law, late="3 hours", silence_ms=86_400_000)
        query = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        got = {(r.series_id, r.ts): list(r.probabilities) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        batch = regimes.hamilton_filter(spark.createDataFrame(rows, schema), *law, r="value", order="ts")
        want = {(r.series_id, r.ts): list(r.probabilities) for r in batch.collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-12)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


class _Store(dict):
    """A state's map, which counts what is read of it at once."""

    most = reads = 0

    def updateValue(self, name, value):  # noqa: N802
        self[name], self.reads = value, 0

    def getValue(self, name):  # noqa: N802
        self.reads += self[name][0]
        self.most = max(self.most, self.reads)
        return self[name]

    def removeKey(self, name):  # noqa: N802
        self.reads = 0
        del self[name]


@pytest.mark.parametrize("times", [1, 3, 60, 100_000])
def test_held_rows_stay_in_bounded_slots(times):
    """Whatever the lag and however many rows are of one time, some slots' rows are in memory at once."""
    rng, store, slots, came, gone, size = np.random.default_rng(times), _Store(), [], [], [], 50
    values = np.array([-np.inf, -1.5, -0.25, 0.0, 0.25, 2.0, np.inf, np.nan])
    for until in (None, None, times // 3, times // 2, times // 2, times):
        held = online._Held(store, slots, size)
        for n in (1, 7, 50, 50, 50, 50, 50, 50, 50, 50):
            low = max([-1, *(int(g[-1, 0]) for g in gone if len(g))]) + 1
            if low <= times:
                came.append(online._pairs(rng.integers(low, times + 1, n), np.where(rng.random(n) < 0.5, rng.choice(values, n), rng.normal(size=n))))
                held.add(came[-1])
        # No row of what was taken comes later.
        if until is not None:
            gone += [*held.take(until)] or [np.empty((0, 2), np.int64)]
            assert held.first() is None or held.first() > until
        slots = [list(s) for s in held.state()]
    got = np.concatenate(gone)
    want = online._in_order(np.concatenate(came))
    assert (got == want).all() and not store and held.first() is None
    assert store.most <= 3 * size and len(slots) == 1
    assert np.array_equal(online._values(online._pairs(np.zeros(8, np.int64), values)), values, equal_nan=True)


def test_a_key_beyond_a_slot_and_a_key_that_returns(spark, tmp_path):
    """State in slots of 16 rows: more rows than that wait, many of one time; a key forgotten after its silence starts anew; a null key is one."""
    rng = np.random.default_rng(8)
    start, folder = datetime(2024, 3, 1), str(tmp_path / "in")
    hours = [rng.integers(0, 24, 400), rng.integers(18, 48, 400), np.repeat(100, 60), np.repeat(110, 1), np.repeat(240, 1), np.repeat(960, 1)]
    steps = [[(k, start + timedelta(hours=int(h)), float(v)) for h, v in zip(hs, rng.normal(0, 0.2, len(hs)), strict=True) for k in ("a", None)] for hs in hours]
    for k, at in ((0, 1), (4, 250)):
        steps[k] += [("back", start + timedelta(hours=at, minutes=m), 0.1 * m) for m in range(5)]
    schema = "series_id string, ts timestamp, value double"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    law = (simulate.TRANSITION, [0.0, 0.1, -0.1], [0.1, 0.2, 0.3])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    made = online.filter_stream_by_time(stream, *law, late="36 hours", silence_ms=86_400_000, held_rows=16)
    made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rounded = lambda rows: sorted((str(r.series_id), r.ts, *(round(p, 9) for p in r.probabilities)) for r in rows)
    # The batch filter leaves equal times as they come; by value here, and each life of a key by itself.
    frame = pd.DataFrame([r for rows in steps[:5] for r in rows], columns=["series_id", "ts", "value"]).sort_values(["ts", "value"])
    want = []
    for name, part in frame.groupby("series_id", dropna=False):
        lives = part["ts"] > start + timedelta(hours=200)
        for one in [part[~lives], part[lives]] if name == "back" else [part]:
            p, _ = regimes.filter_states(one["value"].to_numpy(), *(np.asarray(x, float) for x in law))
            want += [(str(None if pd.isna(name) else name), t.to_pydatetime(), *(round(float(x), 9) for x in q)) for t, q in zip(one["ts"], p, strict=True)]
    assert rounded(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    parts = []
    for name, n in (("a", 400), ("b", 260), ("short", 90)):
        x = rng.normal(size=(n, 3))
        x[:, 2] = 4.0 if name == "b" else x[:, 2]
        y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
        y[:170] = 1 if name == "b" else y[:170]  # first folds of one class
        parts.append(pd.DataFrame({"series_id": name, "date": np.arange(n), "f1": x[:, 0], "f2": 100 + 5 * x[:, 1], "f3": x[:, 2], "target": y, "next_return": rng.normal(size=n)}))
    return spark.createDataFrame(pd.concat(parts))


@pytest.mark.parametrize(("embargo", "block_rows"), [(0, 64), (30, 4096)])
def test_shared_passes_equal_single_fits(frame, monkeypatch, embargo, block_rows):
    monkeypatch.setattr(shared_folds, "HELD", 50)
    features = ["f1", "f2", "f3"]
    got = shared_folds.walk_forward_predictions(frame, features, min_train=100, test=40, embargo=embargo, block_rows=block_rows).toPandas()
    want = models.walk_forward_predictions(frame, features, models.Logistic, 100, 40, embargo).toPandas()
    got, want = (d.sort_values(["series_id", "date"]).reset_index(drop=True)[sorted(d.columns)] for d in (got, want))
    assert len(got) == len(want) > 300
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-8, rtol=0)


def test_shared_passes_without_folds(frame):
    assert shared_folds.walk_forward_predictions(frame.where("series_id = 'short'"), ["f1"], min_train=100, test=40).count() == 0
    assert shared_folds.walk_forward_predictions(frame.where(F.lit(False)), ["f1"], min_train=100, test=40).count() == 0
