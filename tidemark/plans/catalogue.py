"""Registry of the engine's queries over the test tables, each with its SQL oracle where SQL can state it.

Doubles are rounded on both sides, so that the last bits of sums in different
orders do not count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normal, ts
from tidemark.operators import backtest as bt
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import folds, models, portfolio, regimes, simulate, tiles
from tidemark.operators import statistics as st
from tidemark.plans import experiments
from tidemark.sources import market
from tidemark.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 8


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All doubles rounded but prices; -0.0 becomes 0.0.

    A price is one division of exact sums, equal to the last bit in any engine, and often a tie of rounding.
    """
    exact = ("price", "peak")
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


def significant(c: str, digits: int = 9):
    """A column to so many significant digits, for compounded values of any size."""
    return (F.format_string(f"%.{digits - 1}e", F.col(c)).cast("double") + F.lit(0.0)).alias(c)


def sig(expr: str, name: str, digits: int = 9) -> str:
    return f"CAST(printf('%.{digits - 1}e', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0 AS {name}"


def rounded_ledger(ledger: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(ledger.dtypes)
    return ledger.select(*[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns], significant("equity"), significant("drawdown"))


def metric_row(df: DataFrame) -> DataFrame:
    """Metrics rounded to 6 places; compounded ones to significant digits."""
    compounded = [c for c in df.columns if c in ("total_return", "max_drawdown", "equity", "drawdown")]
    kept = df.select(*[significant(c) if c in compounded else F.col(c) for c in df.columns])
    return kept.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" and c not in compounded else F.col(c) for c, t in kept.dtypes])


def r(expr: str, name: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# --- SQL views that the oracles share ---------------------------------------

DAILY = """
prices AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0) AS price
  FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
changes AS (SELECT date, price, price / nullif(lag(price) OVER (ORDER BY date), 0) - 1 AS ret FROM prices),
daily AS (SELECT * FROM changes WHERE ret IS NOT NULL)"""


def _roll(fn: str, c: str, n: int, least: int, shift: int) -> str:
    frame = f"(ORDER BY date ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({c}) OVER {frame} >= {least} THEN {fn}({c}) OVER {frame} END"


def _z(base: str, sign: int = 1, source: str = "daily") -> str:
    """CTEs ``based`` and ``zed`` (date, price, ret, value): a signal by its base expression."""
    return f"""
based AS (SELECT *, {base} AS base FROM {source}),
zed AS (SELECT date, price, ret, {sign}.0 * ((lag(base) OVER (ORDER BY date)) - {_roll("avg", "base", 250, 60, 1)}) / nullif({_roll("stddev_samp", "base", 250, 60, 1)}, 0) AS value,
        lead(ret) OVER (ORDER BY date) AS fwd FROM based)"""


MOMENTUM_BASE = "price / nullif(lag(price, 60) OVER (ORDER BY date), 0) - 1"
REVERSION_BASE = "price / nullif(lag(price, 5) OVER (ORDER BY date), 0) - 1"
VOL_BASE = _roll("stddev_samp", "ret", 20, 20, 0)
MOMENTUM = f"{DAILY}, {_z(MOMENTUM_BASE)}"
LONG = f"""{DAILY},
b AS (SELECT *, {MOMENTUM_BASE} AS b1, {REVERSION_BASE} AS b2, {VOL_BASE} AS b3, lead(ret) OVER (ORDER BY date) AS fwd FROM daily),
wide AS (SELECT date, price, fwd,
  {", ".join(f"{s}.0 * ((lag({x}) OVER (ORDER BY date)) - {_roll('avg', x, 250, 60, 1)}) / nullif({_roll('stddev_samp', x, 250, 60, 1)}, 0) AS {n}" for x, s, n in (("b1", 1, "alpha_momentum"), ("b2", -1, "alpha_mean_reversion"), ("b3", -1, "alpha_vol_managed")))}
  FROM b),
long AS (SELECT date, price, fwd, 'alpha_momentum' AS signal, alpha_momentum AS value FROM wide UNION ALL
         SELECT date, price, fwd, 'alpha_mean_reversion', alpha_mean_reversion FROM wide UNION ALL
         SELECT date, price, fwd, 'alpha_vol_managed', alpha_vol_managed FROM wide)"""
PREDICTIONS = f"{MOMENTUM}, predictions AS (SELECT date, 1 / (1 + exp(-value)) AS probability, fwd AS next_return, CAST(fwd > 0 AS INTEGER) AS target FROM zed WHERE value IS NOT NULL AND fwd IS NOT NULL)"


def _ledger(source: str, position: str, cost: str = "CAST(0.0002 AS DOUBLE)", by: str = "", extra: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    w = f"({part}ORDER BY date)"
    run = f"({part}ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""
placed AS (SELECT *, {position} AS position FROM {source}),
turned AS (SELECT *, coalesce(abs(position - lag(position) OVER {w}), abs(position)) AS turnover FROM placed),
netted AS (SELECT *, position * next_return - turnover * {cost} AS strategy_return FROM turned),
grown AS (SELECT *, product(1 + strategy_return) OVER {run} AS equity FROM netted),
ledger AS (SELECT *, equity / nullif(max(equity) OVER {run}, 0) - 1 AS drawdown FROM grown)"""


def _position(up: str) -> str:
    return f"CASE WHEN probability <= CAST(1 AS DOUBLE) - {up} THEN -1 WHEN probability >= {up} THEN 1 ELSE 0 END"


UP = "CAST(0.54 AS DOUBLE)"
METRICS = f"""{sig("max_by(equity, date) - 1", "total_return")},
 {r("CASE WHEN stddev_samp(strategy_return) = 0 THEN 0 ELSE sqrt(252) * avg(strategy_return) / stddev_samp(strategy_return) END", "annualised_sharpe", 6)},
 {sig("min(drawdown)", "max_drawdown")}, {r("avg(turnover)", "mean_turnover", 6)}"""


def _rank(c: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0"


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


# --- frames that the queries share ------------------------------------------


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: three price signals with fwd."""
    frame = market.daily_series(spark, sf_dir)
    frame = ft.vol_managed_signal(ft.mean_reversion_signal(ft.momentum_signal(frame)))
    return frame.withColumn("fwd", F.lead("return", 1).over(ts.spec()))


SIGNALS = ["alpha_momentum", "alpha_mean_reversion", "alpha_vol_managed"]


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.to_long(_signals(spark, sf_dir), SIGNALS, ["series_id", "date", "price", "fwd"])


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-probabilities of the momentum signal."""
    frame = ft.momentum_signal(market.daily_series(spark, sf_dir)).withColumn("next_return", F.lead("return", 1).over(ts.spec()))
    some = frame.where("alpha_momentum is not null and next_return is not null")
    return some.select("series_id", "date", (1.0 / (1.0 + F.exp(-F.col("alpha_momentum")))).alias("probability"), "next_return", (F.col("next_return") > 0).cast("int").alias("target"))


def _hourly_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.terciles_by_value(market.hourly_series(spark, sf_dir)).select("series_id", "date", "value", "regime")


HOURLY = """
hourly AS (SELECT date_trunc('hour', ts) AS date, CAST(sum(CAST(value AS DECIMAL(28,12))) AS DOUBLE) / count(value) AS value FROM events GROUP BY 1),
edges AS (SELECT list_distinct(quantile_cont(value, [0, 1.0/3, 2.0/3, 1])) AS e FROM hourly),
inner_edges AS (SELECT list_sort(e)[2:len(e) - 1] AS e FROM edges),
states AS (SELECT date, value, CAST(len(list_filter(i.e, lambda x: x < value)) AS INTEGER) AS regime FROM hourly, inner_edges i)"""


# --- series, features and signals -------------------------------------------


@query(f"WITH {DAILY} SELECT 'ALL' AS series_id, date, price, {r('ret', 'return')} FROM daily")
def daily_series(spark, sf_dir):
    return rounded(market.daily_series(spark, sf_dir))


@query(f"WITH {DAILY} SELECT 'ALL' AS series_id, date, price FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
def date_range(spark, sf_dir):
    """Rows between two labels, both included."""
    return market.daily_series(spark, sf_dir).where(F.col("date").between("1996-01-01", "1996-06-30")).select("series_id", "date", "price")


_FEATURES = [f"lag(ret, {k}) OVER (ORDER BY date) AS return_lag_{k}" for k in ft.LAGS]
for _n in ft.WINDOWS:
    _FEATURES += [
        f"lag(price, 1) OVER (ORDER BY date) / nullif(lag(price, {_n + 1}) OVER (ORDER BY date), 0) - 1 AS momentum_{_n}",
        f"{_roll('stddev_samp', 'ret', _n, _n, 1)} AS volatility_{_n}",
        f"price / nullif({_roll('max', 'price', _n, _n, 1)}, 0) - 1 AS drawdown_{_n}",
    ]
FEATURE_NAMES = [f"return_lag_{k}" for k in ft.LAGS] + [f"{kind}_{n}" for n in ft.WINDOWS for kind in ("momentum", "volatility", "drawdown")]
FEATURES = f"{DAILY}, f AS (SELECT date, price, ret, {', '.join(_FEATURES)}, CAST(lead(ret) OVER (ORDER BY date) > 0 AS INTEGER) AS target, lead(ret) OVER (ORDER BY date) AS next_return FROM daily), features AS (SELECT * FROM f WHERE next_return IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURE_NAMES)})"


@query(f"WITH {FEATURES} SELECT 'ALL' AS series_id, date, price, {r('ret', 'return')}, {', '.join(r(c, c) for c in FEATURE_NAMES)}, target, {r('next_return', 'next_return')} FROM features")
def features_all(spark, sf_dir):
    return rounded(ft.build_features(market.daily_series(spark, sf_dir)))


def _signal_sql(base: str, sign: int, name: str) -> str:
    return f"WITH {DAILY}, {_z(base, sign)} SELECT 'ALL' AS series_id, date, {r('value', name)} FROM zed"


@query(_signal_sql(MOMENTUM_BASE, 1, "alpha_momentum"))
def signal_momentum(spark, sf_dir):
    return rounded(ft.momentum_signal(market.daily_series(spark, sf_dir)).select("series_id", "date", "alpha_momentum"))


@query(_signal_sql(REVERSION_BASE, -1, "alpha_mean_reversion"))
def signal_mean_reversion(spark, sf_dir):
    return rounded(ft.mean_reversion_signal(market.daily_series(spark, sf_dir)).select("series_id", "date", "alpha_mean_reversion"))


@query(_signal_sql(VOL_BASE, -1, "alpha_vol_managed"))
def signal_vol_managed(spark, sf_dir):
    return rounded(ft.vol_managed_signal(market.daily_series(spark, sf_dir)).select("series_id", "date", "alpha_vol_managed"))


def _uniform(part: int, seed: int, *key: str) -> str:
    """The draw of ``ts.uniform`` in SQL."""
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(key)})), {1 + 13 * part}, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / {1 << 52}::DOUBLE"


_DAY = "CAST(date AS VARCHAR)"


@query(f"""WITH {DAILY} SELECT 'ALL' AS series_id, date, {r(f"sqrt(-2 * ln({_uniform(0, 3, chr(39) + 'ALL' + chr(39), _DAY)})) * cos(({_uniform(1, 3, chr(39) + 'ALL' + chr(39), _DAY)}) * 6.283185307179586::DOUBLE)", 'alpha_placebo')} FROM daily""")
def signal_placebo(spark, sf_dir):
    return rounded(ft.placebo_signal(market.daily_series(spark, sf_dir), seed=3).select("series_id", "date", "alpha_placebo"))


@query()
def signal_regime_transition(spark, sf_dir):
    posteriors = regimes.walk_forward_posteriors(market.daily_series(spark, sf_dir), models.MIN_TRAIN, models.TEST)
    return ft.regime_transition_signal(posteriors).select("series_id", "date", "alpha_regime_transition")


# --- evaluation -------------------------------------------------------------

PAIRS = "pairs AS (SELECT signal, date, value, fwd FROM long WHERE value IS NOT NULL AND fwd IS NOT NULL)"


@query(f"WITH {LONG}, {PAIRS}, k AS (SELECT signal, {_rank('value', 'signal')} AS a, {_rank('fwd', 'signal')} AS b FROM pairs) SELECT 'ALL' AS series_id, signal, count(*) AS n, {r('CASE WHEN count(*) >= 10 THEN ' + _corr('a', 'b') + ' END', 'ic')} FROM k GROUP BY signal")
def ic_full(spark, sf_dir):
    return rounded(ev.information_coefficient(_long(spark, sf_dir)))


_HORIZONS = " UNION ALL ".join(f"SELECT signal, {h} AS horizon, value, lead(price, {h}) OVER (PARTITION BY signal ORDER BY date) / nullif(price, 0) - 1 AS fwd_h FROM long" for h in (1, 5, 10, 20))


@query(f"WITH {LONG}, h AS ({_HORIZONS}), p AS (SELECT * FROM h WHERE value IS NOT NULL AND fwd_h IS NOT NULL), k AS (SELECT signal, horizon, {_rank('value', 'signal, horizon')} AS a, {_rank('fwd_h', 'signal, horizon')} AS b FROM p) SELECT 'ALL' AS series_id, signal, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, {r(_corr('a', 'b'), 'ic')} FROM k GROUP BY signal, horizon")
def ic_decay(spark, sf_dir):
    return rounded(ev.ic_decay(_long(spark, sf_dir)))


_BLOCKS = f"cut AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY signal ORDER BY date) - 1) / 60) AS INTEGER) AS block FROM pairs), k AS (SELECT signal, block, {_rank('value', 'signal, block')} AS a, {_rank('fwd', 'signal, block')} AS b FROM cut), blocks AS (SELECT signal, block, count(*) AS n, {_corr('a', 'b')} AS ic FROM k GROUP BY signal, block HAVING count(*) = 60)"


@query(f"WITH {LONG}, {PAIRS}, {_BLOCKS} SELECT 'ALL' AS series_id, signal, block, n, {r('ic', 'ic')} FROM blocks")
def ic_blocks(spark, sf_dir):
    return rounded(ev.block_ic(_long(spark, sf_dir)))


_TSTAT = f"count(ic) AS n, {r('avg(ic)', 'mean_ic')}, {r('CASE WHEN count(ic) >= 2 THEN avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) END', 't_stat', 6)}"


@query(f"WITH {LONG}, {PAIRS}, {_BLOCKS} SELECT 'ALL' AS series_id, signal, {_TSTAT} FROM blocks GROUP BY signal")
def ic_blocks_tstat(spark, sf_dir):
    return rounded(ev.non_overlapping_ic_t_stat(_long(spark, sf_dir)).withColumn("t_stat", F.round("t_stat", 6)))


_ROLLING = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY date) AS rn FROM pairs),
win AS (SELECT x.signal, x.date AS day, x.rn, y.value, y.fwd FROM numbered x JOIN numbered y ON y.signal = x.signal AND y.rn BETWEEN x.rn - 59 AND x.rn WHERE x.rn >= 60),
rolled AS (SELECT signal, day, {_rank('value', 'signal, day')} AS a, {_rank('fwd', 'signal, day')} AS b FROM win),
rolling AS (SELECT signal, day, {_corr('a', 'b')} AS ic FROM rolled GROUP BY signal, day)"""


@query(f"WITH {LONG}, {PAIRS}, {_ROLLING} SELECT 'ALL' AS series_id, signal, day AS date, {r('ic', 'ic')} FROM rolling")
def ic_rolling(spark, sf_dir):
    return rounded(ev.rolling_ic(_long(spark, sf_dir)))


@query(f"WITH {LONG}, {PAIRS}, {_ROLLING} SELECT 'ALL' AS series_id, signal, {_TSTAT} FROM rolling GROUP BY signal")
def ic_rolling_tstat(spark, sf_dir):
    return rounded(ev.ic_t_stat(ev.rolling_ic(_long(spark, sf_dir))).withColumn("t_stat", F.round("t_stat", 6)))


@query(f"WITH {LONG}, present AS (SELECT signal, date, value, lag(value) OVER (PARTITION BY signal ORDER BY date) AS prev FROM long WHERE value IS NOT NULL) SELECT 'ALL' AS series_id, signal, count(*) AS n, {r('corr(value, prev)', 'autocorrelation')} FROM present WHERE prev IS NOT NULL GROUP BY signal")
def signal_autocorr(spark, sf_dir):
    return rounded(ev.signal_autocorrelation(_long(spark, sf_dir)))


@query(f"WITH {LONG}, present AS (SELECT signal, date, sign(value) AS s FROM long WHERE value IS NOT NULL), c AS (SELECT signal, coalesce(abs(s - lag(s) OVER (PARTITION BY signal ORDER BY date)) > 0, false) AS c FROM present) SELECT 'ALL' AS series_id, signal, {r('avg(CAST(c AS DOUBLE))', 'turnover')} FROM c GROUP BY signal")
def implied_turnover(spark, sf_dir):
    return rounded(ev.implied_turnover(_long(spark, sf_dir)))


@query(f"""WITH {LONG}, {PAIRS}, e AS (SELECT signal, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM pairs GROUP BY signal),
binned AS (SELECT p.signal, p.fwd, len(list_filter(e.e[2:len(e.e) - 1], lambda x: x < p.value)) AS bin FROM pairs p JOIN e USING (signal))
SELECT 'ALL' AS series_id, signal, 'bin_' || bin AS bin, {r('avg(fwd)', 'mean_return')}, count(*) AS n FROM binned GROUP BY signal, bin""")
def quantile_returns(spark, sf_dir):
    return rounded(ev.quantile_returns(_long(spark, sf_dir)))


@query(f"""WITH {LONG}, {PAIRS}, p AS (SELECT *, sign(value) AS pos FROM pairs), n AS (SELECT signal, pos * fwd - coalesce(abs(pos - lag(pos) OVER (PARTITION BY signal ORDER BY date)), abs(pos)) * CAST(0.0002 AS DOUBLE) AS net FROM p)
SELECT 'ALL' AS series_id, signal, {r('CASE WHEN stddev_samp(net) = 0 THEN 0 ELSE sqrt(252) * avg(net) / stddev_samp(net) END', 'sharpe')} FROM n GROUP BY signal""")
def signal_sharpe(spark, sf_dir):
    return rounded(ev.signal_sharpe(_long(spark, sf_dir)))


_T = "CASE WHEN count(ic) >= 2 THEN avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) END"
_REPORT = f"""{_ROLLING}, naive AS (SELECT signal, {_T} AS t FROM rolling GROUP BY signal),
{_BLOCKS}, block_t AS (SELECT signal, {_T} AS t FROM blocks GROUP BY signal),
fr AS (SELECT signal, {_rank('value', 'signal')} AS a, {_rank('fwd', 'signal')} AS b FROM pairs), whole AS (SELECT signal, count(*) AS n, {_corr('a', 'b')} AS ic FROM fr GROUP BY signal),
h AS ({_HORIZONS}), hp AS (SELECT * FROM h WHERE value IS NOT NULL AND fwd_h IS NOT NULL), hk AS (SELECT signal, horizon, {_rank('value', 'signal, horizon')} AS a, {_rank('fwd_h', 'signal, horizon')} AS b FROM hp),
decays AS (SELECT signal, horizon, {_corr('a', 'b')} AS ic FROM hk GROUP BY signal, horizon), decay AS (SELECT signal, {", ".join(f"max(ic) FILTER (horizon = {h}) AS d{h}" for h in (1, 5, 10, 20))} FROM decays GROUP BY signal),
there AS (SELECT signal, date, value, sign(value) AS s, lag(value) OVER (PARTITION BY signal ORDER BY date) AS prev FROM long WHERE value IS NOT NULL), ac AS (SELECT signal, corr(value, prev) AS ac FROM there WHERE prev IS NOT NULL GROUP BY signal),
flips AS (SELECT signal, coalesce(abs(s - lag(s) OVER (PARTITION BY signal ORDER BY date)) > 0, false) AS c FROM there), turn AS (SELECT signal, avg(CAST(c AS DOUBLE)) AS turnover FROM flips GROUP BY signal),
cutpoints AS (SELECT signal, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM pairs GROUP BY signal),
binned AS (SELECT p.signal, p.fwd, len(list_filter(c.e[2:len(c.e) - 1], lambda x: x < p.value)) AS bin FROM pairs p JOIN cutpoints c USING (signal)),
bins AS (SELECT signal, {", ".join(f"avg(fwd) FILTER (bin = {b}) AS m{b}, count(*) FILTER (bin = {b}) AS n{b}" for b in range(5))} FROM binned GROUP BY signal),
pos AS (SELECT *, sign(value) AS pos FROM pairs), net AS (SELECT signal, pos * fwd - coalesce(abs(pos - lag(pos) OVER (PARTITION BY signal ORDER BY date)), abs(pos)) * CAST(0.0002 AS DOUBLE) AS net FROM pos),
sh AS (SELECT signal, CASE WHEN stddev_samp(net) = 0 THEN 0 ELSE sqrt(252) * avg(net) / stddev_samp(net) END AS sharpe FROM net GROUP BY signal)"""
_REPORT_COLUMNS = [("naive.t", "naive_t_stat", 5), ("block_t.t", "block_t_stat", 5), *[(f"d{h}", f"decay_{h}", 8) for h in (1, 5, 10, 20)], ("ac.ac", "autocorrelation", 8), ("turnover", "turnover", 8), *[(f"m{b}", f"bin_{b}", 8) for b in range(5)], ("sharpe", "sharpe", 6)]


@query(f"WITH {LONG}, {PAIRS}, {_REPORT} SELECT 'ALL' AS series_id, signal, whole.n, {r('whole.ic', 'ic')}, {', '.join(r(*x) for x in _REPORT_COLUMNS)}, {', '.join(f'n{b} AS bin_{b}_n' for b in range(5))} FROM whole JOIN naive USING (signal) JOIN block_t USING (signal) JOIN decay USING (signal) JOIN ac USING (signal) JOIN turn USING (signal) JOIN bins USING (signal) JOIN sh USING (signal)")
def alpha_reports(spark, sf_dir):
    """The whole report of three signals, its map and its list of bins as columns."""
    report = ev.alpha_report(_long(spark, sf_dir))
    decay = [F.col("decay")[h].alias(f"decay_{h}") for h in (1, 5, 10, 20)]
    bins = [F.get("bins", F.lit(b))["mean_return"].alias(f"bin_{b}") for b in range(5)] + [F.get("bins", F.lit(b))["n"].alias(f"bin_{b}_n") for b in range(5)]
    five = [F.round(c, 5).alias(c) for c in ("naive_t_stat", "block_t_stat")]
    return rounded(report.select("series_id", "signal", "n", "ic", *five, *decay, "autocorrelation", "turnover", *bins, F.round("sharpe", 6).alias("sharpe")))


_NAMES = [(a, b) for a in SIGNALS for b in SIGNALS]


@query(f"WITH {LONG} " + " UNION ALL ".join(f"SELECT 'ALL' AS series_id, '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'rho')} FROM wide" for a, b in _NAMES))
def signal_corr_matrix(spark, sf_dir):
    return rounded(ev.signal_correlation(_signals(spark, sf_dir), SIGNALS))


_ZS = ", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS z{i}" for i, c in enumerate(SIGNALS))


@query(f"WITH {LONG}, z AS (SELECT date, {_ZS} FROM wide) SELECT 'ALL' AS series_id, date, {r('(coalesce(z0, 0) + coalesce(z1, 0) + coalesce(z2, 0)) / nullif((z0 IS NOT NULL)::INTEGER + (z1 IS NOT NULL)::INTEGER + (z2 IS NOT NULL)::INTEGER, 0)', 'combined')} FROM z")
def combine_equal(spark, sf_dir):
    return rounded(ev.combine_equal_weight(_signals(spark, sf_dir), SIGNALS).select("series_id", "date", "combined"))


@query(f"""WITH {LONG}, {PAIRS}, k AS (SELECT signal, {_rank('value', 'signal')} AS a, {_rank('fwd', 'signal')} AS b FROM pairs), i AS (SELECT signal, corr(a, b) AS ic FROM k GROUP BY signal),
wt AS (SELECT {", ".join(f"max(ic) FILTER (signal = '{c}') / (SELECT sum(abs(ic)) FROM i) AS w{j}" for j, c in enumerate(SIGNALS))} FROM i), z AS (SELECT date, {_ZS} FROM wide)
SELECT 'ALL' AS series_id, date, {r('coalesce(z0 * w0, 0) + coalesce(z1 * w1, 0) + coalesce(z2 * w2, 0)', 'combined')} FROM z, wt""")
def combine_ic(spark, sf_dir):
    return rounded(ev.combine_ic_weighted(_signals(spark, sf_dir), SIGNALS).select("series_id", "date", "combined"))


_RIDGE = f"""c AS (SELECT date, {", ".join(SIGNALS)}, fwd FROM wide WHERE {" AND ".join(f"{x} IS NOT NULL" for x in [*SIGNALS, "fwd"])}),
z AS (SELECT date, fwd, {_ZS} FROM c),
g AS (SELECT {", ".join(f"count(*) * covar_pop(z{i}, z{j}) + {int(i == j)} AS a{i}{j}" for i in range(3) for j in range(i, 3))}, {", ".join(f"count(*) * covar_pop(z{i}, fwd) AS y{i}" for i in range(3))} FROM z),
m AS (SELECT *, a11 * a22 - a12 * a12 AS c00, a02 * a12 - a01 * a22 AS c01, a01 * a12 - a02 * a11 AS c02, a00 * a22 - a02 * a02 AS c11, a01 * a02 - a00 * a12 AS c12, a00 * a11 - a01 * a01 AS c22 FROM g),
beta AS (SELECT (c00 * y0 + c01 * y1 + c02 * y2) / d AS b0, (c01 * y0 + c11 * y1 + c12 * y2) / d AS b1, (c02 * y0 + c12 * y1 + c22 * y2) / d AS b2 FROM (SELECT *, a00 * c00 + a01 * c01 + a02 * c02 AS d FROM m))"""


@query(f"WITH {LONG}, {_RIDGE} SELECT 'ALL' AS series_id, date, {r('coalesce(z0, 0) * b0 + coalesce(z1, 0) * b1 + coalesce(z2, 0) * b2', 'combined')} FROM z, beta")
def combine_ridge(spark, sf_dir):
    return rounded(ev.combine_ridge(_signals(spark, sf_dir), SIGNALS).select("series_id", "date", "combined"))


@query(f"""WITH {LONG}, c AS (SELECT date, alpha_momentum AS x, alpha_mean_reversion AS y, alpha_vol_managed AS v FROM wide WHERE alpha_momentum IS NOT NULL AND alpha_mean_reversion IS NOT NULL AND alpha_vol_managed IS NOT NULL),
o1 AS (SELECT *, y - avg(y) OVER () - covar_pop(y, x) OVER () / nullif(var_pop(x) OVER (), 0) * (x - avg(x) OVER ()) AS y1 FROM c),
o2 AS (SELECT *, v - avg(v) OVER () - covar_pop(v, x) OVER () / nullif(var_pop(x) OVER (), 0) * (x - avg(x) OVER ()) - covar_pop(v, y1) OVER () / nullif(var_pop(y1) OVER (), 0) * (y1 - avg(y1) OVER ()) AS v1 FROM o1)
SELECT 'ALL' AS series_id, date, {r('x', 'alpha_momentum')}, {r('y1', 'alpha_mean_reversion')}, {r('v1', 'alpha_vol_managed')} FROM o2""")
def orthogonal_residuals(spark, sf_dir):
    return rounded(ev.orthogonalize(_signals(spark, sf_dir), SIGNALS).select("series_id", "date", *SIGNALS))


# --- backtests and sizing ---------------------------------------------------


@query(f"WITH {PREDICTIONS}, {_ledger('predictions', _position(UP))} SELECT 'ALL' AS series_id, date, {r('probability', 'probability')}, CAST(position AS INTEGER) AS position, CAST(turnover AS INTEGER) AS turnover, {r('strategy_return', 'strategy_return')}, {sig('equity', 'equity')}, {sig('drawdown', 'drawdown')} FROM ledger")
def backtest_ledger(spark, sf_dir):
    ledger = bt.run_backtest(_predictions(spark, sf_dir))
    columns = ["series_id", "date", "probability", "position", "turnover", "strategy_return"]
    return rounded_ledger(ledger, columns)


@query(f"WITH {PREDICTIONS}, {_ledger('predictions', _position(UP))} SELECT 'ALL' AS series_id, {METRICS}, {r('avg(CAST(position <> 0 AS DOUBLE))', 'active_days', 6)} FROM ledger")
def momentum_backtest(spark, sf_dir):
    return metric_row(bt.backtest_metrics(bt.run_backtest(_predictions(spark, sf_dir))))


@query(f"WITH {PREDICTIONS}, long_only AS (SELECT date, CAST(1 AS DOUBLE) AS probability, next_return FROM predictions), {_ledger('long_only', '1')} SELECT 'ALL' AS series_id, {METRICS}, {r('avg(CAST(position <> 0 AS DOUBLE))', 'active_days', 6)} FROM ledger")
def buy_and_hold(spark, sf_dir):
    return metric_row(bt.backtest_metrics(bt.buy_and_hold(_predictions(spark, sf_dir))))


@query(f"""WITH {PREDICTIONS}, drawn AS (SELECT date, {_uniform(0, 0, "'ALL'", _DAY)} AS probability, next_return FROM predictions), {_ledger('drawn', _position(UP))} SELECT 'ALL' AS series_id, {METRICS}, {r('avg(CAST(position <> 0 AS DOUBLE))', 'active_days', 6)} FROM ledger""")
def random_signal(spark, sf_dir):
    return metric_row(bt.backtest_metrics(bt.random_signal(_predictions(spark, sf_dir), seed=0)))


_VOL_VIEW = f"vols AS (SELECT *, {_position(UP)} AS direction, {_roll('stddev_samp', 'next_return', 20, 20, 1)} AS vol FROM predictions)"
_VOL_POSITION = "direction * CASE WHEN nullif(vol, 0) IS NULL THEN 0 ELSE least(CAST(0.01 AS DOUBLE) / nullif(vol, 0), 3.0::DOUBLE) END"


@query(f"WITH {PREDICTIONS}, {_VOL_VIEW}, {_ledger('vols', _VOL_POSITION)} SELECT 'ALL' AS series_id, date, CAST(direction AS INTEGER) AS direction, {r('position', 'position')}, {r('turnover', 'turnover')}, {r('strategy_return', 'strategy_return')}, {sig('equity', 'equity')}, {sig('drawdown', 'drawdown')} FROM ledger")
def vol_target_ledger(spark, sf_dir):
    ledger = bt.run_vol_targeted_backtest(_predictions(spark, sf_dir))
    return rounded_ledger(ledger, ["series_id", "date", "direction", "position", "turnover", "strategy_return"])


@query(f"WITH {PREDICTIONS}, {_VOL_VIEW}, {_ledger('vols', _VOL_POSITION)} SELECT 'ALL' AS series_id, {METRICS}, {r('avg(CAST(direction <> 0 AS DOUBLE))', 'active_days', 6)}, {r('avg(abs(position))', 'mean_gross_leverage', 6)} FROM ledger")
def vol_target_metrics(spark, sf_dir):
    return metric_row(bt.backtest_metrics(bt.run_vol_targeted_backtest(_predictions(spark, sf_dir))))


THRESHOLDS, COSTS, LOOKBACKS = [0.50, 0.52, 0.54, 0.56, 0.58], [0.0, 0.0002, 0.0005, 0.001], [5, 10, 20, 60, 120, 250]
_GRID = f"grid AS (SELECT p.*, t.threshold, c.cost FROM predictions p, (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in THRESHOLDS)}]) AS threshold) t, (SELECT unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in COSTS)}]) AS cost) c)"


@query(f"WITH {PREDICTIONS}, {_GRID}, {_ledger('grid', _position('threshold'), 'cost', 'threshold, cost')} SELECT 'ALL' AS series_id, threshold, cost, {METRICS}, {r('avg(CAST(position <> 0 AS DOUBLE))', 'active_days', 6)} FROM ledger GROUP BY threshold, cost")
def threshold_cost_grid(spark, sf_dir):
    return metric_row(bt.grid_backtest(_predictions(spark, sf_dir), THRESHOLDS, COSTS))


_LOOK = " UNION ALL ".join(f"SELECT date, lead(ret) OVER (ORDER BY date) AS next_return, {k} AS lookback, price / nullif(lag(price, {k}) OVER (ORDER BY date), 0) - 1 AS m FROM daily" for k in LOOKBACKS)


@query(f"WITH {DAILY}, l AS ({_LOOK}), g AS (SELECT l.*, c.cost FROM l, (SELECT unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in COSTS[:3])}]) AS cost) c WHERE m IS NOT NULL AND next_return IS NOT NULL), {_ledger('g', 'sign(m)', 'cost', 'lookback, cost')} SELECT 'ALL' AS series_id, CAST(lookback AS INTEGER) AS lookback, cost, count(*) AS n, {r('CASE WHEN stddev_samp(strategy_return) = 0 THEN 0 ELSE sqrt(252) * avg(strategy_return) / stddev_samp(strategy_return) END', 'sharpe', 6)} FROM ledger GROUP BY lookback, cost")
def lookback_cost_grid(spark, sf_dir):
    return rounded(bt.lookback_grid(market.daily_series(spark, sf_dir), LOOKBACKS, COSTS[:3]), 6)


@query(f"WITH {PREDICTIONS}, e AS (SELECT sign(probability - 0.5) * next_return AS e FROM predictions) SELECT 'ALL' AS series_id, {r('CASE WHEN var_samp(e) = 0 THEN 0 ELSE avg(e) / var_samp(e) END', 'kelly')}, {r('0.5 * CASE WHEN var_samp(e) = 0 THEN 0 ELSE avg(e) / var_samp(e) END', 'half_kelly')} FROM e")
def kelly(spark, sf_dir):
    edge = _predictions(spark, sf_dir).select("series_id", bt.edge_return().alias("e"))
    return rounded(edge.groupBy("series_id").agg(bt.kelly_fraction("e").alias("kelly"), bt.fractional_kelly("e").alias("half_kelly")))


@query(f"WITH {DAILY} SELECT 'ALL' AS series_id, {r('CASE WHEN stddev_pop(ret) = 0 THEN 0 ELSE sqrt(252) * avg(ret) / stddev_pop(ret) END', 'sharpe')} FROM daily")
def annualized_sharpe(spark, sf_dir):
    return rounded(market.daily_series(spark, sf_dir).groupBy("series_id").agg(bt.annualized_sharpe("return").alias("sharpe")))


@query(f"WITH {DAILY} SELECT 'ALL' AS series_id, count(*) AS n, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'std')}, {r('skewness(ret)', 'skew', 6)}, {r('kurtosis(ret)', 'kurtosis', 6)} FROM daily")
def return_moments(spark, sf_dir):
    made = st.moments(market.daily_series(spark, sf_dir), "return")
    return rounded(made.withColumns({"skew": F.round("skew", 6), "kurtosis": F.round("kurtosis", 6)}))


# --- panels -----------------------------------------------------------------

BRANDS = """
bp AS (SELECT p_brand AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0) AS price
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
full_months AS (SELECT date FROM bp GROUP BY date HAVING count(*) = (SELECT count(DISTINCT series_id) FROM bp)),
panel AS (SELECT * FROM (SELECT series_id, date, price, price / nullif(lag(price) OVER (PARTITION BY series_id ORDER BY date), 0) - 1 AS ret FROM bp WHERE date IN (SELECT date FROM full_months)) WHERE ret IS NOT NULL)"""
COV = "dev AS (SELECT date AS t, series_id AS asset, ret - avg(ret) OVER (PARTITION BY series_id) AS d FROM panel), cov AS (SELECT a.asset AS i, b.asset AS j, sum(a.d * b.d) / (count(*) - 1) AS cov FROM dev a JOIN dev b USING (t) GROUP BY 1, 2)"


def _panel(spark, sf_dir) -> DataFrame:
    return market.brand_panel(spark, sf_dir).select(F.col("date").alias("t"), F.col("series_id").alias("asset"), F.col("return").alias("r"))


@query(f"WITH {BRANDS} SELECT series_id, date, price, {r('ret', 'return')} FROM panel")
def brand_panel(spark, sf_dir):
    return rounded(market.brand_panel(spark, sf_dir))


@query(f"WITH {BRANDS}, {COV} SELECT i, j, {r('cov', 'cov')} FROM cov")
def panel_covariance(spark, sf_dir):
    return rounded(tiles.panel_covariance(_panel(spark, sf_dir)))


@query(f"WITH {BRANDS}, {COV}, v AS (SELECT i, cov FROM cov WHERE i = j) SELECT c.i, c.j, {r('c.cov / sqrt(x.cov * y.cov)', 'rho')} FROM cov c JOIN v x ON x.i = c.i JOIN v y ON y.i = c.j")
def panel_corr(spark, sf_dir):
    return rounded(tiles.correlation(tiles.panel_covariance(_panel(spark, sf_dir))))


@query(f"""WITH {BRANDS}, dev AS (SELECT date AS t, series_id AS asset, ret - avg(ret) OVER (PARTITION BY series_id) AS d FROM panel),
s AS (SELECT a.asset AS i, b.asset AS j, sum(a.d * b.d) / count(*) AS s, count(*) AS n FROM dev a JOIN dev b USING (t) GROUP BY 1, 2),
k AS (SELECT sum(CASE WHEN i = j THEN s END) / count(DISTINCT i) AS mu, sum(s * s) AS f, max(n) AS n FROM s),
g AS (SELECT sum((s.s - CASE WHEN s.i = s.j THEN k.mu ELSE 0 END) ** 2) AS gamma FROM s, k),
p AS (SELECT avg(q * q) AS m4 FROM (SELECT t, sum(d * d) AS q FROM dev GROUP BY t))
SELECT k.n AS n_obs, {r('least(1, greatest(0, (p.m4 - k.f) / g.gamma / k.n))', 'delta', 6)} FROM k, g, p""")
def ledoit_wolf_delta(spark, sf_dir):
    return rounded(tiles.ledoit_wolf(_panel(spark, sf_dir))[1], 6)


@query(f"""WITH e AS (SELECT vec_id AS t, unnest(range(len(embedding))) AS asset, unnest(embedding)::DOUBLE AS x FROM embeddings), dev AS (SELECT t, asset, x - avg(x) OVER (PARTITION BY asset) AS d FROM e)
SELECT a.asset AS i, b.asset AS j, {r('sum(a.d * b.d) / (count(*) - 1)', 'cov')} FROM dev a JOIN dev b USING (t) GROUP BY 1, 2""")
def embedding_covariance(spark, sf_dir):
    return rounded(tiles.array_covariance(market.table(spark, sf_dir, "embeddings"), "embedding", width=16))


_SQUARED = "[[list_dot_product(a, b) FOR b IN m] FOR a IN m]"


@query(f"""WITH RECURSIVE e AS (SELECT vec_id AS t, unnest(range(len(embedding))) AS asset, unnest(embedding)::DOUBLE AS x FROM embeddings), dev AS (SELECT t, asset, x - avg(x) OVER (PARTITION BY asset) AS d FROM e),
cov AS (SELECT a.asset AS i, b.asset AS j, sum(a.d * b.d) / (count(*) - 1) AS c FROM dev a JOIN dev b USING (t) GROUP BY 1, 2),
c AS MATERIALIZED (SELECT list(l ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS l FROM cov GROUP BY i)),
p AS (SELECT 0 AS k, [[x / list_sum([m[i][i] FOR i IN range(1, len(m) + 1)]) FOR x IN a] FOR a IN m] AS m FROM c
  UNION ALL SELECT k + 1, [[x / list_sum([s[i][i] FOR i IN range(1, len(s) + 1)]) FOR x IN a] FOR a IN s] FROM (SELECT k, {_SQUARED} AS s FROM p WHERE k < 24)),
v AS (SELECT list_sum([list_dot_product(c.m[i], p.m[i]) FOR i IN range(1, len(p.m) + 1)]) AS top, list_sum([c.m[i][i] FOR i IN range(1, len(c.m) + 1)]) AS trace FROM p, c WHERE k = 24)
SELECT {r('top', 'eigenvalue')}, {r('top / trace', 'share')} FROM v""")
def embedding_first_factor(spark, sf_dir):
    """The largest eigenvalue of the covariance and its share (in SQL by squaring the matrix until one eigenvector is left)."""
    values, _, trace = tiles.leading_eigenpairs(market.table(spark, sf_dir, "embeddings"), 1, "embedding")
    return rounded(spark.createDataFrame([(float(values[0]), float(values[0]) / trace)], "eigenvalue double, share double"))


@query()
def embedding_leading(spark, sf_dir):
    """The eight leading eigenvalues of the correlation, their shares, and whether they exceed the noise edge."""
    vectors = market.table(spark, sf_dir, "embeddings")
    values, loadings, trace = tiles.leading_eigenpairs(vectors, 8, "embedding", of_correlation=True)
    edge = portfolio.marchenko_pastur_bounds(len(loadings), vectors.count())[1]
    return rounded(spark.createDataFrame([(k, float(v), float(v) / trace, bool(v > edge)) for k, v in enumerate(values)], "k int, eigenvalue double, share double, signal boolean"))


@query()
def embedding_spectrum(spark, sf_dir):
    """Eigenvalues, their shares, and whether they exceed the noise edge."""
    vectors = market.table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    data = portfolio.cross_products(vectors)
    values, _ = portfolio.eigen_descending(data.correlation())
    edge = portfolio.marchenko_pastur_bounds(values.size, data.n_obs)[1]
    share = portfolio.explained_variance_ratio(values)
    return spark.createDataFrame([(k, round(float(v), 8), round(float(s), 8), bool(v > edge)) for k, (v, s) in enumerate(zip(values, share, strict=True))], "k int, eigenvalue double, share double, signal boolean")


_CROSS = f"""ranked AS (SELECT date, series_id, ret, row_number() OVER (PARTITION BY date ORDER BY ret, series_id) AS k, count(*) OVER (PARTITION BY date) AS n FROM panel),
bucketed AS (SELECT *, (SELECT count(*) FROM (SELECT unnest([1, 2, 3, 4]) AS q) WHERE 1.0::DOUBLE + (n - 1) * (q / 5.0::DOUBLE) < k) AS bucket FROM ranked),
weights AS (SELECT date, series_id, CASE bucket WHEN 4 THEN 0.5 / count(*) OVER (PARTITION BY date, bucket) WHEN 0 THEN -0.5 / count(*) OVER (PARTITION BY date, bucket) ELSE 0 END AS weight FROM bucketed)"""


@query(f"WITH {BRANDS}, {_CROSS} SELECT series_id, date, {r('weight', 'weight')} FROM weights")
def quantile_ls_weights(spark, sf_dir):
    return rounded(portfolio.quantile_long_short(market.brand_panel(spark, sf_dir), "return", ["date"], "series_id").select("series_id", "date", "weight"))


@query(f"WITH {BRANDS}, {COV}, {_CROSS} SELECT a.date, {r('sum(a.weight * cov * b.weight)', 'variance')} FROM weights a JOIN cov ON cov.i = a.series_id JOIN weights b ON b.date = a.date AND b.series_id = cov.j GROUP BY a.date")
def weights_realized_variance(spark, sf_dir):
    panel = market.brand_panel(spark, sf_dir)
    weights = portfolio.quantile_long_short(panel, "return", ["date"], "series_id").select("date", F.col("series_id").alias("asset"), "weight")
    return rounded(portfolio.realized_variance(weights, tiles.panel_covariance(_panel(spark, sf_dir)), ["date"]))


@query()
def portfolio_comparison(spark, sf_dir):
    """Minimum-variance weights under the raw, denoised and shrunk covariance."""
    _, data = portfolio.panel_cross(_panel(spark, sf_dir))
    raw = data.covariance()
    found = {"sample": raw, "denoised": portfolio.denoise_covariance(raw, data.n_obs), "shrunk": portfolio.ledoit_wolf(data)[0]}
    rows = []
    for name, cov in found.items():
        w = portfolio.minimum_variance_weights(cov)
        rows.append((name, float(abs(w).sum()), float(w @ raw @ w)))
    return spark.createDataFrame(rows, "covariance string, gross double, variance double")


# --- folds, models, metrics -------------------------------------------------

_FOLDS = "n AS (SELECT count(*) AS n FROM features), folds AS (SELECT CAST(n AS INTEGER) AS n, unnest(range(800, n - 125, 125)) AS start FROM n)"


@query(f"WITH {FEATURES}, {_FOLDS} SELECT 'ALL' AS series_id, n, CAST((start - 800) / 125 AS INTEGER) AS fold, CAST(start AS INTEGER) AS start, CAST(greatest(start - 10, 0) AS INTEGER) AS train_rows, 125 AS test_rows FROM folds")
def fold_table(spark, sf_dir):
    return folds.fold_table(ft.build_features(market.daily_series(spark, sf_dir)), 800, 125, embargo=10)


@query(f"WITH {FEATURES}, {_FOLDS}, rows_ AS (SELECT row_number() OVER (ORDER BY date) - 1 AS rn, target FROM features) SELECT 'ALL' AS series_id, CAST((start - 800) / 125 AS INTEGER) AS fold, count(*) FILTER (rn < start - 30) AS train_rows, count(*) FILTER (rn >= start AND rn < start + 125) AS test_rows, sum(CASE WHEN rn < start - 30 THEN target ELSE 0 END)::BIGINT AS train_positives FROM folds, rows_ GROUP BY fold")
def fold_train_counts(spark, sf_dir):
    made = folds.fold_counts(ft.build_features(market.daily_series(spark, sf_dir)), 800, 125, [30])
    return made.drop("embargo")


@query(f"WITH {FEATURES}, {_FOLDS}, rows_ AS (SELECT row_number() OVER (ORDER BY date) - 1 AS rn, target FROM features), e AS (SELECT unnest([0, 10, 30]) AS embargo) SELECT 'ALL' AS series_id, CAST(embargo AS INTEGER) AS embargo, CAST((start - 800) / 125 AS INTEGER) AS fold, count(*) FILTER (rn < start - embargo) AS train_rows, count(*) FILTER (rn >= start AND rn < start + 125) AS test_rows, sum(CASE WHEN rn < start - embargo THEN target ELSE 0 END)::BIGINT AS train_positives FROM folds, rows_, e GROUP BY embargo, fold")
def embargo_counts(spark, sf_dir):
    return folds.fold_counts(ft.build_features(market.daily_series(spark, sf_dir)), 800, 125, [0, 10, 30])


@query(f"WITH {FEATURES}, {_FOLDS}, rows_ AS (SELECT row_number() OVER (ORDER BY date) - 1 AS rn, date, target FROM features) SELECT 'ALL' AS series_id, CAST((start - 800) / 125 AS INTEGER) AS fold, rn >= start AS is_test, count(*) AS n, min(date) AS first, max(date) AS last FROM folds JOIN rows_ ON rn < start - 10 OR (rn >= start AND rn < start + 125) GROUP BY 2, 3")
def fold_spans(spark, sf_dir):
    """Rows that each fold trains and tests on, as the fits get them."""
    rows = folds.expanding_rows(ft.build_features(market.daily_series(spark, sf_dir)).select("series_id", "date", "target"), 800, 125, embargo=10)
    return rows.groupBy("series_id", "fold", "is_test").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("""WITH s AS (SELECT CAST(d.n_chars AS DOUBLE) AS score, l.quality AS target FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL),
k AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM s)
SELECT 'quality' AS label, count(*) AS n, sum(target)::BIGINT AS positives, round((sum(k) FILTER (target = 1) - sum(target)::DOUBLE * (sum(target) + 1) / 2) / (sum(target)::DOUBLE * (count(*) - sum(target))), 8) + 0.0 AS auc FROM k""")
def auc_rank(spark, sf_dir):
    return rounded(models.auc(market.label_scores(spark, sf_dir).withColumn("label", F.lit("quality")), "score", "target", ["label"]))


@query(f"WITH {PREDICTIONS} SELECT 'ALL' AS series_id, count(*) AS n, {r('avg(CAST(CAST(probability >= 0.5 AS INTEGER) = target AS DOUBLE))', 'accuracy')} FROM predictions")
def accuracy(spark, sf_dir):
    return rounded(_predictions(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), models.accuracy().alias("accuracy")))


@query()
def walk_forward_logit(spark, sf_dir):
    frame = ft.build_features(market.daily_series(spark, sf_dir))
    return models.walk_forward_predictions(frame, FEATURE_NAMES, models.Logistic)


@query()
def walk_forward_boosting(spark, sf_dir):
    frame = ft.build_features(market.daily_series(spark, sf_dir))
    return models.walk_forward_predictions(frame, FEATURE_NAMES, models.Boosting)


@query()
def regime_conditioned_logit(spark, sf_dir):
    frame = ft.build_features(market.daily_series(spark, sf_dir))
    return models.regime_conditioned_predictions(frame, FEATURE_NAMES, models.Logistic)


@query()
def model_choice(spark, sf_dir):
    """The best of the candidate models by pooled walk-forward AUC, then accuracy."""
    frame = ft.build_features(market.daily_series(spark, sf_dir))
    made = None
    for name, make in models.candidate_models().items():
        one = models.validate(name, models.walk_forward_predictions(frame, FEATURE_NAMES, make)).metrics
        made = one if made is None else made.unionByName(one)
    return models.best_model(made)


_SCORED = " UNION ALL ".join(f"SELECT '{n}' AS model, 1 / (1 + exp(-{n})) AS p, CAST(fwd > 0 AS INTEGER) AS y FROM wide WHERE {n} IS NOT NULL AND fwd IS NOT NULL" for n in SIGNALS)


@query(f"""WITH {LONG}, s AS ({_SCORED}), k AS (SELECT *, {_rank('p', 'model')} AS k FROM s),
m AS (SELECT model, count(*) AS n, (sum(k) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0) AS auc, avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS DOUBLE)) AS accuracy FROM k GROUP BY model)
SELECT 'ALL' AS series_id, model, n, {r('auc', 'auc')}, {r('accuracy', 'accuracy')} FROM m ORDER BY auc DESC, accuracy DESC, model LIMIT 1""")
def best_signal_model(spark, sf_dir):
    """The choice among candidates whose predictions are given: each signal's pseudo-probability."""
    wide = _signals(spark, sf_dir)
    made = None
    for name in SIGNALS:
        some = wide.where(F.col(name).isNotNull() & F.col("fwd").isNotNull())
        scored = some.select("series_id", (1.0 / (1.0 + F.exp(-F.col(name)))).alias("probability"), (F.col("fwd") > 0).cast("int").alias("target"))
        one = models.validate(name, scored).metrics
        made = one if made is None else made.unionByName(one)
    return rounded(models.best_model(made).select("series_id", "model", "n", "auc", "accuracy"))


# --- regimes ----------------------------------------------------------------


@query(f"WITH {HOURLY} SELECT 'EVENTS' AS series_id, date, {r('value', 'value')}, regime FROM states")
def hourly_regimes(spark, sf_dir):
    return rounded(_hourly_regimes(spark, sf_dir))


@query(f"""WITH {HOURLY}, flagged AS (SELECT *, CASE WHEN lag(regime) OVER (ORDER BY date) IS DISTINCT FROM regime THEN 1 ELSE 0 END AS new FROM states), numbered AS (SELECT *, CAST(sum(new) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run FROM flagged)
SELECT 'EVENTS' AS series_id, run, any_value(regime) AS value, min(date) AS first, max(date) AS last, count(*) AS length FROM numbered GROUP BY run""")
def regime_spans(spark, sf_dir):
    return ts.runs(_hourly_regimes(spark, sf_dir), "regime")


@query(f"WITH {HOURLY}, p AS (SELECT lag(regime) OVER (ORDER BY date) AS from_state, regime AS to_state FROM states) SELECT 'EVENTS' AS series_id, from_state, to_state, count(*) AS n FROM p WHERE from_state IS NOT NULL GROUP BY 2, 3")
def regime_transition_counts(spark, sf_dir):
    return regimes.transition_counts(_hourly_regimes(spark, sf_dir))


_DETECTED = f"{HOURLY}, seen AS (SELECT date, regime, coalesce(lag(regime, 2) OVER (ORDER BY date), regime) AS aligned, row_number() OVER (ORDER BY date) AS i, lag(regime) OVER (ORDER BY date) AS before FROM states)"


def _detected(spark, sf_dir) -> DataFrame:
    """A detector that names each state two rows late."""
    frame = _hourly_regimes(spark, sf_dir)
    return frame.withColumn("aligned", F.coalesce(F.lag("regime", 2).over(ts.spec()), F.col("regime")))


@query(f"""WITH {_DETECTED}, lags AS (SELECT c.i, coalesce(min(d.i) - c.i, 30) AS lag FROM seen c LEFT JOIN seen d ON d.i BETWEEN c.i AND c.i + 29 AND d.aligned = c.regime WHERE c.regime <> c.before GROUP BY c.i)
SELECT 'EVENTS' AS series_id, count(*) AS changes, {r('avg(lag)', 'mean_lag')} FROM lags""")
def detection_lag(spark, sf_dir):
    return rounded(regimes.detection_lag(_detected(spark, sf_dir)))


@query(f"WITH {_DETECTED} SELECT 'EVENTS' AS series_id, regime AS true, aligned AS predicted, count(*) AS n FROM seen GROUP BY 2, 3")
def confusion(spark, sf_dir):
    return regimes.confusion(_detected(spark, sf_dir), "regime", "aligned")


_MEANS, _STDS = [0.0, 0.02, -0.02], [0.05, 0.1, 0.3]
_START = [float(x) for x in regimes.stationary_distribution(simulate.TRANSITION)]
_LIKE = ", ".join(f"exp(-0.5 * ((ret - ({m!r}::DOUBLE)) / {v!r}::DOUBLE) ** 2) / ({v!r}::DOUBLE * sqrt(2 * pi())) AS l{k}" for k, (m, v) in enumerate(zip(_MEANS, _STDS, strict=True)))
_MOVE = ", ".join("l{0} * ({1}) AS j{0}".format(k, " + ".join(f"p{i} * {float(simulate.TRANSITION[i][k])!r}::DOUBLE" for i in range(3))) for k in range(3))
_FILTER = f"""WITH RECURSIVE {DAILY}, likes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date) AS t, date, {_LIKE} FROM daily),
f AS (SELECT 0::BIGINT AS t, NULL::DATE AS date, {", ".join(f"{x!r}::DOUBLE AS p{k}" for k, x in enumerate(_START))}, 0::DOUBLE AS ll
  UNION ALL SELECT t, date, j0 / m, j1 / m, j2 / m, ll + ln(m) FROM (SELECT *, greatest(j0 + j1 + j2, 1e-300::DOUBLE) AS m FROM (SELECT likes.t, likes.date, f.ll, {_MOVE} FROM f JOIN likes ON likes.t = f.t + 1)))
SELECT 'ALL' AS series_id, date, {", ".join(r(f"p{k}", f"p{k}", 7) for k in range(3))}, {r("ll", "log_likelihood", 5)} FROM f WHERE t > 0"""


@query(_FILTER)
def hamilton_filter(spark, sf_dir):
    made = regimes.hamilton_filter(market.daily_series(spark, sf_dir), simulate.TRANSITION, _MEANS, _STDS)
    return rounded(made.select("series_id", "date", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)], F.round("log_likelihood", 5).alias("log_likelihood")), 7)


@query()
def hmm_states(spark, sf_dir):
    return regimes.infer_states(market.daily_series(spark, sf_dir)).select("series_id", "date", "state", "posterior")


@query()
def hmm_parameters(spark, sf_dir):
    return regimes.hmm_parameters(market.daily_series(spark, sf_dir))


@query()
def regime_detection_scores(spark, sf_dir):
    return regimes.detect_regimes(simulate.simulate_market(spark, 2000, seed=7))["scores"]


# --- joins, bootstrap, simulation -------------------------------------------


@query(f"WITH {DAILY} SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, price, {r('ret', 'return')} FROM orders LEFT JOIN daily ON daily.date = CAST(o_orderdate AS DATE)")
def date_align(spark, sf_dir):
    orders = market.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    # The series has a row for each day; it is left to the optimizer whether its measured size allows a broadcast.
    return rounded(orders.join(market.daily_series(spark, sf_dir).drop("series_id"), "date", "left").select("o_orderkey", "date", "price", "return"))


_DRAWS = f"""counted AS (SELECT count(*) AS n FROM ledger),
drawn AS (SELECT k.range AS rep, i.range AS i, n, {_uniform(0, 0, "'ALL'", "k.range", "i.range")} AS u0, {_uniform(1, 0, "'ALL'", "k.range", "i.range")} AS u1 FROM counted, range(2000) k, range((SELECT n FROM counted)) i),
started AS (SELECT rep, i, n, last_value(CASE WHEN i = 0 OR u0 < 0.05::DOUBLE THEN floor(u1 * n)::BIGINT - i END IGNORE NULLS) OVER (PARTITION BY rep ORDER BY i ROWS UNBOUNDED PRECEDING) AS ahead FROM drawn),
source AS (SELECT row_number() OVER (ORDER BY date) - 1 AS place, strategy_return AS x, strategy_return - avg(strategy_return) OVER () AS c FROM ledger),
resampled AS (SELECT rep, x, c FROM started JOIN source ON place = (ahead + i) % n)"""
_POP_SHARPE = "CASE WHEN stddev_pop({0}) = 0 THEN 0 ELSE sqrt(252) * avg({0}) / stddev_pop({0}) END"


@query(f"""WITH {PREDICTIONS}, {_ledger('predictions', _position(UP))}, {_DRAWS}, v AS (SELECT {_POP_SHARPE.format('x')} AS v FROM resampled GROUP BY rep)
SELECT 'ALL' AS series_id, (SELECT round({_POP_SHARPE.format('strategy_return')}, 6) FROM ledger) + 0.0 AS point, {r('quantile_cont(v, 0.05)', 'lower', 6)}, {r('quantile_cont(v, 0.95)', 'upper', 6)} FROM v""")
def bootstrap_ci(spark, sf_dir):
    return rounded(st.block_bootstrap_ci(bt.run_backtest(_predictions(spark, sf_dir)), "strategy_return", st.sharpe_of), 6)


@query(f"""WITH {PREDICTIONS}, {_ledger('predictions', _position(UP))}, {_DRAWS}, v AS (SELECT avg(c) AS v FROM resampled GROUP BY rep), o AS (SELECT avg(strategy_return) AS o FROM ledger)
SELECT 'ALL' AS series_id, {r('any_value(o)', 'observed')}, {r('avg(CAST(abs(v) >= abs(o) AS DOUBLE))', 'p_value')} FROM v, o""")
def bootstrap_p(spark, sf_dir):
    return rounded(st.bootstrap_p_value(bt.run_backtest(_predictions(spark, sf_dir)), "strategy_return"))


_S = "strategy_return"
_TRIALS = [0.01, 0.02, 0.03, -0.01, 0.0, 0.015]


def _polynomial(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _upper_quantile(p: str) -> str:
    """The normal quantile of a p between 0.925 and 1 - 1e-11."""
    root = f"(sqrt(-ln(1 - {p})) - 1.6::DOUBLE)"
    return f"({_polynomial(normal.NEAR_TOP, root)} / {_polynomial(normal.NEAR_BOTTOM, root)})"


def _central_quantile(p: str) -> str:
    """The normal quantile of a p within 0.425 of a half."""
    q = f"({normal.CENTRE_TO**2!r}::DOUBLE - ({p} - 0.5::DOUBLE) ** 2)"
    return f"(({p} - 0.5::DOUBLE) * {_polynomial(normal.CENTRE_TOP, q)} / {_polynomial(normal.CENTRE_BOTTOM, q)})"


_TAIL = f"exp(z * z / -2) * {_polynomial(normal.TAIL_TOP, 'abs(z)')} / {_polynomial(normal.TAIL_BOTTOM, 'abs(z)')}"


@query(f"""WITH {PREDICTIONS}, {_ledger('predictions', _position(UP))}, m AS (SELECT count(*) AS n, avg({_S}) AS mean, stddev_samp({_S}) AS std, skewness({_S}) AS skew, kurtosis({_S}) AS kurt FROM ledger),
e AS (SELECT n, mean / std AS ratio, sqrt(greatest(1 - skew * (mean / std) + (kurt + 2) / 4 * (mean / std) ** 2, 1e-12) / (n - 1)) AS error FROM m),
t AS (SELECT stddev_samp(x) AS spread, count(*)::DOUBLE AS k FROM (SELECT unnest({_TRIALS}::DOUBLE[]) AS x)),
b AS (SELECT spread * ((1 - {st.EULER_GAMMA}::DOUBLE) * {_upper_quantile('(1 - 1 / k)') if 1 - 1 / len(_TRIALS) > 0.925 else _central_quantile('(1 - 1 / k)')} + {st.EULER_GAMMA}::DOUBLE * {_upper_quantile('(1 - 1 / (k * exp(1::DOUBLE)))')}) AS best FROM t),
z AS (SELECT n, (ratio - best) / error AS z FROM e, b)
SELECT 'ALL' AS series_id, n, {r(f'CASE WHEN z > 0 THEN 1 - {_TAIL} ELSE {_TAIL} END', 'dsr')} FROM z""")
def deflated_sharpe(spark, sf_dir):
    return rounded(st.deflated_sharpe_ratio(bt.run_backtest(_predictions(spark, sf_dir)), "strategy_return", _TRIALS))


@query(f"""WITH {PREDICTIONS}, {_ledger('predictions', _position(UP))}, m AS (SELECT count(*) AS n, avg({_S}) AS mean, stddev_samp({_S}) AS std, skewness({_S}) AS skew, kurtosis({_S}) AS kurt FROM ledger)
SELECT 'ALL' AS series_id, n, {r('mean / std', 'ratio')}, {r('sqrt(greatest(1 - skew * (mean / std) + (kurt + 2) / 4 * (mean / std) ** 2, 1e-12) / (n - 1))', 'error')} FROM m""")
def sharpe_error(spark, sf_dir):
    """What the deflated ratio is made of: the per-period Sharpe ratio and its error under skew and fat tails."""
    made = st.moments(bt.run_backtest(_predictions(spark, sf_dir)), "strategy_return")
    return rounded(made.select("series_id", "n", (F.col("mean") / F.col("std")).alias("ratio"), st.sharpe_error("n", "mean", "std", "skew", "kurtosis").alias("error")))


@query()
def market_sim(spark, sf_dir):
    return simulate.simulate_market(spark, 500, seed=7, n_series=4)


@query()
def gbm_paths(spark, sf_dir):
    return simulate.simulate_gbm(spark, 0.05, 0.2, 100.0, 1.0, 64, seed=1, scheme="milstein", n_paths=8)


@query()
def ou_estimates(spark, sf_dir):
    return simulate.estimate_ou(simulate.simulate_ou(spark, 3.0, 1.0, 0.5, 0.5, 50.0, 5000, seed=2, n_paths=4), "x", 0.01)


@query()
def heston_paths(spark, sf_dir):
    return simulate.simulate_heston(spark, 0.05, 2.0, 0.04, 0.3, -0.7, 100.0, 0.04, 1.0, 100, seed=3, n_paths=4)


@query()
def merton_paths(spark, sf_dir):
    return simulate.simulate_merton(spark, 0.05, 0.2, 3.0, -0.05, 0.1, 100.0, 1.0, 100, seed=4, n_paths=4)


@query()
def ctmc_occupancy(spark, sf_dir):
    return simulate.occupancy(simulate.simulate_ctmc(spark, simulate.generator_of(simulate.TRANSITION), 500.0, 0, seed=5, n_paths=8), 500.0)


@query("""SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS t, CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(DATE '2016-01-01', DATE '2016-01-01' + INTERVAL 1407 DAY, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 QUALIFY row_number() OVER (ORDER BY d) <= 1000""")
def business_calendar(spark, sf_dir):
    return market.business_days(spark, "2016-01-01", 1000)


@query(f"WITH {BRANDS}, {COV} SELECT i AS asset, {r('cov / sum(cov) OVER ()', 'share')} FROM cov WHERE i = j")
def explained_total(spark, sf_dir):
    """Share of each asset in the panel's total variance."""
    var = portfolio.long_covariance(_panel(spark, sf_dir)).where("i = j")
    return rounded(portfolio.explained_share(var, "cov").select(F.col("i").alias("asset"), "share"))


@query("""WITH b AS (SELECT (1 - sqrt(0.25::DOUBLE)) ** 2 AS low, (1 + sqrt(0.25::DOUBLE)) ** 2 AS high), g AS (SELECT unnest(range(0, 301)) / 100.0::DOUBLE AS x)
SELECT x, round(CASE WHEN x >= low AND x <= high AND x > 0 THEN sqrt(greatest(0, (high - x) * (x - low))) / (2 * pi() * 0.25 * x) ELSE 0 END, 8) + 0.0 AS density FROM g, b""")
def noise_density(spark, sf_dir):
    """Eigenvalue density of pure noise, 50 assets and 200 observations."""
    grid = spark.range(301).select((F.col("id") / F.lit(100.0)).alias("x"))
    return rounded(grid.select("x", portfolio.marchenko_pastur_pdf("x", 50, 200).alias("density")))


_OU = f"""pairs AS (SELECT ln(price) AS a, lead(ln(price)) OVER (ORDER BY date) AS b FROM daily), s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM pairs WHERE b IS NOT NULL),
k AS (SELECT *, c / va AS slope, greatest(1e-8::DOUBLE, least(1 - 1e-8::DOUBLE, c / va)) AS bb FROM s)"""


@query(f"WITH {DAILY}, {_OU} SELECT 'ALL' AS series_id, {r('-ln(bb)', 'kappa', 6)}, {r('(mb - slope * ma) / (1 - bb)', 'theta', 6)}, {r('sqrt(2 * -ln(bb) * greatest(0, (vb - slope * c) * n / (n - 2)) / (1 - bb * bb))', 'sigma', 6)} FROM k")
def ou_fit_prices(spark, sf_dir):
    """Mean reversion of the log price."""
    frame = market.daily_series(spark, sf_dir).withColumn("x", F.log("price"))
    return rounded(simulate.estimate_ou(frame, "x", 1.0, ["series_id"], "date"), 6)


@query(f"WITH {HOURLY}, held AS (SELECT regime AS state, date_diff('second', date, coalesce(lead(date) OVER (ORDER BY date), (SELECT max(date) FROM states))) / 3600.0::DOUBLE AS h FROM states) SELECT CAST(state AS INTEGER) AS state, {r('sum(h)', 'hours', 6)} FROM held GROUP BY 1")
def state_occupancy(spark, sf_dir):
    """Hours spent in each state, each row holding until the next."""
    frame = _hourly_regimes(spark, sf_dir)
    paths = frame.select(F.lit(0).alias("path_id"), ts.row_index().alias("k"), (F.unix_seconds(F.col("date").cast("timestamp")) / 3600.0).alias("jump_time"), F.col("regime").alias("state"))
    return rounded(simulate.occupancy(paths).select("state", F.col("time").alias("hours")), 6)


@query(f"WITH {LONG} SELECT 'ALL' AS series_id, {r('sum(alpha_momentum * alpha_vol_managed) / sqrt(sum(alpha_momentum * alpha_momentum) * sum(alpha_vol_managed * alpha_vol_managed))', 'cosine')} FROM wide WHERE alpha_momentum IS NOT NULL AND alpha_vol_managed IS NOT NULL")
def signal_cosine(spark, sf_dir):
    rows = _signals(spark, sf_dir).where("alpha_momentum is not null and alpha_vol_managed is not null")
    return rounded(rows.groupBy("series_id").agg(portfolio.cosine("alpha_momentum", "alpha_vol_managed").alias("cosine")))


@query(f"WITH {DAILY} SELECT 'ALL' AS series_id, CAST(floor(ret * 20) AS INTEGER) AS bucket, count(*) AS n FROM daily GROUP BY 2")
def return_histogram(spark, sf_dir):
    frame = market.daily_series(spark, sf_dir)
    return frame.groupBy("series_id", F.floor(F.col("return") * 20).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY 1, 2")
def windowed_event_means(spark, sf_dir):
    events = market.table(spark, sf_dir, "events")
    made = online.windowed_means(events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean_value")
    return rounded(made, 6)


@query(f"WITH {DAILY} SELECT date_trunc('year', date)::DATE AS year, {sig('product(1 + ret) - 1', 'total_return')} FROM daily GROUP BY 1")
def yearly_total_return(spark, sf_dir):
    frame = market.daily_series(spark, sf_dir)
    return metric_row(frame.groupBy(F.trunc("date", "year").alias("year")).agg(bt.total_return("return").alias("total_return")))


@query(f"WITH {DAILY} SELECT date, price, max(price) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM daily")
def running_peak(spark, sf_dir):
    return rounded(market.daily_series(spark, sf_dir).select("date", "price", bt.running_peak("price").alias("peak")))


# --- closed forms, the cache, leakage ----------------------------------------


@query("SELECT t, w, round(100.0::DOUBLE * exp((0.05 - 0.5 * 0.2 ** 2)::DOUBLE * (t / 64.0::DOUBLE) + 0.2::DOUBLE * w), 8) + 0.0 AS x FROM (SELECT range AS t, round(sin(range::DOUBLE), 12) AS w FROM range(65))")
def gbm_closed_form(spark, sf_dir):
    """The closed form of geometric Brownian motion over a given path of the driving motion."""
    grid = spark.range(65).select(F.col("id").alias("t"), F.round(F.sin(F.col("id").cast("double")), 12).alias("w"))
    made = grid.withColumn("x", simulate.gbm_exact(0.05, 0.2, 100.0, F.col("t") / F.lit(64.0), "w"))
    return made.select("t", "w", (F.round("x", 8) + F.lit(0.0)).alias("x"))


_GRID_SQL = "(SELECT k.range / 2.0::DOUBLE AS kappa, v.range / 50.0::DOUBLE AS theta, x.range / 10.0::DOUBLE AS xi FROM range(1, 9) k, range(1, 9) v, range(1, 9) x)"


def _parameters(spark: SparkSession) -> DataFrame:
    n = spark.range(512).select((F.floor(F.col("id") / 64) + 1).alias("a"), (F.pmod(F.floor(F.col("id") / 8), F.lit(8)) + 1).alias("b"), (F.pmod("id", F.lit(8)) + 1).alias("c"))
    return n.select((F.col("a") / F.lit(2.0)).alias("kappa"), (F.col("b") / F.lit(50.0)).alias("theta"), (F.col("c") / F.lit(10.0)).alias("xi"))


@query(f"SELECT *, 2 * kappa * theta > xi * xi AS positive FROM {_GRID_SQL}")
def feller_grid(spark, sf_dir):
    """Where the variance process stays positive, over a grid of its parameters."""
    return _parameters(spark).withColumn("positive", simulate.feller_condition(F.col("kappa"), F.col("theta"), F.col("xi")))


@query(f"SELECT DISTINCT kappa, xi, round(xi * xi / (2 * kappa), 10) + 0.0 AS variance FROM {_GRID_SQL}")
def ou_stationary_grid(spark, sf_dir):
    """Stationary variance of mean reversion, over a grid of its parameters."""
    return rounded(_parameters(spark).select("kappa", "xi").distinct().withColumn("variance", simulate.ou_stationary_variance(F.col("kappa"), F.col("xi"))), 10)


@query(f"WITH {DAILY} SELECT how, 'ALL' AS series_id, date, price, {r('ret', 'return')} FROM daily, (SELECT unnest(['miss', 'hit', 'refresh']) AS how)")
def series_cache(spark, sf_dir):
    """The cached loader: a miss downloads and writes, a hit reads the file (its download would fail), a refresh downloads again."""
    prices = market.daily_prices(spark, sf_dir)

    def fail(_: str) -> DataFrame:
        raise AssertionError("a cached series was downloaded")

    one, two = market.scratch_dir(spark), market.scratch_dir(spark)
    market.load_series(spark, "ALL", two, lambda _: prices.limit(3))  # what the refresh replaces
    loaded = {
        "miss": market.load_series(spark, "ALL", one, lambda _: prices), "hit": market.load_series(spark, "ALL", one, fail),
        "refresh": market.load_series(spark, "ALL", two, lambda _: prices, refresh=True),
    }
    made = [df.select(F.lit(how).alias("how"), "*") for how, df in loaded.items()]
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]))


@query(f"""WITH {DAILY}, m AS (SELECT DATE '1995-06-17' AS d), b AS (SELECT date, price / nullif(lag(price, 60) OVER (ORDER BY date), 0) - 1 AS x FROM daily),
s AS (SELECT date, p / nullif(lag(p, 60) OVER (ORDER BY date), 0) - 1 AS y FROM (SELECT date, CASE WHEN date > d THEN price * 1.5::DOUBLE ELSE price END AS p FROM daily, m))
SELECT date > d AS shocked, count(*) AS n, count(*) FILTER (abs(x - y) > 1e-9) AS changed FROM b JOIN s USING (date), m WHERE x IS NOT NULL GROUP BY 1""")
def shock_join(spark, sf_dir):
    """A trailing feature of the series and of one with prices shocked after a date, joined by date: nothing before the shock may change."""
    base = market.daily_series(spark, sf_dir).select("series_id", "date", "price")
    late = F.col("date") > F.lit("1995-06-17").cast("date")
    marked = base.withColumn("_p", F.when(late, F.col("price") * 1.5).otherwise(F.col("price")))
    one = base.select("series_id", "date", ts.pct_change("price", 60, ts.spec()).alias("x"))
    two = marked.select("series_id", "date", late.alias("shocked"), ts.pct_change("_p", 60, ts.spec()).alias("y"))
    met = one.join(two, ["series_id", "date"]).where("x is not null")
    return met.groupBy("shocked").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("x") - F.col("y")) > 1e-9).alias("changed"))


@query(f"WITH {BRANDS}, t AS (SELECT date, series_id, ret FROM panel), v AS (SELECT series_id AS asset, avg(ret) AS mean, stddev_samp(ret) AS std, count(*) AS n FROM t GROUP BY 1) SELECT asset, n, {r('mean', 'mean')}, {r('std', 'std')} FROM v")
def panel_moments(spark, sf_dir):
    """Mean and deviation of every asset from the panel's vectors."""
    names, data = portfolio.panel_cross(_panel(spark, sf_dir))
    std = (data.cross.diagonal() / (data.n_obs - 1)) ** 0.5
    return rounded(spark.createDataFrame([(str(a), data.n_obs, float(m), float(v)) for a, m, v in zip(names, data.mean, std, strict=True)], "asset string, n long, mean double, std double"))


# --- simulators driven by given shocks, small matrices, files ----------------

_SHOCKS = """shocks AS (SELECT p.range AS path_id, s.range AS step, round(sin((s.range * (p.range + 1))::DOUBLE), 9) AS z, round(cos((s.range * (p.range + 2))::DOUBLE), 9) AS y,
  CASE WHEN (s.range * (p.range + 3)) % 7 = 0 THEN 2 WHEN (s.range + p.range) % 5 = 0 THEN 1 ELSE 0 END AS jumps FROM range(4) p, range(1, 101) s)"""


def _shocks(spark: SparkSession) -> DataFrame:
    """Shocks of four paths of 100 steps by a rule that SQL can state."""
    grid = spark.range(400).select(F.floor(F.col("id") / 100).alias("path_id"), (F.pmod("id", F.lit(100)) + 1).alias("step"))
    z = F.round(F.sin((F.col("step") * (F.col("path_id") + 1)).cast("double")), 9)
    y = F.round(F.cos((F.col("step") * (F.col("path_id") + 2)).cast("double")), 9)
    jumps = F.when(F.pmod(F.col("step") * (F.col("path_id") + 3), F.lit(7)) == 0, 2).when(F.pmod(F.col("step") + F.col("path_id"), F.lit(5)) == 0, 1).otherwise(0)
    return grid.select("path_id", "step", z.alias("z"), y.alias("y"), jumps.alias("jumps"))


_GBM_STEP = {"euler": "1 + 0.05::DOUBLE * dt + 0.2::DOUBLE * dw", "milstein": "1 + 0.05::DOUBLE * dt + 0.2::DOUBLE * dw + 0.5::DOUBLE * 0.04::DOUBLE * (dw * dw - dt)"}
_GBM = " UNION ALL ".join(f"SELECT '{k}' AS scheme, path_id, step, product({v}) OVER (PARTITION BY path_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, z / 10 AS dw, 0.01::DOUBLE AS dt FROM shocks)" for k, v in _GBM_STEP.items())


@query(f"WITH {_SHOCKS}, g AS ({_GBM}), a AS (SELECT scheme, path_id, CAST(step AS INTEGER) AS step, 100 * f AS x FROM g UNION ALL SELECT DISTINCT scheme, path_id, 0, 100::DOUBLE FROM g) SELECT scheme, path_id, step, {r('step * 0.01::DOUBLE', 't')}, {r('x', 'x')} FROM a")
def gbm_from_increments(spark, sf_dir):
    """Both schemes of geometric Brownian motion on given increments."""
    noise = _shocks(spark).select("path_id", F.col("step").cast("int").alias("step"), (F.col("z") / 10).alias("dw"))
    made = [simulate.simulate_gbm(spark, 0.05, 0.2, 100.0, 1.0, 100, scheme=k, increments=noise).select(F.lit(k).alias("scheme"), "*") for k in ("euler", "milstein")]
    return rounded(made[0].unionByName(made[1]))


_OU_A = {"exact": float(math.exp(-3.0 * 0.01)), "euler": 1 - 3.0 * 0.01}
_OU_B = {"exact": float(math.sqrt(0.25 * (1 - math.exp(-3.0 * 0.01) ** 2) / 6.0)), "euler": 0.5 * 0.01**0.5}
_OU_PATHS = ", ".join(
    f"{k} AS (SELECT path_id, 0::BIGINT AS step, -0.5::DOUBLE AS x FROM range(4) t(path_id) UNION ALL SELECT o.path_id, s.step, {_OU_A[k]!r}::DOUBLE * o.x + {_OU_B[k]!r}::DOUBLE * s.z FROM {k} o JOIN shocks s ON s.path_id = o.path_id AND s.step = o.step + 1)"
    for k in ("exact", "euler")
)


@query("WITH RECURSIVE " + _SHOCKS + ", " + _OU_PATHS + " " + " UNION ALL ".join(f"SELECT '{k}' AS scheme, path_id, CAST(step AS INTEGER) AS step, {r('step * 0.01::DOUBLE', 't')}, {r('x + 1', 'x')} FROM {k}" for k in ("exact", "euler")))
def ou_from_shocks(spark, sf_dir):
    """Both schemes of mean reversion on given shocks."""
    made = [simulate.simulate_ou(spark, 3.0, 1.0, 0.5, 0.5, 1.0, 100, scheme=k, shocks=_shocks(spark)).select(F.lit(k).alias("scheme"), "*") for k in ("exact", "euler")]
    return rounded(made[0].unionByName(made[1]))


_HESTON = f"""WITH RECURSIVE {_SHOCKS}, h AS (SELECT path_id, 0::BIGINT AS step, 0.04::DOUBLE AS v, ln(100::DOUBLE) AS s FROM range(4) t(path_id)
  UNION ALL SELECT path_id, step, v + 2 * (0.04::DOUBLE - up) * 0.01::DOUBLE + 0.6::DOUBLE * sqrt(up) * z * {0.01**0.5!r}::DOUBLE,
    s + (0.05::DOUBLE - 0.5::DOUBLE * up) * 0.01::DOUBLE + sqrt(up) * (-0.7::DOUBLE * z + {(1 - 0.49) ** 0.5!r}::DOUBLE * y) * {0.01**0.5!r}::DOUBLE
  FROM (SELECT h.path_id, k.step, h.v, h.s, greatest(h.v, 0) AS up, k.z, k.y FROM h JOIN shocks k ON k.path_id = h.path_id AND k.step = h.step + 1))
SELECT path_id, CAST(step AS INTEGER) AS step, {r('step * 0.01::DOUBLE', 't')}, {r('exp(s)', 'price', 7)}, {r('greatest(v, 0)', 'variance')} FROM h"""


@query(_HESTON)
def heston_from_shocks(spark, sf_dir):
    """Stochastic variance by full truncation on given shocks; some paths reach a variance of zero."""
    shocks = _shocks(spark).withColumnsRenamed({"z": "z1", "y": "z2"})
    made = simulate.simulate_heston(spark, 0.05, 2.0, 0.04, 0.6, -0.7, 100.0, 0.04, 1.0, 100, shocks=shocks)
    return rounded(made.withColumn("price", F.round("price", 7)))


_MERTON_DRIFT = (0.05 - 0.5 * 0.04 - 3.0 * (math.exp(-0.05 + 0.5 * 0.01) - 1)) * 0.01


@query(f"""WITH {_SHOCKS}, m AS (SELECT path_id, step, jumps, sum({_MERTON_DRIFT!r}::DOUBLE + 0.2::DOUBLE * 0.1::DOUBLE * z + jumps * -0.05::DOUBLE + sqrt(jumps) * 0.1::DOUBLE * y) OVER (PARTITION BY path_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS s FROM shocks)
SELECT path_id, CAST(step AS INTEGER) AS step, {r('step * 0.01::DOUBLE', 't')}, {r('100 * exp(s)', 'price', 7)}, CAST(jumps AS BIGINT) AS jumps FROM m UNION ALL SELECT path_id, 0, 0, 100, 0 FROM range(4) t(path_id)""")
def merton_from_shocks(spark, sf_dir):
    """Jump diffusion on given jumps and shocks: a cumulative sum of steps."""
    made = simulate.simulate_merton(spark, 0.05, 0.2, 3.0, -0.05, 0.1, 100.0, 1.0, 100, shocks=_shocks(spark).withColumnRenamed("y", "size"))
    return rounded(made.withColumn("price", F.round("price", 7)))


_CHAIN = ", ".join(f"({i}, {j}, {float(simulate.TRANSITION[i][j])!r}::DOUBLE)" for i in range(3) for j in range(3))


@query(f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('p - CAST(i = j AS INTEGER)', 'rate')} FROM (VALUES {_CHAIN}) t(i, j, p)")
def generator_rates(spark, sf_dir):
    """The continuous-time generator of the daily chain."""
    return rounded(portfolio.matrix_frame(spark, simulate.generator_of(simulate.TRANSITION), "rate"))


@query(f"""WITH t AS (FROM (VALUES {_CHAIN}) t(i, j, p)), p AS (SELECT {", ".join(f"max(p) FILTER (i = {i} AND j = {j}) AS p{i}{j}" for i in range(3) for j in range(3))} FROM t),
w AS (SELECT p10 * p20 + p10 * p21 + p12 * p20 AS w0, p01 * p21 + p01 * p20 + p02 * p21 AS w1, p02 * p12 + p02 * p10 + p01 * p12 AS w2 FROM p)
SELECT CAST(state AS INTEGER) AS state, {r('x / (w0 + w1 + w2)', 'share')} FROM w, (SELECT unnest([0, 1, 2]) AS state), LATERAL (SELECT CASE state WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END AS x)""")
def stationary_shares(spark, sf_dir):
    """The distribution that the daily chain keeps (in SQL by its spanning trees)."""
    return rounded(spark.createDataFrame([(k, float(x)) for k, x in enumerate(regimes.stationary_distribution(simulate.TRANSITION))], "state int, share double"))


@query(f"SELECT series_id, date, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS state FROM ({_FILTER})")
def hamilton_states(spark, sf_dir):
    """The likeliest state of each day, of equals the first."""
    made = regimes.hamilton_filter(market.daily_series(spark, sf_dir), simulate.TRANSITION, _MEANS, _STDS)
    p = F.transform("probabilities", lambda x: F.round(x, 7))
    return made.select("series_id", "date", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("state"))


_PAIR = ["Brand#11", "Brand#23"]
_PAIR_SQL = f"""WITH {BRANDS}, x AS (SELECT date, max(ret) FILTER (series_id = '{_PAIR[0]}') AS a, max(ret) FILTER (series_id = '{_PAIR[1]}') AS b FROM panel GROUP BY date),
c AS (SELECT count(*) AS n, covar_samp(a, a) AS s, covar_samp(b, b) AS t, covar_samp(a, b) AS u FROM x),
e AS (SELECT *, 1 + abs(u / sqrt(s * t)) AS e0, 1 - abs(u / sqrt(s * t)) AS e1, (1 + sqrt(2::DOUBLE / n)) ** 2 AS edge, s * t - u * u AS det FROM c),
v AS (SELECT *, CASE WHEN e0 <= edge THEN 0 ELSE u END AS d FROM e)
SELECT name, {r('value', 'value')} FROM (SELECT unnest(['eigenvalue_0', 'eigenvalue_1', 'share_0', 'edge', 'minimum_variance_0', 'denoised_0', 'mean_variance_0', 'mean_variance_1']) AS name,
  unnest([e0, e1, e0 / 2, edge, (t - u) / (s + t - 2 * u), (t - d) / (s + t - 2 * d), (t * 0.001::DOUBLE - u * 0.002::DOUBLE) / det, (s * 0.002::DOUBLE - u * 0.001::DOUBLE) / det]) AS value FROM v)"""


@query(_PAIR_SQL)
def pair_portfolio(spark, sf_dir):
    """Spectrum, noise edge and weights of two assets, for which all have closed forms."""
    panel = _panel(spark, sf_dir).where(F.col("asset").isin(_PAIR))
    _, data = portfolio.panel_cross(panel)
    cov = data.covariance()
    values = portfolio.eigen_descending(data.correlation())[0]
    denoised = portfolio.denoise_covariance(cov, data.n_obs)
    mean = portfolio.mean_variance_weights(cov, [0.001, 0.002])
    found = {
        "eigenvalue_0": values[0], "eigenvalue_1": values[1], "share_0": portfolio.explained_variance_ratio(values)[0], "edge": portfolio.marchenko_pastur_bounds(2, data.n_obs)[1],
        "minimum_variance_0": portfolio.minimum_variance_weights(cov)[0], "denoised_0": portfolio.minimum_variance_weights(denoised)[0], "mean_variance_0": mean[0], "mean_variance_1": mean[1],
    }
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double"))


@query(f"WITH {PREDICTIONS}, {_ledger('predictions', _position(UP))} SELECT 'ALL' AS series_id, date, CAST(position AS INTEGER) AS position, {r('strategy_return', 'strategy_return')} FROM ledger ORDER BY date DESC LIMIT 100")
def ledger_tail(spark, sf_dir):
    """The last 100 rows of the ledger, as the dashboard shows them."""
    ledger = bt.run_backtest(_predictions(spark, sf_dir))
    return rounded(ledger.orderBy(F.desc("date")).limit(100).select("series_id", "date", "position", "strategy_return"))


@query(f"WITH {BRANDS}, p AS (SELECT series_id, date, price FROM bp WHERE series_id IN ('Brand#11', 'Brand#23', 'Brand#35')), q AS (SELECT *, price / nullif(lag(price) OVER (PARTITION BY series_id ORDER BY date), 0) - 1 AS ret FROM p) SELECT series_id, date, price, {r('ret', 'return')} FROM q WHERE ret IS NOT NULL")
def panel_files(spark, sf_dir):
    """A panel read from one file for each series."""
    folder = market.scratch_dir(spark)
    prices = market.brand_prices(spark, sf_dir)
    paths = {name: f"{folder}/{k}.parquet" for k, name in enumerate(["Brand#11", "Brand#23", "Brand#35"])}
    for name, path in paths.items():
        market.write_series(prices.where(F.col("series_id") == name).select("date", "price"), path)
    return rounded(market.load_panel(spark, paths))


# --- experiments ------------------------------------------------------------


def report(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames of an experiment as one: frame, row (JSON of a row's columns)."""
    made = [df.select(F.lit(name).alias("frame"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for name, df in frames.items()]
    out = made[0]
    for one in made[1:]:
        out = out.unionByName(one)
    return out


@query()
def experiment_baseline(spark, sf_dir):
    return report(experiments.baseline_research(market.daily_series(spark, sf_dir)))


@query()
def experiment_regimes(spark, sf_dir):
    return report(experiments.regime_research(simulate.simulate_market(spark, 4000, seed=7)))


@query()
def experiment_alphas(spark, sf_dir):
    return report(experiments.alpha_research(market.daily_series(spark, sf_dir)))


@query()
def experiment_rigor(spark, sf_dir):
    return report(experiments.statistical_rigor(market.daily_series(spark, sf_dir)))


@query()
def experiment_portfolio(spark, sf_dir):
    return report(experiments.portfolio_research(spark))


@query()
def experiment_real_data(spark, sf_dir):
    return report(experiments.real_data_research(market.daily_series(spark, sf_dir)))


@query()
def figures(spark, sf_dir):
    return report(experiments.figure_data(spark, market.daily_series(spark, sf_dir)))


@query()
def dashboard(spark, sf_dir):
    return report(experiments.dashboard_run(spark))
