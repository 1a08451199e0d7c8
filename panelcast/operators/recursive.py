"""Recursive multi-step forecast with rolling state (ML10).

Day t + 1 is predicted from lags, rolling means and rolling standard deviations
of what is known or predicted up to day t, and from its own calendar.  The
horizon is sequential by nature; series are independent, and one step is
row-local: no shuffle, no window.

The state is one row per series: the last ``depth`` values of each target as a
ring buffer, and for each rolling width the running sum and sum of squares.  A
step adds the prediction and takes away the value that falls out of the width,
so its cost does not depend on the widths.  Sums are kept about a centre fixed
per series, so that squares do not cancel.

Training features (``recursive_features``) are defined as the forecast sees
them: all windows end the day before, so no target takes part in its own
features.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from .frames import STATION_DATE, SeriesFrame, bounded, checkpoint
from .windows import last_rows


@dataclass(frozen=True)
class History:
    """Which features of the past are made for every target (in rows of the series)."""

    lags: tuple[int, ...] = (1, 3, 5, 7, 14, 30)
    means: tuple[int, ...] = (3, 7, 14, 30)
    stds: tuple[int, ...] = (3, 7, 30)

    @property
    def depth(self) -> int:
        return max((*self.lags, *self.means, *self.stds))

    @property
    def widths(self) -> list[int]:
        return sorted({*self.means, *self.stds})

    def names(self, targets: Sequence[str]) -> list[str]:
        return [n for t in targets for n in (*(f"{t}_lag_{k}" for k in self.lags), *(f"{t}_rolling_{n}" for n in self.means),
                                             *(f"{t}_rolling_std_{n}" for n in self.stds))]


def calendar_features(date: str) -> dict[str, Column]:
    """The sine and cosine parts of a day (DT7), as the survey's forecast makes them for every step."""
    d = F.col(date)
    parts = {"day_of_year": (F.dayofyear(d), 365.25), "day_of_week": (F.weekday(d), 7), "month": (F.month(d), 12)}
    out = {}
    for name, (x, period) in parts.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = dt.cyclical(x, period)
    return out


CALENDAR = [f"{p}_{f}" for p in ("day_of_year", "day_of_week", "month") for f in ("sin", "cos")]


def recursive_features(df: DataFrame, targets: Sequence[str], history: History = History(), frame: SeriesFrame = STATION_DATE,
                       calendar: Callable[[str], Mapping[str, Column]] = calendar_features) -> DataFrame:
    """``df`` with the features of every row, all from earlier rows of its series (one halo pass)."""
    def build(w):
        out = {}
        for t in targets:
            out |= {f"{t}_lag_{k}": F.lag(t, k).over(w) for k in history.lags}
            out |= {f"{t}_rolling_{n}": F.avg(t).over(w.rowsBetween(-n, -1)) for n in history.means}
            out |= {f"{t}_rolling_std_{n}": F.stddev_samp(t).over(w.rowsBetween(-n, -1)) for n in history.stds}
        return out

    return bounded(df, frame, build, before=history.depth).withColumns(calendar(frame.order))


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name].cast("double"))


def _total(values: Column, centre: Column, power: int = 1) -> Column:
    """The sum of (value - centre) ** power."""
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + ((y - centre) if power == 1 else (y - centre) * (y - centre)))


def _start(history_rows: DataFrame, targets: Sequence[str], h: History, frame: SeriesFrame) -> DataFrame:
    """One row per series: the first day to predict, and per target the buffer, its centre and the sums of every width."""
    keys, order = list(frame.keys), frame.order
    tail = last_rows(history_rows.select(*keys, order, *targets), h.depth, frame)
    state = tail.groupBy(*keys).agg(F.date_add(F.max(order), 1).alias(order), F.sort_array(F.collect_list(F.struct(order, *targets))).alias("_rows"))
    state = state.withColumns({f"_v_{t}": _field("_rows", t) for t in targets})
    state = state.withColumns({f"_c_{t}": F.floor(_total(F.col(f"_v_{t}"), F.lit(0.0)) / F.size(f"_v_{t}")).cast("double") for t in targets})
    sums = {}
    for t in targets:
        for n in h.widths:
            last = F.slice(f"_v_{t}", -F.least(F.size(f"_v_{t}"), F.lit(n)), F.lit(n))
            c = F.col(f"_c_{t}")
            sums[f"_s_{t}_{n}"] = _total(last, c)
            sums[f"_q_{t}_{n}"] = _total(last, c, 2)
    return state.withColumns(sums).drop("_rows")


def _features_of_state(t: str, h: History) -> dict[str, Column]:
    v, c = F.col(f"_v_{t}"), F.col(f"_c_{t}")
    out = {f"{t}_lag_{k}": F.get(v, F.size(v) - k) for k in h.lags}
    held = {n: F.least(F.size(v), F.lit(n)).cast("double") for n in h.widths}
    for n in h.means:
        out[f"{t}_rolling_{n}"] = F.col(f"_s_{t}_{n}") / held[n] + c
    for n in h.stds:
        s, q = F.col(f"_s_{t}_{n}"), F.col(f"_q_{t}_{n}")
        var = F.try_divide(q - s * s / held[n], held[n] - 1)
        out[f"{t}_rolling_std_{n}"] = F.sqrt(F.when(var < 0, F.lit(0.0)).otherwise(var))
    return out


def _advanced(t: str, p: Column, h: History) -> dict[str, Column]:
    """The state of ``t`` after one more value."""
    v, c = F.col(f"_v_{t}"), F.col(f"_c_{t}")
    out = {f"_v_{t}": F.slice(F.concat(v, F.array(p)), -F.least(F.size(v) + 1, F.lit(h.depth)), F.lit(h.depth)), f"_c_{t}": c}
    for n in h.widths:
        gone = F.when(F.size(v) >= n, F.get(v, F.size(v) - n) - c).otherwise(F.lit(0.0))
        out[f"_s_{t}_{n}"] = F.col(f"_s_{t}_{n}") + (p - c) - gone
        out[f"_q_{t}_{n}"] = F.col(f"_q_{t}_{n}") + (p - c) * (p - c) - gone * gone
    return out


def recursive_forecast(history_rows: DataFrame, models: Mapping[str, object], horizon: int, history: History = History(),
                       frame: SeriesFrame = STATION_DATE, static: Sequence[str] = (), fill: Mapping[str, float] | None = None,
                       calendar: Callable[[str], Mapping[str, Column]] = calendar_features, floor_at: float | None = 0.0,
                       checkpoint_every: int = 5) -> DataFrame:
    """``horizon`` days after each series' last one: (keys, day, one column per target).

    ``models`` maps a target to a fitted pipeline whose ``transform`` adds
    ``<target>_pred``; all targets of a day are predicted from the same state.
    ``static`` columns keep their latest value.  Missing features take the
    value of ``fill`` (training medians).  Rows with a missing target take no
    part.  Lineage is cut into the shared checkpoint folder every few days.
    """
    targets, keys, order = list(models), list(frame.keys), frame.order
    known = history_rows.dropna(subset=targets)
    state = _start(known, targets, history, frame)
    if static:
        latest = known.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in static])
        state = state.join(latest, keys)
    kind = f"array<struct<{order}:date,{','.join(f'{t}:double' for t in targets)}>>"
    state = checkpoint(state.withColumn("_out", F.array().cast(kind)))
    kept = [c for c in state.columns if c not in (order, "_out") and not c.startswith(("_v_", "_c_", "_s_", "_q_"))]
    for step in range(1, horizon + 1):
        made: dict[str, Column] = dict(calendar(order))
        for t in targets:
            made |= _features_of_state(t, history)
        x = state.withColumns(made)
        if fill:
            x = x.fillna({k: v for k, v in fill.items() if k in x.columns})
        columns = x.columns
        for t, model in models.items():
            raw = F.col(f"{t}_pred").cast("double")
            x = model.transform(x).select(*columns, (raw if floor_at is None else F.when(raw < floor_at, F.lit(floor_at)).otherwise(raw)).alias(f"_p_{t}"))
            columns = x.columns
        after: dict[str, Column] = {}
        for t in targets:
            after |= _advanced(t, F.col(f"_p_{t}"), history)
        row = F.struct(F.col(order), *[F.col(f"_p_{t}").alias(t) for t in targets])
        state = x.select(*kept, F.date_add(order, 1).alias(order), *[c.alias(n) for n, c in after.items()], F.concat("_out", F.array(row)).alias("_out"))
        # also after the last step: a filter pushed from the caller's side through the steps would repeat their expressions
        if step % checkpoint_every == 0 or step == horizon:
            state = checkpoint(state)
    return state.select(*keys, F.explode("_out").alias("_o")).select(*keys, f"_o.{order}", *[f"_o.{t}" for t in targets])
