"""Streaming forms of the ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.phases import NAMES, Debounced, conditions
from ..schemas import PHASES


def stream_phases(df: DataFrame, time: str, v: str, vz: str, agl: str, turn: str, flight: str = "flight_id") -> DataFrame:
    """(flight, time, phase) for rows that come in order of time from batch to batch; the state is three numbers a flight."""
    found = conditions(*map(F.col, (v, vz, agl, turn)))
    rows = df.select(F.col(flight), F.col(time).alias("_t"), *(F.coalesce(found[n], F.lit(False)).alias(n) for n in NAMES))
    kind = dict(df.dtypes)[flight]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (0, 0.0, 0.0, None)
        machine = Debounced(kept[0], kept[1:3], kept[3])
        pdf = pd.concat(list(frames)).sort_values("_t", kind="stable")
        states = machine.run(pdf["_t"].to_numpy(float), {n: pdf[n].to_numpy(bool) for n in NAMES})
        state.update((machine.state, *machine.held, machine.last))
        yield pd.DataFrame({flight: [key[0]] * len(pdf), time: pdf["_t"].to_numpy(), "phase": [PHASES[s] for s in states]})

    return rows.groupBy(flight).applyInPandasWithState(run, f"{flight} {kind}, {time} double, phase string", "state int, a double, b double, last double", "append", GroupStateTimeout.NoTimeout)


def stream_sessions(df: DataFrame, time: str, gap: str, late: str, flight: str = "flight_id") -> DataFrame:
    """Runs of rows without a gap in event time: flight, start, end, rows.  An addition; late rows are dropped."""
    session = F.session_window(time, gap)
    grouped = df.withWatermark(time, late).groupBy(flight, session.alias("s")).agg(F.count("*").alias("n_rows"))
    return grouped.select(flight, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_rows")
