"""Page-Hinkley and EWMA detectors as keyed state, one row out per observation.

Observations are taken strictly in the order of their ``row_idx``, in whatever batch they arrive:
one that comes early waits in a map state until all before it have come, one that comes again is
left out. Nothing of a key is gathered in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.drift import EWMA, PH

STATE = "n long, mean double, cum double, lo double, hi double, fast double, slow double, var double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DriftProcessor(StatefulProcessor):
    """State per stream key: eight numbers, and the observations that came too early."""

    def __init__(self, keys: list[str], ph: dict, ewma: dict):
        self.keys, self.ph, self.ewma = keys, ph, ewma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", STATE)
        self.early = handle.getMapState("early", "row_idx long", "x double")

    def observe(self, s: tuple, x: float) -> tuple[tuple, bool, bool]:
        """The state after one value, and whether the two detectors fire."""
        n, mean, cum, lo, hi, fast, slow, var = s
        ph, ew = self.ph, self.ewma
        n += 1
        mean += (x - mean) / n
        cum += x - mean - ph["alpha"]
        lo, hi = min(lo, cum), max(hi, cum)
        if n == 1:
            fast, slow, var = x, x, 0.0
        else:
            gap = x - fast
            fast += ew["fast_alpha"] * gap
            var = ew["fast_alpha"] * gap * gap + (1 - ew["fast_alpha"]) * var
            slow += ew["slow_alpha"] * (x - slow)
        risen = n >= ph["min_n"] and (cum - lo > ph["threshold"] or hi - cum > ph["threshold"])
        apart = n >= ew["min_n"] and var > 0 and abs(fast - slow) > ew["k_sigma"] * var**0.5
        return (n, mean, cum, lo, hi, fast, slow, var), bool(risen), bool(apart)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        for batch in rows:
            out = []
            for at, x in zip(batch["row_idx"].tolist(), batch["x"].tolist(), strict=True):
                if at > state[0]:
                    self.early.updateValue((at,), (x,))
                while self.early.containsKey((state[0] + 1,)):
                    at = state[0] + 1
                    state, *fired = self.observe(state, self.early.getValue((at,))[0])
                    self.early.removeKey((at,))
                    out.append((*key, at, *fired))
            yield pd.DataFrame(out, columns=[*self.keys, "row_idx", "ph_alarm", "ewma_alarm"])
        self.state.update(state)

    def close(self) -> None:
        pass


def stream_drift(errors: DataFrame, keys: list[str], ph: dict | None = None, ewma: dict | None = None) -> DataFrame:
    """``errors``: keys, row_idx, x. Needs the RocksDB state store (``ROCKSDB``)."""
    proc = DriftProcessor(keys, {**PH, **(ph or {})}, {**EWMA, **(ewma or {})})
    types = dict(errors.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "row_idx long", "ph_alarm boolean", "ewma_alarm boolean"])
    return errors.groupBy(*keys).transformWithStateInPandas(proc, schema, "Append", "None")
