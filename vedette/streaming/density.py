"""Half-space trees on a stream: keyed state per (client, asset)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import rules
from ..operators import hst

STATE = T.StructType([
    T.StructField("seen", T.LongType()), T.StructField("learned", T.LongType()), T.StructField("last_us", T.LongType()),
    T.StructField("recent", T.ArrayType(T.LongType())), T.StructField("before", T.BinaryType()),
    T.StructField("current", T.BinaryType())])
OUT = ("client_id string, asset_id string, event_id long, seq long, raw_score double, river_warmup boolean, learned boolean")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
N = len(rules.FEATURES)


def _rounded(x: float) -> float:
    return float(np.floor(x * 10000.0 + 0.5) / 10000.0)


class DensityProcessor(StatefulProcessor):
    """State per key: counters, the last minute's times and the learned vectors of two blocks.

    Two blocks of 2000 vectors bound the state. A control row (``control`` = reset) clears
    the key. Rows of one batch are taken in time order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("density", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable")
        if self.state.exists():
            seen, learned, last, recent, before, current = self.state.get()
            recent = list(recent)
            before = np.frombuffer(before, dtype=float).reshape(-1, N)
            current = list(np.frombuffer(current, dtype=float).reshape(-1, N))
        else:
            seen, learned, last, recent, before, current = 0, 0, None, [], np.zeros((0, N)), []
        out, waiting = [], []

        def flush() -> None:
            if waiting:
                x = np.array([w[1] for w in waiting])
                raw = hst.density(x, before) if len(before) else np.zeros(len(x))
                out.extend((*w[0], float(s), *w[2]) for w, s in zip(waiting, raw))
                waiting.clear()

        for r in batch.itertuples(index=False):
            if r.control == "reset":
                flush()
                seen, learned, last, recent, before, current = 0, 0, None, [], np.zeros((0, N)), []
                continue
            t = int(r.ts_us)
            gap = 1.0 if last is None else _rounded(min(1.0, np.log10(max(0.0, (t - last) / 1e6) + 1.0) / np.log10(3601.0)))
            recent = [x for x in recent if x > t - 60_000_000] + [t]
            hour, day = (t // 3_600_000_000) % 24, (t // 86_400_000_000 + 3) % 7
            x = [r.severity_score, r.asset_value, gap, r.event_type_id, r.command_risk, r.numeric_anomaly,
                 _rounded(np.sin(2 * np.pi * hour / 24) / 2 + 0.5), _rounded(day / 6.0), _rounded(min(1.0, len(recent) / 60.0))]
            last, seen = t, seen + 1
            learns, warm = r.danger_score < rules.FORCED_DANGER, seen < rules.WARMUP_EVENTS
            if learned // rules.HST_WINDOW != (learned - len(current)) // rules.HST_WINDOW:
                flush()  # the block is full: it becomes the reference of the next one
                before, current = np.array(current).reshape(-1, N), []
            waiting.append(((int(r.event_id), seen), x, (warm, bool(learns))))
            if learns:
                copies = 2 if warm else 1
                current += [x] * copies
                learned += copies
        flush()
        self.state.update((seen, learned, last, recent, before.astype(float).tobytes(),
                           np.array(current, dtype=float).reshape(-1, N).tobytes()))
        if out:
            frame = pd.DataFrame(out, columns=["event_id", "seq", "raw_score", "river_warmup", "learned"])
            frame.insert(0, "asset_id", key[1])
            frame.insert(0, "client_id", key[0])
            yield frame

    def close(self) -> None:
        pass


def stream_hst(stream: DataFrame) -> DataFrame:
    """raw_score per event. Needs client_id, asset_id, event_id, ts_us, the five base
    features, danger_score and control (NULL or "reset")."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy("client_id", "asset_id").transformWithStateInPandas(
        statefulProcessor=DensityProcessor(), outputStructType=OUT, outputMode="Append", timeMode="None")
