"""Belief tracking on a stream of evidence, and windowed counts with late data."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.vec import transition_matrix
from ..operators.temporal import Fold
from ..schema import N_STAGES


def windowed(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and kind; the watermark closes windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", kind, "n", "total")


#: The time, in microseconds, of a row that closes a series.
CLOSED = 1 << 62


def closing(series: DataFrame, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """Rows of a stream for ``track`` after which nothing of these series waits any more."""
    none = F.lit(None)
    return series.select(key).distinct().select(key, F.lit(CLOSED).cast("long").alias("at"), none.cast("long").alias(order), none.cast("array<double>").alias("belief"))


def track(events: DataFrame, series: str = "user_id", order: str = "event_id", belief: str = "belief", delay: float = 600.0) -> DataFrame:
    """(series, order, stage, confidence, late): beliefs of a stream fused in event time. ``events``: series, at (microseconds), order, belief.

    A row waits until its series has been seen ``delay`` seconds beyond it, and is then folded in the order (at, order), so batches may
    come in any order within the delay. A row from before what is folded already is late: it comes out at once with ``late`` and
    without a stage, and changes nothing. ``closing`` rows let all that waits go. The state of a series is its last
    belief, its latest time and the rows of the delay that wait, not the series.
    """
    step_ = Fold(transition_matrix(N_STAGES))
    wait = round(delay * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # what waits is a line of text a row: a batch that lets nothing go adds its lines and reads none
        last, seen, oldest, waiting = (list(state.get[0]) or None, *state.get[1:]) if state.exists else (None, -CLOSED, CLOSED, "")
        closed, out, new = seen - wait, [], []
        for rows in batches:
            for at, i, b in zip(rows["at"], rows[order], rows[belief], strict=True):
                seen = max(seen, int(at))
                if b is None:
                    continue
                if at < closed:
                    out.append((int(i), None, None, True))
                else:
                    oldest = min(oldest, int(at))
                    new.append(json.dumps([int(at), int(i), [float(v) for v in b]]))
        waiting = "\n".join([waiting, *new] if waiting else new)
        closed = seen - wait
        if oldest < closed:
            held = sorted((json.loads(x), x) for x in waiting.split("\n"))
            for (at, i, b), _ in held:
                if at < closed:
                    last = step_(last, b)
                    out.append((i, max(range(N_STAGES), key=lambda k: last[k]), max(last), False))
            held = [h for h in held if h[0][0] >= closed]
            oldest, waiting = held[0][0][0] if held else CLOSED, "\n".join(x for _, x in held)
        state.update((last or [], seen, oldest, waiting))
        if out:
            ids, stages, confidences, late = zip(*out, strict=True)
            yield pd.DataFrame({series: [key[0]] * len(out), order: ids, "stage": pd.array(stages, "Int32"), "confidence": pd.array(confidences, "Float64"), "late": late})

    schema = f"{series} long, {order} long, stage int, confidence double, late boolean"
    return events.select(series, "at", order, belief).groupBy(series).applyInPandasWithState(step, schema, "belief array<double>, seen long, oldest long, waiting string", "append", GroupStateTimeout.NoTimeout)
