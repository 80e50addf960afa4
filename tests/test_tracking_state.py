"""F20 stream_belief_tracking: a batch that lets nothing go costs its own rows, not what waits."""

from types import SimpleNamespace
from unittest.mock import MagicMock

import pandas as pd
from veridica.streaming import tracking

SECOND = 1_000_000


class State(SimpleNamespace):
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_waiting_rows_are_neither_read_nor_told(monkeypatch):
    events = MagicMock()
    tracking.track(events, delay=4)
    step = events.select().groupBy().applyInPandasWithState.call_args[0][0]
    belief = [0.5, 0.1, 0.1, 0.1, 0.1, 0.1]
    state, loads = State(), tracking.json.loads

    def batch(*times):
        rows = pd.DataFrame({"at": [t * SECOND for t in times], "event_id": times, "belief": [belief] * len(times)})
        return list(step((7,), iter([rows]), state))

    monkeypatch.setattr(tracking.json, "loads", lambda _: 1 / 0)
    assert batch(3, 1) == [] and batch(2) == []
    monkeypatch.setattr(tracking.json, "loads", loads)
    (told,) = batch(6)
    assert told["event_id"].tolist() == [1] and told["user_id"].tolist() == [7] and not told["late"].any()
    (told,) = batch(1, 20)
    assert list(zip(told["event_id"], told["late"], strict=True)) == [(1, True), (2, False), (3, False), (6, False)]
    assert told["stage"].isna().tolist() == [True, False, False, False]
    (late,) = batch(5)
    assert late["late"].tolist() == [True]
