"""What a key on a live stream costs in calls of the state store."""

import numpy as np
import pandas as pd

from txrisk.streaming import live_state


class Store:
    """A state variable that counts its calls and entries."""

    def __init__(self, calls):
        self.calls, self.held = calls, []

    def get(self):
        self.calls.append("get")
        return iter(list(self.held)) if self.listed else (self.held[-1] if self.held else None)

    def appendValue(self, value):
        self.calls.append("append")
        self.held.append(value)

    def put(self, values):
        self.calls.append("put")
        self.held = list(values)

    def update(self, value):
        self.calls.append("update")
        self.held = [value]

    def clear(self):
        self.calls.append("clear")
        self.held = []


class Handle:
    def __init__(self):
        self.calls, self.timers, self.stores = [], set(), {}

    def _store(self, name, listed):
        store = self.stores[name] = Store(self.calls)
        store.listed = listed
        return store

    def getValueState(self, name, schema):
        return self._store(name, False)

    def getListState(self, name, schema):
        return self._store(name, True)

    def registerTimer(self, ms):
        self.calls.append("timer")
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls.append("timer")
        self.timers.discard(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_key_costs_a_few_state_calls_however_many_events_it_has():
    n, handle, processor = 1000, Handle(), live_state.LiveState()
    processor.init(handle)
    us = np.arange(n) * 1000
    writes = pd.DataFrame({"us": us, "what": 0, "id": np.arange(n), "payload": [str(i) for i in range(n)], "until_us": us + 10**9})
    asks = writes.assign(what=live_state.ASK, payload=None, until_us=0)
    assert list(processor.handleInputRows(("k",), iter([writes, asks]), Clock(0))) == []
    assert len(handle.stores["waiting"].held) == 2 and handle.timers == {0}
    made = pd.concat(processor.handleExpiredTimer(("k",), Clock(500), None))
    assert made["payload"].tolist() == [str(i) for i in range(500)] and set(made["key"]) == {"k"}
    assert len(handle.stores["waiting"].held) == 1 and 500 in handle.timers
    made = pd.concat(processor.handleExpiredTimer(("k",), Clock(5000), None))
    assert made["id"].tolist() == list(range(500, 1000)) and len(handle.calls) <= 20
    late = list(processor.handleInputRows(("k",), iter([writes]), Clock(5000)))
    assert late == [] and not handle.stores["waiting"].held
    list(processor.handleExpiredTimer(("k",), Clock(2 * 10**6), None))
    assert not handle.stores["entry"].held and not handle.stores["due"].held
