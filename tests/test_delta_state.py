"""The delta stream's state without a stream: calls to the store and rows that wait."""
import pandas as pd

from pricelens.streaming.events import DeltaState


class Store:
    """One key's values and timers; counts calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.values.get(name)

            def update(self, value):
                store.calls += 1
                store.values[name] = value

            def clear(self):
                store.values.pop(name, None)
        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_waiting_rows_are_one_value_and_keep_one_timer():
    state, store = DeltaState(2_000), Store()
    state.init(store)
    part = pd.DataFrame({"ts_ms": [3_000, 1_000, 2_000, 9_000], "snapshot_seq": [3, 1, 2, 4], "volume": [30, 10, 20, 40]})
    assert list(state.handleInputRows(("x",), iter([part]), Clock(0))) == [] and store.calls <= 6 and store.timers == {9_000}
    (out,) = state.handleInputRows(("x",), iter([part.assign(ts_ms=9_500, snapshot_seq=5, volume=50).head(1)]), Clock(3_000))
    assert out["snapshot_seq"].tolist() == [1, 2, 3] and out["delta_volume"].tolist() == [pd.NA, 10, 10] and store.timers == {9_500}
    store.timers.clear()  # the engine drops a timer that has expired
    (out,) = state.handleExpiredTimer(("x",), Clock(9_600), None)
    assert out["snapshot_seq"].tolist() == [4, 5] and out["segment_start"].tolist() == [9_000, 9_000] and store.timers == {11_501}
    store.timers.clear()
    assert list(state.handleExpiredTimer(("x",), Clock(20_000), None)) == [] and not store.values
