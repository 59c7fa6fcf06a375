"""What request limits ask of the state: each access is a call between Spark and Python, so they may not grow with the windows."""

import pandas as pd

from rulewright.streaming import live


class _Store:
    """A state or a set of timers that counts the calls."""

    calls = 0

    def __init__(self):
        self.data = {}

    def __getattr__(self, name):
        data = self.data
        ways = {"containsKey": data.__contains__, "getValue": data.__getitem__, "updateValue": data.__setitem__, "removeKey": data.pop, "keys": lambda: list(data), "exists": lambda: "v" in data, "get": lambda: data["v"], "update": lambda v: data.update(v=v), "clear": data.clear, "registerTimer": lambda t: data.update({t: t}), "deleteTimer": data.pop}
        _Store.calls += 1
        return ways[name]


class _Handle(_Store):
    def getMapState(self, *_):  # noqa: N802
        return _Store()

    getValueState = getMapState  # noqa: N815


class _Times:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def _rows(hours, policy="view", subject=1):
    return pd.DataFrame({"at": [h * 3_600_000_000 + m for h in hours for m in (2, 1, 0)], "policy": policy, "subject": subject, "event_id": range(3 * len(hours))})


def test_calls_and_timers_do_not_grow_with_windows_and_subjects():
    handle, limiter = _Handle(), live._Limiter({"view": 2}, 3600)
    limiter.init(handle)
    _Store.calls = 0
    many = pd.concat([_rows(range(48), subject=s) for s in range(50)])
    list(limiter.handleInputRows((0,), iter([many]), None))
    assert len(handle.data) == 1 and _Store.calls < 20
    list(limiter.handleInputRows((0,), iter([_rows([-1])]), None))
    assert list(handle.data) == [0]
    # the watermark is at the end of hour 29: a whole stretch closes, and part of the next one
    handle.data.pop(0)
    out = pd.concat(limiter.handleExpiredTimer((0,), _Times(30 * 3_600_000), _Times(0)))
    assert len(out) == 2 * (50 * 30 + 1) and set(out["n"]) == {3} and list(handle.data) == [31 * 3_600_000]
    handle.data.clear()
    rest = pd.concat(limiter.handleExpiredTimer((0,), _Times(99 * 3_600_000), _Times(0)))
    assert len(rest) == 2 * 50 * 18 and not limiter.held.data
    assert out[(out["subject"] == 1) & (out["window_start"] == pd.Timestamp(0))]["event_id"].tolist() == [2, 1]
