"""Calls of the state store by reminders: each is a turn between two processes, and an item's rows cost a bounded number of them."""

from pyspark.sql import Row
from quillgraph.streaming.reminders import Reminders


class Store:
    """The handle and the value of one item's state; each call is noted."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, due):
        self.calls.append("register")
        self.timers.add(due)

    def deleteTimer(self, due):
        self.calls.append("delete")
        self.timers.remove(due)


def test_timers_are_moved_without_listing_them():
    store, made = Store(), Reminders()
    made.init(store)

    def turn(*rows):
        store.calls.clear()
        assert list(made.handleInputRows(("a",), iter([Row(due=d, seq=s, status=t, description="x") for d, s, t in rows]), None)) == []
        return store.calls

    assert turn((5, 2, "open"), (3, 1, "open")) == ["get", "update", "register"] and store.timers == {5}
    assert turn((7, 1, "open")) == ["get"]  # older than what is known
    assert turn((9, 3, "open")) == ["get", "update", "delete", "register"] and store.timers == {9}
    assert turn((9, 4, "done")) == ["get", "update", "delete"] and store.timers == set()
    assert turn((8, 5, "open")) == ["get", "update", "register"]
    store.timers.clear()
    assert [r.id for r in made.handleExpiredTimer(("a",), None, None)] == ["a"] and store.value[2] == "reminded"
    assert turn((99, 6, "open")) == ["get"] and store.timers == set()
