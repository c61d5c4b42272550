"""Calls that the review stream makes to the state server: they, not the rows, set its time."""

from pyspark.sql import Row

from tidemark.streaming.review import Cases, Requests


class Counted:
    """A handle whose states are a dictionary and count what is asked of them."""

    def __init__(self):
        self.calls, self.entries, self.value = 0, {}, None

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def containsKey(self, key):
        self.calls += 1
        return key in self.entries

    def getValue(self, key):
        self.calls += 1
        return self.entries[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def command(case, request, version, content="x", actor="me", action="claim"):
    return Row(application_id=case, request_id=request, action=action, actor=actor, expected_version=version, content=content)


def test_new_requests_cost_two_calls_and_commands_that_are_not_accepted_none():
    bind, move, ids, cases = Requests(), Cases(), Counted(), Counted()
    bind.init(ids)
    move.init(cases)
    bound = list(bind.handleInputRows((0,), iter([command("A", f"q{i}", 0) for i in range(100)]), None))
    assert ids.calls == 200 and not any(r.issue or r.again for r in bound)
    out = list(move.handleInputRows(("A",), iter(bound), None))
    # The case's state is looked for and written, and one request is accepted.
    assert [r.result for r in out].count("accepted") == 1 and {r.reason for r in out} == {"", "stale_version"} and cases.calls == 3


def test_ids_of_one_bucket_stay_apart_within_a_batch_and_over_batches():
    bind, move = Requests(), Cases()
    bind.init(Counted())
    move.init(Counted())
    first = list(bind.handleInputRows((0,), iter([command("B", "q1", 1, content="z"), command("A", "q1", 0), command("A", "q1", 0), command("A", "q2", 7)]), None))
    assert [(r.application_id, r.request_id, r.issue, r.again) for r in first] == [("B", "q1", "request_conflict", False), ("A", "q1", "", False), ("A", "q1", "", False), ("A", "q2", "", False)]
    out = list(move.handleInputRows(("A",), iter(r for r in first if r.application_id == "A"), None))
    assert [(r.request_id, r.result) for r in out] == [("q1", "accepted"), ("q1", "replayed"), ("q2", "rejected")]
    later = list(bind.handleInputRows((0,), iter([command("A", "q1", 0), command("A", "q2", 7, content="y"), command("A", "q3", 0)]), None))
    assert [(r.request_id, r.issue, r.again) for r in later] == [("q1", "", True), ("q2", "request_conflict", True), ("q3", "", False)]
    assert [(r.request_id, r.result, r.reason) for r in move.handleInputRows(("A",), iter(later), None)] == [("q1", "replayed", ""), ("q3", "rejected", "stale_version"), ("q2", "rejected", "request_conflict")]
