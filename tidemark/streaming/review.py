"""Live acceptance of review commands: two chained keyed states, by request and by case."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import journal

COMMAND = "application_id string, request_id string, action string, actor string, expected_version int, issue string, again boolean"
OUT = "application_id string, request_id string, expected_version int, result string, reason string, version int"
#: Of request ids; a bucket's commands of one batch are held in one task.
BUCKETS = 4096
#: States by key with entries of their own need this store.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(status: str, owner: str | None, version: int, action: str, actor: str, expected: int) -> str:
    """The rule that a command breaks in a case's state, or an empty text."""
    if expected != version:
        return "stale_version"
    if action == "claim":
        return "" if status == "queued" else "not_queued"
    if action in ("release", "resolve"):
        return "" if status == "in_review" and owner == actor else "not_owner"
    return "" if action == "reopen" and status == "resolved" else "not_resolved"


AFTER = {"claim": "in_review", "release": "queued", "resolve": "resolved", "reopen": "queued"}


class Requests(StatefulProcessor):
    """By bucket of request ids, an entry for each id: what the id stands for is what its first command says; others are a conflict.

    ``again`` tells that an earlier batch had the id.  A key costs calls of its own, so ids share buckets; entries of a bucket are read one by one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getMapState("said", "request_id string", "content string")

    def handleInputRows(self, key: tuple[int], rows: Iterator[Row], timer_values) -> Iterator[Row]:
        commands: dict[str, list[Row]] = {}
        for c in rows:
            commands.setdefault(c.request_id, []).append(c)
        for request, same in commands.items():
            again = self.said.containsKey((request,))
            if again:
                said = self.said.getValue((request,))[0]
            else:
                said = min((c.expected_version, c.content) for c in same)[1]
                self.said.updateValue((request,), (said,))
            for c in same:
                yield Row(application_id=c.application_id, request_id=request, action=c.action, actor=c.actor, expected_version=c.expected_version, issue="" if c.content == said else "request_conflict", again=again)

    def close(self) -> None:
        pass


class Cases(StatefulProcessor):
    """By case: its status, owner and version as one value, and an entry for each request that it accepted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("case", "status string, owner string, version int")
        self.accepted = handle.getMapState("accepted", "request_id string", "version int")

    def handleInputRows(self, key: tuple[str], rows: Iterator[Row], timer_values) -> Iterator[Row]:
        status, owner, version = self.state.get() if self.state.exists() else ("queued", None, 0)
        now = set()
        for c in sorted(rows, key=lambda c: (c.expected_version, c.request_id)):
            request = c.request_id
            if c.issue:
                result, reason = "rejected", c.issue
            # Only a request of an earlier batch can have an entry from there.
            elif request in now or c.again and self.accepted.containsKey((request,)):
                result, reason = "replayed", ""
            else:
                reason = decide(status, owner, version, c.action, c.actor, c.expected_version)
                result = "rejected" if reason else "accepted"
                if not reason:
                    status, owner, version = AFTER[c.action], c.actor if c.action in ("claim", "resolve") else None, version + 1
                    self.accepted.updateValue((request,), (version,))
                    now.add(request)
            yield Row(application_id=key[0], request_id=request, expected_version=c.expected_version, result=result, reason=reason, version=version)
        self.state.update((status, owner, version))

    def close(self) -> None:
        pass


def stream_review(commands: DataFrame, queue: DataFrame) -> DataFrame:
    """Accepted, replayed and rejected commands of a stream; a case's commands are decided one after another.

    The rules that a command can break by itself, and whether its case is in
    ``queue``, are checked before it reaches any state.  A request id stands for
    what the first such command says, over all cases and for good, even if the
    command is then rejected: the same again is replayed if it was accepted and
    decided anew if not, anything else is a conflict.  A batch reads and writes
    the entries of its own requests and cases only.
    """
    commands.sparkSession.conf.set(STORE, ROCKS)
    said = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in journal.CONTENT))
    known = queue.select("application_id").distinct().withColumn("known", F.lit(True))
    issue = F.coalesce(journal.command_issue(), F.when(F.col("known").isNull(), "unknown_case"))
    read = commands.join(known, "application_id", "left")
    judged = read.select("application_id", "request_id", "action", "actor", F.col("expected_version").cast("int").alias("expected_version"), F.sha2(F.to_json(said), 256).alias("content"), issue.alias("issue"))
    broken = judged.filter("issue is not null").select("application_id", "request_id", "expected_version", F.lit("rejected").alias("result"), F.col("issue").alias("reason"), F.lit(None).cast("int").alias("version"))
    bound = judged.filter("issue is null").withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS))).groupBy("bucket").transformWithState(Requests(), COMMAND, "Append", "None")
    decided = bound.groupBy("application_id").transformWithState(Cases(), OUT, "Append", "None")
    return decided.unionByName(broken)
