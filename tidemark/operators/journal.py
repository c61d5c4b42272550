"""Replay of an append-only review journal, up to its first violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import carried
from tidemark.operators.reconcile import row_words

#: Fixed values of the review rules.
ACTIONS = ("claim", "release", "resolve", "reopen")
OUTCOMES = ("cleared", "escalated")
NAME_CHARS, TEXT_CHARS = 200, 2000
#: What a command says; a request that comes again has to say the same.
CONTENT = ("application_id", "action", "actor", "expected_version", "note", "evidence", "outcome")


def command_issue() -> Column:
    """The first rule that a command breaks by itself, or null.

    Names and texts stand without white space around them; a null text is an
    empty one.  A claim says nothing more, a release or reopening gives its
    reason, a resolution its reason, evidence and outcome.
    """
    given = lambda c: F.coalesce(c, F.lit(""))
    name = lambda c: F.coalesce((F.length(c) <= NAME_CHARS) & (F.col(c) != "") & ~F.col(c).rlike(r"^\s|\s$|\x00"), F.lit(False))
    text = lambda c: (F.length(given(c)) <= TEXT_CHARS) & ~given(c).rlike(r"^\s|\s$|\x00")
    empty = lambda c: given(c) == ""
    is_ = lambda *actions: F.col("action").isin(*actions)
    rules = [
        *((~name(c), f"invalid_{c}") for c in ("request_id", "application_id", "actor")),
        *((~text(c), f"invalid_{c}") for c in ("note", "evidence", "outcome")),
        (~F.coalesce(F.col("expected_version") >= 0, F.lit(False)), "invalid_version"),
        (~F.coalesce(is_(*ACTIONS), F.lit(False)), "invalid_action"),
        (is_("claim") & ~(empty("note") & empty("evidence") & empty("outcome")), "claim_with_text"),
        (is_("resolve") & (empty("note") | empty("evidence")), "incomplete_resolution"),
        (is_("resolve") & ~given("outcome").isin(*OUTCOMES), "unknown_outcome"),
        (is_("release", "reopen") & empty("note"), "missing_reason"),
        (is_("release", "reopen") & ~(empty("evidence") & empty("outcome")), "evidence_without_resolution"),
    ]
    return F.coalesce(*(F.when(condition, F.lit(code)) for condition, code in rules))


def transitions(journal: DataFrame) -> DataFrame:
    """Events with the rule of the state machine that they break, or null; right up to a case's first violation.

    A case's state follows from its last event: the owner of a claimed case is
    the actor of that claim.
    """
    case = Window.partitionBy("application_id").orderBy("sequence")
    before, actor = F.lag("action").over(case), F.lag("actor").over(case)
    place = F.row_number().over(case) - 1
    queued = before.isNull() | before.isin("release", "reopen")
    issue = (
        F.when(F.col("expected_version") != place, "stale_version")
        .when((F.col("action") == "claim") & ~queued, "not_queued")
        .when(F.col("action").isin("release", "resolve") & ~F.coalesce((before == "claim") & (actor == F.col("actor")), F.lit(False)), "not_owner")
        .when((F.col("action") == "reopen") & ~F.coalesce(before == "resolve", F.lit(False)), "not_resolved")
    )
    return journal.withColumn("issue", F.coalesce(command_issue(), issue))


#: A time with its offset from UTC, which is none.
UTC_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-]00:00)\z"


def _utc(stamp: str, kind: str) -> Column:
    """Whether a stamp is in UTC: a text says so, a timestamp is an instant."""
    if kind == "timestamp":
        return F.col(stamp).isNotNull()
    text = F.col(stamp).cast("string")
    return F.coalesce(text.rlike(UTC_STAMP) & F.try_to_timestamp(F.translate(F.substring(text, 1, 16), "T", " "), F.lit("yyyy-MM-dd HH:mm")).isNotNull(), F.lit(False))


def judged(journal: DataFrame, queue: DataFrame) -> DataFrame:
    """Events with ``issue``, the first rule of the journal or of their case that they break, or null; right up to the journal's first violation.

    Sequences run from 1 without a gap, a request comes once, its case is in the
    queue, and its time is UTC.
    """
    kind = journal.schema["occurred_at"].dataType.typeName() if "occurred_at" in journal.columns else None
    placed = carried(transitions(journal).withColumn("one", F.lit(1).cast("long")), (), ("sequence",), position=("sum", "one"))
    # What comes again is found by the first of each request, not by an order of them all.
    firsts = journal.groupBy("request_id").agg(F.min("sequence").alias("first"))
    known = queue.select("application_id").distinct().withColumn("known", F.lit(True))
    rows = placed.join(firsts, "request_id", "left").join(known, "application_id", "left")
    none = F.lit(None).cast("string")
    whole = F.coalesce(
        F.when(~F.coalesce(F.col("sequence") == F.col("position"), F.lit(False)), "broken_sequence"),
        F.when(F.coalesce(F.col("sequence") > F.col("first"), F.lit(False)), "repeated_request"),
        F.when(F.col("known").isNull(), "unknown_case"),
        none if kind is None else F.when(~_utc("occurred_at", kind), "time_not_utc"),
    )
    own = ("invalid_", "claim_with", "incomplete_", "unknown_outcome", "missing_", "evidence_without")
    single = F.col("issue").rlike("^(" + "|".join(own) + ")")
    return rows.withColumn("issue", F.when(single, F.col("issue")).otherwise(F.coalesce(whole, "issue"))).drop("one", "position", "first", "known")


def first_violation(events: DataFrame) -> DataFrame:
    """One row: the first sequence that breaks a rule and that rule, null if none does."""
    return events.agg(F.min(F.when(F.col("issue").isNotNull(), F.struct("sequence", "issue"))).alias("x")).select(F.col("x.sequence").alias("violation"), F.col("x.issue").alias("issue"))


def replay(queue: DataFrame, journal: DataFrame) -> DataFrame:
    """Each queued case's state after the events before the journal's first violation, and that violation's sequence and rule.

    No event after it counts, whatever its case: a broken journal says nothing more.
    """
    events = judged(journal, queue)
    first = first_violation(events)
    legal = events.crossJoin(F.broadcast(first.select("violation"))).filter("violation is null or sequence < violation")
    last = legal.groupBy("application_id").agg(F.max_by(F.struct("action", "actor", "outcome"), "sequence").alias("x"), F.count("*").alias("version"))
    status = F.when(F.col("x.action") == "claim", "in_review").when(F.col("x.action") == "resolve", "resolved").otherwise("queued")
    out = queue.join(last, "application_id", "left").crossJoin(F.broadcast(first))
    return out.select(
        "application_id",
        status.alias("status"),
        F.when(F.col("x.action").isin("claim", "resolve"), F.col("x.actor")).alias("owner"),
        F.when(F.col("x.action") == "resolve", F.col("x.outcome")).alias("outcome"),
        F.coalesce("version", F.lit(0)).alias("version"),
        "violation",
        "issue",
    )


def integrity(journal: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: events, whether sequences are dense, repeated requests, events of unknown cases, times that aren't UTC, and the first violation."""
    repeated = journal.groupBy("request_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("repeated_requests"))
    unknown = journal.join(queue, "application_id", "left_anti").agg(F.count("*").alias("unknown_cases"))
    kind = journal.schema["occurred_at"].dataType.typeName()
    dense = journal.agg(F.count("*").alias("events"), ((F.min("sequence") == 1) & (F.max("sequence") == F.count("*")) & (F.count_distinct("sequence") == F.count("*"))).alias("dense"), F.count_if(~_utc("occurred_at", kind)).alias("not_utc"))
    return dense.crossJoin(repeated).crossJoin(unknown).crossJoin(first_violation(judged(journal, queue)))


def idempotent(commands: DataFrame) -> DataFrame:
    """Each request once: ``new``, ``replayed`` if the same content came again, or ``conflict``."""
    content = F.struct(*CONTENT)
    out = commands.groupBy("request_id").agg(F.count("*").alias("times"), F.count_distinct(content).alias("versions"))
    return out.select("request_id", "times", F.when(F.col("versions") > 1, "conflict").when(F.col("times") > 1, "replayed").otherwise("new").alias("result"))


def review_status(states: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return states.agg(
        F.count("*").alias("cases"), of("queued").alias("queued"), of("in_review").alias("in_review"), of("resolved").alias("resolved"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES),
        F.round(of("resolved") / F.nullif(F.count("*"), F.lit(0)), 8).alias("completion_rate"),
    )


def consistent_cut(journal: DataFrame, n: int) -> DataFrame:
    """The journal as it was after its first ``n`` events."""
    return journal.filter(F.col("sequence") <= n)


def running_identity(journal: DataFrame, *columns: str) -> DataFrame:
    """``(sequence, rows, word_0, ..)``: the fingerprint of ``columns`` of every cut ``sequence <= n``, from one pass of running sums."""
    words = [f"w{i}" for i in range(4)]
    hashed = journal.select("sequence", F.lit(1).cast("long").alias("one"), *(w.cast("decimal(38,0)").alias(n) for w, n in zip(row_words(*columns), words, strict=True)))
    summed = carried(hashed, (), ("sequence",), rows=("sum", "one"), **{f"word_{i}": ("sum", w) for i, w in enumerate(words)})
    # Of rows of one sequence, the cut has all.
    cut = summed.groupBy("sequence").agg(F.max("rows").alias("rows"), *(F.max(f"word_{i}").cast("string").alias(f"word_{i}") for i in range(4)))
    return cut


def bundle(queue: DataFrame, journal: DataFrame, n: int, *columns: str) -> DataFrame:
    """Each case's state at the cut ``sequence <= n``, beside the identity of the cut's events."""
    upto = running_identity(journal, *columns).filter(F.col("sequence") <= n)
    identity = upto.agg(F.max_by(F.struct("rows", *(f"word_{i}" for i in range(4))), "sequence").alias("x")).select("x.*")
    return replay(queue, consistent_cut(journal, n)).crossJoin(F.broadcast(identity))
