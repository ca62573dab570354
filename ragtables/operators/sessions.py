"""Conversation events: admission of connections, session state, routing, replies of the assistant.

Events: (event_id, conversation_id, ts, organization_id, actor 'user'|'agent', kind 'connect'|'disconnect'|'typing'|
other). What holds at an event follows from strictly earlier events of its conversation, ordered by (ts, event_id).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtables.functions.text import strip

ORDER = ("ts", "event_id")


def last_before(events: DataFrame, values: dict[str, Column], unit: str = "hour") -> DataFrame:
    """Add, for each name, the last non-NULL value of its expression among earlier events of the conversation.

    A conversation is cut into time slices so that one which holds a large part of all events spreads over many
    tasks: each slice is first summed up to its last values, a window over these few summaries carries them forward,
    and a window within the slice does the rest.
    """
    slices = [F.col("conversation_id"), F.date_trunc(unit, "ts").alias("_slice")]
    marked = events.withColumns({"_slice": slices[1], **{f"_v_{n}": v for n, v in values.items()}})

    def last_in_slice(name):
        value = F.col(f"_v_{name}")
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*ORDER))).alias(f"_s_{name}")

    summary = marked.groupBy("conversation_id", "_slice").agg(*[last_in_slice(n) for n in values])
    earlier_slices = (Window.partitionBy("conversation_id").orderBy("_slice")
                      .rowsBetween(Window.unboundedPreceding, -1))
    carried = summary.select("conversation_id", "_slice", *[
        F.last(f"_s_{n}", ignorenulls=True).over(earlier_slices).alias(f"_c_{n}") for n in values])
    in_slice = (Window.partitionBy("conversation_id", "_slice").orderBy(*ORDER)
                .rowsBetween(Window.unboundedPreceding, -1))
    return marked.join(carried, ["conversation_id", "_slice"]).select(*events.columns, *[
        F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(in_slice), F.col(f"_c_{n}")).alias(n) for n in values])


def _is(actor: str, kind: str) -> Column:
    return (F.col("actor") == actor) & (F.col("kind") == kind)


def session_mode(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Add the state before each event: ``session_org`` (NULL: no session), ``mode`` and ``user_present``.

    A user's connect opens a new session in 'ai' mode without agent; an agent of the session's organization turns it
    to 'human' and back to 'ai' on leaving; a user's disconnect keeps the session.
    """
    opened = last_before(events, {
        "session_org": F.when(_is("user", "connect"), F.col("organization_id")),
        "user_present": F.when(_is("user", "connect"), True).when(_is("user", "disconnect"), False),
    }, unit)
    admitted = _is("agent", "connect") & F.coalesce(F.col("session_org") == F.col("organization_id"), F.lit(False))
    mode = (F.when(_is("user", "connect") | _is("agent", "disconnect"), "ai").when(admitted, "human"))
    return (last_before(opened, {"mode": mode}, unit)
            .withColumn("mode", F.coalesce("mode", F.lit("ai")))
            .withColumn("user_present", F.coalesce("user_present", F.lit(False))))


def route_messages(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Add ``route``: where each event goes.

    'admitted', 'rejected' or 'closed' for connects and disconnects; 'agent', 'user', 'ai', 'dropped' or 'rejected' for
    the others. Every kind other than 'typing' is a message.
    """
    state = session_mode(events, unit)
    human, present = F.col("mode") == "human", F.col("user_present")
    same_org = F.coalesce(F.col("session_org") == F.col("organization_id"), F.lit(False))
    route = (F.when(_is("user", "connect"), "admitted")
             .when(_is("agent", "connect"), F.when(same_org, "admitted").otherwise("rejected"))
             .when(F.col("kind") == "disconnect", "closed")
             .when(F.col("actor") == "user",
                   F.when(~present, "rejected").when(human, "agent")
                   .when(F.col("kind") == "typing", "dropped").otherwise("ai"))
             .otherwise(F.when(~human, "rejected").when(present, "user").otherwise("dropped")))
    return state.withColumn("route", route)


class Session(NamedTuple):
    """State of one conversation, for the streaming form."""

    organization: str | None = None
    mode: str = "ai"
    user_present: bool = False


def step(session: Session, actor: str, kind: str, organization: str) -> tuple[Session, str]:
    """Route of one event and the state after it; the rules of :func:`route_messages` one event at a time."""
    if kind == "connect":
        if actor == "user":
            return Session(organization, "ai", True), "admitted"
        if session.organization is not None and session.organization == organization:
            return session._replace(mode="human"), "admitted"
        return session, "rejected"
    if kind == "disconnect":
        return session._replace(**({"user_present": False} if actor == "user" else {"mode": "ai"})), "closed"
    if actor == "user":
        if not session.user_present:
            return session, "rejected"
        if session.mode == "human":
            return session, "agent"
        return session, "dropped" if kind == "typing" else "ai"
    if session.mode != "human":
        return session, "rejected"
    return session, "user" if session.user_present else "dropped"


def admit_connections(connects: DataFrame, unit: str = "hour") -> DataFrame:
    """Add ``decision``: 'admitted' or the first rule that a connection breaks. Claims of the token are columns:
    ``claims_valid``, ``claim_conversation_id``, ``claim_organization_id``, ``claim_type``."""
    broken = (F.when(F.col("token").isNull() | F.col("conversation_id").isNull(),
                     "No token/conversation id provided")
              .when(~F.col("claims_valid"), "Invalid token")
              .when(~F.col("claim_conversation_id").eqNullSafe(F.col("conversation_id")), "Conversation mismatch")
              .when(F.col("claim_organization_id").isNull(), "Organization ID not found"))
    judged = connects.withColumn("_broken", broken)
    opens = F.col("_broken").isNull() & (F.col("claim_type") == "user")
    known = last_before(judged, {"_session_org": F.when(opens, F.col("claim_organization_id"))}, unit)
    decision = (F.coalesce(
        F.col("_broken"),
        F.when(F.col("claim_type") == "user", "admitted")
        .when(F.col("claim_type") == "agent",
              F.when(F.col("_session_org").isNull(), "Session not found")
              .when(F.col("_session_org") != F.col("claim_organization_id"), "Organization mismatch")
              .otherwise("admitted"))
        .otherwise("Invalid type")))
    return known.withColumn("decision", decision).drop("_broken", "_session_org")


def ai_reply_events(messages: DataFrame) -> DataFrame:
    """Three events for each message the assistant answers: typing on, the answer or an error, typing off.

    ``answer`` holds the model's reply; NULL means that the call failed with ``error``.
    """
    def event(seq, kind, body, typing):
        return F.struct(F.lit(seq).alias("seq"), kind.alias("type"), body.alias("body"),
                        F.lit(typing).cast("boolean").alias("is_typing"))

    failed = F.col("answer").isNull()
    reply_kind = F.when(failed, "error").otherwise("message")
    reply = F.when(failed, F.concat(F.lit("AI error: "), F.coalesce("error", F.lit("")))).otherwise(strip(F.col("answer")))
    none = F.lit(None).cast("string")
    events = F.array(event(1, F.lit("typing"), none, True), event(2, reply_kind, reply, None),
                     event(3, F.lit("typing"), none, False))
    rest = [c for c in messages.columns if c not in ("answer", "error")]
    return messages.select(*rest, F.explode(events).alias("e")).select(*rest, "e.*")


def conversation_rollup(messages: DataFrame) -> DataFrame:
    """Last message of each conversation, as one aggregate with map-side combine."""
    last = F.max_by("content", F.struct("created_at", "message_id"))
    return messages.groupBy("conversation_id").agg(
        last.alias("last_message_snippet"), F.max("created_at").alias("last_message_at"),
        F.count("*").alias("n_messages"))


def feedback_summary(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Positive and negative feedback per conversation. Feedback is counted per message before the join."""
    per_message = feedback.groupBy("message_id").agg(
        F.count_if(F.col("feedback") == "positive").alias("p"), F.count_if(F.col("feedback") == "negative").alias("n"))
    return (messages.select("message_id", "conversation_id").join(per_message, "message_id")
            .groupBy("conversation_id").agg(F.sum("p").alias("positive"), F.sum("n").alias("negative")))
