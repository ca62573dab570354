"""Chat messages and session events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.catalog.fixtures import view
from ragtables.operators import filters as B
from ragtables.operators import sessions as S
from ragtables.session import scratch_path


def state_sql(events: str) -> str:
    """The state before each event by plain windows over whole conversations."""
    before = "OVER (PARTITION BY conversation_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
    opened AS (SELECT *,
        last_value(CASE WHEN actor = 'user' AND kind = 'connect' THEN organization_id END IGNORE NULLS) {before}
            AS session_org,
        coalesce(last_value(CASE WHEN actor = 'user' AND kind = 'connect' THEN true
                                 WHEN actor = 'user' AND kind = 'disconnect' THEN false END IGNORE NULLS) {before},
                 false) AS user_present FROM {events}),
    state AS (SELECT *,
        coalesce(last_value(CASE WHEN actor = 'user' AND kind = 'connect' THEN 'ai'
                                 WHEN actor = 'agent' AND kind = 'disconnect' THEN 'ai'
                                 WHEN actor = 'agent' AND kind = 'connect' AND session_org = organization_id
                                     THEN 'human' END IGNORE NULLS) {before}, 'ai') AS mode FROM opened)"""


ROUTE = """CASE WHEN kind = 'connect' THEN CASE WHEN actor = 'user' THEN 'admitted'
                     WHEN session_org = organization_id THEN 'admitted' ELSE 'rejected' END
                WHEN kind = 'disconnect' THEN 'closed'
                WHEN actor = 'user' THEN CASE WHEN NOT user_present THEN 'rejected' WHEN mode = 'human' THEN 'agent'
                                              WHEN kind = 'typing' THEN 'dropped' ELSE 'ai' END
                WHEN mode <> 'human' THEN 'rejected' WHEN user_present THEN 'user' ELSE 'dropped' END"""


@query("session_mode", f"""
    WITH {state_sql('v_session_events')}
    SELECT event_id, conversation_id, coalesce(session_org, '') AS session_org, mode, user_present FROM state""")
def session_mode(spark, sf):
    state = S.session_mode(view(spark, sf, "v_session_events"))
    return state.select("event_id", "conversation_id", F.coalesce("session_org", F.lit("")).alias("session_org"),
                        "mode", "user_present")


ROUTED = f"WITH {state_sql('v_session_events')} SELECT event_id, conversation_id, {ROUTE} AS route FROM state"
MIXED = f"WITH {state_sql('v_mixed_events')} SELECT event_id, conversation_id, {ROUTE} AS route FROM state"


@query("route_messages", ROUTED)
def route_messages(spark, sf):
    routed = S.route_messages(view(spark, sf, "v_session_events"))
    return routed.select("event_id", "conversation_id", "route")


@query("route_mixed_messages", MIXED)
def route_mixed_messages(spark, sf):
    """Events with leaving users and agents of other organizations; every route occurs."""
    routed = S.route_messages(view(spark, sf, "v_mixed_events"), unit="day")
    return routed.select("event_id", "conversation_id", "route")


@query("route_messages_stream", MIXED)
def route_messages_stream(spark, sf):
    """The same events as a stream through keyed state."""
    from ragtables.catalog.fixtures import VIEWS, stream
    from ragtables.streaming.routing import route_stream

    base = scratch_path(spark, "routes")
    events = spark.sql(VIEWS["v_mixed_events"].replace("FROM events", "FROM {events}"), events=stream(spark, sf, "events"))
    sink = (route_stream(events).writeStream.format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    sink.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("route_out_of_order_stream", f"""
    WITH clocks AS (SELECT batch, max(max(epoch_ms(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                        - 2 * 86400000 AS clock FROM v_arriving_events GROUP BY batch),
    judged AS (SELECT e.*, coalesce(epoch_ms(ts) < clock, false) AS late FROM v_arriving_events e JOIN clocks c ON c.batch = e.batch),
    on_time AS (SELECT * FROM judged WHERE NOT late),
    {state_sql('on_time')}
    SELECT event_id, conversation_id, {ROUTE} AS route FROM state
    UNION ALL SELECT event_id, conversation_id, 'late' FROM judged WHERE late""")
def route_out_of_order_stream(spark, sf):
    """Events that come in batches of six days, some a day and some twelve days after their time, and a last one that moves the clock."""
    from ragtables.streaming.routing import DAY_MS, route_in_order

    base = scratch_path(spark, "arrivals")
    arriving = view(spark, sf, "v_arriving_events")
    arriving.write.partitionBy("batch").parquet(f"{base}/batches")  # the table is looked through once, by all tasks
    events = spark.read.schema(arriving.schema).parquet(f"{base}/batches")
    for batch in range(7):  # one file for each batch of the stream
        events.filter(F.col("batch") == batch).coalesce(1).write.mode("append").parquet(f"{base}/in")
    last = events.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "conversation_id": F.lit(-1).cast("long"),
                                        "ts": F.lit("2030-01-01 00:00:00").cast(events.schema["ts"].dataType)})
    last.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sink = (route_in_order(stream, delay_ms=2 * DAY_MS).writeStream.format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    sink.awaitTermination()
    return spark.read.parquet(f"{base}/out").filter("event_id >= 0")


@query("admit_connections", """
    WITH judged AS (SELECT *, CASE WHEN token IS NULL OR conversation_id IS NULL
                                       THEN 'No token/conversation id provided'
                                   WHEN NOT claims_valid THEN 'Invalid token'
                                   WHEN claim_conversation_id <> conversation_id THEN 'Conversation mismatch'
                                   WHEN claim_organization_id IS NULL THEN 'Organization ID not found' END AS broken
                    FROM v_connects),
    known AS (SELECT *, last_value(CASE WHEN broken IS NULL AND claim_type = 'user' THEN claim_organization_id END
                                   IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY ts, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS session_org FROM judged)
    SELECT event_id, conversation_id, CASE WHEN broken IS NOT NULL THEN broken WHEN claim_type = 'user' THEN 'admitted'
        WHEN claim_type <> 'agent' THEN 'Invalid type' WHEN session_org IS NULL THEN 'Session not found'
        WHEN session_org <> claim_organization_id THEN 'Organization mismatch' ELSE 'admitted' END AS decision
    FROM known""")
def admit_connections(spark, sf):
    judged = S.admit_connections(view(spark, sf, "v_connects"))
    return judged.select("event_id", "conversation_id", "decision")


@query("ai_reply_events", r"""
    WITH asked AS (SELECT q.conv_id, q.turn, a.text AS answer FROM conversations q LEFT JOIN conversations a
                       ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
                   WHERE q.role = 'user')
    SELECT conv_id, turn, 1 AS seq, 'typing' AS type, '' AS body FROM asked
    UNION ALL SELECT conv_id, turn, 2, CASE WHEN answer IS NULL THEN 'error' ELSE 'message' END,
                     CASE WHEN answer IS NULL THEN 'AI error: no answer' ELSE regexp_replace(answer, '^\s+|\s+$', '', 'g') END FROM asked
    UNION ALL SELECT conv_id, turn, 3, 'typing', '' FROM asked""")
def ai_reply_events(spark, sf):
    """The next message of the assistant stands for the model's reply."""
    rows = view(spark, sf, "conversations")
    replies = rows.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = rows.filter("role = 'user'").select("conv_id", "turn").join(replies, ["conv_id", "turn"], "left")
    events = S.ai_reply_events(asked.withColumn("error", F.lit("no answer")))
    return events.select("conv_id", "turn", "seq", "type", F.coalesce("body", F.lit("")).alias("body"))


@query("message_contract", """
    SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(content_type, 'text') AS content_type,
           coalesce(CAST(timestamp AS STRING), '2026-02-01 00:00:00') AS created_at,
           CASE WHEN content = '' THEN 'content'
                WHEN coalesce(role, 'user') NOT IN ('user', 'assistant', 'system') THEN 'role'
                WHEN coalesce(content_type, 'text') NOT IN ('text', 'file') THEN 'content_type'
                WHEN conversation_id = '' THEN 'conversation_id' ELSE '' END AS reason
    FROM v_raw_messages""")
def message_contract(spark, sf):
    judged = B.message_contract(view(spark, sf, "v_raw_messages"), "2026-02-01 00:00:00")
    return judged.select("conv_id", "turn", "role", "content_type",
                         F.col("created_at").cast("string").alias("created_at"),
                         F.coalesce("reason", F.lit("")).alias("reason"))


@query("prompt_projection", """
    SELECT conv_id, turn, 'system' AS first_role, 'You are a helpful customer support assistant.' AS first_content,
           'user' AS second_role, CASE WHEN role = 'user' AND text <> '' THEN text ELSE coalesce(content, '') END
               AS second_content
    FROM (SELECT *, CASE WHEN turn % 5 = 4 THEN '' WHEN turn % 5 = 3 THEN NULL ELSE text END AS content
          FROM conversations) x""")
def prompt_projection(spark, sf):
    rows = view(spark, sf, "conversations").withColumns({
        "message": F.when(F.col("role") == "user", F.col("text")),
        "content": F.when(F.col("turn") % 5 == 4, F.lit("")).when(F.col("turn") % 5 != 3, F.col("text")),
    })
    first, second = F.col("prompt")[0], F.col("prompt")[1]
    return B.prompt_projection(rows).select(
        "conv_id", "turn", first["role"].alias("first_role"), first["content"].alias("first_content"),
        second["role"].alias("second_role"), second["content"].alias("second_content"))


@query("conversation_rollup", """
    SELECT conversation_id, max_by(content, message_id) AS last_message_snippet,
           CAST(max(created_at) AS STRING) AS last_message_at, count(*) AS n_messages
    FROM v_messages GROUP BY conversation_id""")
def conversation_rollup(spark, sf):
    rolled = S.conversation_rollup(view(spark, sf, "v_messages"))
    return rolled.withColumn("last_message_at", F.col("last_message_at").cast("string"))


@query("feedback_summary", """
    SELECT m.conversation_id, CAST(count_if(feedback = 'positive') AS BIGINT) AS positive,
           CAST(count_if(feedback = 'negative') AS BIGINT) AS negative
    FROM v_messages m JOIN v_feedback f ON f.message_id = m.message_id GROUP BY m.conversation_id""")
def feedback_summary(spark, sf):
    return S.feedback_summary(view(spark, sf, "v_messages"), view(spark, sf, "v_feedback"))
