import random

import pytest
from pyspark.sql import functions as F

from ragtables.operators import sessions as S
from ragtables.session import scratch_path
from tests.conftest import plan

SCHEMA = "event_id long, conversation_id long, ts timestamp, organization_id string, actor string, kind string"


def random_events(spark, n=1500, conversations=7, seed=1):
    """Random events; one conversation holds a third of them. Some share their time."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        conversation = 0 if rnd.random() < 1 / 3 else rnd.randrange(conversations)
        rows.append((i, conversation, rnd.randrange(0, 200000), rnd.choice(["a", "a", "a", "b"]),
                     rnd.choice(["user", "agent"]),
                     rnd.choice(["connect", "disconnect", "typing", "message", "other"])))
    df = spark.createDataFrame(rows, "event_id long, conversation_id long, s long, organization_id string,"
                                     " actor string, kind string")
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1700000000)).drop("s")


def step_by_step(events):
    sessions, routes = {}, {}
    for e in sorted(events.collect(), key=lambda e: (e.ts, e.event_id)):
        session, route = S.step(sessions.get(e.conversation_id, S.Session()), e.actor, e.kind, e.organization_id)
        sessions[e.conversation_id], routes[e.event_id] = session, route
    return routes


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "year"])
def test_batch_equals_the_state_machine_for_any_slice(spark, unit):
    events = random_events(spark)
    got = {r.event_id: r.route for r in S.route_messages(events, unit).collect()}
    want = step_by_step(events)
    assert got == want
    assert set(want.values()) == {"admitted", "rejected", "closed", "agent", "user", "ai", "dropped"}


def test_no_window_over_events_spans_a_whole_conversation(spark):
    """Windows over events are cut by slice; the one over conversations sees a row per slice only."""
    text = plan(S.last_before(random_events(spark, 10), {"x": F.col("kind")}))
    over_events = [line for line in text.split("\n") if "Window [" in line and "_v_x" in line]
    assert over_events and all("_slice" in line for line in over_events)


def test_quirks_of_a_session(spark):
    log = [("user", "connect", "a", "admitted"), ("agent", "connect", "b", "rejected"),
           ("user", "message", "a", "ai"), ("user", "typing", "a", "dropped"), ("agent", "connect", "a", "admitted"),
           ("user", "typing", "a", "agent"), ("user", "whatever", "a", "agent"), ("user", "disconnect", "a", "closed"),
           ("agent", "message", "a", "dropped"), ("user", "connect", "a", "admitted"),
           ("agent", "message", "a", "rejected"), ("user", "message", "a", "ai"), ("agent", "connect", "a", "admitted"),
           ("agent", "typing", "a", "user"), ("agent", "disconnect", "a", "closed"), ("user", "message", "a", "ai")]
    rows = [(i, 1, i, org, actor, kind) for i, (actor, kind, org, _) in enumerate(log)]
    df = spark.createDataFrame(rows, "event_id long, conversation_id long, s long, organization_id string,"
                                     " actor string, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.route for r in S.route_messages(df, "minute").orderBy("event_id").collect()]
    assert got == [route for *_, route in log]


def test_stream_equals_batch_over_several_batches(spark):
    from ragtables.streaming.routing import route_stream

    base = scratch_path(spark, "events")
    events = random_events(spark, 400)
    by_time = sorted(events.collect(), key=lambda e: (e.ts, e.event_id))
    for n in range(3):
        share = spark.createDataFrame(by_time[n * 150:(n + 1) * 150], events.schema)
        share.coalesce(1).write.mode("append").parquet(f"{base}/in")
        query = (route_stream(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
                 .writeStream.format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    got = {r.event_id: r.route for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == step_by_step(events)


def test_admission_ladder(spark):
    rows = [
        (1, None, 1, 0, True, 1, "a", "user", "No token/conversation id provided"),
        (2, "t", 1, 1, False, 1, "a", "user", "Invalid token"),
        (3, "t", 1, 2, True, 2, "a", "user", "Conversation mismatch"),
        (4, "t", 1, 3, True, 1, None, "user", "Organization ID not found"),
        (5, "t", 1, 4, True, 1, "a", "agent", "Session not found"),
        (6, "t", 1, 5, True, 1, "a", "user", "admitted"),
        (7, "t", 1, 6, True, 1, "b", "agent", "Organization mismatch"),
        (8, "t", 1, 7, True, 1, "a", "agent", "admitted"),
        (9, "t", 1, 8, True, 1, "a", "robot", "Invalid type"),
        (10, "t", 1, 9, True, 1, "a", None, "Invalid type"),
        (11, "t", 1, 10, True, None, "a", "user", "Conversation mismatch"),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows],
                               "event_id long, token string, conversation_id long, s long, claims_valid boolean,"
                               " claim_conversation_id long, claim_organization_id string, claim_type string")
    judged = S.admit_connections(df.withColumn("ts", F.timestamp_seconds("s")), "minute")
    assert {r.event_id: r.decision for r in judged.collect()} == {r[0]: r[-1] for r in rows}


def test_replies(spark):
    df = spark.createDataFrame([(1, "  answer ", None), (2, None, "quota")], "i int, answer string, error string")
    got = [(r.i, r.seq, r.type, r.body, r.is_typing) for r in S.ai_reply_events(df).orderBy("i", "seq").collect()]
    assert got == [(1, 1, "typing", None, True), (1, 2, "message", "answer", None), (1, 3, "typing", None, False),
                   (2, 1, "typing", None, True), (2, 2, "error", "AI error: quota", None),
                   (2, 3, "typing", None, False)]


def test_replies_and_last_messages_keep_whole_texts(spark):
    from ragtables.operators.sessions import ai_reply_events, conversation_rollup

    asked = spark.createDataFrame([(1, "\t hi \n", None)], "id int, answer string, error string")
    assert [r.body for r in ai_reply_events(asked).collect()] == [None, "hi", None]
    messages = spark.createDataFrame([("c", 1, 1, "x" * 300)], "conversation_id string, message_id int, created_at int, content string")
    assert conversation_rollup(messages).first().last_message_snippet == "x" * 300


def test_events_out_of_order_are_routed_as_in_order(spark, tmp_path):
    """Five batches with a restart between: late events are told apart, a long pause forgets the session, state stays small."""
    import datetime

    from ragtables.operators.sessions import Session, step
    from ragtables.streaming.routing import DAY_MS, route_in_order

    start, schema = datetime.datetime(2024, 1, 1), "event_id long, conversation_id long, ts timestamp, organization_id string, actor string, kind string"
    kinds = [("user", "connect"), ("user", "message"), ("agent", "connect"), ("agent", "message"), ("user", "typing"), ("user", "disconnect"), ("agent", "disconnect")]
    batches = [[], [], [], [], []]
    for i in range(240):
        day = i / 12  # 20 days, five batches of four days; some come a batch later, some two
        actor, kind = kinds[(i * 5 + i // 7) % 7]
        batch = int(day // 4) + (2 if i % 31 == 3 else 1 if i % 4 == 1 and day % 4 > 3 else 0)
        batches[min(batch, 4)].append((i, i % 5, start + datetime.timedelta(days=day), f"org_{i % 2}", actor, kind))
    batches[4].append((240, 0, start + datetime.timedelta(days=60), "org_0", "user", "message"))  # after a pause beyond the lifetime
    batches.append([(999, 99, start + datetime.timedelta(days=400), "org_0", "user", "typing")])

    want, clock, on_time, seen = {}, None, [], []
    for batch in batches:
        for e in batch:
            late = clock is not None and e[2] < clock
            want[e[0]] = "late" if late else None
            if not late:
                on_time.append(e)
        seen += [e[2] for e in batch]
        clock = max(seen) - datetime.timedelta(days=2)
    sessions, last = {}, {}
    for e in sorted(on_time, key=lambda e: (e[2], e[0])):
        c = e[1]
        if c in last and e[2] - last[c] > datetime.timedelta(days=30):
            sessions[c] = Session()
        sessions[c], want[e[0]] = step(sessions.get(c, Session()), e[4], e[5], e[3])
        last[c] = e[2]
    del want[999]

    def run(part):
        for i, batch in part:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = (route_in_order(stream, 2 * DAY_MS, 30 * DAY_MS).writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        return query.lastProgress

    numbered = list(enumerate(batches))
    run(numbered[:2])
    progress = run(numbered[2:])
    got = {r.event_id: r.route for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and "late" in got.values() and got[240] == "rejected"
    # One session, one list and one timer each for the conversations that are left.
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) <= 40


def test_waiting_events_are_kept_packed_by_groups(spark, tmp_path):
    """The state has rows per group and session, not per event; ids beside missing ones stay exact, names may be ids."""
    import datetime

    from ragtables.operators.sessions import Session, step
    from ragtables.streaming.routing import DAY_MS, route_in_order

    start, schema = datetime.datetime(2024, 1, 1), "event_id long, conversation_id string, ts timestamp, organization_id string, actor string, kind string"
    kinds = [("user", "connect"), ("agent", "connect"), ("user", "message"), ("agent", "typing"), ("user", "disconnect")]
    first, second = [], []
    for i in range(600):
        event = (2**60 + i, f"c{i % 60}", start + datetime.timedelta(minutes=i), None if i % 7 == 0 else "org", *kinds[i // 60 % 5])
        first.append(event)
    second = [(None, "c0", start + datetime.timedelta(days=9), "org", "user", "message"), (7, "late", start - datetime.timedelta(days=2), "org", "user", "message"),
              (8, None, start, "org", "user", "message"), (9, "c1", None, "org", "user", "message")]
    want, sessions = [(7, "late", "late")], {}
    for event_id, conversation, _, organization, actor, kind in first:
        sessions[conversation], route = step(sessions.get(conversation, Session()), actor, kind, organization)
        want.append((event_id, conversation, route))
    third = [(10, "c59", start + datetime.timedelta(days=30), "org", "user", "message")]
    want.append((None, "c0", "rejected"))

    for batch in (first, [*second, (6, "c2", start + datetime.timedelta(days=8), "org", "user", "message")], third):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want.append((6, "c2", "rejected"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (route_in_order(stream, DAY_MS, groups=4).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(((r.event_id, r.conversation_id, r.route) for r in rows), key=repr) == sorted(want, key=repr)
    written = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert written[0] <= 3 * 4  # packed events, the note and the timer of each group
