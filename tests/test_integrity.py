import pytest

from ragtables.operators import integrity as I
from ragtables.schemas import DEFAULTS, REFERENCES, TABLES, Reference, conform, schema, with_defaults
from tests.conftest import plan

REFS = (Reference("bots", "org", "orgs", "cascade"), Reference("keys", "bot", "bots", "cascade"),
        Reference("keys", "org", "orgs", "cascade"), Reference("talks", "key", "keys", "set_null"),
        Reference("talks", "org", "orgs", "cascade"), Reference("leads", "talk", "talks", "set_null"),
        Reference("notes", "key", "keys", "cascade"))


@pytest.fixture
def tables(spark):
    return {
        "orgs": spark.createDataFrame([(1,), (2,)], "id int"),
        "bots": spark.createDataFrame([(10, 1), (20, 2), (30, None), (40, 9)], "id int, org int"),
        "keys": spark.createDataFrame([(100, 10, None), (200, 20, 2), (300, 30, 1), (400, 77, 2)],
                                      "id int, bot int, org int"),
        "talks": spark.createDataFrame([(1000, 100, 2), (2000, 200, 1), (3000, 200, None)], "id int, key int, org int"),
        "leads": spark.createDataFrame([(1, 1000), (2, 2000), (3, None)], "id int, talk int"),
        "notes": spark.createDataFrame([(7, 100), (8, 200), (9, 300)], "id int, key int"),
    }


def test_reference_audit(tables):
    got = {(r.child, r.column): (r.n_rows, r.n_orphans) for r in I.fk_audit(tables, REFS).collect()}
    assert got == {("bots", "org"): (3, 1), ("keys", "bot"): (4, 1), ("keys", "org"): (3, 0),
                   ("talks", "key"): (3, 0), ("talks", "org"): (2, 0), ("leads", "talk"): (2, 0),
                   ("notes", "key"): (3, 0)}


def test_reference_audit_counts_before_it_joins(spark):
    """One key holds nearly all rows; what is joined is one counted row per key."""
    child = spark.range(10000).selectExpr("id", "CAST(CASE WHEN id % 100 = 0 THEN id ELSE -1 END AS BIGINT) AS p")
    parents = spark.range(500)
    refs = (Reference("c", "p", "d", "none"),)
    text = plan(I.fk_audit({"c": child, "d": parents}, refs))
    assert text.index("Join") < text.index("partial_count")
    got = I.fk_audit({"c": child, "d": parents}, refs).first()
    assert (got.n_rows, got.n_orphans) == (10000, 10000 - 5)


def test_deletion_follows_references(tables):
    gone = {"orgs": tables["orgs"].filter("id = 1")}
    doomed, kept = I.cascade_delete(tables, gone, REFS)
    ids = {t: sorted(r.id for r in df.collect()) for t, df in doomed.items()}
    assert ids == {"orgs": [1], "bots": [10], "keys": [100, 300], "talks": [2000], "notes": [7, 9]}
    assert sorted(r.id for r in kept["keys"].collect()) == [200, 400]
    after = I.delete_rows(tables, gone, REFS)
    assert {r.id: r.key for r in after["talks"].collect()} == {1000: None, 3000: 200}
    assert {r.id: r.talk for r in after["leads"].collect()} == {1: 1000, 2: None, 3: None}
    assert "LeftSemi" in plan(doomed["notes"]) and "LeftAnti" in plan(kept["keys"])


def test_deleting_nothing_changes_nothing(tables):
    after = I.delete_rows(tables, {"orgs": tables["orgs"].filter("id = 99")}, REFS)
    for name, df in tables.items():
        assert sorted(map(str, after[name].collect())) == sorted(map(str, df.select(*after[name].columns).collect()))


def test_unique_audit_ignores_nulls(spark):
    users = spark.createDataFrame([("a", "x"), ("a", None), ("a", None), ("b", "x")], "email string, google_id string")
    got = {r.key_columns: (r.n_duplicated_keys, r.n_rows) for r in
           I.unique_audit({"users": users}, (("users", ("email",)), ("users", ("google_id",)))).collect()}
    assert got == {"email": (1, 3), "google_id": (1, 2)}


def test_value_audit(spark):
    t = {"message_feedback": spark.createDataFrame([("positive",), ("meh",), ("meh",), (None,)], "feedback string")}
    got = [tuple(r) for r in I.value_audits(t, I.VOCABULARIES[:1]).collect()]
    assert got == [("message_feedback", "feedback", "meh", 2)]


def test_schemas(spark):
    assert len(TABLES) == 18 and len(REFERENCES) == 19
    for r in REFERENCES:
        assert r.column in schema(r.child).names and "id" in schema(r.parent).names
    for table, defaults in DEFAULTS.items():
        assert set(defaults) <= set(schema(table).names)


def test_older_snapshots_conform_and_take_defaults(spark):
    old = spark.createDataFrame([("i", "e", None), ("j", "f", "admin")], "id string, email string, role string")
    rows = with_defaults(conform(old, "organization_invites"), "organization_invites", "2026-01-01 00:00:00")
    assert [(f.name, f.dataType) for f in rows.schema] == [
        (f.name, f.dataType) for f in schema("organization_invites")]
    got = {r.id: (r.role, str(r.created_at), r.accepted_at) for r in rows.collect()}
    assert got == {"i": ("editor", "2026-01-01 00:00:00", None), "j": ("admin", "2026-01-01 00:00:00", None)}
