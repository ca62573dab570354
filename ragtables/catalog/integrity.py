"""Audits and removal along references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.catalog.fixtures import tables, view
from ragtables.operators import integrity as I
from ragtables.schemas import REFERENCES, UNIQUE_KEYS

FK_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{r.child}' AS child, '{r.column}' AS "column", '{r.parent}' AS parent,
               count(c.{r.column}) AS n_rows,
               count(c.{r.column}) - count(p.id) AS n_orphans
        FROM t_{r.child} c LEFT JOIN t_{r.parent} p ON p.id = c.{r.column}"""
    for r in REFERENCES)


@query("fk_audit", FK_SQL)
def fk_audit(spark, sf):
    return I.fk_audit(tables(spark, sf))


UNIQUE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns, count(*) AS n_duplicated_keys,
               CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows
        FROM (SELECT count(*) AS n FROM t_{t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)}
              GROUP BY {', '.join(k)} HAVING count(*) > 1) x"""
    for t, k in UNIQUE_KEYS)


@query("unique_audit", UNIQUE_SQL)
def unique_audit(spark, sf):
    return I.unique_audit(tables(spark, sf, [t for t, _ in UNIQUE_KEYS]))


VALUE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS n FROM t_{t}
        WHERE {c} NOT IN ({', '.join(f"'{v}'" for v in allowed)}) GROUP BY {c}"""
    for t, c, allowed in I.VOCABULARIES)


@query("value_audits", VALUE_SQL)
def value_audits(spark, sf):
    return I.value_audits(tables(spark, sf, [t for t, _, _ in I.VOCABULARIES]))


# Organizations of one region go; bots, keys, files, sources and the rest go with them.
GONE = """
    gone AS (SELECT 'org_' || CAST(n_nationkey AS STRING) AS id FROM nation n JOIN region r
                 ON n.n_regionkey = r.r_regionkey WHERE r_name = 'ASIA'),
    gone_bots AS (SELECT id FROM t_bots WHERE organization_id IN (SELECT id FROM gone))"""

ORG_ONLY = ("organization_members", "organization_invites", "conversations_meta", "leads")
ORG_AND_BOT = ("api_keys", "files", "training_sources")


def _gone(spark, sf):
    nation, region = view(spark, sf, "nation"), view(spark, sf, "region")
    asia = region.filter(F.col("r_name") == "ASIA")
    orgs = nation.join(asia, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return {"organizations": orgs.select(F.concat(F.lit("org_"), F.col("n_nationkey").cast("string")).alias("id"))}


CASCADE_SQL = f"""
    WITH {GONE}
    SELECT 'organizations' AS table_name, count(*) AS n_left FROM t_organizations
    WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'bots', count(*) FROM t_bots WHERE id NOT IN (SELECT id FROM gone_bots)
    """ + "".join(f"""
    UNION ALL SELECT '{t}', count(*) FROM t_{t} WHERE organization_id NOT IN (SELECT id FROM gone)""" for t in ORG_ONLY
) + "".join(f"""
    UNION ALL SELECT '{t}', count(*) FROM t_{t} WHERE organization_id NOT IN (SELECT id FROM gone)
        AND coalesce(bot_id, -1) NOT IN (SELECT id FROM gone_bots)""" for t in ORG_AND_BOT)


@query("cascade_delete", CASCADE_SQL)
def cascade_delete(spark, sf):
    """Rows left in each table that an organization's removal reaches."""
    from functools import reduce

    from pyspark.sql import DataFrame

    reached = ("organizations", "bots", *ORG_ONLY, *ORG_AND_BOT)
    doomed, kept = I.cascade_delete(tables(spark, sf, reached), _gone(spark, sf))
    return reduce(DataFrame.unionByName, [
        kept[t].agg(F.count("*").alias("n_left")).select(F.lit(t).alias("table_name"), "n_left") for t in doomed])


@query("set_null_delete", f"""
    WITH {GONE}
    SELECT id, organization_id, coalesce(CASE WHEN bot_id IN (SELECT id FROM gone_bots) THEN NULL ELSE bot_id END, -1)
               AS bot_id,
           coalesce(CASE WHEN conversation_id IN (SELECT id FROM t_conversations_meta
                                                  WHERE organization_id IN (SELECT id FROM gone))
                         THEN NULL ELSE conversation_id END, -1) AS conversation_id
    FROM t_leads WHERE organization_id NOT IN (SELECT id FROM gone)""")
def set_null_delete(spark, sf):
    """Leads after the same removal: those of removed organizations are gone, other references are emptied."""
    reached = ("organizations", "bots", "api_keys", "conversations_meta", "leads")
    leads = I.delete_rows(tables(spark, sf, reached), _gone(spark, sf))["leads"]
    return leads.select("id", "organization_id", F.coalesce("bot_id", F.lit(-1)).alias("bot_id"),
                        F.coalesce("conversation_id", F.lit(-1)).alias("conversation_id"))
