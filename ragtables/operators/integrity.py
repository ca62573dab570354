"""Audits of references, keys and values, and removal along references.

Tables come as a dictionary by name; each has its id in a column ``id``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.fixed_values import (
    FEEDBACK_VALUES, FILE_STATUSES, JOB_STATUSES, OTP_PURPOSES, OTP_TYPES, SOURCE_STATUSES,
)
from ragtables.operators.bounded import broadcast_if_small
from ragtables.schemas import REFERENCES, UNIQUE_KEYS, Reference

# Columns with an enumerated vocabulary.
VOCABULARIES = (
    ("message_feedback", "feedback", FEEDBACK_VALUES),
    ("otps", "type", OTP_TYPES),
    ("otps", "purpose", OTP_PURPOSES),
    ("training_jobs", "status", JOB_STATUSES),
    ("training_sources", "status", SOURCE_STATUSES),
    ("files", "status", FILE_STATUSES),
)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fk_audit(tables: dict[str, DataFrame], references: Sequence[Reference] = REFERENCES) -> DataFrame:
    """(child, column, parent, n_rows, n_orphans) of each reference; NULL keys are no violation.

    Child keys are counted before the join, so a key that very many rows share arrives as a few counted rows, and all
    references to one parent share one join.
    """
    audits = []
    for parent in dict.fromkeys(r.parent for r in references):
        keys = _union(
            tables[r.child].filter(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("key"))
            .agg(F.count("*").alias("n"))
            .select(F.lit(r.child).alias("child"), F.lit(r.column).alias("column"), "key", "n")
            for r in references if r.parent == parent)
        ids = tables[parent].select(F.col("id").alias("key"), F.lit(True).alias("found"))
        orphans = F.when(F.col("found").isNull(), F.col("n")).otherwise(0)
        audits.append(keys.join(ids, "key", "left").groupBy("child", "column")
                      .agg(F.sum("n").alias("n_rows"), F.sum(orphans).alias("n_orphans"))
                      .withColumn("parent", F.lit(parent)))
    return _union(audits)


def unique_audit(tables: dict[str, DataFrame], keys: Sequence[tuple[str, Sequence[str]]] = UNIQUE_KEYS) -> DataFrame:
    """(table_name, key_columns, n_duplicated_keys, n_rows) of each unique key; keys with a NULL do not count."""
    audits = []
    for table, columns in keys:
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        counted = tables[table].filter(complete).groupBy(*columns).agg(F.count("*").alias("n"))
        audits.append(counted.filter(F.col("n") > 1)
                      .agg(F.count("*").alias("n_duplicated_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
                      .select(F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key_columns"),
                              "n_duplicated_keys", "n_rows"))
    return _union(audits)


def value_audits(tables: dict[str, DataFrame], rules=VOCABULARIES) -> DataFrame:
    """(table_name, column_name, value, n) of values outside their vocabulary; NULL passes."""
    return _union(
        tables[table].filter(~F.col(column).isin(*allowed)).groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value", "n")
        for table, column, allowed in rules)


def cascade_delete(tables: dict[str, DataFrame], deleted: dict[str, DataFrame],
                   references: Sequence[Reference] = REFERENCES) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Rows that go with the deleted ids along cascading references, and the tables without them.

    ``deleted`` maps tables to the ids removed there. The depth of references is fixed by the schema, so this is a
    fixed chain of semi joins, parents first. The doomed ids of a table that others refer to are written once and
    read by each of them, by broadcast while their measured size allows. A surviving row is one whose own references
    meet no doomed id, so a table is scanned once and never joined with itself. Returns (doomed ids, surviving rows) by table.
    """
    cascades = [r for r in references if r.on_delete == "cascade" and r.child in tables and r.parent in tables]
    given = {t: broadcast_if_small(ids.select("id").distinct()) for t, ids in deleted.items()}
    doomed = dict(given)
    pending = list(tables)
    while pending:
        ready = [t for t in pending if not any(r.child == t and r.parent in pending for r in cascades)]
        if not ready:
            raise ValueError("cascading references form a cycle")
        for table in ready:
            hits = [tables[table].join(doomed[r.parent].withColumnRenamed("id", r.column), r.column, "left_semi")
                    .select("id") for r in cascades if r.child == table and r.parent in doomed]
            if hits:
                ids = _union(hits + ([doomed[table]] if table in doomed else [])).distinct()
                is_parent = any(r.parent == table for r in references)
                doomed[table] = broadcast_if_small(ids) if is_parent else ids
        pending = [t for t in pending if t not in ready]

    def survivors(table: str, rows: DataFrame) -> DataFrame:
        gone = [("id", given[table])] if table in given else []
        gone += [(r.column, doomed[r.parent].withColumnRenamed("id", r.column)) for r in cascades if r.child == table and r.parent in doomed]
        return reduce(lambda df, g: df.join(g[1], g[0], "left_anti"), gone, rows).select(rows.columns)

    return doomed, {t: survivors(t, df) for t, df in tables.items()}


def set_null_delete(child: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Child rows with the reference emptied where its parent is among the deleted ids."""
    gone = deleted.select(F.col("id").alias(column)).distinct().withColumn("_gone", F.lit(True))
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return child.join(gone, column, "left").withColumn(column, kept).select(*child.columns)


def delete_rows(tables: dict[str, DataFrame], deleted: dict[str, DataFrame],
                references: Sequence[Reference] = REFERENCES) -> dict[str, DataFrame]:
    """All tables after a deletion: cascading references remove rows, the others of that kind are emptied."""
    doomed, kept = cascade_delete(tables, deleted, references)
    for r in references:
        if r.on_delete == "set_null" and r.child in kept and r.parent in doomed:
            kept[r.child] = set_null_delete(kept[r.child], r.column, doomed[r.parent])
    return kept
