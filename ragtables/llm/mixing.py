"""Mix sources to target weights: hash-random keys, ranges of keys within each source, prefix sums of token counts, a cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtables.llm.common import broadcast_checked, words_of
from ragtables.session import materialize

#: Hexadecimal digits of the key: 60 bits.
KEY_DIGITS = 15
DOCUMENTS_PER_RANGE = 2_000
EPOCHS = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. No target exceeds
    ``EPOCHS`` times its source; the excess is shared anew by weight among the others. In the order of size per weight
    the sources at their limit come first, so running sums show the level at which the rest shares.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.get(weights, place % len(WEIGHTS)).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    limit = F.col("source_size") * EPOCHS
    level = ((F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
             / F.sum("weight").over(after).cast("double"))
    leveled = weighed.withColumn("level", level).withColumn("free", limit > F.col("level") * F.col("weight"))
    shared = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy())
    target = F.least(limit.cast("double"), F.coalesce(shared["level"] * F.col("weight"), limit.cast("double")))
    return leveled.select("source", "source_size", "rows", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(row columns, size, source_size, target, taken) for every row of ``docs`` (doc_id, source, size).

    Each document has a key from a hash of its id; the documents of a source, ordered by key, are cut where the sum of
    their sizes meets the target: all of them once per whole epoch that fits, then those before the cut once more, the
    one at the cut in part. So the words taken of a source are its target, rounded to a whole number. Ranges of keys
    hold about ``DOCUMENTS_PER_RANGE`` documents whatever the source, and prefix sums are taken within a range and over
    the sums of the ranges, so a source with a third of all rows is many tasks.

    Ties in the key go by doc_id, then size; equal rows are interchangeable. Null ids have a key too. A source of size 0
    has the target 0. Deterministic: reruns agree, and nothing depends on the partitioning.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))),
                             1, KEY_DIGITS), 16, 10).cast("long")
    rows = materialize(docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), key.alias("key")), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = materialize(source_targets(sizes), "targets")
    same = F.col("r.source").eqNullSafe(F.col("t.source"))
    ranges = F.ceil(F.col("t.rows") / DOCUMENTS_PER_RANGE)
    placed = rows.alias("r").join(targets.alias("t"), same).select(
        "r.*", "t.source_size", "t.target",
        F.floor(F.col("r.key").cast("double") / float(16**KEY_DIGITS) * ranges).alias("part"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("in_part"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", F.col("part").alias("p"), F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("earlier"))
    placed = placed.alias("a").join(parts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.p")))
    words = F.round("a.target").cast("long")
    epochs = F.when(F.col("a.source_size") > 0, F.floor(words / F.col("a.source_size"))).otherwise(0)
    # Double division may round up when the quotient is all but whole.
    epochs = F.when(epochs * F.col("a.source_size") > words, epochs - 1).otherwise(epochs)
    rest = words - epochs * F.col("a.source_size") - F.col("a.inside") - F.col("b.earlier")
    taken = F.col("a.size") * epochs + F.greatest(F.lit(0), F.least(F.col("a.size"), rest))
    return placed.select("a.doc_id", "a.source", "a.size", "a.source_size", "a.target", taken.cast("long").alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size counts the words of the whole text, 0 for null."""
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Documents as the mix takes them: left out, repeated, or cut at a word; columns of ``docs``.

    A document taken in part keeps its first words, joined by spaces, and n_chars follows the text. Documents without
    words are not taken. Rows that agree in doc_id, source and size are told apart by an order of their texts.
    """
    plan = materialize(mix(sized(docs)).filter("taken > 0").select(_row_key(F.col("size")).alias("row"), "size", "taken"), "plan")
    several = materialize(plan.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row"), "several")
    size = F.size(words_of(F.col("text"))).cast("long")
    keyed = docs.withColumn("row__", _row_key(size))
    if not several.count():
        return _taken(keyed, broadcast_checked(plan, "plan", row_bytes=48), docs.columns)
    once = _taken(keyed, plan.join(several, "row", "left_anti"), docs.columns)
    texts = Window.partitionBy("row__").orderBy(F.xxhash64("text"))
    rows = keyed.join(several.withColumnRenamed("row", "row__"), "row__").withColumn("number__", F.row_number().over(texts))
    number = F.row_number().over(Window.partitionBy("row").orderBy("taken"))
    more = plan.join(several, "row").select("size", "taken", F.xxhash64("row", number).alias("row"))
    rows = rows.withColumn("row__", F.xxhash64("row__", "number__"))
    return once.unionByName(_taken(rows, more, docs.columns))


def _row_key(size):
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), size)


def _taken(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    joined = rows.alias("d").join(plan.alias("p"), F.col("d.row__") == F.col("p.row"))
    times = F.ceil(F.col("p.taken") / F.col("p.size")).cast("int")
    repeated = joined.withColumn("epoch__", F.explode(F.sequence(F.lit(1), times)))
    left = F.col("p.taken") - (F.col("epoch__") - 1) * F.col("p.size")
    cut = F.array_join(F.slice(words_of(F.col("d.text")), 1, F.greatest(left, F.lit(1)).cast("int")), " ")
    text = F.when(left >= F.col("p.size"), F.col("d.text")).otherwise(cut)
    out = {"text": text, "n_chars": F.length(text).cast("long")}
    return repeated.select(*[out[c].alias(c) if c in out else F.col(f"d.{c}") for c in columns])
