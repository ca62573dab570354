"""Term weights by document frequency: fitted once per embedding version, the same for chunks and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtables.fixed_values import EMBEDDING_DIMENSIONS, EMBEDDING_VERSION, MAX_DISTANCE, TOP_K
from ragtables.operators.bounded import broadcast_if_small
from ragtables.sources.snapshots import Store

#: Distances are ranked at so many digits, as sums of products differ in their last ones by order.
DIGITS = 9


def terms(text: Column) -> Column:
    """Array of the words of a text in lower case; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def fit_term_weights(texts: DataFrame, text: str = "content", version: str = EMBEDDING_VERSION) -> DataFrame:
    """(embedding_version, term, document_frequency, n_documents, weight) of a table of texts, each row a document.

    The weight is ln((n + 1) / (df + 1)) + 1. A document counts once per term, so only distinct terms of a text leave it,
    and counts are summed per task before the shuffle: a term that every text has is one row per task. Null and empty
    texts are documents without terms; an empty table gives no rows.
    """
    n = texts.count()
    found = (texts.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term")
             .agg(F.count("*").alias("document_frequency")))
    weight = F.log(F.lit(n + 1.0) / (F.col("document_frequency") + 1.0)) + 1.0
    return found.select(F.lit(version).alias("embedding_version"), "term", "document_frequency", F.lit(n).cast("long").alias("n_documents"),
                        weight.alias("weight"))


def stored_term_weights(store: Store, texts: DataFrame, text: str = "content", version: str = EMBEDDING_VERSION) -> DataFrame:
    """Weights of a version from a store, fitted on ``texts`` and published if no run has done so: a later call, on
    whatever texts, reads the same weights, so vectors of one version stay comparable."""
    writer = f"term_weights/{version}"
    if not store.has_batch(writer, 0):
        store.publish({"term_weights": fit_term_weights(texts, text, version)}, writer=writer, batch=0)
    return store.read("term_weights").filter(F.col("embedding_version") == version)


def weigh_terms(texts: DataFrame, weights: DataFrame, key: str = "document_id", text: str = "content") -> DataFrame:
    """(key, term, tf, weight): the vector of each text, scaled to unit length, one row per term; ``key`` is unique.

    ``weights`` holds one version. A term it lacks weighs as one that no document has. Texts without words have no rows.
    Weights are broadcast while their measured bytes allow; beyond that both sides are joined by term, where Spark splits
    the partitions of terms that most texts have.
    """
    n = weights.agg(F.max("n_documents")).first()[0] or 0
    known = broadcast_if_small(weights.select("term", F.col("weight").alias("_idf")))
    # Dealt by key before the words are cut out: the counts, the lookups and the lengths then stay where the text is.
    dealt = texts.select(key, text).repartition(key)
    counts = dealt.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    idf = F.coalesce("_idf", F.log(F.lit(n + 1.0)) + 1.0)
    weighed = counts.join(known, "term", "left").select(key, F.struct("term", "tf", (F.col("tf") * idf).alias("w")).alias("t"))
    vectors = weighed.groupBy(key).agg(F.collect_list("t").alias("t"), F.sqrt(F.sum(F.col("t.w") * F.col("t.w"))).alias("norm"))
    return vectors.select(key, "norm", F.explode("t").alias("t")).select(key, "t.term", "t.tf", (F.col("t.w") / F.col("norm")).alias("weight"))


def hashed_vectors(weighed: DataFrame, key: str = "document_id", output: str = "embedding",
                   dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """(key, vector of unit length): weighed terms added up by a hash of the term, for retrieval over dense vectors."""
    slot = F.pmod(F.xxhash64("term"), F.lit(dimensions))
    slots = weighed.groupBy(key, slot.alias("slot")).agg(F.sum("weight").alias("w"))
    packed = slots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(dimensions - 1).cast("long"))
    dense = F.transform(at, lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("float"))
    return packed.select(key, dense.alias(output))


def retrieve_by_terms(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(query_id, rank, document_id, distance) from weighed terms of queries and of documents.

    A distance is 1 less the sum of products over the terms that both have. Products are added up where the document's
    terms are; of each task only the ``k`` best of a query go on. Ties go to the smaller document_id.
    """
    asked = broadcast_if_small(queries.select("query_id", "term", F.col("weight").alias("_q")))
    both = vectors.join(asked, "term").groupBy("query_id", "document_id").agg(F.sum(F.col("weight") * F.col("_q")).alias("score"))
    near = both.withColumn("distance", F.round(1.0 - F.col("score"), DIGITS)).filter(F.col("distance") <= max_distance)
    order = Window.partitionBy("query_id").orderBy("distance", "document_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "document_id", "distance")
