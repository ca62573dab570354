"""Term weights against plain counts."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from ragtables.operators.weighting import fit_term_weights, hashed_vectors, retrieve_by_terms, stored_term_weights, weigh_terms
from ragtables.sources.snapshots import Store

ROWS = [("a", "The cat, the dog"), ("b", "the BIRD"), ("c", None), ("d", ""), ("e", "the cat the dog"), ("f", "Übung 12 übung")]
SCHEMA = "document_id string, content string"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_weights(rows):
    df = Counter(t for _, text in rows for t in set(words(text)))
    return {t: math.log((len(rows) + 1) / (c + 1)) + 1 for t, c in df.items()}, math.log(len(rows) + 1) + 1


def plain_vector(text, weights, unseen):
    tf = Counter(words(text))
    raw = {t: c * weights.get(t, unseen) for t, c in tf.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()}


def test_weights_and_vectors_equal_plain_counts(spark):
    texts = spark.createDataFrame(ROWS, SCHEMA)
    fitted = fit_term_weights(texts)
    weights, unseen = plain_weights(ROWS)
    got = {r.term: r for r in fitted.collect()}
    assert set(got) == set(weights) and all(math.isclose(got[t].weight, w) for t, w in weights.items())
    assert got["the"].document_frequency == 3 and {r.n_documents for r in got.values()} == {6}
    more = [*ROWS, ("new", "the whale whale")]
    vectors = weigh_terms(spark.createDataFrame(more, SCHEMA), fitted).collect()
    for key, text in more:
        mine = {r.term: r.weight for r in vectors if r.document_id == key}
        want = plain_vector(text, weights, unseen)
        assert mine.keys() == want.keys() and all(math.isclose(mine[t], want[t]) for t in want)


def test_retrieval_by_terms(spark):
    texts = spark.createDataFrame(ROWS, SCHEMA)
    fitted = fit_term_weights(texts)
    asked = [(1, "cat"), (2, "bird the"), (3, None), (4, "nowhere")]
    queries = weigh_terms(spark.createDataFrame(asked, "query_id long, content string"), fitted, "query_id")
    hits = [tuple(r) for r in retrieve_by_terms(queries, weigh_terms(texts, fitted), 2, 0.95).orderBy("query_id", "rank").collect()]
    weights, unseen = plain_weights(ROWS)
    want = []
    for q, text in asked:
        mine = plain_vector(text, weights, unseen) if text else {}
        near = sorted((round(1 - sum(mine.get(t, 0) * w for t, w in plain_vector(x, weights, unseen).items()), 9), d) for d, x in ROWS if x)
        want += [(q, i + 1, d, s) for i, (s, d) in enumerate([p for p in near if p[0] <= 0.95][:2])]
    assert [h[:3] for h in hits] == [w[:3] for w in want] and all(math.isclose(h[3], w[3], abs_tol=2e-9) for h, w in zip(hits, want))
    assert hits[0][2] == "a" and hits[1][2] == "e"  # a tie goes to the smaller id


def test_a_version_is_fitted_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = stored_term_weights(store, spark.createDataFrame(ROWS, SCHEMA), version="v1")
    again = stored_term_weights(store, spark.createDataFrame([("x", "other words")], SCHEMA), version="v1")
    assert sorted(r.term for r in again.collect()) == sorted(r.term for r in first.collect()) == sorted(plain_weights(ROWS)[0])
    new = stored_term_weights(store, spark.createDataFrame([("x", "other words")], SCHEMA), version="v2")
    assert sorted(r.term for r in new.collect()) == ["other", "words"] and store.version() == 2
    assert stored_term_weights(store, spark.createDataFrame(ROWS, SCHEMA), version="v1").count() == len(plain_weights(ROWS)[0])


def test_hashed_vectors_and_empty_tables(spark):
    texts = spark.createDataFrame(ROWS, SCHEMA)
    weighed = weigh_terms(texts, fit_term_weights(texts))
    vectors = {r.document_id: r.embedding for r in hashed_vectors(weighed, dimensions=64).collect()}
    slots = {r.term: r.slot for r in weighed.select("term", F.pmod(F.xxhash64("term"), F.lit(64)).alias("slot")).distinct().collect()}
    assert set(vectors) == {"a", "b", "e", "f"} and vectors["a"] == vectors["e"]
    for key, text in ROWS:
        if key in vectors:
            want = [0.0] * 64
            for t, w in plain_vector(text, *plain_weights(ROWS)).items():
                want[slots[t]] += w
            norm = math.sqrt(sum(x * x for x in want))
            assert all(math.isclose(a, b / norm, abs_tol=1e-6) for a, b in zip(vectors[key], want))
    none = spark.createDataFrame([], SCHEMA)
    assert fit_term_weights(none).count() == 0 and weigh_terms(none, fit_term_weights(none)).count() == 0
    assert math.isclose(weigh_terms(texts.filter("document_id = 'b'"), fit_term_weights(none)).first().weight, math.sqrt(0.5))


def test_words_are_not_shuffled_where_weights_are_broadcast(spark):
    from ragtables.operators.weighting import fit_term_weights, weigh_terms
    from tests.conftest import plan

    texts = spark.createDataFrame([(1, "a b a"), (2, "b c"), (2, "c"), (None, "a")], "document_id long, text string")
    weighed = weigh_terms(texts, fit_term_weights(texts, "text"), text="text")
    assert plan(weighed).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert sorted((r.document_id or 0, r.term, r.tf) for r in weighed.collect()) == [(0, "a", 1), (1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 2)]
