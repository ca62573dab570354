"""Benchmark decontamination by spaced seeds: fixed masks over words, a join of hashes, confirmed aligned overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm.common import MAX_BROADCAST_BYTES, broadcast_checked, lower_ascii, words_of
from ragtables.session import materialize

#: A position counts where the mask has a 1; masks and their order are fixed values of the method.
MASKS = ("11111", "1101011", "11010011", "110010011")
#: Masks for items of fewer than ``SHORT`` words: of two neighbours one word in seven can be another and a pair is left.
SHORT_MASKS, SHORT = ("1", "11"), 8
WINDOW = 25
SIMILARITY = 0.8


def _seeds(words, at, size, short):
    """Array of the hashes of all masks at a position; null where a mask does not fit or, for short items, is not used."""
    hashes = []
    for number, mask in enumerate((*MASKS, *(SHORT_MASKS if short is not None else ()))):
        picked = [F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]
        used = at + len(mask) <= size
        hashes.append(F.when(used if number < len(MASKS) else used & short(mask), F.xxhash64(F.lit(number), *picked)))
    return F.array(*hashes)


def _positions(rows: DataFrame, key: str, short=None) -> DataFrame:
    """(key, size, at, seed) of every mask at every position of the words of a text; ``short`` says where short masks are used."""
    hashed = rows.select(key, F.transform(words_of(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("w"))
    least = min(map(len, MASKS)) if short is None else 1
    placed = hashed.select(key, "w", F.size("w").alias("size")).filter(f"size >= {least}").select(
        key, "w", "size", F.explode(F.sequence(F.lit(0), F.col("size") - least)).alias("at"))
    seeds = placed.select(key, "size", "at", F.explode(_seeds(F.col("w"), F.col("at"), F.col("size"), short)).alias("seed"))
    return seeds.filter("seed is not null")


def _of_short_items(mask: str):
    return F.col("size") == 1 if mask == "1" else (F.col("size") > 1) & (F.col("size") < SHORT)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, matched) for each document that holds a passage of an item.

    A document holds a passage if, at some alignment with the item, ``window`` consecutive words (all words of a shorter
    item) are equal in ``similarity`` of the places; ``matched`` is the largest number of equal words in such a window.
    Words are compared in lower case (A-Z). Alignments come from seeds that both sides share; four masks ignore different
    places, so a substituted word spoils only the seeds that use it. Items of two to seven words have pairs of neighbours
    as seeds too, and items of one word that word, so at the default similarity no alignment of theirs is missed either.

    Positions are filtered by the seeds of the benchmark as they are made; the seeds are broadcast while their measured
    size allows, else both sides are shuffled. Hits are brought to one row per alignment before any text is compared, so
    a passage that very many documents share costs a few rows for each. A text is cut into words once for all of its
    alignments, and each takes only as many words along as the item has. Null texts are empty; rows without an id match
    nothing; rows that share a doc_id are one document; other columns are ignored.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    items = benchmark.select("item_id", "text").filter("item_id is not null")
    words = items.select("item_id", words_of(lower_ascii(F.col("text"))).alias("iw"))
    short = words.filter(F.size("iw").between(1, SHORT - 1)).limit(1).count() > 0
    seeds = _positions(items, "item_id", _of_short_items if short else None).select(
        "item_id", F.col("size").alias("n"), F.col("at").alias("item_at"), "seed").distinct()
    seeds = broadcast_checked(seeds, "seeds", row_bytes=64)
    hits = _positions(docs, "doc_id", (lambda mask: F.lit(True)) if short else None).join(seeds, "seed")
    hits = hits.groupBy("doc_id", "item_id", "n", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("seeds"))
    hits = materialize(hits.select("doc_id", "item_id", "n", "shift"), "alignments")
    # A document has at most as many alignments with an item as both have words.
    of_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("a"))
    of_doc = F.broadcast(of_doc) if hits.count() * 64 <= MAX_BROADCAST_BYTES else of_doc
    texts = docs.join(of_doc, "doc_id").select("doc_id", words_of(lower_ascii(F.col("text"))).alias("dw"), "a")
    lead = F.greatest(-F.col("shift"), F.lit(0))
    parts = texts.select("doc_id", "dw", F.explode("a").alias("a")).select("doc_id", "dw", "a.*").select(
        "doc_id", "item_id", lead.alias("lead"), F.slice("dw", F.greatest("shift", F.lit(0)) + 1, F.col("n")).alias("part"))
    pairs = parts.join(broadcast_checked(words, "items", row_bytes=4096), "item_id")
    equal = F.transform("iw", lambda w, i: (F.when(i >= F.col("lead"), F.get("part", i - F.col("lead"))).eqNullSafe(w)).cast("int"))
    pairs = pairs.select("doc_id", "item_id", equal.alias("equal"), F.least(F.size("iw"), F.lit(window)).alias("width"))
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("width")),
                       lambda i: F.aggregate(F.slice("equal", i + 1, F.col("width")), F.lit(0), lambda a, b: a + b))
    scored = pairs.select("doc_id", "item_id", "width", F.array_max(sums).alias("matched"))
    scored = scored.filter(F.col("matched") >= F.ceil(F.col("width") * similarity))
    return scored.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, with their columns."""
    found = materialize(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
