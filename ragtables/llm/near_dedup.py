"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands, star-shaped candidate edges.

A document's set holds the distinct shingles of two words (A-Z in lower case). One 64-bit hash per shingle fills all
bins: the top bits choose the bin, the least hash of a bin is its value, and an empty bin copies the value of a filled
bin that its own sequence of random probes meets first. Bands of the bins are bucket keys. In a bucket only edges to
centres are made, so their number is linear in the bucket. Every edge is confirmed on the full sets. Members that the
stars leave in different components are then compared inside the tasks, which give out links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtables.llm.common import broadcast_checked, text_bytes, text_slices
from ragtables.llm.components import connected_components
from ragtables.llm.words import mix, word_hashes
from ragtables.session import materialize

BINS_LOG2, ROWS, MEMBERS_PER_SALT = 8, 6, 1024
CENTERS, SMALL = 4, 5
#: Most members of a cell on average, shingles of its outer ones, and members compared at once.
OUTER, MEMBERS, OUTER_SHINGLES, BLOCK = 512, 512, 1 << 20, 64
BINS = 1 << BINS_LOG2
BANDS = BINS // ROWS
_SINGLE = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its two-word shingles.

    A text of one word has that word as its only element; a text without words has none.
    """
    hashes, at = word_hashes(data, offsets)
    pairs = mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + np.roll(hashes, -1)[:-1]) if len(hashes) else hashes
    sets = []
    for begin, end in zip(at[:-1], at[1:], strict=True):
        if end - begin < 2:
            sets.append(mix(hashes[begin:end] ^ _SINGLE))
            continue
        ordered = np.sort(pairs[begin : end - 1])
        sets.append(ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))])
    return sets


def probe_table(length: int = 2048) -> np.ndarray:
    cells = np.arange(BINS * length, dtype=np.uint64).reshape(BINS, length)
    return (mix(cells + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BINS_LOG2)).astype(np.int64)


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS_LOG2)
_WEIGHTS = mix(np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(17)).reshape(BANDS, ROWS) | np.uint64(1)


def signature(ordered: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Values of all bins of a non-empty sorted set; ``probes`` has the bins that each bin asks, in order."""
    at = np.searchsorted(ordered, _EDGES)
    values = ordered[np.minimum(at, len(ordered) - 1)]
    filled = (at < len(ordered)) & (values >> np.uint64(64 - BINS_LOG2) == np.arange(BINS, dtype=np.uint64))
    empty, width = np.flatnonzero(~filled), 16
    while len(empty) and width <= probes.shape[1]:
        hits = filled[probes[empty, :width]]
        found = hits.any(axis=1)
        values[empty[found]] = values[probes[empty[found], hits[found].argmax(axis=1)]]
        empty, width = empty[~found], width * 16 if width < 256 else width * 8
    if len(empty):  # no probe met a filled bin: the next filled one, in a circle
        full = np.flatnonzero(filled)
        values[empty] = values[full[np.searchsorted(full, empty) % len(full)]]
    return values


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys, one per band, of a matrix of signatures."""
    rows = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    return mix((rows * _WEIGHTS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def least_linkable(similarity: int) -> int:
    """Smallest set that can be linked with a different set."""
    n = 1
    while 100 * n < similarity * (n + 1):
        n += 1
    return n


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                     ("bands", pa.list_(pa.int64()))])


def _sign(similarity: int):
    least = least_linkable(similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = probe_table()
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(*text_bytes(part.column("text")))
                digests = np.array([[mix(s).sum(dtype=np.uint64), mix(s * np.uint64(3) + np.uint64(7)).sum(dtype=np.uint64)]
                                    for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                large = [i for i, s in enumerate(sets) if len(s) >= least]
                keys = band_keys(np.stack([signature(sets[i], probes) for i in large])) if large else np.zeros((0, BANDS), np.uint64)
                counts = np.zeros(len(sets) + 1, np.int32)
                counts[np.array(large, int) + 1] = BANDS
                bands = pa.ListArray.from_arrays(np.cumsum(counts, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), bands], schema=_SIGNED)

    return sign


_PAIR = pa.schema([("center", pa.int64()), ("member", pa.int64())])


def _confirm(similarity: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the texts of a centre, then those of its members."""
        center, own = None, []
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(*text_bytes(part.column("text")))
                linked = []
                for c, member, kind, s in zip(part.column("center").to_pylist(), part.column("doc").to_pylist(),
                                              part.column("kind").to_pylist(), sets, strict=True):
                    if c != center:
                        center, own = c, []
                    if kind == 0:
                        own.append(s)
                        continue
                    for o in own:
                        if 100 * min(len(o), len(s)) < similarity * max(len(o), len(s)):
                            continue
                        common = len(np.intersect1d(o, s, assume_unique=True))
                        if 100 * common >= similarity * (len(o) + len(s) - common):
                            linked.append((c, member))
                            break
                if linked:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*linked, strict=True)], schema=_PAIR)

    return confirm


def confirm_edges(docs: DataFrame, edges: DataFrame, similarity: int) -> DataFrame:
    """Those (center, member) whose full sets are similar enough.

    Texts are sent once per edge to the centre's tasks; a centre with many members is dealt over several.
    """
    salts = edges.groupBy("center").agg(F.ceil(F.count("*") / MEMBERS_PER_SALT).alias("salts"))
    edges = edges.join(salts, "center").select(
        "center", "member", F.pmod(F.xxhash64("member"), "salts").alias("salt"))
    wanted = (edges.select(F.col("member").alias("doc"), "center", "salt", F.lit(1).alias("kind"))
              .unionByName(edges.select(F.col("center").alias("doc"), "center", "salt", F.lit(0).alias("kind")).distinct()))
    wanted = broadcast_checked(wanted, "wanted", row_bytes=64)
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc").select("center", "salt", "kind", "doc", "text")
    dealt = texts.repartition("center", "salt").sortWithinPartitions("center", "salt", "kind")
    schema = "center long, member long"
    return materialize(dealt.mapInArrow(_confirm(similarity), schema), "links").distinct()


def _ranked(buckets: DataFrame) -> DataFrame:
    """With ``me``, the place of a member among those that may be centres: most company first, then a random order."""
    return buckets.withColumn("me", F.struct(-F.col("company"), F.xxhash64("rep").alias("h"), "rep", "n"))


def _candidates(buckets: DataFrame, similarity: int) -> DataFrame:
    """(center, member) of every bucket: its first member of each of four random parts with all members after it.

    A bucket of up to ``SMALL`` members has all of them as centres. Members of a large bucket are dealt over several tasks.
    """
    ranked = _ranked(buckets).withColumn("salts", F.ceil(F.col("size") / MEMBERS_PER_SALT)).withColumn(
        "salt", F.pmod(F.xxhash64("rep", F.lit(6)), "salts"))
    parts = [F.min(F.when(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(CENTERS)) == i, F.col("me"))) for i in range(CENTERS)]
    few = F.collect_list(F.when(F.col("size") <= SMALL, F.col("me")))
    centers = ranked.groupBy("key").agg(F.array_distinct(F.array_compact(F.concat(F.array(*parts), few))).alias("centers"),
                                        F.first("salts").alias("salts"))
    centers = centers.select("key", "centers", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    edges = ranked.join(centers, ["key", "salt"]).select("me", F.explode("centers").alias("c")).filter("c < me")
    return _fitting(edges.select(F.col("c.rep").alias("center"), F.col("c.n").alias("cn"), F.col("me.rep").alias("member"), F.col("me.n").alias("n")), similarity)


def _fitting(edges: DataFrame, similarity: int) -> DataFrame:
    return edges.filter(f"100 * least(n, cn) >= {similarity} * greatest(n, cn)").select("center", "member").distinct()


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two members and more, with ``size``. Keys of very many rows are looked up by broadcast, not dealt by key."""
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    hot = broadcast_checked(shared.filter(F.col("size") > MEMBERS_PER_SALT), "hot", row_bytes=48)
    rest = rows.join(hot.select("key"), "key", "left_anti").join(shared.filter(F.col("size") <= MEMBERS_PER_SALT), "key")
    return rest.unionByName(rows.join(hot, "key"))


def contracted(links: DataFrame) -> DataFrame:
    """Links (center, member) with the same components and without redundancy: each member with its least centre, and
    its least centre with its other centres, every pair once.

    A member has at most ``CENTERS`` centres in each of its ``BANDS`` buckets (``SMALL`` in a small one), so the list of
    its centres is bounded; what remains is one link per member and the pairs of centres that share a member.
    """
    stars = links.groupBy("member").agg(F.sort_array(F.collect_set("center")).alias("centers"))
    least = F.col("centers")[0]
    own = stars.select(least.alias("center"), "member")
    others = F.slice("centers", 2, F.greatest(F.size("centers"), F.lit(1)))
    pairs = stars.filter(F.size("centers") > 1).select(least.alias("center"), F.explode(others).alias("member"))
    return own.unionByName(pairs).distinct()


def _sketches(sets: list[np.ndarray], probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per bin and the bucket keys of non-empty sets."""
    signatures = np.stack([signature(s, probes) for s in sets])
    return (mix(signatures) & np.uint64(255)).astype(np.uint8), band_keys(signatures).view(np.int64)


def _least_agreement(n: np.ndarray, similarity: int) -> np.ndarray:
    """Share of equal bytes that linked sets reach, but for six standard deviations; ``n`` is the size of the smaller."""
    return similarity / 100 - 6 * 0.4 / np.sqrt(np.minimum(n, BINS))


@dataclass
class _Side:
    """Members of a cell: ids, components, whether they are outer ones, sets, sketches and bucket keys."""

    rep: np.ndarray
    component: np.ndarray
    outer: np.ndarray
    sets: list[np.ndarray]
    sketch: np.ndarray
    keys: np.ndarray

    def part(self, a: int, b: int) -> _Side:
        return _Side(self.rep[a:b], self.component[a:b], self.outer[a:b], self.sets[a:b], self.sketch[a:b], self.keys[a:b])

    @staticmethod
    def of(sides: list[_Side]) -> _Side:
        join = [np.concatenate([getattr(s, f) for s in sides]) for f in ("rep", "component", "outer", "sketch", "keys")]
        return _Side(*join[:3], [x for s in sides for x in s.sets], *join[3:])


def _links_between(own: _Side, other: _Side, key: int, joined: set[tuple[int, int]], similarity: int) -> Iterator[tuple[int, int]]:
    """Links of outer members with others of the bucket ``key``, one for each pair of components.

    Sizes, then sketches, then the full sets decide. A pair is looked at in the first bucket that it shares, and a pair
    of outer members from the side of the lesser id.
    """
    sizes = [np.array([len(x) for x in side.sets]) for side in (own, other)]
    less, more = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    fit = (100 * less >= similarity * more) & (own.component[:, None] != other.component)
    fit &= ~(other.outer & (other.rep < own.rep[:, None]))
    agreement = (own.sketch[:, None, :] == other.sketch).mean(axis=2)
    i, j = np.nonzero(fit & (agreement >= _least_agreement(less, similarity)))
    shared = own.keys[i] == other.keys[j]
    first = own.keys[i, shared.argmax(axis=1)] == key
    for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
        ends = int(own.component[a]), int(other.component[b])
        if ends in joined:
            continue
        common = len(np.intersect1d(own.sets[a], other.sets[b], assume_unique=True))
        if 100 * common >= similarity * (sizes[0][a] + sizes[1][b] - common):
            joined.add(ends)
            yield int(own.rep[a]), int(other.rep[b])


def _compare(similarity: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the outer members of a cell, then those they are compared with."""
        probes, cell, own, joined = probe_table(), None, [], set()
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(*text_bytes(part.column("text")))
                part, sets = part.filter(pa.array([len(x) > 0 for x in sets])), [x for x in sets if len(x)]
                if not sets:  # rows that share a doc_id can have other texts
                    continue
                columns = [part.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "outer")]
                rows = _Side(*columns, sets, *_sketches(sets, probes))
                places = np.stack([part.column(c).to_numpy() for c in ("key", "tile", "salt", "kind")])
                borders = 1 + np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0))
                linked = []
                for a, b in zip([0, *borders], [*borders, len(sets)], strict=True):
                    *here, kind = places[:, a].tolist()
                    if here != cell:
                        cell, own, joined = here, [], set()
                    if kind == 0:
                        own.append(rows.part(a, b))
                    elif own:
                        own = [_Side.of(own)] if len(own) > 1 else own
                        for low in range(a, b, BLOCK):
                            linked.extend(_links_between(own[0], rows.part(low, min(low + BLOCK, b)), here[0], joined, similarity))
                if linked:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*linked, strict=True)], schema=_PAIR)

    return compare


def _between_components(docs: DataFrame, buckets: DataFrame, component: DataFrame, similarity: int) -> DataFrame:
    """(center, member): the links inside buckets between members that the stars left in different components.

    Each member outside the largest component of its bucket is compared with all members of other components. A bucket is
    cut into cells of about ``OUTER`` times ``MEMBERS`` members (fewer, if their sets are large), a task holds the outer
    members of one cell, and only links come out. Buckets of up to ``SMALL`` members have been compared whole.
    """
    named = buckets.filter(F.col("size") > SMALL).join(
        component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("key", "rep", F.col("n").alias("shingles"), F.coalesce("component", "rep").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("l"), F.count("*").alias("k")).filter("k > 1")
    named = materialize(named.join(largest, "key").select(
        "key", "rep", "component", "shingles", (F.col("component") != F.col("l.component")).alias("outer")), "several")
    outer = F.when(F.col("outer"), F.col("shingles"))
    grid = named.groupBy("key").agg(
        F.ceil(F.count("*") / MEMBERS).alias("salts"),
        F.greatest(F.ceil(F.count(outer) / OUTER), F.ceil(F.sum(outer) / OUTER_SHINGLES)).alias("tiles"))
    placed = named.join(grid, "key")
    row = ("key", F.col("rep").alias("doc"), "component", "outer")
    members = placed.select(*row, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
                            F.pmod(F.xxhash64("rep", F.lit(3)), "salts").alias("salt"), F.lit(1).alias("kind"))
    outers = placed.filter("outer").select(*row, F.pmod(F.xxhash64("rep", F.lit(4)), "tiles").alias("tile"),
                                           F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    wanted = broadcast_checked(members.unionByName(outers), "cells", row_bytes=96)
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc").withColumnRenamed("doc", "rep")
    dealt = texts.repartition("key", "tile", "salt").sortWithinPartitions("key", "tile", "salt", "kind")
    return materialize(dealt.mapInArrow(_compare(similarity), "center long, member long"), "between").distinct()


def near_duplicates(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * shared shingles >= ``similarity`` * all shingles of both. Documents of the same set are
    one class, found by a 128-bit digest of the set, and are linked through its least doc_id. Classes meet in buckets of
    6 of 252 bins: at the similarity of 0.8 a pair shares no bucket with a probability of 5e-6. In a bucket the first
    member of each of ``CENTERS`` random parts is joined with all members after it, in the order of how much company
    they have in all their buckets; the members of small buckets are all joined. An original has more company than its
    copies, so a group of copies that are too far from each other hangs together by it. All edges are confirmed on full
    sets, and confirmed links are contracted before components are found. Then members of a bucket in different components are compared cell by cell, so that no link inside a bucket is
    lost: by sizes, by one byte per bin (six standard deviations below the similarity), by full sets.

    Null, empty and blank texts have empty sets, are linked with nothing and kept. Rows that share a doc_id are one
    document. Rows without doc_id are linked with nothing and kept, with a null component. All other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_sign(similarity), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    members = signed.filter("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2")
    classes = members.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    same = materialize(members.join(classes, ["d1", "d2", "n"]).filter("doc_id <> rep").select("rep", "doc_id").distinct(), "copies")

    # Only documents that are least in their class go on to the buckets.
    alone = signed.filter("doc_id is not null and size(bands) > 0").join(same.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = materialize(alone.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("key")), "bands")
    buckets = materialize(_sized(rows), "buckets")
    company = buckets.groupBy("rep").agg(F.sum("size").alias("company"))
    buckets = materialize(buckets.join(company, "rep"), "company")

    edges = materialize(_candidates(buckets, similarity), "candidates")
    links = same.select(F.col("rep").alias("center"), F.col("doc_id").alias("member")).unionByName(contracted(confirm_edges(docs, edges, similarity)))
    component = materialize(connected_components(links, "center", "member"), "components")
    found = _between_components(docs, buckets, component, similarity)
    if found.limit(1).count():
        # Components are nodes of the second round.
        end = [component.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("center", "member")]
        merged = found.join(end[0], "center", "left").join(end[1], "member", "left").select(
            F.coalesce("c_center", "center").alias("a"), F.coalesce("c_member", "member").alias("b"))
        joined = connected_components(merged, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("final"))
        new = joined.join(component, "component", "left_anti").select(F.col("component").alias("node"), "final")
        component = component.join(joined, "component", "left").select("node", F.coalesce("final", "component").alias("final")).unionByName(new)
        component = component.withColumnRenamed("final", "component")
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(
        component.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select(
        "doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the least doc_id, once.

    Rows that share a doc_id are one document only if they share the text, too.
    """
    texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")).distinct()
    clashing = materialize(texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "clashing")
    if clashing.limit(1).count():
        return _deduplicated_by_text(docs, similarity)
    found = materialize(near_duplicates(docs, similarity), "found")
    gone = broadcast_checked(found.filter("not kept").select("doc_id").distinct(), "gone", row_bytes=32)
    stay = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    return _once(docs, stay, found.filter("kept"), "doc_id")


def _deduplicated_by_text(docs: DataFrame, similarity: int) -> DataFrame:
    """The same where rows of one doc_id have different texts: a hash of both names a document."""
    named = docs.withColumn("key__", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = materialize(near_duplicates(named.select(F.col("key__").alias("doc_id"), "text"), similarity), "found")
    found = found.filter("doc_id is not null").select(F.col("doc_id").alias("key__"), "component_id")
    ids = named.filter("key__ is not null").select("key__", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    least = found.distinct().join(ids, "key__").groupBy("component_id").agg(F.min(F.struct("doc_id", "key__")).alias("first"))
    kept = materialize(least.select("first.key__"), "kept")
    stay = named.join(kept, "key__", "left_semi").unionByName(named.filter("key__ is null"))
    return _once(named, stay.select(named.columns), found.join(kept, "key__", "left_semi"), "key__").select(docs.columns)


def _once(docs: DataFrame, stay: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """One row of each document of ``stay``; ``kept`` has the key of each of its rows."""
    twice = materialize(kept.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "twice")
    if not twice.count():
        return stay
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text")))
    first = stay.join(twice, key, "left_semi").withColumn("number__", number).filter("number__ = 1")
    return stay.join(twice, key, "left_anti").select(docs.columns).unionByName(first.select(docs.columns))
