"""Near-duplicate documents by SimHash: groups of like fingerprints, and of texts whose sets of word shingles are alike."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprint import BLOCK, fingerprint_batches, shingle_hashes, simhash
from .hamming import Near, similar_groups
from .shared import Writer, persisted, persisted_map, scratch

#: Bits within which the fingerprints of two texts are candidates. Sets that are 0.8 alike differ in 9.7 bits of 64 on average, with a deviation of 2.9: about 19 of 20 such pairs are within 14 bits, and nearly all that are more alike.
RADIUS = 14
#: Words of 64 bits of a text's whole fingerprint: the first is searched, and candidates lie within WIDE_RADIUS bits over all. At 0.8 the expected distance is 78 bits, with a deviation of 8.
WORDS, WIDE_RADIUS = 8, 94
_WIDE = tuple(f"fp{k}" for k in range(1, WORDS))
#: Rows up to which a table of ids or keys is broadcast (some 20 bytes each). A larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row: the SimHash of the whole text's word shingles, as a signed number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: fingerprint_batches(b, shingle, seed), "doc_id long, fp long")


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """Every row's fingerprint and the smallest doc_id reachable over links of at most ``radius`` bits.

    Copies meet in one fingerprint before anything is joined, and only
    distinct fingerprints are searched and linked. Null and wordless texts
    have fingerprint zero and link like others. Rows with a null doc_id have
    a component, of which null is the id only if no row has one. Repeated rows
    give repeated results; an empty table gives no rows. Only doc_id and text
    are read, whatever other columns are named.

    Returns doc_id, fp, component_id.
    """
    rows = persisted(fingerprints(docs, shingle), "fingerprints")
    with scratch(docs.sparkSession, "simhash") as write:
        fps = write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
        groups = similar_groups(fps.select(F.col("fp").alias("key"), "fp", F.lit(1).alias("size")), Near(radius), write).withColumnRenamed("key", "fp")
        known = write(fps.join(groups, "fp").select("fp", "root", "first_id"), "known")
        roots = write(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
        classes = persisted(known.join(roots, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key(own: np.ndarray) -> int:
    """A signed hash of a set of shingles in order."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _class_batches(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, hash of the text's set of shingles, its size, its SimHash)."""
    for batch in batches:
        keys, sizes, fps, held, size = [], [], [], [], 0
        for t in batch.column(1):
            held.append(np.unique(shingle_hashes(t.as_py(), n)))
            keys.append(_key(held[-1]))
            sizes.append(len(held[-1]))
            size += sizes[-1]
            if size >= BLOCK:
                fps.append(simhash(held, WORDS))
                held, size = [], 0
        fps.append(simhash(held, WORDS))
        told = np.ascontiguousarray(np.concatenate(fps).T).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), *map(pa.array, told)], ["doc_id", "key", "size", "fp", *_WIDE])


def _set_batches(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (key, the text's distinct shingle hashes in order), some texts at a time."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int32)
        flat = np.concatenate([np.empty(0, np.uint64), *held]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([_key(x) for x in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "shingles"])

    for batch in batches:
        held, size = [], 0
        for t in batch.column(0):
            held.append(np.unique(shingle_hashes(t.as_py(), n)))
            size += len(held[-1])
            if size >= 4 * BLOCK:
                yield told(held)
                held, size = [], 0
        yield told(held)


def _sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, shingle: int, write: Writer) -> DataFrame:
    """(key, shingles) of some classes, made again from the text of one document of each. Sets of all texts would be larger than the texts."""
    wanted = write(classes.join(keys, "key").select("key", "first_id"), "wanted")
    ids = _small(wanted.where("first_id IS NOT NULL").select(F.col("first_id").alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = texts.join(ids, "doc_id", "left_semi").select("text")
    if not wanted.where("first_id IS NULL").isEmpty():
        held = held.union(texts.where("doc_id IS NULL").select("text"))
    made = held.mapInArrow(lambda b: _set_batches(shingle, b), "key long, shingles array<long>").join(_small(wanted.select("key")), "key", "left_semi")
    return write(made.dropDuplicates(["key"]), "sets")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, key, root, component_id, rep_key) of every row.

    ``key`` is a 64-bit hash of the set of word shingles; texts of one set are
    one class, and no others are, whatever their fingerprints. Classes whose
    SimHashes lie within ``radius`` of 64 bits (and WIDE_RADIUS of all) and whose sizes allow the similarity
    are candidates, and link if their sets are at least ``similarity`` alike
    (common shingles over all). Null and wordless texts have an empty set and
    are one class. ``root`` is the smallest key reachable over links,
    ``component_id`` the smallest doc_id there, null if no row of it has one,
    and ``rep_key`` the smallest key with that doc_id.

    Representatives are compared first and only what these leave apart pair
    by pair, so a group of near copies costs about its size and not its
    square, and no table of pairs or sets outlives the call.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = persisted_map(named, lambda b: _class_batches(shingle, b), "doc_id long, key long, size int, fp long, " + ", ".join(f"{c} long" for c in _WIDE), "keys")
    least = math.ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 30  # smaller sets are like none but themselves
    with scratch(docs.sparkSession, "near-dedup", by_tasks=True) as write:
        classes = write(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("size", "fp", *_WIDE)]), "classes")

        def verify(pairs: DataFrame) -> DataFrame:
            pairs = write(pairs, "pairs")
            sets = _sets(docs, classes, pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct(), shingle, write)
            first, second = (sets.select(F.col("key").alias(end), F.col("shingles").alias(f"of_{end}")) for end in "uv")
            common = F.size(F.array_intersect("of_u", "of_v"))
            alike = common + 1e-9 >= similarity * (F.size("of_u") + F.size("of_v") - common)
            return pairs.join(first, "u").join(second, "v").where(alike).select("u", "v", "ru", "rv")

        groups = similar_groups(classes.where(F.col("size") >= least), Near(radius, similarity, _WIDE, WIDE_RADIUS), write, verify)
        known = write(classes.join(groups, "key", "left").select("key", "first_id", F.coalesce("root", "key").alias("root")), "known")
        reps = write(known.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("key"))).alias("_rep")), "reps")
        known = persisted(known.join(reps, "root").select("key", "root", F.col("_rep.first_id").alias("component_id"), F.col("_rep.key").alias("rep_key")), "known", by_tasks=True)
    return rows.select("doc_id", "key").join(known, "key").select("doc_id", "key", "root", "component_id", "rep_key")


def _key_batches(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, doc_id, text) to (number, doc_id, hash of the set of shingles)."""
    for batch in batches:
        keys = [_key(np.unique(shingle_hashes(t.as_py(), n))) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["_row", "doc_id", "key"])


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id; the columns as they are.

    A group without any doc_id keeps a row too. Of rows of one group that
    share its smallest doc_id, the ones with the group's ``rep_key`` are told
    apart by a hash of the whole row, of which the smallest stays; a doc_id
    with texts in two groups may stay once in each. Wordless texts are one
    group.
    """
    classes = persisted(near_duplicates(docs, shingle, similarity, radius), "classes", by_tasks=True)
    several = persisted(classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "several", by_tasks=True)
    stays = "doc_id <=> component_id AND key = rep_key"
    dropped = _small(persisted(classes.where(f"NOT ({stays})").select("doc_id").distinct().where("doc_id IS NOT NULL"), "dropped", by_tasks=True))
    if several.isEmpty():
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = _small(several.where("doc_id IS NOT NULL"))
    named = docs.where("doc_id IS NOT NULL")
    once = named.join(repeated, "doc_id", "left_anti").join(dropped, "doc_id", "left_anti").select(docs.columns)
    others = docs.where("doc_id IS NULL").select(docs.columns).union(named.join(repeated, "doc_id", "left_semi").select(docs.columns))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = others.select(whole.alias("_all"), F.xxhash64(F.to_json(whole)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = others.select("_row", "doc_id", "text").mapInArrow(lambda b: _key_batches(shingle, b), "_row long, doc_id long, key long")
    reps = classes.where(stays).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    first = keys.join(reps, F.expr("doc_id <=> _id AND key = _key")).groupBy("_id", "_key").agg(F.min("_row").alias("_row")).select("_row")
    return once.union(others.join(_small(persisted(first, "rows", by_tasks=True)), "_row", "left_semi").dropDuplicates(["_row"]).select("_all.*"))
