"""Mixing sources to target weights with distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import persisted
from .text import n_words

#: Hexadecimal digits of the key that make a range: 4096 ranges a source.
KEY_RANGE_DIGITS = 3
#: Sources up to which the table of cuts is broadcast (some 200 bytes each).
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Targets of sources by weight, none above ``cap`` times its size.

    ``sizes`` has one row for each source: source, source_size. The level at
    which the capped sources' excess is all reshared by weight is found in
    closed form: in the order of cap / weight, a source is capped as long as
    the level of what remains lies at or above its own ratio. The level rises
    up to the first source that is not capped and falls after it.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(all_rows).cast("double")
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = ranked.withColumn("_level", left / open_weight)
    free = F.col("_level") * F.col("_weight") < F.col("_cap")
    final = F.coalesce(F.max(F.when(free, F.col("_level"))).over(all_rows), F.lit(float("inf")))
    return level.select("source", "source_size", "_weight", "_cap", final.alias("_level")).select(
        "source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_weight")).alias("target")
    )


def mix_key(doc_id: Column) -> Column:
    """The hash-random key of a document: 32 hexadecimal digits."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _plan(docs: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """The mix by stacks of rows that share doc_id and size: source, doc_id, size, _key, _count, source_size, target, _epochs, and _rest, the words that the last epoch has left for the stack."""
    measured = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("_key", mix_key(F.col("doc_id")))
    stacks = measured.groupBy("source", "_key", "doc_id", "size").agg(F.count("*").alias("_count")).withColumn("_range", F.substring("_key", 1, KEY_RANGE_DIGITS))
    stacks = persisted(stacks, "mix")
    words_of = F.col("size") * F.col("_count")
    ranges = stacks.groupBy("source", "_range").agg(F.sum(words_of).alias("_words"))
    budget = targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, cap)
    prefix = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_words").over(prefix), F.lit(0))).alias("r")
    plan = starts.join(budget.alias("b"), F.expr("r.source <=> b.source")).select("r.source", "_range", "_start", "source_size", "target")
    within = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = stacks.withColumn("_inner", F.coalesce(F.sum(words_of).over(within), F.lit(0))).alias("d")
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = words - epochs * F.col("source_size") - F.col("_start") - F.col("_inner")
    joined = placed.join(plan.alias("p"), F.expr("d.source <=> p.source and d._range = p._range"))
    return joined.select("d.source", "doc_id", "size", "_key", "_count", "source_size", "target", epochs.alias("_epochs"), rest.cast("long").alias("_rest"))


def _taken(epochs: Column, size: Column, rest: Column, before: Column) -> Column:
    """Words of a row that ``before`` rows of its stack precede: whole epochs, and what the last one has left for it."""
    return (epochs * size + F.greatest(F.lit(0), F.least(size, rest - before * size))).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """How many words of each document a mix takes.

    Sources, by code point with null last, weigh ``weights`` again and again
    and share the words of all documents; no target goes over ``cap`` times
    the source's size. Within a source, documents stand in the order of a hash
    of their id. A target is met by whole epochs over the source and then a cut
    of the last one, exactly at the budget, in that order: one document at the
    cut gives a part of its words.

    The keys are cut into ranges. Sums of ranges make the prefix sums of
    ranges, and only rows within one range are sorted together, so that a
    source with a third of all rows is dealt over as many tasks as its rows
    need. Rows of one doc_id and size are counted before they are sorted, so
    that an id of very many rows is as many as it has sizes. Only the ranges'
    sums, not the rows, meet in one task.

    A null text has size 0, a null source is a source, a null doc_id has the
    key of an empty one. Rows of the same doc_id stand in the order of their
    size, and equal ones are interchangeable. Other columns are ignored,
    whatever their names. An empty table gives no rows.

    Returns doc_id, source, size, source_size, target, taken.
    """
    each = _plan(docs, weights, cap).withColumn("_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    return each.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("_epochs"), F.col("size"), F.col("_rest"), F.col("_before")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes words of, with size, target and taken.

    A source's cut is one place in the order of rows, so the texts are never
    sorted or shuffled: rows are compared with the cuts, a row for each
    source. Only the rows of a cut itself (one doc_id and size of a source)
    are put in order, by a hash of the text, to give exactly what is left;
    the words that a source gives are those of :func:`mix_sources`. Columns
    of ``docs`` named like the new ones are replaced.
    """
    at = F.struct(F.col("_key"), F.col("doc_id").isNotNull().alias("_named"), F.col("size"))
    cuts = _plan(docs, weights, cap).groupBy("source").agg(
        F.max("target").alias("_target"), F.max("_epochs").alias("_epochs"), F.max(F.when((F.col("_rest") > 0) & (F.col("size") > 0), F.struct(at.alias("at"), F.col("_rest").alias("rest")))).alias("_cut")
    )
    cuts = persisted(cuts.withColumnRenamed("source", "_source"), "mix-cuts")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    columns = [c for c in docs.columns if c not in ("size", "target", "taken")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), mix_key(F.col("doc_id")).alias("_key"), F.col("doc_id").isNotNull().alias("_named"), F.col("source").alias("_of"))
    size = n_words(F.col("_row.text"))
    place = F.struct(F.col("_key"), F.col("_named"), F.col("_size").alias("size"))
    out = lambda df, taken: df.select("_row.*", F.col("_size").alias("size"), F.col("_target").alias("target"), taken.alias("taken")).where("taken > 0")
    joined = own.join(cuts, F.expr("_of <=> _source")).withColumn("_size", size)
    whole = joined.where(F.col("_cut").isNull() | (place != F.col("_cut.at")))
    part = F.when(place < F.col("_cut.at"), F.col("_size")).otherwise(F.lit(0))
    last = own.join(cuts, F.expr("_of <=> _source AND _key = _cut.at._key")).withColumn("_size", size).where(place == F.col("_cut.at"))
    last = last.withColumn("_before", F.row_number().over(Window.partitionBy("_of").orderBy(F.xxhash64("_row.text"))) - 1)
    return out(whole, (F.col("_epochs") * F.col("_size") + part).cast("long")).union(out(last, _taken(F.col("_epochs"), F.col("_size"), F.col("_cut.rest"), F.col("_before"))))
