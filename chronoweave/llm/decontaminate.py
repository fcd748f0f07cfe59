"""Benchmark passages in documents, by SimHash of item-sized windows.

All of it is Spark expressions. Every window of an item's size whose
similarity to an item can reach the threshold is fingerprinted: one that holds
fewer shingles of items of its size than the threshold takes cannot. The
fingerprints are looked up among the items' in a multi-index: the 64 bits fall
into blocks, and fingerprints within RADIUS bits differ in at most RADIUS //
BLOCKS bits of one block at least, so that no item within the radius is
missed. The similarity of shingles with their counts decides.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import persisted
from .text import let, window_hashes, words

#: Words of a shingle; an item of fewer words is one shingle.
SHINGLE = 5
#: Fingerprints within so many bits are candidates. At similarity 0.8 the expected distance is 10 bits, with a deviation of 3.
RADIUS = 23
#: Blocks of bits of the multi-index.
BLOCKS = 6
#: Rows and elements of arrays up to which a table is broadcast (some 100 bytes a row, 8 an element). Larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_ELEMENTS = 400_000, 4_000_000


def _small(df: DataFrame, array: str | None = None) -> DataFrame:
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(array)) if array else F.lit(0), F.lit(0)).alias("m")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and size["m"] <= BROADCAST_ELEMENTS else df


def _fingerprint(hs: Column) -> Column:
    """Bits set in over half the hashes."""
    one = lambda b: F.when(2 * F.size(F.filter(hs, lambda h: F.getbit(h, b) == 1)) > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(one(b)))


def _block(fp: Column, k: int) -> tuple[Column, int]:
    """Block ``k`` of a fingerprint, and its width."""
    low, high = 64 * k // BLOCKS, 64 * (k + 1) // BLOCKS
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)), high - low


def _index(items: DataFrame) -> DataFrame:
    """Every item under all values of each block within the block's radius."""
    each = RADIUS // BLOCKS
    slots = []
    for k in range(BLOCKS):
        value, width = _block(F.col("fp"), k)
        masks = [sum(1 << b for b in c) for d in range(each + 1) for c in combinations(range(width), d)]
        slots.append(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value"))))
    return items.select("item_id", "n", "fp", F.explode(F.concat(*slots)).alias("_slot")).select("_slot.*", "item_id", "n", "fp")


def _common(a: Column, b: Column) -> Column:
    """The number of elements that two arrays share, with repeats."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), k (words of a shingle), hs (shingles) and fp of each item with a word."""
    ws = benchmark.select(F.col("item_id").alias("item_id"), words(F.lower("text")).alias("ws")).where(F.size("ws") > 0).withColumn("n", F.size("ws"))
    hs = F.when(F.col("n") >= SHINGLE, window_hashes(F.col("ws"), SHINGLE))
    for k in range(1, SHINGLE):
        hs = hs.when(F.col("n") == k, window_hashes(F.col("ws"), k))
    return ws.select("item_id", "n", F.least("n", F.lit(SHINGLE)).alias("k"), hs.alias("hs")).withColumn("fp", _fingerprint(F.col("hs")))


def _starts(similarity: float) -> Column:
    """The starts of windows that hold enough shingles of items, from the sorted places ``at`` of such shingles in a text.

    Of a window and an item with a and b shingles, similarity s takes s (a + b)
    / (1 + s) common ones. A window with so many holds as many places that
    follow each other in ``at``, so the starts of all such runs are all.
    """
    item = F.col("n") - F.col("k") + 1
    window = F.least(F.col("n"), F.col("total")) - F.col("k") + 1
    last = F.greatest(F.lit(0), F.col("total") - F.col("n"))
    need = F.greatest(F.ceil(F.lit(similarity) * (window + item) / F.lit(1 + similarity) - 1e-9).cast("int"), F.lit(1))

    def run(i: Column) -> Column:
        low, high = F.greatest(F.lit(0), F.get("at", i + need - 1) - window + 1), F.least(F.get("at", i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    runs = F.transform(F.sequence(F.lit(0), F.size("at") - need), run)
    return F.when((F.size("at") >= need) & (window >= need), F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<int>"))


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents that hold a passage like an item of the benchmark.

    Words are parted by white space and compared in lower case. A window of as
    many words as the item has (the whole document, if that is shorter) is a
    match if its shingles of five words, with their counts, are at least
    ``similarity`` like the item's: common ones over all. An item of fewer than
    five words must lie there word for word. Null and wordless texts match
    nothing. Rows of the same doc_id count together, so do all rows whose
    doc_id is null; repeated rows make no difference, and a text that many rows
    share is compared once. Only doc_id, item_id and
    the two texts are read, whatever other columns are named. An empty table
    on either side gives no rows.

    Returns doc_id, item_id, similarity (of the best window), start (its first
    word, counted from 0; the first of equals) and n_windows (that match).
    """
    items = persisted(_item_table(benchmark), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # SHINGLE values at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType).add("similarity", "double").add("start", "long").add("n_windows", "long"))
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("of"))
    texts = given.select("of", words(F.lower("text")).alias("ws"))
    anchors = _small(persisted(items.select("k", "n", F.explode("hs").alias("h")).distinct(), "anchors"))
    hits = []
    for k in sizes:
        shingles = texts.select("of", F.size("ws").alias("total"), F.posexplode(window_hashes(F.col("ws"), k)).alias("pos", "h"))
        hits.append(shingles.join(anchors.where(F.col("k") == k), "h").select("of", "total", "k", "n", "pos"))
    met = reduce(DataFrame.union, hits).groupBy("of", "total", "k", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    places = met.select("of", "k", "n", F.explode(_starts(similarity)).alias("start")).select("of", F.struct("k", "n", "start").alias("place"))
    by_text = _small(persisted(places.groupBy("of").agg(F.collect_list("place").alias("places")), "places"), "places")
    held = given.select("of", "text").join(by_text, "of").dropDuplicates(["of"]).select("of", words(F.lower("text")).alias("ws"), "places")

    def of_size(k: int) -> Column:
        mine = F.filter("places", lambda p: p["k"] == k)
        cut = lambda hs, p: F.slice(hs, p["start"] + 1, F.greatest(p["n"] - k + 1, F.lit(1)))
        return let(window_hashes(F.col("ws"), k), lambda hs: F.transform(mine, lambda p: F.struct(p["n"].alias("n"), p["start"].alias("start"), cut(hs, p).alias("hs"))))

    windows = held.select("of", F.explode(F.flatten(F.array(*[of_size(k) for k in sizes]))).alias("w")).select("of", "w.n", "w.start", "w.hs").where(F.size("hs") > 0)
    windows = persisted(windows.withColumn("fp", _fingerprint(F.col("hs"))), "windows")
    slots = [F.struct(F.lit(k).alias("block"), _block(F.col("fp"), k)[0].alias("value")) for k in range(BLOCKS)]
    lookups = windows.select("of", "n", "start", "fp", F.inline(F.array(*slots))).alias("w")
    index = _small(persisted(_index(items), "index")).alias("i")
    near = F.expr(f"w.block = i.block AND w.value = i.value AND w.n = i.n AND bit_count(w.fp ^ i.fp) <= {RADIUS}")
    candidates = lookups.join(index, near).select("w.of", "w.n", "w.start", "i.item_id").distinct()
    known = _small(items.select("item_id", F.col("n").alias("_n"), F.col("hs").alias("item_hs")), "item_hs")
    shared = _common(F.col("hs"), F.col("item_hs")).cast("double")
    paired = candidates.alias("c").join(windows.alias("w"), ["of", "n", "start"])
    scored = paired.join(known.alias("i"), F.expr("c.item_id <=> i.item_id AND n = i._n")).select("of", "c.item_id", "start", (shared / (F.size("hs") + F.size("item_hs") - shared)).alias("similarity"))
    found = _small(persisted(scored.where(F.col("similarity") >= similarity).distinct(), "found"))
    best = given.select("doc_id", "of").distinct().join(found, "of").select("doc_id", "item_id", "start", "similarity").distinct().groupBy("doc_id", "item_id")
    return best.agg(F.max("similarity").alias("similarity"), (-F.max(F.struct("similarity", -F.col("start")))["col2"]).cast("long").alias("start"), F.count("*").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose doc_id holds a passage of the benchmark; its columns as they are."""
    found = benchmark_passages(docs, benchmark, similarity).select("doc_id").distinct()
    return docs.alias("d").join(_small(persisted(found, "contaminated")).alias("f"), F.expr("d.doc_id <=> f.doc_id"), "left_anti")
