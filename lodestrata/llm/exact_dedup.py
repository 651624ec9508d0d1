"""Exact dedup (operator 4): progressive refinement by length, prefix hash, full hash.

Texts are equal when identical after each run of white space is replaced by one
space. A first pass counts lengths. A second one hashes a prefix of the texts
whose length occurs more than once, and counts (length, prefix). A third hashes
the whole of those whose length and prefix occur more than once; the groups of
that hash decide. Which lengths and prefixes repeat, a bitmap tells each task
without a shuffle (a false positive costs one hash, nothing else). Only narrow
rows are ever shuffled.

Cases: null counts as empty, and empty texts are equal to each other. Of equal
texts the row with the smallest doc_id stays; a null doc_id comes after all
others. Repeated rows (one doc_id, equal texts) are all marked as kept when that
doc_id stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import drop, materialise, small_enough

PREFIX = 64
#: Longs in a bitmap: sixteen bits for each key, within these bounds (a quarter of a megabyte to four).
LEAST_LONGS, MOST_LONGS = 1 << 15, 1 << 19
#: Groups of equal texts (a hash and two longs each) up to this number may be broadcast.
BROADCAST_GROUPS = 100_000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bitmap(keys: DataFrame, name: str) -> tuple[DataFrame, int]:
    """One row with an array of longs in which each of ``keys`` (materialised; one column of longs) has its bit, and the number of bits."""
    longs = min(MOST_LONGS, max(LEAST_LONGS, 1 << (keys.count() // 4).bit_length()))
    key = keys.columns[0]
    parts = keys.select((F.pmod(key, F.lit(64 * longs)) / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    words = keys.sparkSession.range(longs, numPartitions=1).select(F.col("id").cast("int").alias("w")).join(F.broadcast(parts), "w", "left")
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias(name)), 64 * longs


def _set_in(name: str, bits: int, key: Column) -> Column:
    """Whether the key has its bit in the array ``name``."""
    at = F.pmod(key, F.lit(bits))
    word = F.element_at(name, (F.floor(at / 64) + 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: dict[str, Column] | None = None, prefix: int = PREFIX) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the columns of ``carry`` (narrow, computed in the third pass): one row for each document."""
    carry = carry or {}
    norm = normalised(text)
    size, head = F.length("_norm").cast("long"), F.xxhash64(F.substring("_norm", 1, prefix))
    lengths = materialise(docs.select(F.length(norm).cast("long").alias("size")).groupBy("size").agg(F.count("*").alias("n")).filter("n > 1").select("size"), "lengths")
    by_length, length_bits = _bitmap(lengths, "_lengths")
    by_length = materialise(by_length, "bitmap")

    # The bitmaps are single rows of bounded size.
    long_enough = docs.select(norm.alias("_norm")).crossJoin(F.broadcast(by_length)).filter(_set_in("_lengths", length_bits, size))
    twice = long_enough.select(size.alias("size"), head.alias("head")).groupBy("size", "head").agg(F.count("*").alias("n")).filter("n > 1")
    twice = materialise(twice.select(F.xxhash64("size", "head").alias("key")), "prefixes")
    by_prefix, prefix_bits = _bitmap(twice, "_prefixes")
    by_prefix = materialise(by_prefix, "bitmap")

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), norm.alias("_norm"), *(c.alias(f"_carry_{k}") for k, c in carry.items()))
    rows = rows.crossJoin(F.broadcast(by_length)).crossJoin(F.broadcast(by_prefix))
    again = _set_in("_prefixes", prefix_bits, F.xxhash64(size, head))
    full = F.when(_set_in("_lengths", length_bits, size), F.when(again, F.sha2("_norm", 256)))
    rows = rows.select("_id", full.alias("_full"), *(f"_carry_{k}" for k in carry))
    rows = materialise(rows, "hashed")
    several = rows.filter("_full is not null")
    groups = materialise(several.groupBy("_full").agg(F.min("_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1"), "groups")
    # Rows without a full hash are alone: they pass by the join, where their null keys would all meet in one task.
    joined = several.join(F.broadcast(groups) if small_enough(groups, BROADCAST_GROUPS) else groups, "_full", "left")
    alone = rows.filter("_full is null").withColumns({"_keep": F.lit(None).cast("long"), "_n": F.lit(None).cast("long")})
    out = joined.unionByName(alone)
    drop(lengths, by_length, twice, by_prefix)
    keep = F.when(F.col("_n").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("_id")).alias("kept"), *(F.col(f"_carry_{k}").alias(k) for k in carry),
    )
