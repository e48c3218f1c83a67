"""Joins that move less: tables bucketed once by their key, and a Bloom filter ahead of an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources import bucketed

#: Bits of a Bloom filter for each key, and the most words of 64 bits that one may have: 2^20 rows of two longs are broadcast at most.
BITS, MOST_WORDS = 16, 1 << 20


def co_located(left: DataFrame, right: DataFrame, left_key: str, right_key: str, buckets: int | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Both tables, written in buckets of their keys, and the condition to join them on. Joins and groupings by the key then need no exchange.

    Each side is shuffled once, when it is written; all later joins read its buckets as they lie. ``buckets`` are as
    many as the session's shuffle partitions unless given. ``right`` should have few rows a key.

    A key with more of ``left``'s rows than a bucket's share (there are at most ``buckets`` of these) is spread over
    as many buckets as it fills: its rows get a ``salt``, and ``right``'s rows of that key a copy for each. Inner,
    left, left semi and left anti joins of ``left`` with ``right`` give what they would without that. Where no key
    is so large there is no salt, and groups by the key lie in one bucket too. Null keys of ``left`` count as one
    key, which finds nothing. ``left`` should be a scan or a written table, as the salt follows the order of its rows. Columns
    ``left_salt`` and ``right_salt`` are replaced; column names of the two sides must differ.
    """
    buckets = buckets or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = left.groupBy(F.col(left_key).alias("hot_key")).agg(F.count("*").alias("hot_rows"))
    share = F.expr(f"CAST(ceil(hot_rows * {buckets} / hot_all) AS INT)")
    total = left.count()
    # keys with more than a bucket's share: fewer than there are buckets
    hot = sizes.withColumn("hot_all", F.lit(total)).where(f"hot_rows * {buckets} > hot_all").select("hot_key", share.alias("slices")).persist()
    try:
        if hot.isEmpty():
            left, right = bucketed(left, "left", [left_key], buckets), bucketed(right, "right", [right_key], buckets)
            return left, right, left[left_key] == right[right_key]
        slices = F.coalesce("slices", F.lit(1))
        left = left.drop("left_salt").join(F.broadcast(hot), F.col(left_key).eqNullSafe(F.col("hot_key")), "left")
        left = left.withColumn("left_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), slices).cast("int")).drop("hot_key", "slices")
        right = right.drop("right_salt").join(F.broadcast(hot), F.col(right_key) == F.col("hot_key"), "left")
        right = right.withColumn("right_salt", F.explode(F.sequence(F.lit(0), slices - 1))).drop("hot_key", "slices")
        left, right = bucketed(left, "left", [left_key, "left_salt"], buckets), bucketed(right, "right", [right_key, "right_salt"], buckets)
    finally:
        hot.unpersist()
    return left, right, (left[left_key] == right[right_key]) & (left["left_salt"] == right["right_salt"])


def may_match(large: DataFrame, small: DataFrame, large_key: str, small_key: str) -> DataFrame:
    """Rows of ``large`` but those that a Bloom filter of ``small``'s keys shows to have no partner, to be joined after that.

    Each key sets two bits of one word of 64. The filter is a table of words, found with partial aggregates and
    broadcast; it has BITS bits a key, which let through about one in fifty of other keys, and MOST_WORDS words at
    most. Were it to need more, ``small`` is not small, and ``large`` is returned as it is. Rows with null keys don't
    pass. The keys must have one type. Columns ``bloom_word``, ``bloom_mask`` and ``bloom_bits`` of ``large`` are dropped.
    """
    if large.schema[large_key].dataType != small.schema[small_key].dataType:
        raise ValueError(f"{large_key} and {small_key} must have the same type")
    keys = small.where(F.col(small_key).isNotNull())
    words, wanted = 1, keys.select(F.approx_count_distinct(small_key)).first()[0] * BITS / 64
    while words < wanted:
        words *= 2
    if words > MOST_WORDS:
        return large

    def marks(key: str) -> list[Column]:
        h = F.xxhash64(key)
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
        return [h.bitwiseAND(F.lit(words - 1)).alias("bloom_word"), bit(40).bitwiseOR(bit(50)).alias("bloom_mask")]

    table = keys.select(*marks(small_key)).groupBy("bloom_word").agg(F.bit_or("bloom_mask").alias("bloom_bits"))
    plain = large.drop("bloom_word", "bloom_mask", "bloom_bits")
    rows = plain.where(F.col(large_key).isNotNull()).select("*", *marks(large_key))
    found = rows.join(F.broadcast(table), "bloom_word")  # MOST_WORDS rows at most
    return found.where(F.col("bloom_bits").bitwiseAND(F.col("bloom_mask")) == F.col("bloom_mask")).select(*plain.columns)
