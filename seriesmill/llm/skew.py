"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Rows of one key that stay together. On tables of over HOT_KEYS times as many rows it grows with them, so that no more
#: than HOT_KEYS keys can be split, and their list can be broadcast.
HOT, HOT_KEYS = 256, 100_000
#: Rows of short keys that may be broadcast, by their counted number.
FEW = 1_000_000
#: Bytes of a table that may be broadcast, by its counted rows and the lengths of its texts.
BROADCAST = 32 << 20


def fits(t: DataFrame) -> bool:
    """Whether a settled table is small enough to be sent to every task."""
    sized = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for n, kind in t.dtypes]
    return (t.agg(F.sum(sum(sized[1:], sized[0]))).first()[0] or 0) <= BROADCAST


def salted(left: DataFrame, right: DataFrame, key: str | tuple[str, ...], *by: str, of: DataFrame | None = None, hot: int = HOT, keep: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """The inner join of ``left`` with ``right``, whose keys are distinct. Rows of a key that ``left`` has more than ``hot``
    times are dealt by ``by`` to as many tasks as needed, each with a copy of the right row. ``of``: a settled table with the
    keys of ``left`` as often as there, to count them by; else ``left`` is read for that. ``keep``: leave the dealing's number
    (salt_) in, and the number of tasks that the key's rows are dealt to (copies_). ``counts``: a settled table of the keys and how
    often ``left`` has them (rows_), where that is known; keys that ``right`` lacks may be left out."""
    keys, of = [key] if isinstance(key, str) else list(key), left if of is None else of
    hot = max(hot, -(-of.count() // HOT_KEYS))
    copies = F.ceil(F.col("rows_") / F.lit(hot)).cast("int")
    counted = of.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_")) if counts is None else counts
    many = settle(counted.filter(F.col("rows_") > hot).select(*keys, copies.alias("copies_")), "hot-keys")
    if many.isEmpty():
        plain = left.join(right, keys)
        return plain.withColumns({"salt_": F.lit(0), "copies_": F.lit(1)}) if keep else plain
    many = F.broadcast(many)
    own = F.coalesce("copies_", F.lit(1))
    dealt = left.join(many, keys, "left").withColumn("salt_", F.pmod(F.xxhash64(*by), own).cast("int")).drop("copies_")
    spread = right.join(many, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), own - 1))).drop("copies_")
    if keep:
        return dealt.join(right.join(many, keys, "left").withColumn("copies_", own).withColumn("salt_", F.explode(F.sequence(F.lit(0), own - 1))), [*keys, "salt_"])
    return dealt.join(spread, [*keys, "salt_"]).drop("salt_")


def picked(rows: DataFrame, keys: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with the settled table ``keys`` of short rows, which is broadcast where it has few of them."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, condition, how)
