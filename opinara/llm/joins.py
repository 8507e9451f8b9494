"""Joins with a table of one row per key when one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.session import cut_lineage

#: Rows of one key from which on they aren't all sent to one task.
HOT_KEY = 1000
#: Rows that are broadcast at most; their number is counted first.
MAX_BROADCAST = 500_000
#: Parts of a hot key where there are too many hot keys to broadcast.
SALTS = 16


def join_by_size(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row per key and in ``count`` the key's number of rows.

    Hot keys leave the shuffle: their rows of ``table`` are broadcast, after they were counted.  If there are too many of
    them, every key is cut into ``SALTS`` parts by a hash of the row and ``table`` is repeated for each part."""
    hot = F.col(count) > HOT_KEY
    number = table.where(hot).limit(MAX_BROADCAST + 1).count()
    if not number:
        return rows.join(table, keys, how)
    table = cut_lineage(table, "keys")
    if number <= MAX_BROADCAST:
        large = table.where(hot)
        split = rows.join(F.broadcast(large), keys)
        rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(table.where(~hot), keys, how)
        return split.unionByName(rest)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    parts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(parts, [*keys, "_salt"], how).drop("_salt")


def packed(docs: DataFrame, **beside: Column) -> DataFrame:
    """The columns ``beside`` and each row as one struct ``row``, so that no name of ``docs`` can clash with an operator's;
    ``unpacked`` brings the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in beside.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def broadcast_if_few(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcasting if it has at most ``MAX_BROADCAST`` rows."""
    return F.broadcast(table) if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table
