"""Joins of a large side with hot keys to a table that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

#: Bytes up to which the other side is sent to every task; its rows are stored and measured first.
SENT_BYTES = 32 << 20
#: Parts that a key of the large side is dealt into when the other side is larger than that.
PARTS = 32


def join_hot(large: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`large` joined to `other` on `keys`, without one task for one hot key.

    `other` is stored once and its size taken in bytes of text. Up to `SENT_BYTES` it
    is broadcast and `large` is not shuffled at all. Beyond, rows of `large` get one of
    `PARTS` numbers, in turn, rows of `other` all of them, and the number joins the
    key. `how` is inner, left, left_semi or left_anti; both ways give the same rows.
    """
    held = cut(other)
    size = held.select(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in held.columns]))))).first()[0]
    if (size or 0) <= SENT_BYTES:
        return large.join(F.broadcast(held), keys, how)
    dealt = large.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    copies = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")
