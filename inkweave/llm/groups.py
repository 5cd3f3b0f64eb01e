"""All pairs within groups, large groups in slots; connected components are those of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators.components import components

__all__ = ["components", "slotted", "within"]


def slotted(members: DataFrame, key: str, id_: str, most: int = 1_000) -> DataFrame:
    """members (key, id) with slots, the number of parts of about `most` ids its group is cut into, and slot, the one it is in."""
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    return members.join(n, key).withColumn("slots", F.ceil(F.col("n") / most).cast("int")).withColumn("slot", F.expr(f"CAST(pmod(xxhash64({id_}), slots) AS int)")).drop("n")


def within(members: DataFrame, key: str, id_: str, most: int = 1_000) -> DataFrame:
    """(key, a, b), a < b: all pairs of the ids that share a key. A large group is cut into slots, and every two slots meet apart."""
    cells = slotted(members, key, id_, most).withColumn("other", F.explode(F.expr("sequence(0, slots - 1)"))).select(key, id_, "slot", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"))
    a, b = cells.withColumnsRenamed({id_: "a", "slot": "slot_a"}), cells.withColumnsRenamed({id_: "b", "slot": "slot_b"})
    return a.join(b, [key, "lo", "hi"]).where("a < b AND (slot_a <> slot_b OR lo = hi)").select(key, "a", "b")
