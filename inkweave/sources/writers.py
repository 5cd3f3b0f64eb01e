"""Writers: submissions, split datasets, feature blocks and metrics; checksums that tie blocks to their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(scored: DataFrame, id_col: str = "pair_id", score: str = "predicted") -> DataFrame:
    return scored.select(F.col(id_col).cast("bigint").alias("id"), F.col(score).cast("double").alias("predicted"))


def write_submission(scored: DataFrame, path: str, expected_rows: int | None = None, id_col: str = "pair_id", score: str = "predicted") -> int:
    """CSV with header `id,predicted` in the order of id; a wrong number of rows is an error."""
    out = submission(scored, id_col, score)
    n = out.count()
    if expected_rows is not None and n != expected_rows:
        raise ValueError(f"{n} rows to write, {expected_rows} expected")
    out.orderBy("id").write.mode("overwrite").csv(path, header=True)
    return n


def write_splits(df: DataFrame, path: str) -> None:
    """One directory for each split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def checksum(df: DataFrame, *cols: str) -> DataFrame:
    """(rows, checksum): a fingerprint that does not depend on the order of rows."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])), 1, 8), 16, 10)
    return df.agg(F.count("*").alias("rows"), F.sum(hashed.cast("bigint")).cast("bigint").alias("checksum"))


def write_features(df: DataFrame, path: str, name: str, pairs: DataFrame) -> None:
    """A feature block with the checksum of the pairs it was made for."""
    sums = checksum(pairs, "pair_id", "u", "v").first()
    df.withColumns({"block": F.lit(name), "pairs_checksum": F.lit(sums["checksum"])}).write.mode("overwrite").parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The ends and labels of the pairs (pair_id, split, u, v, y), a directory for each split, with a fingerprint of each beside them."""
    pairs.select("pair_id", "split", "u", "v", "y").write.mode("overwrite").partitionBy("split").parquet(f"{path}/pairs")
    sums = [checksum(pairs.where(F.col("split") == r["split"]), "pair_id", "u", "v").withColumn("split", F.lit(r["split"])) for r in pairs.select("split").distinct().collect()]
    for k, s in enumerate(sums):
        s.write.mode("overwrite" if k == 0 else "append").parquet(f"{path}/manifest")


def fuse(pairs: DataFrame, *paths: str) -> DataFrame:
    """pairs with the columns of feature blocks written by write_features, side by side; a block that was made for other pairs is an error, and so is a column in two blocks."""
    own = checksum(pairs, "pair_id", "u", "v").first()["checksum"]
    out, seen = pairs, set(pairs.columns)
    for path in paths:
        block = pairs.sparkSession.read.parquet(path)
        other = [r["pairs_checksum"] for r in block.select("pairs_checksum").distinct().limit(2).collect()]
        if other != [own]:
            raise ValueError(f"the block {path} was made for other pairs")
        block = block.drop("block", "pairs_checksum", "split", "u", "v", "y")
        if twice := (set(block.columns) - {"pair_id"}) & seen:
            raise ValueError(f"{sorted(twice)} are in two blocks")
        seen |= set(block.columns)
        out = out.join(block, "pair_id")
    return out


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
