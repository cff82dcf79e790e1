"""Rosters, and a seeded sample that fills a quota for each stratum of any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_position(roster: DataFrame, position: str) -> DataFrame:
    return roster.filter(F.col("position") == position)


def quota_sample(rows: DataFrame, quotas: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """Rows drawn without replacement to fill ``quotas`` (the strata and ``quota``).

    The draw is by a seeded hash of the strata and ``key``, so it does not depend on how
    rows are laid out.  Raises ValueError when a stratum has too few rows.
    """
    strata = list(strata)
    have = rows.groupBy(*strata).agg(F.count("*").alias("available"))
    short = quotas.join(have, strata, "left").filter(F.coalesce("available", F.lit(0)) < F.col("quota")).head(1)
    if short:
        raise ValueError(f"Not enough rows for {', '.join(str(short[0][s]) for s in strata)}")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*strata, key]]))
    # Input partitions trim their strata first, so a large stratum reaches its task as its leading draws only.
    slots = Window.partitionBy(*strata, "_slot").orderBy("_digest", key)
    wanted = rows.join(quotas, strata).withColumns({"_digest": digest, "_slot": F.spark_partition_id()})
    trimmed = wanted.withColumn("_draw", F.row_number().over(slots)).filter(F.col("_draw") <= F.col("quota"))
    drawn = Window.partitionBy(*strata).orderBy("_digest", key)
    kept = trimmed.withColumn("_draw", F.row_number().over(drawn)).filter(F.col("_draw") <= F.col("quota"))
    return kept.select(*rows.columns)
