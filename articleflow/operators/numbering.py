"""Consecutive numbers in a given order, without ever sorting a whole table or a whole group in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BITS = 16


def number_rows(df: DataFrame, order: str, out: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: 1, 2, 3 ... by ``order``, over the table or within each ``by`` group.

    ``order`` is a long; where it is repeated within a group, ``ties`` must tell the rows apart, or a task that runs again may number them otherwise. Rows are numbered inside blocks of 2**16
    consecutive order values; how many rows lie before a block comes from counting blocks, runs of 2**16 blocks, and
    runs of those. A long has room for 2**15 of the last, so no task sorts more than 65,536 rows, however large a
    group is and however wide its values are spread, and the numbers are a function of the data alone: a task that runs again gives the same ones.

    ``df`` is read twice; hand in a stored table when it is costly to compute.
    """
    by = list(by)
    counts = df.groupBy(*by, F.shiftright(order, BLOCK_BITS).alias("_level0")).agg(F.count("*").alias("_n0"))
    levels = [counts]
    for level in (1, 2):
        up = F.shiftright(f"_level{level - 1}", BLOCK_BITS).alias(f"_level{level}")
        levels.append(levels[-1].groupBy(*by, up).agg(F.sum(f"_n{level - 1}").alias(f"_n{level}")))

    def before(level: int) -> Column:
        keys = [*by, f"_level{level + 1}"] if level < 2 else by
        ahead = Window.partitionBy(*keys).orderBy(f"_level{level}").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(f"_n{level}").over(ahead), F.lit(0))

    bases = levels[2].select(*by, "_level2", before(2).alias("_base"))
    for level in (1, 0):
        parent = F.shiftright(f"_level{level}", BLOCK_BITS).alias(f"_level{level + 1}")
        placed = levels[level].select(*by, f"_level{level}", f"_n{level}", parent)
        own = placed.withColumn("_own", before(level)).join(bases, [*by, f"_level{level + 1}"])
        bases = own.select(*by, f"_level{level}", (F.col("_base") + F.col("_own")).alias("_base"))
    bases = bases.withColumnRenamed("_level0", "_block")

    position = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order, *ties))
    numbered = df.withColumn("_block", F.shiftright(order, BLOCK_BITS)).join(bases, [*by, "_block"])
    return numbered.select(*[F.col(name) for name in df.columns], (F.col("_base") + position).alias(out))


def assign_ids(new: DataFrame, existing: DataFrame, order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Give new rows the ids after the largest one in ``existing``, in ``order``."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = number_rows(new.drop("id"), order, "_number", ties=ties)
    return numbered.withColumn("id", last + F.col("_number")).drop("_number")
