"""Paired comparison of two result tables and of stored predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from regionmatch.operators.ordering import id_bucket, position
from regionmatch.session import cut_lineage

PRIME = (1 << 31) - 1
ROUNDS = ((48271, 69621), (16807, 39373), (630360016, 742938285), (950706376, 1226874159))
#: Below which of PRIME values a draw is 0, 1, 2 and so on.
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12))



def document_delta(a: DataFrame, b: DataFrame, key: str = "document_id", value: str = "document_iou") -> DataFrame:
    """Per-key difference ``b - a`` of two result tables with the same keys."""
    left = a.select(key, F.col(value).alias("base"))
    right = b.select(key, F.col(value).alias("candidate"))
    return left.join(right, key, "full").withColumn("delta", F.col("candidate") - F.col("base"))


def better_worse(deltas: DataFrame, eps: float) -> DataFrame:
    """Documents that moved by more than ``eps``; a delta counts at nine decimals, so one of exactly ``eps`` is neither."""
    delta = F.round("delta", 9)
    return deltas.agg(
        F.count("*").alias("documents"),
        F.avg("delta").alias("mean_delta"),
        F.count_if(delta > eps).alias("better"),
        F.count_if(delta < -eps).alias("worse"),
    )


def resample_count(number: Column, replicate: Column, seed: int = 0) -> Column:
    """How often a resample takes a row: a Poisson draw of mean one from the row's number and the replicate's.

    A counter-based generator: rounds of a quadratic modulo 2**31 - 1, whole numbers below 2**63 throughout, so
    any engine can repeat it.
    """
    x = F.pmod(number.cast("long"), F.lit(PRIME))
    for mul, add in ROUNDS:
        x = (x * (x + mul) + (replicate.cast("long") + 1) * add + (seed + 1)) % PRIME
    count = F.when(x < POISSON[0], 0)
    for k, edge in enumerate(POISSON[1:], 1):
        count = count.when(x < edge, k)
    return count.otherwise(len(POISSON))


def numbered(df: DataFrame, key: str, bucket: Column, name: str) -> DataFrame:
    """Give unique keys consecutive positions from zero, in key order."""
    return position(df, [], [F.col(key)], bucket, name).withColumn(name, F.col(name) - 1)


#: Positions to a piece of the deltas, pieces that one task holds (64 MB of numbers), and replicates to a task's group.
PIECE, PIECES, REPLICATES = 1 << 20, 8, 25


def bootstrap_means(deltas: DataFrame, key: str, bucket: Column | None = None, replicates: int = 5000, seed: int = 0) -> DataFrame:
    """Mean delta of every document-level resample of as many draws as there are documents.

    Draw ``i`` of replicate ``b`` takes the document at the position ``scalars.draw(seed, b, i, n)``, so the resamples can
    be repeated in any engine. The deltas are packed by position; a group of replicates meets a bounded part of them and
    makes its draws there, so no draw is a row. Documents without a delta are drawn and do not count.
    """
    at = cut_lineage(numbered(deltas.select(key, "delta"), key, id_bucket(F.col(key)) if bucket is None else bucket, "_at"))
    n = at.count()

    def pack(table):
        import numpy as np
        import pyarrow as pa

        where = table.column("_at").to_numpy()
        part = int(where.min()) // PIECE
        values = np.full(min(PIECE, n - part * PIECE), np.nan)
        values[where - part * PIECE] = table.column("delta").to_numpy()
        return pa.table({"_piece": pa.array([part], pa.int64()), "_values": pa.array([values.tobytes()], pa.binary())})

    def resample(table):
        import numpy as np
        import pyarrow as pa

        from regionmatch.functions.counters import draws

        order = np.argsort(table.column("_piece").to_numpy())
        first = int(table.column("_piece").to_numpy().min()) * PIECE
        packed = table.column("_values")
        values = np.concatenate([np.frombuffer(packed[int(k)].as_py(), np.float64) for k in order])
        known = ~np.isnan(values)
        values = np.where(known, values, 0.0)
        start = table.column("_group")[0].as_py() * REPLICATES
        numbers = range(start, min(start + REPLICATES, replicates))
        total, count = dict.fromkeys(numbers, 0.0), dict.fromkeys(numbers, 0)
        for number, index in draws(seed, numbers, n):
            if n > len(values):
                index = index[(index >= first) & (index < first + len(values))] - first
            total[number] += float(values[index].sum())
            count[number] += int(known[index].sum())
        return pa.table({"replicate": pa.array(list(numbers), pa.int64()), "_n": pa.array(list(count.values()), pa.int64()),
                         "_sum": pa.array(list(total.values()), pa.float64())})

    pieces = at.withColumn("_p", F.expr(f"_at div {PIECE}")).groupBy("_p").applyInArrow(lambda t: pack(t.select(["_at", "delta"])), "_piece long, _values binary")
    groups = -(-replicates // REPLICATES)
    meet = cut_lineage(pieces).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_part", F.expr(f"_piece div {PIECES}"))
    sums = meet.repartition(groups, "_group", "_part").groupBy("_group", "_part").applyInArrow(resample, "replicate long, _n long, _sum double")
    sums = sums.groupBy("replicate").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    return sums.select("replicate", F.try_divide("_sum", "_n").alias("mean_delta"))


def bootstrap_interval(means: DataFrame) -> DataFrame:
    """95 % interval over the replicates; their number is a parameter, not the data size."""
    q = F.percentile("mean_delta", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.count("*").alias("replicates"), q.alias("_q")).select(
        "replicates", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi")
    )


def grouped_delta(deltas: DataFrame, groups: DataFrame, on: str, group: str) -> DataFrame:
    """Mean delta per group, such as the fold of each document."""
    return deltas.join(groups, on).groupBy(group).agg(
        F.count("*").alias("documents"), F.avg("delta").alias("mean_delta")
    )


def changed_rows(a: DataFrame, b: DataFrame, key: str, value: str, cut: float) -> DataFrame:
    """Keys whose value moved by more than ``cut`` or exists on one side only."""
    d = document_delta(a, b, key, value)
    return d.filter(F.col("delta").isNull() | (F.abs("delta") > cut))


def aligned_mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tol: float) -> DataFrame:
    """Merge check: rows missing on either side, or whose shared columns differ by more than ``tol``."""
    left = a.select(*keys, F.lit(True).alias("_in_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(*keys, F.lit(True).alias("_in_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = left.join(right, list(keys), "full")
    off = F.lit(False)
    for c in columns:
        off = off | F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tol, F.lit(False)) | (
            F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()
        )
    problem = (
        F.when(F.col("_in_a").isNull(), "only_b").when(F.col("_in_b").isNull(), "only_a").when(off, "differs")
    )
    return both.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def replay_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, counted with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("only_b"))
    )


def blend(parts: Sequence[DataFrame], keys: Sequence[str], prob: str = "p") -> DataFrame:
    """Mean of several probability tables by row key."""
    out = parts[0].select(*keys, prob)
    for d in parts[1:]:
        out = out.unionByName(d.select(*keys, prob))
    return out.groupBy(*keys).agg(F.avg(prob).alias(prob))
