"""Choosing among scored candidates: nested folds, margins, cut rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from regionmatch.session import by_shuffle


def nested_choice(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per held-out fold, the candidate with the best mean on the other folds and its held-out mean.

    ``scores``: document_id, fold, candidate, score; with ``keys`` each of their values chooses by itself.  Inner means come from totals minus the
    fold's own sums, so no fold is scanned twice.  Ties go to the first candidate name.
    """
    own = scores.groupBy(*keys, "fold", "candidate").agg(F.sum("score").alias("_s"), F.count("*").alias("documents"))
    whole = own.groupBy(*keys, "candidate").agg(F.sum("_s").alias("_ts"), F.sum("documents").alias("_tn"))
    j = own.join(whole, [*keys, "candidate"]).withColumn(
        "inner_score", (F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("documents"))
    )
    j = j.withColumn("outer_score", F.col("_s") / F.col("documents"))
    pick = F.min_by(
        F.struct("candidate", "inner_score", "outer_score", "documents"),
        F.struct(-F.round("inner_score", 9), "candidate"),
    )
    return j.groupBy(*keys, "fold").agg(pick.alias("_p")).select(*keys, "fold", "_p.*")


def choose_with_margin(curve: DataFrame, gain: str, default: float, margin: float) -> DataFrame:
    """Per query, the threshold of largest gain (lowest on ties) when it passes the margin, else the default."""
    best = curve.groupBy("query").agg(
        F.max_by(F.struct(F.col("threshold"), F.col(gain).alias("g")), F.struct(F.col(gain), -F.col("threshold"))).alias("_b")
    )
    return best.select(
        "query",
        F.when(F.col("_b.g") > margin, F.col("_b.threshold")).otherwise(F.lit(default)).alias("threshold"),
        F.col("_b.g").alias("predicted_gain"),
    )


# ---- competition between the queries of one drawing -------------------------------------


def alias_pairs(maps: DataFrame, inside: DataFrame, t: float, value: str = "p") -> DataFrame:
    """Pairs of queries of one drawing whose maps have a median above ``t`` in each other's box.

    ``maps``: image, query, y, x, value; ``inside``: query, image, y, x (cells of the query box).
    A median above ``t`` needs at least half of the box cells above ``t``, so only cells above
    ``t`` are paired; the exact middle is looked up for the few pairs that sit on one half.
    """
    c = F.col
    size = inside.groupBy("query").agg(F.count("*").alias("n")).withColumnRenamed("query", "host")
    host = by_shuffle(inside.select("image", "y", "x", c("query").alias("host")))
    guest = maps.select("image", "y", "x", c("query").alias("guest"), c(value).alias("_v"))
    high = host.join(guest.filter(c("_v") > t), ["image", "y", "x"]).filter(c("host") != c("guest"))
    seen = high.groupBy("host", "guest").agg(F.count("*").alias("k"), F.min("_v").alias("_up")).join(size, "host")
    clear = seen.filter(2 * c("k") > c("n")).select("host", "guest")
    close = seen.filter(2 * c("k") == c("n")).select("host", "guest", "_up")
    below = host.join(close.select("host", "guest"), "host").join(
        guest.filter(c("_v") <= t), ["image", "y", "x", "guest"]).groupBy("host", "guest").agg(F.max("_v").alias("_dn"))
    ties = close.join(below, ["host", "guest"]).filter((c("_up") + c("_dn")) / 2 > t).select("host", "guest")
    one_way = clear.unionByName(ties)
    back = one_way.select(c("host").alias("guest"), c("guest").alias("host"))
    return one_way.join(back, ["host", "guest"], "left_semi").select(c("host").alias("query"), c("guest").alias("alias"))


def compete(maps: DataFrame, aliases: DataFrame, margin: float, value: str = "p") -> DataFrame:
    """Push a cell below one half where another query of the drawing, not an alias, beats it by ``margin``.

    Per cell only the strongest queries are kept, as many as the drawing's longest alias list
    plus two: among those is always one that is neither the query itself nor its alias.
    """
    from pyspark.sql import Window as W

    c = F.col
    lists = aliases.groupBy("query").agg(F.collect_set("alias").alias("_aliases"))
    # ``lists`` has one row per query; its length sets how many rivals a cell must keep.
    most = maps.select("image", "query").distinct().join(lists, "query", "left").groupBy("image").agg(
        (F.max(F.coalesce(F.size("_aliases"), F.lit(0))) + 2).alias("_keep"))
    rank = F.row_number().over(W.partitionBy("image", "y", "x").orderBy(F.desc(value), "query"))
    strong = maps.select("image", "query", "y", "x", value).withColumn("_r", rank).join(most, "image").filter("_r <= _keep")
    rivals = strong.groupBy("image", "y", "x").agg(F.collect_list(F.struct(c(value).alias("v"), c("query").alias("q"))).alias("_rivals"))
    j = maps.join(lists, "query", "left").join(rivals, ["image", "y", "x"])
    others = F.filter("_rivals", lambda r: (r["q"] != c("query")) & ~F.coalesce(F.array_contains("_aliases", r["q"]), F.lit(False)))
    j = j.withColumn("_best", F.array_max(F.transform(others, lambda r: r["v"])))
    beaten = F.coalesce(c(value) + margin < c("_best"), F.lit(False))
    return j.withColumn(value, F.when(beaten, F.least(c(value), F.lit(0.49))).otherwise(c(value))).drop("_aliases", "_rivals", "_best")
