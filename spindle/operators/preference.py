"""What a user's favourites and exclusions say, and what it adds to a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.sequence import exact_mean

#: Bias of a profile by the quality it is learned from.
BIASES = {"face_bias": "face_score", "motion_bias": "motion_intensity", "stability_bias": "stability", "sharpness_bias": "sharpness"}
PREFERRED, AVOIDED, FLOOR = 0.15, -0.20, 0.9


def boosted(shots: DataFrame, favourite: Column) -> DataFrame:
    """Favourites are at least 0.9 sharp, exposed and stable."""
    return shots.withColumns({c: F.when(favourite, F.greatest(F.col(c), F.lit(FLOOR))).otherwise(F.col(c)) for c in ("sharpness", "exposure", "stability") if c in shots.columns})


def apply_lists(shots: DataFrame, favourites: DataFrame, excluded: DataFrame, on: Sequence[str]) -> DataFrame:
    """``shots`` without the excluded; favourites are at least 0.9 sharp, exposed and stable.

    A shot is on a list if any one of its columns ``on`` is among the list's.
    """
    marked = shots
    for c in on:
        own = lambda rows, c=c: rows.filter(F.col(c).isNotNull()).select(c).distinct()
        marked = marked.join(own(excluded), c, "left_anti").join(own(favourites).withColumn(f"__{c}", F.lit(True)), c, "left")
    marked = marked.withColumn("is_favourite", F.coalesce(*[F.col(f"__{c}") for c in on], F.lit(False))).drop(*[f"__{c}" for c in on])
    return boosted(marked, F.col("is_favourite")).select(*shots.columns, "is_favourite")


def learn(shots: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """A profile per key from shots with a ``mark``: favourite, excluded or null.

    The pool is what the lists leave: all but the excluded, favourites at least
    0.9 sharp and stable. A bias is half the difference of means: favourites against excluded, else
    favourites against the pool, else the pool against excluded. The photo bias
    compares favourites with the pool, also when there are none.
    """
    groups = {"fav": F.coalesce(F.col("mark") == "favourite", F.lit(False)), "exc": F.coalesce(F.col("mark") == "excluded", F.lit(False)), "pool": ~F.coalesce(F.col("mark") == "excluded", F.lit(False))}
    shots = boosted(shots, groups["fav"])
    aggs = []
    for g, c in groups.items():
        aggs += [F.count_if(c).alias(f"n_{g}"), F.count_if(c & (F.col("media_type") == "photo")).alias(f"photo_{g}")]
        # A mean over millionths of the group's rows alone.
        aggs += [(F.sum(F.when(c, F.floor(F.col(q) * 1000000 + 0.5).cast("bigint"))).cast("double") / F.count_if(c) / 1000000).alias(f"{q}_{g}") for q in BIASES.values()]
        aggs.append(F.sort_array(F.collect_set(F.when(c & (F.col("event_id") >= 0), F.col("event_id")))).alias(f"events_{g}"))
    per = shots.groupBy(*keys).agg(*aggs)
    fav, exc = F.col("n_fav") > 0, F.col("n_exc") > 0

    def bias(q: str) -> Column:
        half = lambda a, b: (F.col(f"{q}_{a}") - F.col(f"{q}_{b}")) * F.lit(0.5)
        return F.when(fav & exc, half("fav", "exc")).when(fav, half("fav", "pool")).when(exc, half("pool", "exc")).otherwise(F.lit(0.0))

    rate = lambda g: F.col(f"photo_{g}") / F.greatest(F.col(f"n_{g}"), F.lit(1))
    return per.select(*keys, *[bias(q).alias(b) for b, q in BIASES.items()], ((rate("fav") - rate("pool")) * F.lit(0.3)).alias("photo_bias"), F.col("events_fav").alias("preferred_events"), F.col("events_exc").alias("avoided_events"), (F.col("n_fav") + F.col("n_exc")).alias("sample_count"))


def learn_roles(shots: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Bias of each role among a key's favourites: 0.3 times how much more of them than of the pool it is."""
    role = F.when(F.coalesce(F.col("shot_role"), F.lit("")) == "", "unknown").otherwise(F.col("shot_role"))
    per = shots.filter(~F.coalesce(F.col("mark") == "excluded", F.lit(False))).withColumn("role", role).groupBy(*keys, "role").agg(F.count_if(F.col("mark") == "favourite").alias("f"), F.count("*").alias("p"))
    whole = per.groupBy(*keys).agg(F.sum("f").alias("all_f"), F.sum("p").alias("all_p"))
    joined = per.filter("f > 0").join(whole, list(keys))
    return joined.select(*keys, "role", ((F.col("f") / F.col("all_f") - F.col("p") / F.col("all_p")) * F.lit(0.3)).alias("bias"))


def adjustment(role_bias: Column | None = None) -> Column:
    """What a profile's columns add to the score of a shot in the same row; 0 where nothing was learned."""
    value = sum((F.col(b) * F.col(q) for b, q in BIASES.items()), F.lit(0.0))
    if role_bias is not None:
        value = value + F.coalesce(role_bias, F.lit(0.0))
    value = value + F.when(F.array_contains("preferred_events", F.col("event_id")), F.lit(PREFERRED)).otherwise(F.lit(0.0))
    value = value + F.when(F.array_contains("avoided_events", F.col("event_id")), F.lit(AVOIDED)).otherwise(F.lit(0.0))
    value = value + F.when(F.col("media_type") == "photo", F.col("photo_bias")).otherwise(F.lit(0.0))
    return F.when(F.col("sample_count") > 0, value).otherwise(F.lit(0.0))


def mean_qualities(shots: DataFrame) -> DataFrame:
    return shots.agg(*[F.coalesce(exact_mean(F.col(q)), F.lit(0.0)).alias(q) for q in BIASES.values()])


def count_roles(shots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    role = F.when(F.coalesce(F.col("shot_role"), F.lit("")) == "", "unknown").otherwise(F.col("shot_role"))
    return shots.withColumn("shot_role", role).groupBy(*keys, "shot_role").agg(F.count("*").alias("n"))
