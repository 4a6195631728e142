"""Functions over feature names of action and state vectors; names are a small list in the dataset's description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import EFFECTOR_AXES, EFFECTOR_TOKENS, contains_any, words_array


def control_modality(names: Column) -> Column:
    """joint or end-effector by a vote over names (array); null without names or votes."""
    low = F.transform(names, lambda n: F.lower(n))
    parts = lambda n: F.split(F.replace(n, F.lit("_"), F.lit(".")), r"\.")
    effector = F.size(F.filter(low, lambda n: contains_any(n, EFFECTOR_TOKENS) | F.arrays_overlap(parts(n), words_array(EFFECTOR_AXES))))
    joint = F.size(F.filter(low, lambda n: F.array_contains(parts(n), "pos") | n.contains("joint")))
    return F.when(names.isNull() | (F.size(names) == 0), None).when(effector > joint, "end-effector").when(joint > 0, "joint").when(effector > 0, "end-effector")


def component_groups(names: Column, n_dims: Column, groups: dict[str, list[str]] | None = None, default: str = "arm") -> Column:
    """Group of each dimension: the first whose token is in its name, else the default; all default without names."""
    groups = {"gripper": ["gripper"]} if groups is None else groups

    def one(n):
        out = F.lit(default)
        for g, tokens in reversed(groups.items()):
            out = F.when(contains_any(n, tokens), g).otherwise(out)
        return out

    dims = F.when(n_dims > 0, F.sequence(F.lit(0), n_dims - 1)).otherwise(F.array().cast("array<int>"))
    known = names.isNotNull() & (F.size(names) >= n_dims)
    return F.transform(dims, lambda i: F.when(known, one(F.get(names, i))).otherwise(F.lit(default)))


def gripper_dims(names: Column, n_dims: Column) -> Column:
    """Places of dimensions named after a gripper, else the last one."""
    hits = F.filter(F.transform(names, lambda n, i: F.when(F.lower(n).contains("gripper"), i)), lambda i: i.isNotNull())
    last = F.when(n_dims > 0, F.array((n_dims - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, hits).otherwise(last)


def gripper_dim(names: Column, n_dims: Column) -> Column:
    """The first gripper dimension, else the last one; 0 for no dimensions."""
    return F.coalesce(F.get(gripper_dims(names, n_dims), F.lit(0)), F.lit(0))


def dims_table(spark: SparkSession, names: list[str] | None, n_dims: int, groups: dict[str, list[str]] | None = None, default: str = "arm") -> DataFrame:
    """(dim, name, grp), one row a dimension."""
    one = spark.range(1).select(F.lit(names).cast("array<string>").alias("names") if names else F.lit(None).cast("array<string>").alias("names"), F.lit(n_dims).alias("n"))
    return one.select(F.posexplode(component_groups(F.col("names"), F.col("n"), groups, default)).alias("dim", "grp"), "names").select("dim", F.get("names", F.col("dim")).alias("name"), "grp")
