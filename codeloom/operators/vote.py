"""Verdicts and votes over tested candidates, and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUNGS = ["reproduction_and_regression", "regression", "reproduction", "applied"]


def ladder(candidates: DataFrame, reproduction_valid: bool = True) -> DataFrame:
    """The survivors with `rung`: of each run the applied and measured candidates on its first rung that has any."""
    fine = candidates.where("applied and measured")
    reproduced = F.col("reproduction_passed") & F.lit(reproduction_valid)
    rung = F.when(reproduced & F.col("regression_passed"), 0).when(F.col("regression_passed"), 1).when(reproduced, 2).otherwise(3)
    fine = fine.withColumn("_rung", rung)
    fine = fine.withColumn("_best", F.min("_rung").over(W.partitionBy("run"))).where("_rung = _best")
    return fine.withColumn("rung", F.element_at(F.array(*map(F.lit, RUNGS)), F.col("_rung") + 1)).drop("_rung", "_best")


def clusters(survivors: DataFrame) -> DataFrame:
    """run, rung, place, key, size, representative, members: survivors of equal key together, largest first, then the earliest.

    A null key is equal to nothing: such a candidate is a cluster of its own.
    """
    group = F.coalesce("key", F.concat(F.lit("\0"), F.col("id")))
    sums = survivors.groupBy("run", "rung", group.alias("_g")).agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("size"), F.min_by("id", "index").alias("representative"), F.min("index").alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "id"))), lambda x: x["id"]), ",").alias("members"),
    )
    place = F.row_number().over(W.partitionBy("run").orderBy(F.desc("size"), "_first"))
    return sums.withColumn("place", place).drop("_g", "_first")


def verdicts(candidates: DataFrame, runs: DataFrame, timeout: float) -> DataFrame:
    """run, id, status: of candidates without a result not_evaluated, else apply_failed, error, timeout, pass or fail."""
    rows = candidates.join(runs, ["run", "id"], "left")
    status = F.when(~F.col("applied"), "apply_failed").when(F.col("exit_code").isNull(), "not_evaluated").when(F.col("seconds") > timeout, "timeout").when(F.col("exit_code") < 0, "error").when(F.col("exit_code") == 0, "pass").otherwise("fail")
    return rows.select("run", "id", status.alias("status"))


def baseline(runs: DataFrame) -> DataFrame:
    """run, repeats, verified: whether all repeats of a baseline passed and agree."""
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("repeats"), (F.count_if(~F.col("passed")) == 0).alias("verified"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """candidate, warning, advisory, not_checked."""
    return findings.groupBy("candidate").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("warning", "advisory", "not_checked")])


def verdict_lines(statuses: DataFrame) -> DataFrame:
    """run, id, line: a JSON line for each verdict."""
    return statuses.select("run", "id", F.to_json(F.struct(F.lit("candidate").alias("record"), "run", "id", "status")).alias("line"))
