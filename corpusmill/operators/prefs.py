"""Preference records and sweep selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preference(instruction: Column, chosen: Column, rejected: Column, human: str = "human", model: str = "gpt") -> list[Column]:
    """conversations, chosen and rejected of a preference record."""
    said = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return [F.array(said(human, instruction)).alias("conversations"), said(model, chosen).alias("chosen"), said(model, rejected).alias("rejected")]


def rewrite_role(node: str, role: str = "gpt") -> Column:
    """The node with its sender replaced; a missing node stays missing."""
    return F.when(F.col(node).isNotNull(), F.col(node).withField("from", F.lit(role)))


def role_counts(df: DataFrame, node: str, role: str = "gpt") -> DataFrame:
    """(old_role, n, state) of what rewrite_role does: fixed, ok or missing."""
    old = F.col(node)["from"]
    state = F.when(F.col(node).isNull(), "missing").when(old.eqNullSafe(F.lit(role)), "ok").otherwise("fixed")
    return df.groupBy(old.alias("old_role"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def sweep_grid(tasks: DataFrame, rates: DataFrame, evals: DataFrame, trains: DataFrame) -> DataFrame:
    """Every task and rate with its results or nulls; epoch is evaluation's, else training's. Tasks and rates are parameters' names, a few dozen rows."""
    grid = tasks.join(F.broadcast(rates), F.lit(True))
    out = grid.join(evals, ["task", "lr"], "left").join(trains, ["task", "lr"], "left")
    return out.select("task", "lr", "lr_index", "eval_loss", "train_loss", F.coalesce("eval_epoch", "train_epoch").alias("epoch"), F.col("eval_loss").isNotNull().alias("has_eval"), F.col("train_loss").isNotNull().alias("has_train"))


def best_rate(grid: DataFrame, fallback: bool = False) -> DataFrame:
    """(task, lr, metric_used) of the least evaluation loss, the first rate on a tie; with fallback, of the training loss if no evaluation is there."""
    pick = lambda loss: F.min(F.when(F.col(loss).isNotNull(), F.struct(F.col(loss).alias("loss"), "lr_index", "lr")))
    both = grid.groupBy("task").agg(pick("eval_loss").alias("e"), pick("train_loss").alias("t"))
    if not fallback:
        return both.select("task", F.col("e.lr").alias("lr"), F.when(F.col("e").isNotNull(), "eval_loss").alias("metric_used"))
    return both.select("task", F.coalesce("e.lr", "t.lr").alias("lr"), F.when(F.col("e").isNotNull(), "eval_loss").when(F.col("t").isNotNull(), "train_loss").alias("metric_used"))


def sweep_summary(grid: DataFrame) -> DataFrame:
    """One row over all tasks: tasks, those with an evaluation, with training only, and with none, and the rate chosen most often (the first by name on a tie)."""
    best = best_rate(grid, fallback=True)
    used = F.col("metric_used")
    counts = best.agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(used == "eval_loss").alias("n_eval"), F.count_if(used == "train_loss").alias("n_train"), F.count_if(used.isNull()).alias("n_none"))
    often = best.where("lr is not null").groupBy("lr").agg(F.count(F.lit(1)).alias("k")).agg(F.min(F.struct((-F.col("k")).alias("k"), "lr")).alias("m"))
    return counts.join(F.broadcast(often), F.lit(True)).select("n_tasks", "n_eval", "n_train", "n_none", F.col("m.lr").alias("lr"))
