"""Report tables over scores: deltas, leaderboard, gaps, roll-ups and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deltas(scores: DataFrame, name: str, before: str, after: str, measures: list[str]) -> DataFrame:
    """One row: every measure of two named rows and their difference."""
    at = lambda m, who: F.max(F.when(F.col(name) == who, F.col(m)))
    one = scores.agg(*[at(m, who).alias(f"{m}_{label}") for m in measures for label, who in (("before", before), ("after", after))])
    return one.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures})


def leaderboard(ours: DataFrame, baselines: DataFrame, system: str, score: str) -> DataFrame:
    """(system, score, ours, rank, gap): ours and the published systems, best first, ours first on a tie, then by name; gap is to the best published system. One row a system, so one task ranks them."""
    rows = ours.select(system, score, F.lit(True).alias("ours")).union(baselines.select(system, score, F.lit(False)))
    rank = F.row_number().over(Window.orderBy(F.desc(score), F.desc("ours"), system))
    best = F.max(F.when(~F.col("ours"), F.col(score))).over(Window.partitionBy())
    return rows.select(system, score, "ours", rank.alias("rank"), (F.col(score) - best).alias("gap"))


def all_ok(df: DataFrame, ok: str, *by: str) -> DataFrame:
    """(*by, n, n_bad, ok) of every group and, with nulls for by, of all groups: ok if no row is bad."""
    bad = F.count_if(~F.coalesce(F.col(ok), F.lit(False)))
    return df.groupingSets([list(by), []], *by).agg(F.count(F.lit(1)).alias("n"), bad.alias("n_bad"), (bad == 0).alias("ok"))


def counters(df: DataFrame, status: str = "status") -> DataFrame:
    """One row: n, n_ok, n_failed."""
    ok = F.count_if(F.col(status).eqNullSafe("ok"))
    return df.agg(F.count(F.lit(1)).alias("n"), ok.alias("n_ok"), (F.count(F.lit(1)) - ok).alias("n_failed"))


def shown(x: Column, digits: int = 2) -> Column:
    """A number with fixed digits, - for null."""
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def nested(df: DataFrame, outer: str, inner: str, measures: list[str]) -> DataFrame:
    """(outer, report): a JSON object of the inner names, in their order, with their measures; a report has a row a pair of names."""
    entry = F.to_json(F.struct(*measures), {"ignoreNullFields": "false"})
    parts = F.array_sort(F.collect_list(F.struct(F.col(inner).cast("string").alias("k"), F.concat(F.lit('"'), F.col(inner).cast("string"), F.lit('":'), entry).alias("v"))))
    return df.groupBy(outer).agg(F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: x["v"]), ","), F.lit("}")).alias("report"))


def sizes(spark, paths: list[str]) -> DataFrame:
    """(path, found, bytes) of files and folders on any file system that Spark reads."""
    context = spark.sparkContext
    out = []
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        found = files.exists(at)
        out.append((path, found, files.getContentSummary(at).getLength() if found else None))
    return spark.createDataFrame(out, "path string, found boolean, bytes long")


def console(df: DataFrame, digits: int = 2) -> str:
    """A report's rows as lines of aligned columns, numbers with fixed digits and - for null; reports are a few dozen rows."""
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    rows = df.select(*[shown(F.col(c), digits).alias(c) if c in numbers else F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in df.columns]).collect()
    table = [df.columns, *[list(r) for r in rows]]
    wide = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in table)
