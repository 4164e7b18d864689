"""Which scans the events of a code host ask for, and results that a repeated batch overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatecrest.plans import report
from gatecrest.plans.exposure import Analysis

#: A push names its branch and the project's default one; a change its action and files; an installation the projects it covers.
SCHEMA = "kind string, action string, project string, branch string, default_branch string, revision string, paths array<string>, projects array<string>"
REQUESTED = ["project", "branch", "revision", "whole", "paths"]


def requested(events: DataFrame) -> DataFrame:
    """(project, branch, revision, whole, paths): the scans that events (see SCHEMA) ask for. Works on streams, too.

    A push to the default branch asks for a scan of the whole project; a pull request that was opened or has new commits
    for one of the files it changes; an installation that was created for one of each of its projects. Other events ask
    for nothing, nor do those that lack the columns they are told by. No rows give no rows.
    """
    none = F.lit(None).cast("array<string>")
    push = F.struct("project", "branch", "revision", F.lit(True).alias("whole"), none.alias("paths"))
    change = F.struct("project", "branch", "revision", F.lit(False).alias("whole"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
    each = F.transform(F.col("projects"), lambda p: F.struct(p.alias("project"), F.lit("main").alias("branch"), F.lit("HEAD").alias("revision"), F.lit(True).alias("whole"), none.alias("paths")))
    asked = F.when((F.col("kind") == "push") & (F.regexp_replace("branch", "^refs/heads/", "") == F.col("default_branch")), F.array(push))
    asked = asked.when((F.col("kind") == "pull_request") & F.col("action").isin("opened", "synchronize"), F.array(change))
    asked = asked.when((F.col("kind") == "installation") & (F.col("action") == "created"), each)
    out = events.select(F.explode(asked).alias("x")).select("x.*").where("project is not null")
    return out.withColumn("branch", F.regexp_replace("branch", "^refs/heads/", "")).select(*REQUESTED)


def keeping(path: str) -> Callable[[Analysis, int], None]:
    """A sink for changes.watch(): what a batch found goes to folders of its number, so that a repeated batch overwrites its own rows and adds none."""

    def sink(a: Analysis, number: int) -> None:
        for name, df in (("findings", a.findings), ("verdicts", report.verdicts(a.findings, a.files, "project"))):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return sink


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last verdict of each project in a folder that keeping() fills."""
    rows = spark.read.parquet(f"{path}/verdicts")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("batch")))).where("_r = 1").drop("_r")
