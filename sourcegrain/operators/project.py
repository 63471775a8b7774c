"""A whole project from its folder: files, declarations, findings, limits, steps and graph as tables, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions import text as T
from ..sources import files
from . import flow, limits, rules, structure

#: What a run that fails says.
INVALID, EMPTY, CANCELED = "Invalid project path", "No C# or C++ source files found", "Scan canceled."


@dataclass
class ProjectRun:
    """What came of a run: its tables by stage, the rows of each, and the error of one that failed."""

    success: bool = False
    error: str | None = None
    no_source_files: bool = False
    tables: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    #: Stages that an earlier run of the same tree had completed.
    resumed: list[str] = field(default_factory=list)


def declared_methods(sources: DataFrame) -> DataFrame:
    """One row a method, with method_id and all that the analysers ask for; a type without methods is a row whose method_name is
    null. sources: path, language, text. Ids are those of the path and the place in its file, so runs agree."""
    rows = sources.select("path", "language", F.posexplode(lexing.declared_in(F.col("text"))).alias("place", "d")).select("path", "language", "place", "d.*")
    none = F.array().cast("array<string>")
    full = F.concat_ws(".", F.nullif("namespace", F.lit("")), "class_name")
    body = F.col("body")
    return rows.select(
        F.xxhash64("path", "place").alias("method_id"), "path", "language", "place", F.coalesce("namespace", F.lit("")).alias("namespace"), "class_name", full.alias("type_name"), "bases", "method_name", F.coalesce("return_type", F.lit("")).alias("return_type"), "params", "body",
        "fields", F.array().cast("array<struct<name:string,type:string,initial_value:string>>").alias("locals"), F.array().cast("array<struct<name:string,type:string>>").alias("properties"),
        F.array_distinct(T.found(F.coalesce(body, F.lit("")), r"\bthrow\s+new\s+([A-Za-z_][\w.]*)")).alias("thrown"), none.alias("op_limits"), none.alias("class_dependencies"),
    )


def relationships(methods: DataFrame) -> DataFrame:
    """source, kind, target: INHERITS to the first base of a C# class that is no interface by its name and to all of a C++ one, IMPLEMENTS to the others."""
    types = methods.groupBy("type_name").agg(F.min_by("bases", F.struct("path", "place")).alias("bases"), F.min("language").alias("language"))
    rows = types.select("type_name", "language", F.posexplode("bases").alias("at", "base"))
    base = F.regexp_replace("base", r"^(?:public|private|protected|virtual)\s+", "")
    inherits = (F.col("language") != "C#") | (F.col("at") == 0) & ~base.rlike(r"^I\p{Lu}")
    return rows.select(F.col("type_name").alias("source"), F.when(inherits, "INHERITS").otherwise("IMPLEMENTS").alias("kind"), base.alias("target"))


def summary_text(metrics: DataFrame) -> DataFrame:
    """summary: the text that stands for a project's summary. metrics: project, classes, methods, namespaces (null where nothing was counted)."""
    counts = F.format_string("\n\n**Metrics:** %d classes, %d methods, %d namespaces", "classes", "methods", "namespaces")
    return metrics.select(F.concat(F.lit("## Project Summary: "), "project", F.when(F.col("classes").isNotNull(), counts).otherwise("")).alias("summary"))


def _stages(spark: SparkSession, root: str, table: Callable[[str], DataFrame]) -> list[tuple[str, Callable[[], DataFrame]]]:
    name = root.rstrip("/").rsplit("/", 1)[-1]
    methods = lambda: table("methods").filter(F.col("method_name").isNotNull())

    def metrics() -> DataFrame:
        rows = table("methods").agg(F.count_distinct("type_name").alias("classes"), F.count("method_name").alias("methods"), F.count_distinct(F.nullif("namespace", F.lit(""))).alias("namespaces"))
        bad = table("quarantine").agg(F.count_distinct("path").alias("failed"))
        seen = table("files").agg(F.count("*").alias("files"))
        return rows.join(bad).join(seen).select(F.lit(name).alias("project"), F.col("files").alias("files_analyzed"), "failed", "classes", "methods", "namespaces")

    def nodes() -> DataFrame:
        types = table("methods").groupBy("type_name").agg(F.min(F.struct("path", "place")).alias("o"), F.first("namespace").alias("namespace"), F.max("class_name").alias("name"), F.count("method_name").alias("methods"))
        types = types.withColumn("ord", F.xxhash64("o.path", "o.place")).withColumnRenamed("type_name", "full_name").withColumns({"kind": F.lit("class"), "access": F.lit(""), "properties": F.lit(0)})
        return structure.knowledge_graph(types, relationships(table("methods")))[0].select("id", "label", "kind", F.to_json("properties").alias("properties"))

    def edges() -> DataFrame:
        types = table("methods").select("namespace", F.col("type_name").alias("full_name")).distinct().withColumns({"ord": F.lit(0), "name": F.col("full_name"), "kind": F.lit(""), "access": F.lit(""), "methods": F.lit(0), "properties": F.lit(0)})
        return structure.knowledge_graph(types, relationships(table("methods")))[1]

    return [
        ("files", lambda: files.contents(table("listing")).select("path", "mtime", files.language(F.col("path")).alias("language"), "text", "error")),
        ("methods", lambda: declared_methods(table("files").filter("error IS NULL"))),
        ("quarantine", lambda: table("files").filter("error IS NOT NULL").select("path", "error").unionByName(rules.not_analysed(methods()).join(methods().select("method_id", "path"), "method_id").select("path", "error"))),
        ("findings", lambda: rules.analyses(methods())), ("usage", lambda: rules.variable_usage(methods())), ("limits", lambda: limits.variable_limits(methods())), ("steps", lambda: flow.dispatched_steps(methods())), ("nodes", nodes), ("edges", edges), ("metrics", metrics),
    ]


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the run that goes by a tag, from any thread."""
    spark.sparkContext.cancelJobsWithTag(tag)


def analyze_project(spark: SparkSession, root: str, target: str, tag: str = "analyze-project", report: Callable[[str, int], None] | None = None) -> ProjectRun:
    """Analyse the source tree under root into tables under target, in a folder of its own for each state of the tree.

    Every stage is written before the next one reads it, so lost executors cost no more than a stage, and a run over the same
    paths and times goes on after the stages that are complete. report(stage, rows) hears of each stage as it ends. Files that can't be
    read and methods beyond the budget of matches are rows of `quarantine`; the others are analysed. A run stopped by cancel() ends
    with an error, not an exception, and leaves no table of the stage it was in; so does one that fails otherwise.
    """
    run = ProjectRun()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if not root or not root.strip() or not files._exists(spark, root):
        run.error = INVALID
        return run
    fs = hadoop(target).getFileSystem(spark._jsc.hadoopConfiguration())
    spark.sparkContext.addJobTag(tag)
    stage = None
    try:
        listing = files.listing(spark, root)
        state = listing.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "mtime").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0:
            run.error, run.no_source_files = EMPTY, True
            return run
        folder = f"{target}/{state.n}-{int(state.h) & 0xFFFFFFFFFFFFFFFF:016x}"

        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{folder}/{name}")

        for stage, build in [("listing", lambda: listing), *_stages(spark, root, table)]:
            path = f"{folder}/{stage}"
            if fs.exists(hadoop(f"{path}/_SUCCESS")):
                run.resumed.append(stage)
                run.counts[stage] = table(stage).count()
            else:
                seen = Observation(stage)
                build().observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
                run.counts[stage] = seen.get["rows"]
            run.tables[stage] = path
            if report:
                report(stage, run.counts[stage])
        run.success = True
    except Exception as e:  # a failed run is a result
        if stage and not fs.exists(hadoop(f"{folder}/{stage}/_SUCCESS")):
            fs.delete(hadoop(f"{folder}/{stage}"), True)
        run.error = CANCELED if "cancelled" in str(e).lower() else str(e)
    finally:
        spark.sparkContext.removeJobTag(tag)
    return run
