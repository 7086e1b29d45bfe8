"""What a plan or an event log uses: operators, functions and types, with a verdict and times."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Physical operators by the part of the catalogue that covers them.
OPERATORS = {
    "scan": ("Scan", "FileScan", "BatchScan", "LocalTableScan", "InMemoryTableScan", "Range", "RDDScan", "ExistingRDD", "ColumnarToRow"),
    "project": ("Project", "Filter", "Coalesce", "Generate", "Sample"),
    "join": ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct"),
    "aggregate": ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "Expand"),
    "window": ("Window", "WindowGroupLimit"),
    "order": ("Sort", "TakeOrderedAndProject", "GlobalLimit", "LocalLimit", "CollectLimit", "CollectTail"),
    "exchange": ("Exchange", "BroadcastExchange", "ReusedExchange", "AQEShuffleRead", "ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"),
    "set": ("Union",),
    "write": ("Execute", "WriteFiles"),
    "plan": ("AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter", "Subquery", "ReusedSubquery", "SubqueryBroadcast", "SubqueryAdaptiveBroadcast"),
    "python": ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas"),
}
GROUP = {o: g for g, os in OPERATORS.items() for o in os}
#: The name of a node at the start of a line of a plan's text.
_NAME = r"^[\s:+\-|*()\d]*([A-Z]\w*)"
#: How an exchange deals its rows; written like calls in a plan's text, but no functions.
DEALT = {"hashpartitioning", "rangepartitioning", "roundrobinpartitioning", "identitypartitioning", "singlepartition"}
_NODE = re.compile(_NAME)
_CALL = re.compile(r"\b([a-z_][a-z0-9_]*)\(")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(text: str) -> list[tuple[str, str, bool]]:
    """(operator, group, covered) of each node of a plan's text."""
    names = [m[1] for line in text.splitlines() if (m := _NODE.match(line)) and not line.startswith("==")]
    return [(n, GROUP.get(n, "other"), n in GROUP) for n in names]


def functions(text: str) -> list[str]:
    """Functions that a plan calls, without the parts of aggregation."""
    return sorted({f.removeprefix("partial_").removeprefix("merge_") for f in _CALL.findall(text) if f not in DEALT})


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``kind, name, covered, times`` of a frame's physical plan: operators, functions and column types."""
    text = plan_text(df)
    known = {r.function for r in spark.sql("SHOW FUNCTIONS").collect()}
    rows = [("operator", n, ok) for n, _, ok in operators(text)] + [("function", f, f in known) for f in functions(text)] + [("type", t, True) for _, t in df.dtypes]
    return spark.createDataFrame(rows, "kind string, name string, covered boolean").groupBy("kind", "name", "covered").agg(F.count("*").alias("times"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Per SQL execution of Spark event logs: id, description, plan, start, end, ms. Plain files, or compressed ones that the Hadoop at hand can read."""
    raw = spark.read.schema("Event string, executionId long, description string, physicalPlanDescription string, time long").json(path)
    kind = F.substring_index("Event", ".", -1)
    start = raw.filter(kind == "SparkListenerSQLExecutionStart").select("executionId", "description", F.col("physicalPlanDescription").alias("plan"), F.col("time").alias("start"))
    end = raw.filter(kind == "SparkListenerSQLExecutionEnd").groupBy("executionId").agg(F.max("time").alias("end"))
    return start.join(end, "executionId", "left").withColumn("ms", F.col("end") - F.col("start"))


def log_report(spark: SparkSession, path: str) -> DataFrame:
    """``name, group, covered, executions, times, ms`` of each physical operator in event logs: the executions that use it, its nodes, and those executions' time.

    A plan's initial form, which adaptive execution lists after the final one, is left out.
    """
    plan = F.split_part(F.split_part("plan", F.lit("== Initial Plan =="), F.lit(1)), F.lit("\n\n"), F.lit(1))
    lines = event_log(spark, path).select("executionId", "ms", F.explode(F.split(plan, "\n")).alias("line")).filter("line not like '==%'")
    nodes = lines.select("executionId", "ms", F.regexp_extract("line", _NAME, 1).alias("name")).filter("name <> ''")
    each = nodes.groupBy("name", "executionId").agg(F.count("*").alias("times"), F.max("ms").alias("ms"))
    group = F.coalesce(*[F.when(F.col("name").isin(*names), g) for g, names in OPERATORS.items()], F.lit("other"))
    out = each.groupBy("name").agg(F.count("*").alias("executions"), F.sum("times").alias("times"), F.sum("ms").alias("ms"))
    return out.select("name", group.alias("group"), (group != "other").alias("covered"), "executions", "times", "ms")
