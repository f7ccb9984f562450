"""Step markers of the daily runs of a warehouse: an append-only log, one small JSON file
for each finished step, committed whole or not at all by Spark's writer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesoro.sources.literal import literal_frame

_LOG = "run_id string, step string, rows long, at timestamp"
_STEP = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("step", T.StringType()),
                      T.StructField("rows", T.LongType())])


class RunLog:
    """The log of a warehouse, as far as it was when read, and a run that adds to it."""

    def __init__(self, spark: SparkSession, warehouse: str, run_id: str):
        self.spark, self.path, self.run_id = spark, f"{warehouse}/run_log", run_id
        self.done = {(r["run_id"], r["step"]): r["rows"] for r in _entries(spark, self.path).collect()}

    def has(self, step: str, run_id: str | None = None) -> bool:
        return (run_id or self.run_id, step) in self.done

    def rows(self, prefix: str) -> dict[str, int]:
        """Row counts of this run's steps ``prefix:NAME``."""
        return {s[len(prefix) + 1:]: n for (run, s), n in self.done.items() if run == self.run_id and s.startswith(f"{prefix}:")}

    def open_loads(self) -> list[str]:
        """Other runs whose load is staged but not in Bronze."""
        return sorted(run for run, step in self.done
                      if step == "staged" and run != self.run_id and not self.has("bronze", run))

    def add(self, *steps: str | tuple[str, int], run_id: str | None = None) -> None:
        rows = [(run_id or self.run_id, *(s if isinstance(s, tuple) else (s, None))) for s in steps]
        (literal_frame(self.spark, rows, _STEP).withColumn("at", F.current_timestamp())
         .coalesce(1).write.mode("append").json(self.path))
        self.done.update({(run, step): n for run, step, n in rows})


def _entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LOG).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return literal_frame(spark, [], T.StructType.fromDDL(_LOG))


def published_run(spark: SparkSession, warehouse: str) -> str | None:
    """The run that finished last: the one that readers use."""
    last = (_entries(spark, f"{warehouse.rstrip('/')}/run_log").where("step = 'published'")
            .agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id")).first())
    return last["run_id"]
