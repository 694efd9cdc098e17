"""Proof gates: a result is its tables and a table of numbered tests, and is only released when all of them hold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GATES = "num int, name string, passed boolean, skipped boolean, difference decimal(18,2), detail string"


class GateFailure(Exception):
    """A gate failed and the result wasn't forced."""


@dataclass
class Result:
    tables: dict[str, DataFrame]
    gates: DataFrame
    status: dict[str, str] = field(default_factory=lambda: {"ok": "", "failed": "[DOES NOT TIE]"})

    def failed(self) -> list[str]:
        return [f"{r.num} {r.name}" for r in self.gates.where("not passed and not skipped").orderBy("num").collect()]  # one row a gate

    def require(self, force: bool = False) -> str:
        """The status of the result; raises where a gate failed and ``force`` is not set."""
        failed = self.failed()
        if failed and not force:
            raise GateFailure("; ".join(failed))
        return self.status["failed" if failed else "ok"]


def gates(spark: SparkSession, tests: list[tuple[str, DataFrame, Column | None, Column]]) -> DataFrame:
    """One row per (name, one-row table, difference, passed); a null ``passed`` is a test that was skipped."""
    out = spark.createDataFrame([], GATES)
    for num, (name, one, difference, passed) in enumerate(tests, 1):
        diff = difference if difference is not None else F.lit(None)
        out = out.unionAll(one.select(F.lit(num).alias("num"), F.lit(name).alias("name"), F.coalesce(passed, F.lit(True)).alias("passed"), passed.isNull().alias("skipped"), diff.cast("decimal(18,2)").alias("difference"), F.lit("").alias("detail")))
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, surplus): rows of either table the other lacks, as multisets."""
    return a.exceptAll(b).agg(F.count("*").alias("missing")).withColumn("surplus", b.exceptAll(a).agg(F.count("*")).scalar())
