"""The fit and transform contract: state is a set of keyed tables, and a transform never sees labels.

A plan has `fit(history, labels, config) -> FittedState` and `transform(rows, state, config) -> DataFrame`. Rows carry
`row_id`; labels are a table (row_id, label) of their own.
"""

from __future__ import annotations

import inspect
import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class FittedState:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    scalars: dict[str, Any] = field(default_factory=dict)

    def save(self, spark: SparkSession, folder: str) -> None:
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        text = json.dumps({"tables": sorted(self.tables), "scalars": self.scalars})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state.json")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FittedState:
        found = json.loads(spark.read.text(f"{folder}/state.json").first()["value"])
        return cls({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in found["tables"]}, found["scalars"])


def without_label(df: DataFrame, label: str) -> DataFrame:
    return df.drop(label)


def run_plan(plan: Any, df: DataFrame, row_id: str, label: str, config: dict[str, Any] | None = None, fit_split: str = "train") -> tuple[DataFrame, FittedState]:
    """Fits on one split and transforms all rows without their label.

    Labels pass the transform sealed: in a struct under a new name each time, which no rule for numbers or texts takes up. So rows
    keep their label without a join; only for a transform that drops unknown columns the label is joined back by row id. A `fit`
    that takes `both` gets the training rows with their labels, which it would else join itself.
    """
    config, sealed = config or {}, f"sealed_{uuid.uuid4().hex}"
    both = df.where(F.col("split") == fit_split)
    history, labels = both.drop(label), both.select(row_id, label)
    more = {"both": both.withColumnRenamed(label, "label")} if "both" in inspect.signature(plan.fit).parameters else {}
    state = plan.fit(history, labels, config, **more)
    made = plan.transform(df.withColumn(sealed, F.struct(F.col(label).alias("label"))).drop(label), state, config)
    if sealed in made.columns:
        return made.withColumn(label, F.col(sealed)["label"]).drop(sealed), state
    return made.join(df.select(F.col(row_id).alias("lb_id"), label), F.col(row_id) == F.col("lb_id")).drop("lb_id"), state


def with_timeout(spark: SparkSession, seconds: float, run: Callable[[], Any]) -> Any:
    """Runs jobs under a group that a timer cancels; raises TimeoutError if it did."""
    group, over = f"timeout-{threading.get_ident()}-{id(run)}", threading.Event()
    spark.sparkContext.setJobGroup(group, "with a time limit", interruptOnCancel=True)

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return run()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
