"""Sinks. Spark's commit protocol makes each write whole or absent; nothing here writes by itself."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import answer_block


def write_csv(rows: DataFrame, path: str, decimals: int = 6) -> None:
    """Numbers with a fixed number of decimals, partitioned by user."""
    cols = [F.format_string(f"%.{decimals}f", F.bround(c, decimals)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*cols).write.partitionBy("user_id").csv(path, header=True, mode="overwrite")


def write_parquet(rows: DataFrame, path: str, by: str | None = "user_id") -> None:
    w = rows.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_answers(answers: DataFrame, path: str) -> None:
    answers.select(answer_block().alias("value")).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, most: int = 1_000) -> str:
    """A small table (at most `most` rows, else an error) as Markdown."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(map(text, r)) + " |" for r in found)])


def save_model(model, path: str, weights: list[float], use_time: bool, n_features: int, **more) -> None:
    """A fitted pipeline, and beside it what prediction needs to know and what else is to be kept."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"weights": weights, "use_time": use_time, "n_features": n_features, **more}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str):
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about").first()["value"])
    return PipelineModel.load(f"{path}/model"), about
