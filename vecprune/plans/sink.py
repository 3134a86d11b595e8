"""The score file: one text line a query, fields separated by semicolons."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scores(lines: DataFrame, path: str) -> None:
    """Write (value) rows in one file, replacing what is there. The text sink quotes nothing, unlike the CSV sink.

    The rows are gathered by a shuffle, so that what makes them still runs in many tasks.
    """
    lines.repartition(1).write.mode("overwrite").text(path)
