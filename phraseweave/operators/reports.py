"""Results as lines of text, one for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(c: str) -> Column:
    return F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.3f", F.col(c)))


def type_report(best: DataFrame) -> DataFrame:
    """(p, line) of rows p, subject_type, object_type, mean_weight."""
    return best.select("p", F.concat_ws(" | ", "p", "subject_type", "object_type", _share("mean_weight")).alias("line"))


def evaluation_report(rows: DataFrame) -> DataFrame:
    """(p, line) of rows p, known, right, wrong, precision, recall, f."""
    numbers = [F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in ("known", "right", "wrong")]
    shares = [F.concat(F.lit(f"{name}: "), _share(name)) for name in ("precision", "recall", "f")]
    return rows.select("p", F.concat_ws(" ", "p", *numbers, *shares).alias("line"))


def occurrence_report(occurrences: DataFrame) -> DataFrame:
    """Each distinct (s, p, o, sentence_id) once, in order."""
    return occurrences.select("s", "p", "o", "sentence_id").distinct().orderBy("s", "p", "o", "sentence_id")
