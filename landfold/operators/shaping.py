"""Canonical shape of map features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_features(df: DataFrame, default_color: str = "#cccccc") -> DataFrame:
    """Hidden features keep their geometry but lose name and interaction; a colour that is no hex code is replaced."""
    return df.withColumns({
        "name": F.when(~F.col("hidden"), F.trim("name")),
        "interactive": ~F.col("hidden") & ~F.col("background"),
        "color": F.when(F.col("color").rlike("^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), F.col("color")).otherwise(default_color),
    })
