"""CSV tables whose first, unnamed column is the row index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(
    spark: SparkSession,
    path: str,
    features: Sequence[str],
    id_col: str = "id",
    id_type: str = "string",
) -> DataFrame:
    """The index column under the name ``id_col`` and the feature columns as doubles.

    The columns of the file are those of ``features``, in that order; a file whose
    header says otherwise is refused rather than read by position.
    """
    schema = T.StructType.fromDDL(f"`{id_col}` {id_type}")
    for name in features:
        schema = schema.add(name, "double")
    header = spark.read.csv(path, header=True, inferSchema=False).columns[1:]
    if header != list(features):
        raise ValueError(f"the file has the columns {header}, not {list(features)}")
    # The index has no name in the header, so the names are checked above.
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="FAILFAST")
