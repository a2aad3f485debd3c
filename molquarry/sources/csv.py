"""CSV in and out: every field a string on the way in, descriptors rendered on the way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", split: bool = False) -> DataFrame:
    """A CSV file with a header, as strings; quoted fields may hold delimiters, quotes and line ends.

    ``split`` promises that no field holds a line end: then a large file is read by many tasks. A file without
    a header has no columns.
    """
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=not split, escape='"', sep=delimiter, enforceSchema=False).na.fill("")


def read_smiles_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file of one SMILES per line."""
    return spark.read.text(path).withColumnRenamed("value", "smiles")


def smiles_column(df: DataFrame, wanted: str = "SMILES") -> str:
    """The column with a name, in any case, or at an index."""
    if wanted.isdigit() and int(wanted) < len(df.columns):
        return df.columns[int(wanted)]
    found = [c for c in df.columns if c.lower() == wanted.lower()]
    if not found:
        raise ValueError(f"no column {wanted!r} among {df.columns}")
    return found[0]


def rendered(column: Column, kind: T.DataType, error: str = "NA_Error", longest: int = 500) -> Column:
    """A cell of the output: four decimals, NA, INF, -INF; null is an error, long text is cut."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        value = column.cast("double")
        text = F.when(value.isNull(), None).when(F.isnan(value), "NA").when(value == float("inf"), "INF").when(value == float("-inf"), "-INF").otherwise(F.format_string("%.4f", value))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: rendered(x, kind.elementType, error)), ","), F.lit("]"))
    else:
        text = column.cast("string")
        text = F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)
    return F.coalesce(text, F.lit(error))


def write_csv(df: DataFrame, path: str, descriptors: list[str], delimiter: str = ",") -> None:
    """Input columns as they are, descriptors rendered; quotes are doubled."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [rendered(F.col(f"`{c}`"), kinds[c]).alias(c) if c in descriptors else F.col(f"`{c}`") for c in df.columns]
    df.select(*cells).write.mode("overwrite").csv(path, header=True, escape='"', quote='"', sep=delimiter, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
