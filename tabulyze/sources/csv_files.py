"""CSV reading: encoding and line breaks are found out for each file."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DoubleType, NumericType, StringType, StructField, StructType

from tabulyze.functions.columns import require_rows


def probe_files(spark: SparkSession, path: str) -> dict[tuple[str, bool], list[str]]:
    """Files by (encoding, whether quoted cells run over lines), from one pass over the lines.

    A file is UTF-8 if every line decodes as such, else ISO-8859-1, which decodes any byte.
    A line with an odd number of quotes opens a cell that ends on another line; only such
    files are read in one piece.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    files = lines.groupBy("file_path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
                                           F.bool_or(quotes % 2 == 1).alias("broken")).collect()   # one row per file
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in sorted(files, key=lambda r: r["file_path"]):
        groups.setdefault(("UTF-8" if r["utf8"] else "ISO-8859-1", r["broken"]), []).append(unquote(r["file_path"]))
    return groups


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all files are, else ISO-8859-1."""
    return "ISO-8859-1" if any(e != "UTF-8" for e, _ in probe_files(spark, path)) else "UTF-8"


def _common(a: DataType, b: DataType) -> DataType:
    if a == b:
        return a
    return DoubleType() if isinstance(a, NumericType) and isinstance(b, NumericType) else StringType()


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             encoding: str | None = None) -> DataFrame:
    """A header CSV, or a folder of them, as a checked table. Without ``schema`` types are
    inferred in one extra pass, and files that differ get the type that fits all."""
    def reader(how: tuple[str, bool]):
        return (spark.read.option("header", True).option("escape", '"').option("encoding", encoding or how[0])
                .option("multiLine", how[1]))
    try:
        groups = probe_files(spark, path)
        if not groups:
            return require_rows(spark.read.option("header", True).csv(path))
        if schema is None:
            found = [reader(how).option("inferSchema", True).csv(files).schema for how, files in groups.items()]
            if any(s.names != found[0].names for s in found):
                raise ValueError(f"the files of {path!r} have different columns")
            schema = found[0]
            for other in found[1:]:
                schema = StructType([StructField(a.name, _common(a.dataType, b.dataType)) for a, b in zip(schema, other)])
        parts = [reader(how).schema(schema).csv(files) for how, files in groups.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return require_rows(out)
    except ValueError:
        raise
    except Exception as error:
        raise ValueError(f"cannot read {path!r} as CSV: {error}") from error


def preview(df: DataFrame, order: list[str], rows: int = 20) -> DataFrame:
    """The first rows by ``order``."""
    return df.orderBy(*order).limit(rows)
