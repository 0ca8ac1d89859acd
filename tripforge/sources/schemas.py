"""Schemas of many Parquet files: footers read in tasks, merged as an aggregate, one scan for each schema.

The driver knows the files' names, as it must to scan them, and one row for each column and type; it opens no file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contracts import ContractError

#: Files a task reads footers of, and schemes whose files tasks open themselves, to read no more than the footer.
FILES_A_TASK, OPENED = 50, ("file", "hdfs", "s3", "s3a", "gs")
_ROW = "org.apache.spark.sql.parquet.row.metadata"
_COLUMNS = "number long, path string, rows long, columns array<struct<name:string,type:string>>"


def _columns_of(file) -> tuple[int, list[dict]]:
    """Rows of a Parquet file, and its columns as Spark would read them: the schema that Spark left in the footer, or that of the file's own types."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    footer = pq.ParquetFile(file)
    said = (footer.metadata.metadata or {}).get(_ROW.encode())
    schema = StructType.fromJson(json.loads(said)) if said else from_arrow_schema(footer.schema_arrow, prefer_timestamp_ntz=True)
    return footer.metadata.num_rows, [{"name": f.name, "type": f.dataType.simpleString()} for f in schema]


def _row(number: int, path: str, file) -> dict:
    rows, columns = _columns_of(file)
    return {"number": number, "path": path, "rows": rows, "columns": columns}


def _opened(frames):
    import pandas as pd
    from pyarrow import fs

    for frame in frames:
        found = []
        for number, path in zip(frame["number"], frame["path"], strict=True):
            place, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else "file://" + path.removeprefix("file:"))
            with place.open_input_file(inner) as file:
                found.append(_row(number, path, file))
        yield pd.DataFrame(found)


def _loaded(frames):
    import pandas as pd
    import pyarrow as pa

    for frame in frames:
        yield pd.DataFrame([_row(n, p, pa.BufferReader(c)) for n, p, c in zip(frame["number"], frame["path"], frame["content"], strict=True)])


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a file: ``number`` (its place among the paths), ``path``, ``rows`` and ``columns``, read from the footer in a task.

    Files of a store that only Spark reads come whole through its reader of binary files.
    """
    if not paths:
        raise FileNotFoundError("no files")
    listed = spark.createDataFrame(list(enumerate(paths)), "number long, path string")
    if all(p.split("://", 1)[0] in OPENED if "://" in p else p.startswith(("/", "file:")) for p in paths):
        tasks = -(-len(paths) // FILES_A_TASK)
        return listed.repartitionByRange(tasks, "number").mapInPandas(_opened, _COLUMNS)
    full = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = {p: full(p).getFileSystem(conf).makeQualified(full(p)).toString() for p in paths}
    listed = spark.createDataFrame([(n, p, names[p]) for n, p in enumerate(paths)], "number long, path string, full string")
    content = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("full"), "content")
    return listed.join(content, "full").select("number", "path", "content").mapInPandas(_loaded, _COLUMNS)


def describe_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a file and column: path, its rows, the column's place, name and type."""
    columns = footers(spark, paths).select("number", "path", "rows", F.posexplode("columns").alias("place", "column"))
    return columns.select("number", "path", "rows", "place", F.col("column.name").alias("column"), F.col("column.type").alias("dtype"))


def schema_groups(found: DataFrame) -> list[tuple[list[tuple[str, str]], list[str]]]:
    """The schemas of ``footers``, by their first file, each with the paths of its files in order."""
    groups = found.groupBy("columns").agg(F.min("number").alias("first"), F.sort_array(F.collect_list(F.struct("number", "path"))).alias("files"))
    return [([(c.name, c.type) for c in g.columns], [f.path for f in g.files]) for g in groups.orderBy("first").toLocalIterator()]


def merged_columns(groups: list[tuple[list[tuple[str, str]], list[str]]]) -> dict[str, str]:
    """Columns of all schemas, as they first appear, with a type that holds the values of each."""
    from .io import common_type

    kinds: dict[str, set] = {}
    for columns, _ in groups:
        for name, kind in columns:
            kinds.setdefault(name, set()).add(kind)
    return {name: common_type(k) for name, k in kinds.items()}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files united by name, with one scan for each schema among them."""
    groups = schema_groups(footers(spark, paths))
    types = merged_columns(groups)
    out = None
    for columns, files in groups:
        kinds = dict(columns)
        rows = spark.read.schema(", ".join(f"{_quoted(n)} {k}" for n, k in columns)).parquet(*files)
        wide = [(F.col(_quoted(n)).cast(t) if n in kinds else F.lit(None).cast(t)).alias(n) for n, t in types.items()]
        out = rows.select(*wide) if out is None else out.unionAll(rows.select(*wide))
    return out


def read_same(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files that must all have the columns and types of the first."""
    groups = schema_groups(footers(spark, paths))
    if len(groups) > 1:
        raise ContractError(f"{groups[1][1][0]} differs from {paths[0]}")
    columns, files = groups[0]
    return spark.read.schema(", ".join(f"{_quoted(n)} {k}" for n, k in columns)).parquet(*files)
