"""Files to DataFrames and back.  Paths are any the cluster's file systems understand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.functions.numbers import nan_to_null

NULL_TEXT = "\\N"


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "UTF-8", null: str = NULL_TEXT
) -> DataFrame:
    """CSV with a header row.  With a schema nothing is inferred; without one a pass infers it."""
    reader = spark.read.options(header=True, encoding=encoding, nullValue=null, mode="PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON dataset, one record per line."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_parquet(frame: DataFrame, path: str) -> str:
    frame.write.mode("overwrite").parquet(path)
    return path


def write_csv(frame: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """A folder ``<table>.csv`` of part files, which ``register_csv_folder`` takes as one table."""
    frame.write.mode("overwrite").options(header=True, nullValue=NULL_TEXT, encoding=encoding).csv(path)
    return path


def write_records(frame: DataFrame, path: str) -> str:
    """One JSON record per line."""
    frame.write.mode("overwrite").json(path)
    return path


def csv_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name -> path of each CSV file, or folder of CSV parts, directly below ``folder``.

    The name is the text before the first dot.  One level of the folder is listed through its file system, and
    one of each entry that is a folder named like a CSV file; trees below other folders are never looked at.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    entries = [entry for entry in store.listStatus(root) if _is_csv(entry)]
    tables = [
        entry.getPath().getName()
        for entry in entries
        if entry.isFile() or any(part.isFile() and _is_csv(part) for part in store.listStatus(entry.getPath()))
    ]
    return {name.partition(".")[0]: f"{folder.rstrip('/')}/{name}" for name in sorted(tables)}


def _is_csv(entry) -> bool:
    name = entry.getPath().getName()
    return name.endswith(".csv") and name[0] not in "._"


def register_csv_folder(
    spark: SparkSession, folder: str, schemas: dict[str, StructType | str] | None = None
) -> dict[str, DataFrame]:
    """One temporary view per CSV below ``folder``, replacing a view of the same name."""
    tables = {}
    for name, path in csv_tables(spark, folder).items():
        tables[name] = read_csv(spark, path, (schemas or {}).get(name))
        tables[name].createOrReplaceTempView(name)
    return tables


# How a value of each type looks, narrowest first.
WHOLE = r"^[+-]?\d+$"
LOOKS = {
    "int": WHOLE,
    "bigint": WHOLE,
    "double": r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Inf(inity)?)$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}[T ]",
    "boolean": r"^(?i:true|false)$",
}
# A field of a line: quoted with doubled or escaped quotes inside, or plain up to the next comma.
FIELD = r"""(?:^|,)("(?:[^"\\]|\\.|"")*"|[^,]*)"""


def _kind(value: Column) -> Column:
    """The narrowest type that a value can be read as."""
    kind = F.lit("string")
    for name, looks in reversed(LOOKS.items()):
        kind = F.when(value.rlike(looks) & value.try_cast(name).isNotNull(), name).otherwise(kind)
    return kind


def schema_profile(spark: SparkSession, folder: str, sampling_ratio: float = 1.0) -> DataFrame:
    """Inferred column types of every CSV below ``folder``, all found in one job; bad values do not stop it.

    Every value gets the narrowest type that it can be read as.  Types are counted per file and column, the first
    line of each file, which has the names, is taken off again, and what is left joins in a lattice: whole numbers
    widen to doubles, dates to timestamps, and anything else that differs is text, as is a column without values.
    A value does not go over the end of its line.  Every row counts unless ``sampling_ratio`` asks for a part.
    """
    tables = csv_tables(spark, folder)
    if not tables:
        return spark.createDataFrame([], "table_name STRING, position INT, column_name STRING, data_type STRING")
    lines = spark.read.options(pathGlobFilter="*.csv").text(list(tables.values())).filter("trim(value) != ''").select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"),
        (F.rand(0) < sampling_ratio if sampling_ratio < 1 else F.lit(True)).alias("counted"),
        F.col("value").alias("text"),
    )
    fields = lines.select("file", "line", "counted", F.posexplode(F.regexp_extract_all("text", F.lit(FIELD), F.lit(1))).alias("place", "field"))
    inner = F.regexp_replace(F.expr("substring(field, 2, length(field) - 2)"), r'\\(.)|"(")', "$1$2")
    value = F.when(F.col("field").startswith('"'), inner).otherwise(F.col("field"))
    absent = ~F.col("counted") | F.col("value").isin("", NULL_TEXT)
    values = fields.withColumn("value", value).withColumn("kind", F.when(~absent, _kind(F.col("value"))))
    kinds = [*LOOKS, "string"]
    per_file = values.groupBy("file", "place").agg(
        F.min_by(F.struct("value", "kind", "line"), "line").alias("first"),
        *[F.count_if(F.col("kind") == name).alias(name) for name in kinds],
    )
    # Columns that the first line of a file does not name are left out.
    start = F.min("first.line").over(Window.partitionBy("file"))
    named = per_file.withColumn("start", start).filter(F.col("first.line") == F.col("start"))
    entry = F.url_decode(F.regexp_extract("file", r"/([^/]*\.csv)(?:/[^/]*)?$", 1))
    heading = lambda name: F.when(F.col("first.kind") == name, 1).otherwise(0)
    found = named.groupBy(F.substring_index(entry, ".", 1).alias("table_name"), "place").agg(
        F.min_by("first.value", "file").alias("column_name"),
        *[(F.sum(F.col(name) - heading(name)) > 0).alias(name) for name in kinds],
    )
    joined = """CASE WHEN `string` OR NOT (`int` OR `bigint` OR `double` OR `date` OR `timestamp` OR `boolean`) THEN 'string'
        WHEN `boolean` THEN CASE WHEN `int` OR `bigint` OR `double` OR `date` OR `timestamp` THEN 'string' ELSE 'boolean' END
        WHEN `date` OR `timestamp` THEN CASE WHEN `int` OR `bigint` OR `double` THEN 'string' WHEN `timestamp` THEN 'timestamp' ELSE 'date' END
        WHEN `double` THEN 'double' WHEN `bigint` THEN 'bigint' ELSE 'int' END"""
    return found.selectExpr("table_name", "place + 1 AS position", "column_name", f"{joined} AS data_type")
