"""JSON-lines sources and sinks over Spark text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.functions.text import strip
from mooring.schemas import METRIC_RECORD, RAW_GENERATION
from mooring.sources import files

RAW_LINE = "_line"


#: Appended rows of a folder lie in subfolders of this name and a number, after whatever lies in it directly.
BATCH = "batch-"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: ``_late`` (appended?), ``_file``, ``_offset`` of the split, ``_at`` growing within a split."""
    f = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("value").alias(RAW_LINE), f.rlike(rf"/{BATCH}\d+/[^/]+$").alias("_late"), f.alias("_file"), F.col("_metadata.file_block_start").alias("_offset"), F.monotonically_increasing_id().alias("_at"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, row_no, _line`` of the lines that aren't blank.

    ``line_no`` numbers all physical lines from 0, ``row_no`` those not blank; files
    count in the order of their names, appended batches last. Text files carry no
    row index, so one pass counts both kinds of lines in each split, and a second
    adds the start of its split to a line's place in it: ids grow along the lines
    of a split, before and after blank ones are dropped. All in the JVM; broadcast
    is a row of four numbers a split, so a million splits (128 TB of text) are 50 MB.
    """
    placed = _placed(spark, path)
    full = strip(F.col(RAW_LINE)) != ""
    split = ["_late", "_file", "_offset"]
    counts = placed.groupBy(*split).agg(F.min("_at").alias("first"), F.count("*").alias("n"), F.count_if(full).alias("full"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    # splits read by one task follow each other there in the order of their first ids
    task = Window.partitionBy(F.shiftright("first", 33)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    first_row = F.shiftleft(F.shiftright("first", 33), 33) + earlier("full", task)
    starts = counts.select(F.xxhash64("_file").alias("_h"), F.col("_offset").alias("_o"), (earlier("n", before) - F.col("first")).alias("_to_line"), (earlier("full", before) - first_row).alias("_to_row"))
    kept = placed.where(full).withColumn("_row", F.monotonically_increasing_id())
    j = kept.join(F.broadcast(starts), (F.xxhash64("_file") == F.col("_h")) & (F.col("_offset") == F.col("_o")))
    return j.select((F.col("_at") + F.col("_to_line")).alias("line_no"), (F.col("_row") + F.col("_to_row")).alias("row_no"), RAW_LINE)


def parse_lines(lines: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Non-blank lines parsed by ``schema``; the raw line stays as ``_line``.

    ``strict``: a line that is no JSON object fails the job, naming the line;
    otherwise it is left out.
    """
    full = T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())])
    df = lines.where(strip(F.col(RAW_LINE)) != "").withColumn("_j", F.from_json(RAW_LINE, full, {"columnNameOfCorruptRecord": "_corrupt_record", "allowNonNumericNumbers": "true"}))
    bad = F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull()
    if strict:
        where = F.col("line_no").cast("string") if "line_no" in lines.columns else F.lit("?")
        df = df.where(F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid JSON in line "), where, F.lit(": "), F.left(F.col(RAW_LINE), F.lit(80)))).cast("boolean")))
    else:
        df = df.where(~bad)
    return df.select(*lines.columns, *[F.col(f"_j.{f.name}").alias(f.name) for f in schema])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, numbered: bool = False, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file or folder, appended batches too, blank lines skipped."""
    lines = numbered_lines(spark, path) if numbered else spark.read.option("recursiveFileLookup", "true").text(path).withColumnRenamed("value", RAW_LINE)
    return parse_lines(lines, schema, strict)


def metric_files(spark: SparkSession, path: str) -> list[str]:
    """A file itself, or a folder's ``metrics_rank*.jsonl``, else all its ``*.jsonl``, by name."""
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    if files.is_file(spark, path):
        return [path]
    return [f"{path}/{n}" for n in files.names(spark, path, "metrics_rank*.jsonl") or files.names(spark, path, "*.jsonl")]


def read_metric_records(spark: SparkSession, path: str, schema: T.StructType = METRIC_RECORD) -> DataFrame:
    """Metric records of :func:`metric_files`. No row is an error. NaN and infinities are numbers."""
    found = metric_files(spark, path)
    df = spark.read.schema(schema).option("allowNonNumericNumbers", "true").json(found) if found else None
    if df is None or df.isEmpty():
        raise FileNotFoundError(f"no metric records in {path}")
    return df


def read_any_records(spark: SparkSession, path: str, text: Sequence[str] = ()) -> DataFrame:
    """Records of a file, or of every ``*.jsonl`` of a folder, with whatever fields they have.

    Every field is a column: DOUBLE if a record has a number there (text beside
    numbers is null then), else text, as are those named in ``text``. Fields are
    found by one pass over the records' keys; as many come back as there are columns.
    """
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    found = [path] if files.is_file(spark, path) else [f"{path}/{n}" for n in files.names(spark, path, "*.jsonl")]
    if not found:
        raise FileNotFoundError(f"no records in {path}")
    rows = spark.read.text(found).where(strip(F.col("value")) != "").select(F.from_json("value", "map<string,string>").alias("m"))
    number = r"^\s*(-?(\d+(\.\d+)?([eE][+-]?\d+)?|Infinity)|NaN)\s*$"
    seen = rows.select(F.explode("m").alias("name", "value")).where("value is not null").groupBy("name").agg(F.some(F.col("value").rlike(number)).alias("number"))
    fields = sorted((r.name, r.number) for r in seen.collect())
    schema = T.StructType([T.StructField(n, T.DoubleType() if is_number and n not in text else T.StringType()) for n, is_number in fields])
    return spark.read.schema(schema).option("allowNonNumericNumbers", "true").json(found)


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Resume state: the last raw row of each (row_idx, method); empty if nothing is there.

    Last is by file name and place in it, and appended batches come after the rest,
    in the order they were appended in, whatever their sizes.
    """
    from mooring.operators.generation import latest

    if not files.exists(spark, path):
        return spark.createDataFrame([], RAW_GENERATION)
    rows = parse_lines(_placed(spark, path), RAW_GENERATION).withColumn("_order", F.struct("_late", "_file", "_offset", "_at"))
    return latest(rows, "_order").select(*RAW_GENERATION.fieldNames())


def to_lines(df: DataFrame, columns: Sequence[str] | None = None, keep_nulls: bool = True) -> DataFrame:
    """One JSON text a row; nulls are written unless told otherwise."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false" if keep_nulls else "true"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", columns: Sequence[str] | None = None) -> int:
    """Writes a folder of JSON-lines parts and returns the number of rows, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    to_lines(df, columns).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).text(path)
    return int(seen.get["n"])


def append_jsonl(df: DataFrame, path: str) -> int:
    """Appends rows as the next batch of the folder ``path`` and returns their number.

    The batch is written beside the others and named when it is whole, so a failed
    attempt leaves nothing behind that is read. One writer at a time.
    """
    spark = df.sparkSession
    taken = [int(n[len(BATCH) :]) for n in files.names(spark, path, f"{BATCH}*") if n[len(BATCH) :].isdigit()]
    name = f"{BATCH}{max(taken, default=-1) + 1:08d}"
    n = write_jsonl(df, f"{path}/_{name}")
    files.rename(spark, f"{path}/_{name}", f"{path}/{name}")
    return n


def write_raw(df: DataFrame, path: str) -> None:
    """Writes the untouched input lines that :func:`read_jsonl` kept."""
    df.select(F.col(RAW_LINE).alias("value")).write.mode("overwrite").text(path)


def beside(path: str, suffix: str) -> str:
    """``path`` with its last suffix replaced, the default place of what goes with an output."""
    head, slash, tail = path.rpartition("/")
    return f"{head}{slash}{tail.rsplit('.', 1)[0]}.{suffix}"
