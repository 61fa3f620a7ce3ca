"""Sources: event streams, CSV scans, document folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallywatch.schema import CSV_COLUMNS, CSV_TEXT, CSV_TYPED, TRANSACTION_EVENT

def kafka_events(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None,
                 fail_on_data_loss: bool = True) -> DataFrame:
    """Raw event stream of a topic; needs the Kafka package on the class path. ``max_offsets`` bounds a micro-batch."""
    source = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", "earliest").option("failOnDataLoss", str(fail_on_data_loss).lower()))
    if max_offsets is not None:
        source = source.option("maxOffsetsPerTrigger", max_offsets)
    return source.load().select("key", "value", "topic", "partition", "offset", "timestamp")


def file_events(spark: SparkSession, path: str, schema: T.StructType, **options: object) -> DataFrame:
    """The same role as a topic, from a folder of parquet files."""
    reader = spark.readStream.schema(schema)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(path)


def parse_events(raw: DataFrame, schema: T.StructType = TRANSACTION_EVENT) -> DataFrame:
    """JSON value to typed columns. Malformed text gives a row of nulls."""
    kinds = {"topic": "string", "partition": "int", "offset": "long", "timestamp": "timestamp", "key": "string"}
    body = F.from_json(F.col("value").cast("string"), schema)
    origin = [F.col(name).cast(kind).alias(f"kafka_{name}") for name, kind in kinds.items() if name in raw.columns]
    return raw.select(body.alias("event"), *origin).select("event.*", *[f"kafka_{n}" for n in kinds if n in raw.columns])


def event_order(partition: str = "kafka_partition", offset: str = "kafka_offset") -> Column:
    """One integer that orders rows by partition, then offset (offsets below 2**48)."""
    return F.shiftleft(F.col(partition).cast("long"), 48) + F.col(offset)


def read_csv(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    """CSV scan with a declared schema; malformed lines are dropped, nothing is inferred.

    Which lines count as malformed depends on the columns that are read; ``csv_lines`` numbers and rejects lines exactly."""
    return (spark.read.schema(CSV_TEXT if as_text else CSV_TYPED).option("header", True)
            .option("mode", "DROPMALFORMED").csv(path))


def with_file_ordinal(df: DataFrame, name: str = "source_row_id") -> DataFrame:
    """0-based row number in file order: file name, then position in the file.

    Each file split numbers its own rows; split sizes then give the offsets. A
    split is bounded by ``spark.sql.files.maxPartitionBytes``.
    """
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    marked = df.select("*", split.alias("_split")).withColumn("_local", F.monotonically_increasing_id())
    within = F.row_number().over(Window.partitionBy("_split").orderBy("_local")) - 1
    sizes = marked.groupBy("_split").agg(F.count("*").alias("_size"))
    # One row per file split in this window, not per data row.
    before = Window.partitionBy(F.lit(0)).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_split", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (marked.withColumn("_within", within).join(offsets, "_split")
            .withColumn(name, F.col("_within") + F.col("_offset")).drop("_split", "_local", "_within", "_offset"))


def csv_lines(spark: SparkSession, path: str, columns: int = len(CSV_COLUMNS)) -> DataFrame:
    """Every line of the files below its header: file, line_number (from 1, header included), line, source_row_id, reject.

    A line of more than ``columns`` fields is a reject ("too many fields"), one that ends inside quotes too ("open quote"),
    a blank line as well ("blank"). All others are rows; shorter ones lack their last fields. ``source_row_id`` counts the rows
    from 0 through all files in the order of their names and is null for rejects. A field cannot hold a line break.

    Lines are counted per file split before they are parsed, so the numbers do not depend on the columns that are read.
    """
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    raw = spark.read.text(path).select(split.alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    plain = F.when(F.contains("line", F.lit('"')), F.regexp_replace("line", '"[^"]*"', "")).otherwise(F.col("line"))
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(","))) + 1
    reject = (F.when(F.trim("line") == "", "blank").when(F.contains(plain, F.lit('"')), "open quote")
              .when(fields > columns, "too many fields"))
    within = Window.partitionBy("split").orderBy("place")
    header = (F.col("split.start") == 0) & (F.col("number") == 1)
    rows = raw.withColumns({"reject": reject, "number": F.row_number().over(within)}).withColumn("header", header)
    kept = (F.col("reject").isNull() & ~F.col("header")).cast("long")
    rows = rows.withColumn("rank", F.sum(kept).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    # One row per file split in these windows, not per line.
    sizes = rows.groupBy("split").agg(F.count("*").alias("lines"), F.sum(kept).alias("kept"))
    before = Window.partitionBy(F.lit(0)).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("split.path").orderBy("split.start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("split", F.coalesce(F.sum("kept").over(before), F.lit(0)).alias("rows_before"),
                         F.coalesce(F.sum("lines").over(in_file), F.lit(0)).alias("lines_before"))
    ordinal = F.when(F.col("reject").isNull(), F.col("rank") + F.col("rows_before"))
    return rows.where("NOT header").join(sizes, "split").select(
        F.col("split.path").alias("file"), (F.col("number") + F.col("lines_before")).alias("line_number"), "line",
        ordinal.alias("source_row_id"), "reject")


def csv_rows(lines: DataFrame, as_text: bool = False) -> DataFrame:
    """source_row_id and the columns of the lines that are rows. Missing fields are null; a value that does not fit its type too."""
    parsed = F.from_csv("line", (CSV_TEXT if as_text else CSV_TYPED).simpleString()[len("struct<"):-1].replace(":", " "), {"mode": "PERMISSIVE"})
    return lines.where("reject IS NULL").select("source_row_id", parsed.alias("row")).select("source_row_id", "row.*")


def first_rows(df: DataFrame, n: int, ordinal: str = "source_row_id") -> DataFrame:
    """The first n rows of the scan by file position."""
    return df.where(F.col(ordinal) < n)


def to_events(df: DataFrame, source: str = "paysim", batch_id: str | None = None, sequence: str | None = None) -> DataFrame:
    """CSV or hand-entered rows to wire events; given ids and times are kept."""

    def given(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")

    step = F.col("step").cast("int")
    event_step = F.nullif(F.col("event_step").cast("int"), F.lit(0)) if "event_step" in df.columns else F.lit(None)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    columns = {
        "transaction_id": F.coalesce(given("transaction_id"), F.concat(F.lit("TXN-"), F.uuid())),
        "event_time": F.coalesce(given("event_time"), now), "source": F.lit(source),
        "batch_id": F.lit(batch_id).cast("string"),
        "producer_sequence": (F.col(sequence) if sequence else F.lit(None)).cast("int"),
        "step": step, "event_step": F.coalesce(event_step, step), "type": F.col("type").cast("string"),
        "amount": F.col("amount").cast("double"), "nameOrig": F.col("nameOrig").cast("string"),
        "oldbalanceOrg": F.col("oldbalanceOrg").cast("double"), "newbalanceOrig": F.col("newbalanceOrig").cast("double"),
        "nameDest": F.col("nameDest").cast("string"), "oldbalanceDest": F.col("oldbalanceDest").cast("double"),
        "newbalanceDest": F.col("newbalanceDest").cast("double"),
    }
    for label in ("isFraud", "isFlaggedFraud"):
        columns[label] = (F.col(label) if label in df.columns else F.lit(None)).cast("int")
    return df.select(*[c.alias(n) for n, c in columns.items()])


def read_documents(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Text files below a folder: relative_path and text. Bad UTF-8 is replaced, not refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    plain = root.rstrip("/").split("://", 1)[-1].split(":", 1)[-1]
    relative = F.substring_index(F.col("path"), plain + "/", -1)
    return files.select(relative.alias("relative_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
