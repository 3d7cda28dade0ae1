"""Readers for logs, inventories and event queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.jsontree import records_of
from ..session import cut_lineage, small_side


def read_json_lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """Explodes texts (one file or one line per row) into JSON records.

    A text may be one object, an array, or an object with a single key that holds the
    records. Text that is no JSON as a whole is read line by line; lines that are no JSON
    are what ``rejected_lines`` returns.
    """
    good = F.filter(_lines(column), lambda x: F.try_parse_json(x).isNotNull())
    whole = texts.withColumn("_records", records_of(column))
    return whole.withColumn("raw", F.explode(F.coalesce("_records", good))).drop("_records")


def _lines(column: str) -> Column:
    """Trimmed lines of a text that are not empty."""
    return F.filter(F.transform(F.split(column, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def rejected_lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """The lines that ``read_json_lines`` leaves out, as ``line`` with ``line_number`` and the text's other columns."""
    numbered = F.transform(F.split(column, "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), (i + 1).alias("line_number")))
    bad = F.filter(numbered, lambda x: (x["line"] != "") & F.try_parse_json(x["line"]).isNull())
    broken = texts.where(F.col(column).isNotNull() & records_of(column).isNull())
    return broken.select(*[c for c in texts.columns if c != column], F.inline(bad))


def json_quality(texts: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Good and bad texts per key."""
    ok = F.try_parse_json(column).isNotNull()
    return texts.groupBy(*keys).agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


def read_json_files(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """JSON lines (or one JSON text per file) from a folder, with the source file."""
    texts = spark.read.text(path, wholetext=whole).withColumn("file", F.input_file_name())
    return read_json_lines(texts)


_INSIDE = r'[^"]*+(?:""[^"]*+)*+'  # what can follow an opening quote
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|(?!")[^,]*+),)*+'
OPENS = rf'(?s)^{_FIELDS}"{_INSIDE}\z'  # a line begun outside quotes ends inside
STAYS = rf'(?s)^{_INSIDE}(?:\z|"[^,]*+,{_FIELDS}"{_INSIDE}\z)'  # a line begun inside quotes ends inside


def numbered_records(lines: DataFrame) -> DataFrame:
    """CSV records of files cut into blocks, with the line each begins on: (file, line, value, header).

    ``lines`` has file, block (a number that rises in the file), place (rises in the block)
    and value. Counts and quote states per block are summed in the order of the blocks, so
    no task holds more than a block. A line maps the state before it (outside or
    inside quotes) to the one after it: it sets the state, keeps it or turns it; the state
    at any line is the last one set, turned as often as lines since then turn it. A record
    whose quote is never closed reaches to the end of its file. ``header`` is the line of a file's first record.
    """
    at = Window.partitionBy("file", "block").orderBy("place")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    until = at.rowsBetween(Window.unboundedPreceding, 0)
    value = F.regexp_replace("value", "^\ufeff", "")
    opens, stays = F.col("value").rlike(OPENS), F.col("value").rlike(STAYS)
    rows = (lines.withColumn("value", value).withColumns({"opens": opens.cast("int"), "stays": stays.cast("int")})
            .withColumn("turns", (F.col("opens") > F.col("stays")).cast("int"))
            .withColumns({"n": F.row_number().over(at), "turned": F.coalesce(F.sum("turns").over(before), F.lit(0))}))
    sets = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("to"), F.col("turned").alias("turned")))
    rows = cut_lineage(rows.withColumn("set", F.last(sets, ignorenulls=True).over(before)).withColumn("sets", sets))

    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(
        F.count("*").alias("n_lines"), F.sum("turns").alias("turns"), F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("n"))).alias("s"))
    leaves = F.when(F.col("s").isNotNull(), (F.col("s.to") + F.col("turns") - F.col("s.turned")) % 2)
    blocks = blocks.withColumn("leaves", leaves).withColumn("turned", F.coalesce(
        F.sum(F.when(F.col("leaves").isNull(), F.col("turns")).otherwise(0)).over(earlier), F.lit(0)))
    last_set = F.last(F.when(F.col("leaves").isNotNull(), F.struct("leaves", "turned")), ignorenulls=True).over(earlier)
    blocks = blocks.withColumns({"lines_before": F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)), "_set": last_set})
    blocks = small_side(blocks.select("file", "block", "lines_before", (F.coalesce(
        F.col("_set.leaves") + F.col("turned") - F.col("_set.turned"), F.col("turned")) % 2).alias("state")))

    inside = F.coalesce(F.col("set.to") + F.col("turned") - F.col("set.turned"), F.col("state") + F.col("turned")) % 2 == 1
    rows = rows.join(blocks, ["file", "block"]).select("file", "block", "place", "value", (F.col("n") + F.col("lines_before")).alias("n"),
                                                       inside.alias("inside"))
    rows = rows.withColumn("line", F.last(F.when(~F.col("inside"), F.col("n")), ignorenulls=True).over(until))
    begun = rows.groupBy("file", "block").agg(
        F.max("line").alias("line"), F.min(F.when(~F.col("inside") & (F.trim("value") != ""), F.col("n"))).alias("header"))
    begun = small_side(begun.select("file", "block", F.max("line").over(earlier).alias("carried"),
                                    F.min("header").over(Window.partitionBy("file")).alias("header")))
    rows = rows.join(begun, ["file", "block"]).withColumn("line", F.coalesce("line", "carried"))
    listed = F.array_sort(F.collect_list(F.struct("n", "value")))
    return rows.groupBy("file", "line").agg(F.first("header").alias("header"), F.array_join(
        F.transform(listed, lambda x: x["value"]), "\n").alias("value"))


def read_inventory(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """CSV inventory with header; a byte-order mark and all-empty rows are dropped.

    Quotes inside quotes are doubled, a backslash is text. ``row_number`` is the line of its file a row begins on (header is 1), whatever the number
    of files and splits and of line ends inside quotes; ``source`` names a column for the
    file. All files have the columns of the first.
    """
    columns = [c.lstrip("\ufeff") for c in spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"').columns]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    records = numbered_records(lines).where((F.col("line") > F.col("header")) & (F.trim("value") != ""))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = records.withColumn("_fields", F.from_csv("value", schema, {"escape": '"'}))
    own = [F.col("line").alias("row_number"), *([F.col("file").alias(source)] if source else [])]
    fields = [F.col("_fields").getField(c) for c in columns]
    return parsed.where(F.coalesce(*fields).isNotNull()).select(*[f.alias(c) for f, c in zip(fields, columns)], *own)


def queue_stream(spark: SparkSession, path: str, schema: str, max_files: int = 10) -> DataFrame:
    """Event queue as a stream of JSON text files; records that do not parse are left to ``queue_rejects``."""
    texts = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parse_queue(texts, schema)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, per_batch: int = 1_000_000) -> DataFrame:
    """Event queue from Kafka (needs the Kafka connector on the class path)."""
    texts = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
             .option("maxOffsetsPerTrigger", per_batch).load().select(F.col("value").cast("string").alias("value")))
    return parse_queue(texts, schema)


def parse_queue(texts: DataFrame, schema: str) -> DataFrame:
    event = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return texts.where(F.try_parse_json("value").isNotNull()).select(event.alias("e")).select("e.*")


def queue_rejects(texts: DataFrame) -> DataFrame:
    """Queue records that do not parse, as they came; works on tables and streams."""
    return texts.where(F.col("value").isNull() | F.try_parse_json("value").isNull())
