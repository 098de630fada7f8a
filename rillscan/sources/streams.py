"""Streams of characters, words and tokens from tables and files: (stream_id, pos, token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stripped_texts(docs: DataFrame, strip_newlines: bool = True) -> DataFrame:
    """(stream_id, text): a character stream for each document, without line breaks unless they are to stay."""
    text = F.regexp_replace("text", r"[\r\n]", "") if strip_newlines else F.col("text")
    return docs.select(F.col("doc_id").alias("stream_id"), text.alias("text")).where("text is not null")


def characters(docs: DataFrame, strip_newlines: bool = True) -> DataFrame:
    """One row for each character; positions count from 0 in each stream."""
    texts = stripped_texts(docs, strip_newlines)
    return texts.select("stream_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), 0)).alias("at", "token")).select("stream_id", F.col("at").cast("long").alias("pos"), "token")


def words(docs: DataFrame) -> DataFrame:
    """One row for each word between white space."""
    texts = docs.where("text is not null").select(F.col("doc_id").alias("stream_id"), F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), 0).alias("found"))
    return texts.select("stream_id", F.posexplode("found").alias("at", "token")).select("stream_id", F.col("at").cast("long").alias("pos"), "token")


def segments(docs: DataFrame, delimiter: str = "\n") -> DataFrame:
    """One row for each non-empty segment, a carriage return at its end removed."""
    parts = F.filter(F.transform(F.split("text", delimiter, -1), lambda s: F.regexp_replace(s, "\r$", "")), lambda s: F.length(s) > 0)
    return docs.where("text is not null").select(F.col("doc_id").alias("stream_id"), F.posexplode(parts).alias("at", "token")).select("stream_id", F.col("at").cast("long").alias("pos"), "token")


def event_tokens(events: DataFrame) -> DataFrame:
    """Event types as a stream for each user, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.where("event_type is not null").select(F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("event_type").alias("token"))


def first(stream: DataFrame, limit: int) -> DataFrame:
    """The first tokens of every stream; by position, so the answer is always the same."""
    return stream.where(F.col("pos") < limit)


def read_lines(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """(path, line): lines of text files, split at newlines only, carriage returns dropped. strip drops blank lines and edge blanks."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("path"), F.replace("value", F.lit("\r"), F.lit("")).alias("line"))
    return lines.select("path", F.trim("line").alias("line")).where("line <> ''") if strip else lines


def read_segments(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """(path, token): non-empty segments of all files of a path, a carriage return at their ends removed; the last one needs no delimiter."""
    found = spark.read.option("lineSep", delimiter).text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r$", "").alias("token"))
    return found.where("token <> ''")


def natural(name: Column) -> list[Column]:
    """Sort keys under which names that are numbers come by value, others by text behind them."""
    number = F.when(name.rlike(r"^[+-]?\d{1,9}$"), name.cast("int"))
    return [number.isNull(), number, name]


def datasets(paths: DataFrame) -> DataFrame:
    """(dataset, path, at): folders of the files in paths(path), numbered in natural order, with their first ``.txt`` file by name."""
    named = paths.where(F.col("path").endswith(".txt")).select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("dataset"), "path")
    first = named.groupBy("dataset").agg(F.min("path").alias("path"))
    return first.select("dataset", "path", F.row_number().over(Window.orderBy(*natural(F.col("dataset")))).cast("long").alias("at"))


def workload_files(paths: DataFrame, kind: str | None = None) -> DataFrame:
    """paths(path) with what a pattern file's name says: pattern length and kind, as in ``10.rare.txt``, and its place in natural order."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    known = paths.withColumns({"length": F.regexp_extract(name, r"^(\d+)\.", 1).try_cast("int"), "kind": F.regexp_extract(name, r"^\d+\.(\w+)\.txt$", 1)})
    some = known.where(F.col("kind") == kind) if kind else known
    return some.withColumn("at", F.row_number().over(Window.orderBy(F.col("length").isNull(), "length", name)).cast("long"))


def workload(patterns: DataFrame, least: int = 1, lengths: tuple[int, int] | None = None) -> DataFrame:
    """(pid, m): patterns(pid, pattern) of at least ``least`` characters, and inside the lengths if given."""
    m = F.length("pattern").cast("long")
    kept = patterns.select("pid", m.alias("m")).where(F.col("m") >= least)
    return kept.where(F.col("m").between(*lengths)) if lengths else kept


def perf_counters(spark: SparkSession, path: str) -> DataFrame:
    """(path, time, value, event) of counter files: ``time,value,unit,event,..`` or ``time,value,event``; lines without a number are left out."""
    cells = F.split("value", ",")
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), cells.alias("c"))
    event = F.when(F.get("c", F.lit(3)) != "", F.get("c", F.lit(3))).otherwise(F.get("c", F.lit(2)))
    number = F.get("c", F.lit(1))
    return lines.where(number.rlike(r"^-?[0-9]+(\.[0-9]+)?$")).select("path", F.trim(F.get("c", F.lit(0))).try_cast("double").alias("time"), number.cast("double").alias("value"), event.alias("event"))


def csv_line(columns: list[str]):
    """A quoted CSV line: quotes doubled, null as an empty field."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *cells)


def write_csv(df: DataFrame, path: str, append: bool = False, delimiter: str = ",", quote: str = '"', quote_all: bool = True, charset: str = "UTF-8", line_end: str = "\n", header: bool = True) -> None:
    """A CSV folder; quotes inside fields are doubled, null is an empty field. append adds to what is there, as for results of one run after another."""
    options = {"header": header, "sep": delimiter, "quote": quote, "escape": quote, "quoteAll": quote_all, "nullValue": "", "emptyValue": quote * 2 if quote_all else "", "encoding": charset, "lineSep": line_end}
    df.write.mode("append" if append else "overwrite").options(**options).csv(path)


def write_lines(df: DataFrame, path: str, line: str = "line", append: bool = True) -> None:
    """A folder of text lines, as a log of runs."""
    df.select(F.col(line).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)
