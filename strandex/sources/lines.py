"""Corpora of strings: numbered lines, validity, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id that count a partition's rows.
_ROW_BITS = 33


def is_valid(line: Column) -> Column:
    """A line counts if it has only printable ASCII and is not all blanks."""
    return F.coalesce(line.rlike(r"^[ -~]+\z") & (F.trim(line) != ""), F.lit(False))


def number_rows(df: DataFrame, name: str = "line_no") -> DataFrame:
    """Adds dense row numbers from 0 in the order of partitions and of the rows in them.

    One light pass counts each partition's rows; the counts, one for each partition, give each its first number.
    """
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    pid = F.shiftright("__id", _ROW_BITS)
    counts = {r["p"]: r["n"] for r in marked.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect()}
    firsts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        firsts.append(total)
        total += counts.get(p, 0)
    if not firsts:
        return df.withColumn(name, F.lit(0).cast("long"))
    first = F.get(F.array(*(F.lit(f).cast("long") for f in firsts)), pid.cast("int"))
    return marked.withColumn(name, first + F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__id")


def read_lines(spark: SparkSession, path: str | list[str], delimiter: str | bytes = "\n", recursive: bool = False) -> DataFrame:
    """(line_no, line) of text files, records ended by a delimiter; an empty last record is no record.

    The delimiter is one character, or one byte, which may be one that is no text by itself, such as 0xFF.
    """
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).options(**_ends(delimiter)).text(path)
    return number_rows(text).select("line_no", F.col("value").alias("line"))


def write_lines(lines: DataFrame, path: str, delimiter: str | bytes = "\n") -> None:
    """Write (line_no, line) as text files in the order of line_no, each record ended by the delimiter."""
    lines.orderBy("line_no").select(F.col("line").alias("value")).write.mode("overwrite").options(**_ends(delimiter)).text(path)


def _ends(delimiter: str | bytes) -> dict[str, str]:
    """Options of the text source; the encoding is that of the record's end alone."""
    return {"lineSep": delimiter.decode("latin-1"), "encoding": "ISO-8859-1"} if isinstance(delimiter, bytes) else {"lineSep": delimiter}


def from_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(line_no, line) of a table: the key is the order."""
    return df.select(df[key].cast("long").alias("line_no"), df[text].alias("line"))


def split_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos, line): lines of each text."""
    return df.select(df[key].cast("long").alias("doc"), F.posexplode(F.split(df[text], "\n", -1)).alias("pos", "line")).select("doc", F.col("pos").cast("long").alias("pos"), "line")


def valid_lines(lines: DataFrame) -> DataFrame:
    """The lines that count; order and duplicates stay."""
    return lines.where(is_valid(F.col("line")))


def skipped_lines(lines: DataFrame, within: str = "doc", order: str = "pos") -> DataFrame:
    """The lines that don't count, with `reported`, one more than the accepted lines before it in its document."""
    accepted = F.sum(is_valid(F.col("line")).cast("long")).over(Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("reported", accepted + 1).where(~is_valid(F.col("line")))


#: Bits of a composed component number that count the components of a line.
COMPONENT_BITS = 24


def numbered_components(lines: DataFrame, delimiters: str) -> DataFrame:
    """(line_no, line): components as lines of their own, numbered line_no << COMPONENT_BITS | pos; a line of more stops the job."""
    fits = F.assert_true(F.col("pos") < (1 << COMPONENT_BITS), F.lit("a line has too many components"))
    number = F.shiftleft("line_no", COMPONENT_BITS) + F.col("pos")
    return components(lines, delimiters).select(F.when(fits.isNull(), number).alias("line_no"), F.col("token").alias("line"))


def components(lines: DataFrame, delimiters: str) -> DataFrame:
    """(line_no, pos, token): what stands between any of the delimiter characters; empty tokens are dropped."""
    cls = "[" + "".join("\\" + c if c in "[]^-\\&" else c for c in delimiters) + "]"  # a backslash before a letter would name a class
    tokens = F.filter(F.split("line", cls), lambda t: t != "")
    return lines.select("line_no", F.posexplode(tokens).alias("pos", "token")).select("line_no", F.col("pos").cast("long").alias("pos"), "token")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pat): one pattern a line, empty lines and duplicates dropped."""
    return spark.read.text(path).select(F.col("value").alias("pat")).where("pat <> ''").distinct()


def read_length_prefixed(spark: SparkSession, path: str) -> DataFrame:
    """(pat): patterns of a binary file, each after its length in two bytes, high byte first. A file is one row's work."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = []
            for value in b.column(0):
                data, at = value.as_py(), 0
                while at + 2 <= len(data):
                    n = int.from_bytes(data[at : at + 2], "big")
                    found.append(data[at + 2 : at + 2 + n].decode("latin-1"))
                    at += 2 + n
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["pat"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pat string")
