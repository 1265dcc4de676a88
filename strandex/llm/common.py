"""What several operators of this subpackage share: where intermediate tables go, and how a text is cut into words."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
SPACE = r"[\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: operators deal rows out by it and never by a constant of their own."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session that names none (as in tests) gets a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="strandex-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, which may hold dots and backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
