"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.operators.graph import checkpoint, ensure_checkpoint_dir

#: Words are what stands between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def _letters(first: int, last: int) -> str:
    """Set of the letters (category L) within these code points, as ranges for Python's ``re``."""
    runs: list[list[str]] = []
    for c in filter(str.isalpha, map(chr, range(first, last + 1))):
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{a}-{b}" for a, b in runs) + "]"


#: Runs of letters for ``re``, whose word characters also have number signs such as ½. A set below U+10000 is looked up in a table; ranges
#: beyond are tried one by one for each character, so they are asked only about characters that are beyond.
LETTERS = rf"(?:{_letters(0, 0xFFFF)}+|(?![\0-\uFFFF]){_letters(0x10000, sys.maxunicode)}+)+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def sized_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df``, checkpointed and counted; marked for broadcast only if it has at most ``max_rows`` rows."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def hash32(value: Column) -> Column:
    """First 32 bits of the MD5, as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to a new folder below the shared checkpoint folder and read back: lineage cut, columns prunable."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
