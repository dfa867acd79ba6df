"""What several operators share: tables in the shared folder, and loading of tokenizer files."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space of the word patterns, as it stands in a literal of Spark SQL: words are the maximal runs of other characters.
SPACE = " \\u0009\\u000A\\u000B\\u000C\\u000D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one of a local session;
    on a cluster that is an error, as executors would write where nobody else reads."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = at.get()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="reelwright-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: it survives lost executors and cuts the lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables. Only for tables that nothing reads any more: all that was made of them has been stored."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a .json file, once per Python process, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (GPT-2's published rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]
