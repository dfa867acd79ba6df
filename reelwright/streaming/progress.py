"""Live progress: lines of a ripping tool, and a speed over the last ten samples kept as state per job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelwright.session import shared_dir

SAMPLES = 10


def parse_line(line: Column) -> Column:
    """struct<kind, current, total, top> of a progress line: PRGV and PRGC carry three numbers, PRGT none; others null."""
    number = lambda i: F.regexp_extract(line, r"^PRG[VC]:(\d+),(\d+),(\d+)", i).try_cast("bigint")
    top = F.when(number(3) == 0, F.lit(65536)).otherwise(number(3))
    return F.struct(F.regexp_extract(line, r"^(PRG[VCT]):", 1).alias("kind"), number(1).alias("current"), number(2).alias("total"), top.alias("top"))


def percent(current: Column, total: Column, title: Column, titles: Column) -> Column:
    """Whole percent of a job: of the current count if there is one, else by titles done; 100 at most."""
    share = F.when((total > 1) & (current > 0), current / total).otherwise((title + F.try_divide(current, total)) / titles)
    return F.least(F.lit(100), F.floor(100 * F.coalesce(share, F.lit(0.0)))).cast("int")


def speeds(events: DataFrame) -> DataFrame:
    """(user_id, event_id, speed): the mean of each job's last SAMPLES values up to a row, in order of time within what
    arrives together; the last values are kept as state between micro-batches."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        before = list(state.get[0]) if state.exists else []
        values = pd.Series(before + rows["value"].tolist())
        state.update((values.tolist()[-(SAMPLES - 1) :],))
        mean = values.rolling(SAMPLES, min_periods=1).mean().iloc[len(before) :]
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "speed": mean.round(6).to_numpy()})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_id long, speed double", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speeds of all events there are, through a streaming query that ends when it has read them."""
    out = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    batch = spark.read.parquet(path)
    # a streaming source reads folders; a single file is named by a pattern
    source = spark.readStream.schema(batch.schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))
    job = speeds(source).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema("user_id long, event_id long, speed double").parquet(f"{out}/rows")
