"""What a disc is, from the lines of its protocol: label, attributes, protection, file systems, number of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attributes of a disc by their codes.
ATTRIBUTES = {1: "type", 2: "label", 3: "language_code", 4: "language_name", 6: "comment", 32: "volume_name"}
# Bits of protection.
PROTECTIONS = {"aacs": 4, "bdplus": 8, "bus_encryption": 2}
# File systems by words of a line in capitals; of several in one line the last one here counts.
SYSTEMS = {"DVD": ("VIDEO_TS", "DVD"), "Blu-ray": ("BDMV", "BLU-RAY", "BLURAY"), "HD-DVD": ("HDDVD", "HD-DVD")}


def _holds(line: Column, *words: str) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(F.upper(line), F.lit(word))
    return out


def facts(lines: DataFrame, disc: str = "disc", order: str = "n", line: str = "line") -> DataFrame:
    """A row per disc, in one aggregation over its lines:

    - found_label: the quoted text of the first CINFO:2 line whose numbers are whole, null if there is none;
    - the ATTRIBUTES: of CINFO:code,id,flags,"value" lines the value that comes last, null if there is none;
    - aacs, bdplus, bus_encryption: a bit of a CINFO line's flags, or (the first two) their name in any line; raw_flags:
      the last flags other than zero, null if there are none;
    - has_dvd, has_bluray, has_hddvd, has_aacs_files: by words in any line; has_bdsvm_files is never told; disc_type:
      the system that a line names last, else Unknown;
    - titles: the number of the first TCOUNT line that can be read, else that of different titles of TINFO lines.

    Lines whose numbers can't be read and null lines say nothing. Lines of equal order are taken by their text; a null
    disc is a disc like any other; other columns are ignored; no lines give no rows.
    """
    at, text = F.struct(F.col(f"`{order}`"), F.col(f"`{line}`")), F.col(f"`{line}`")
    parts = F.split(text, ",", 4)
    part = lambda i: F.get(parts, F.lit(i))
    head = F.get(F.split(text, ":"), F.lit(1))
    code = F.when(text.startswith("CINFO:"), F.get(F.split(part(0), ":"), F.lit(1)).try_cast("bigint"))
    flags = F.when(code.isNotNull(), F.nullif(part(2).try_cast("bigint"), F.lit(0).cast("bigint")))
    label = F.nullif(F.regexp_extract(text, r'CINFO:2,[0-9]+,[0-9]+,"([^"]+)"', 1), F.lit(""))
    count = F.when(text.startswith("TCOUNT:"), head.try_cast("int"))
    title = F.when(text.startswith("TINFO:"), F.substring_index(head, ",", 1).try_cast("bigint"))
    system = F.lit(None).cast("string")
    for name, words in SYSTEMS.items():
        system = F.when(_holds(text, *words), name).otherwise(system)
    rows = lines.select(
        F.col(f"`{disc}`").alias("disc_"), at.alias("at"), F.when(F.size(parts) == 4, code).alias("code"), F.trim(part(3), F.lit('"')).alias("value"),
        flags.alias("flags"), label.alias("label_"), count.alias("count_"), title.alias("title_"), system.alias("system"),
        _holds(text, "AACS").alias("told_aacs"), _holds(text, "BD+", "BDPLUS").alias("told_bdplus"),
        *[_holds(text, *words).alias(f"on_{k}") for k, words in enumerate(SYSTEMS.values())],
    )
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    bit = lambda name: F.coalesce(F.col("flags").bitwiseAND(F.lit(PROTECTIONS[name])) != 0, F.lit(False))
    found = rows.groupBy("disc_").agg(
        F.min_by("label_", F.when(F.col("label_").isNotNull(), F.col("at"))).alias("found_label"),
        *[F.max_by("value", F.when(F.col("code") == k, F.col("at"))).alias(name) for k, name in ATTRIBUTES.items()],
        some(bit("aacs") | F.col("told_aacs")).alias("aacs"), some(bit("bdplus") | F.col("told_bdplus")).alias("bdplus"), some(bit("bus_encryption")).alias("bus_encryption"),
        F.max_by("flags", F.when(F.col("flags").isNotNull(), F.col("at"))).alias("raw_flags"),
        some("on_0").alias("has_dvd"), some("on_1").alias("has_bluray"), some("on_2").alias("has_hddvd"), some("told_aacs").alias("has_aacs_files"),
        F.lit(False).alias("has_bdsvm_files"), F.coalesce(F.max_by("system", F.when(F.col("system").isNotNull(), F.col("at"))), F.lit("Unknown")).alias("disc_type"),
        F.coalesce(F.min_by("count_", F.when(F.col("count_").isNotNull(), F.col("at"))).cast("bigint"), F.count_distinct("title_")).alias("titles"),
    )
    return found.withColumnRenamed("disc_", disc)
