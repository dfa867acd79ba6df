"""What a DVD holds, from the three forms in which a reader prints it: JSON, XML and lines of text.

JSON and XML become VARIANT trees, so whatever attributes they have are kept and one way leads to titles and to rows of a
tree. Of each disc the first form that can be read counts, in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import scalars as S
from reelwright.session import stored

#: Fixed format of a line of text. Two blanks stand between length and chapters.
LINE = r"Title: (\d+), Length: ([\d:.]+)\s Chapters: (\d+), Cells: (\d+), Audio streams: (\d+), Subpictures: (\d+)"
TITLE = "struct<number: string, length: string, chapters: string, audio: array<map<string, string>>, subtitles: array<map<string, string>>, n_audio: int, n_subtitles: int, properties: map<string, string>>"


def _readable_xml(xml: str) -> Column:
    """Whether a text is one well-formed element."""
    probe = F.from_xml(xml, "none string, broken string", {"columnNameOfCorruptRecord": "broken"})
    return F.col(xml).rlike(r"^\s*<") & probe["broken"].isNull()


def trees(forms: DataFrame) -> DataFrame:
    """(disc, mode, tree, lines) of forms (disc, json, xml, text): mode `JSON` or `XML` with a tree, `Text Fallback` with the
    lines that name titles, or null if no form can be read. Blank forms can't."""
    full = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    df = forms.select("disc", *[full(c).alias(c) for c in ("json", "xml", "text")]).withColumn("parsed", F.try_parse_json("json"))
    # the parser of XML trees fails on what is not well-formed, so that is asked first
    df = df.withColumn("whole", F.when(F.col("parsed").isNull() & _readable_xml("xml"), F.col("xml")))
    # generated code of from_xml to VARIANT doesn't compile; in a lambda it is called by itself, and the rest is compiled
    from_xml = F.expr("get(transform(array(whole), x -> from_xml(x, 'variant')), 0)")
    df = df.withColumn("tree", F.coalesce("parsed", F.when(F.col("whole").isNotNull(), from_xml)))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(LINE))
    df = df.withColumn("lines", F.when(F.col("parsed").isNull() & F.col("whole").isNull(), lines))
    mode = F.when(F.col("parsed").isNotNull(), "JSON").when(F.col("whole").isNotNull(), "XML").when(F.size("lines") > 0, "Text Fallback")
    return df.select("disc", mode.alias("mode"), "tree", F.when(F.size("lines") > 0, F.col("lines")).alias("lines"))


def _text(tree: str, *keys: str) -> Column:
    return F.coalesce(*[F.expr(f"try_variant_get({tree}, '$.{k}', 'string')") for k in keys])


def _many(tree: str, key: str, kind: str) -> Column:
    """The elements below a key, those of an array or the only one, each as kind, null where it isn't such a value."""
    get = lambda t: F.expr(f"try_variant_get({tree}, '$.{key}', '{t}')")
    return F.coalesce(get(f"array<{kind}>"), F.when(get("variant").isNotNull(), F.array(get(kind))), F.array().cast(f"array<{kind}>"))


def _attributes(key: str) -> Column:
    """The attributes of each stream below a title's key by name; `content` is the text of an element."""

    def named(k: Column) -> Column:
        return F.when(k == "_VALUE", "content").otherwise(F.regexp_replace(k, "^_", ""))

    content = lambda x: F.create_map(F.lit("content"), x)
    of_array = F.zip_with(F.col(f"streams.{key}"), F.try_element_at("lists", F.lit(key)), lambda m, x: F.coalesce(m, content(x)))
    only = F.when(F.map_contains_key("texts", key), F.array(F.coalesce(F.try_element_at("objects", F.lit(key)), content(F.try_element_at("texts", F.lit(key))))))
    streams = F.coalesce(of_array, only, F.array().cast("array<map<string,string>>"))
    return F.transform(streams, lambda m: F.transform_keys(m, lambda k, _: named(k)))


#: What a title's tree is read as: its values as text, those that are arrays, those that are objects, and streams' attributes.
PARTS = {"texts": "map<string,string>", "lists": "map<string,array<string>>", "objects": "map<string,map<string,string>>", "streams": "struct<audio: array<map<string,string>>, subp: array<map<string,string>>>"}


def titles(forms: DataFrame) -> DataFrame:
    """(disc, mode, device, number, length, chapters, audio, subtitles, n_audio, n_subtitles, properties), a row for each title
    of the first form that can be read; a disc without titles, or without any such form (mode null), has no row.

    audio and subtitles are the streams' attributes, null where a form only counts streams; properties has the other plain
    values of a title. Numbers of XML are read as numbers, so leading zeros are gone.
    """
    # trees and lines are exploded together: each disc is read once, and no filter repeats the parsing below it
    device = F.coalesce(_text("tree", "device", "_device"), F.lit("N/A"))
    found = trees(forms).select("disc", "mode", device.alias("device"), "lines", *[_many("tree", "track", kind).alias(part) for part, kind in PARTS.items()])
    fields = ", ".join(f"{part}: {kind}" for part, kind in PARTS.items())
    from_trees = F.arrays_zip(*PARTS, F.transform("texts", lambda _: F.lit(None).cast("string")).alias("line")).cast(f"array<struct<{fields}, line: string>>")
    from_lines = F.transform("lines", lambda x: F.struct(*[F.lit(None).cast(kind).alias(part) for part, kind in PARTS.items()], x.alias("line")))
    each = found.select("disc", "mode", "device", F.explode(F.when(F.col("lines").isNull(), from_trees).otherwise(from_lines)).alias("t")).select("disc", "mode", "device", "t.*")
    value = lambda k: F.try_element_at("texts", F.lit(k))
    # texts of arrays and objects begin like that, as those of strings may
    nested = lambda k, v: F.coalesce(v.rlike(r"^[\[{]"), F.lit(False)) & (F.try_element_at("lists", k).isNotNull() | F.try_element_at("objects", k).isNotNull())
    properties = F.map_filter("texts", lambda k, v: ~k.isin("ix", "_ix", "audio", "subp") & ~nested(k, v))
    n_chapters = F.coalesce(F.size(F.try_element_at("lists", F.lit("chapter"))), F.when(F.map_contains_key("texts", "chapter"), 1))
    part = lambda i: F.regexp_extract("line", LINE, i)
    in_line, no_streams = F.col("line").isNotNull(), F.lit(None).cast("array<map<string,string>>")
    of = each.select("disc", "mode", "device", F.when(in_line, part(1)).otherwise(F.coalesce(value("ix"), value("_ix"))).alias("number"), F.when(in_line, part(2)).otherwise(value("length")).alias("length"),
        F.when(in_line, part(3)).otherwise(F.coalesce(value("chapters"), F.when(n_chapters > 0, n_chapters.cast("string")))).alias("chapters"),
        F.when(in_line, no_streams).otherwise(_attributes("audio")).alias("audio"), F.when(in_line, no_streams).otherwise(_attributes("subp")).alias("subtitles"),
        F.when(in_line, F.create_map(F.lit("cells"), part(4))).otherwise(properties).alias("properties"), F.when(in_line, part(5).cast("int")).alias("a"), F.when(in_line, part(6).cast("int")).alias("s"))
    return of.select("disc", "mode", "device", "number", "length", "chapters", "audio", "subtitles", F.coalesce("a", F.size("audio")).alias("n_audio"), F.coalesce("s", F.size("subtitles")).alias("n_subtitles"), "properties")


def pretty(key: Column) -> Column:
    """A key as a label: underscores are blanks, every word begins with a capital."""
    return S.title_case(F.replace(key, F.lit("_"), F.lit(" ")))


def tree_rows(trees: DataFrame, key: str = "disc", tree: str = "tree") -> DataFrame:
    """(key, path, depth, label, value): a row for each entry of a VARIANT tree, value null for those with entries of their own.
    path orders the rows of a tree. Entries of an object are in order of their keys; the elements of an array stand in its
    place, as entries beside each other. Trees are gone down level by level, all at once, as deep as the deepest is."""
    spark, kind = trees.sparkSession, trees.schema[key].dataType.simpleString()
    # sizes of what is an array or an object, else null; what is in them is not gone through
    size = lambda t: F.size(F.try_variant_get("v", "$", f"{t}boolean>"))
    level = trees.filter(F.col(tree).isNotNull()).select(F.col(key).alias("above"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.lit("").alias("label"), F.col(tree).alias("v"))
    out: list[DataFrame] = []
    while True:
        # entries of objects, and elements (without a key) of arrays under the array's own label
        entries = level.withColumnRenamed("v", "whole").lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        entries = entries.select("above", F.concat("path", F.array("pos")).alias("path"), "depth", F.when(F.col("key").isNull(), F.col("label")).otherwise(pretty(F.col("key"))).alias("label"), F.col("key").isNull().alias("element"), F.col("value").alias("v"))
        both = entries.withColumns({"listed": size("array<"), "named": size("map<string,")}).withColumn("filled", F.coalesce("listed", "named", F.lit(0)) > 0)
        value = F.when(~F.col("filled"), F.when(F.col("named") == 0, "{}").when(F.col("listed") == 0, "[]").otherwise(F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("None"))))
        both = stored(both.select("above", "path", "depth", "label", "element", "filled", F.col("named").isNotNull().alias("is_object"), value.alias("value"), F.when(F.col("filled"), F.col("v")).alias("v")), "tree-level")
        # arrays, and objects that are elements, have no row of their own
        own = both.filter("NOT filled OR is_object AND NOT element")
        out.append(own.select(F.col("above").alias("key"), "path", "depth", "label", "value"))
        below = both.filter("filled")
        if not below.head(1):
            break
        level = below.select("above", "path", (F.col("depth") + F.expr("is_object AND NOT element").cast("int")).alias("depth"), "label", "v")
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows.select(F.col("key").cast(kind).alias(key), "path", "depth", "label", "value")


def tree_text(rows: DataFrame, key: str = "disc") -> DataFrame:
    """(key, text): the rows of a tree as lines, indented by two blanks a level. A tree meets in one row."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "label", F.when(F.col("value").isNull() | (F.col("value") == ""), ":").otherwise(F.concat(F.lit(": "), "value")))
    lines = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))).alias("x"))
    return lines.select(key, F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))
