"""Tables of paths: which files are videos, what a disc's root is, and where discs lie in a tree of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of videos, of images of discs, of pictures, and the folders that a disc has.
VIDEOS = ("mkv", "mp4", "m4v", "mov", "avi", "ts", "m2ts", "mts", "webm", "wmv", "flv", "mpg")
DISC_IMAGES, PICTURES, DISC_FOLDERS = ("iso", "img", "bin", "nrg"), ("jpg", "jpeg", "png", "webp"), ("VIDEO_TS", "BDMV")


def extension(path: Column | str) -> Column:
    """Lower-case extension of the last part of a path, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def listed(texts: DataFrame, text: str = "text") -> DataFrame:
    """(n, path) of what a user typed: paths between semicolons or line ends, trimmed, without empty ones."""
    parts = texts.select(F.posexplode(F.split(text, "[;\\n]")).alias("n", "path"))
    return parts.select("n", F.trim("path").alias("path")).filter("path <> ''")


def videos(paths: DataFrame, extensions: tuple[str, ...] = VIDEOS, named: str | None = None) -> DataFrame:
    """(n, path) of the paths with one of the extensions, each once, at its first place n. Rows where the column `named` is
    true were named as files, and count whatever their extension."""
    wanted = extension("path").isin(*extensions)
    wanted = wanted | F.coalesce(F.col(named), F.lit(False)) if named else wanted
    return paths.filter(wanted).groupBy("path").agg(F.min("n").alias("n")).select("n", "path")


def pictures(paths: DataFrame, most: int = 0) -> DataFrame:
    """The paths of pictures by name, up to `most` of them if that is above 0."""
    found = paths.filter(extension("path").isin(*PICTURES)).orderBy(name("path"), "path")
    return found.limit(most) if most > 0 else found


def source_spec(path: Column | str) -> Column:
    """What a ripping tool takes: an image of a disc as iso:, anything else as file:."""
    return F.concat(F.when(extension(path).isin(*DISC_IMAGES), "iso:").otherwise("file:"), path)


def _folders(files: DataFrame) -> DataFrame:
    """(root, folder, depth, child, inside) of files (root, path below it): every folder above a file with its child on the
    way to it, and whether that is a folder. The root's own folder is empty."""
    parts = files.select("root", F.split("path", "/").alias("p"))
    at = parts.select("root", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("depth"))
    return at.select("root", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("folder"), "depth", F.get("p", F.col("depth")).alias("child"), (F.col("depth") < F.size("p") - 1).alias("inside"))


def dvd_roots(files: DataFrame) -> DataFrame:
    """(root, dvd): the folders above a VIDEO_TS folder (of any case), and images (.iso, .img)."""
    above = _folders(files).filter(F.col("inside") & (F.upper("child") == "VIDEO_TS")).select("root", F.col("folder").alias("dvd")).distinct()
    return above.union(files.filter(extension("path").isin("iso", "img")).select("root", F.col("path")))


def disc_roots(files: DataFrame, markers: tuple[str, ...] = DISC_FOLDERS, images: tuple[str, ...] = DISC_IMAGES, max_depth: int = 5) -> DataFrame:
    """(root, kind, disc, name, relative) of the discs below each root of files (root, path).

    A folder is a disc if it has one of the marker folders (the first that it has is its kind); otherwise the images in
    it are discs. Nothing below such a folder is looked at, nor is anything more than max_depth folders down: of folders
    that would stop a search, those with another one above them are dropped by an anti-join on their prefixes.
    """
    kinds = F.coalesce(*[F.max(F.when(F.col("inside") & (F.col("child") == m), m)) for m in markers], F.max(F.when(~F.col("inside") & extension("child").isin(*images), "image")))
    stops = _folders(files).groupBy("root", "folder", "depth").agg(kinds.alias("kind")).filter(F.col("kind").isNotNull() & (F.col("depth") <= max_depth))
    parts = F.split("folder", "/")
    above = stops.filter("depth > 0").select("root", "folder", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("d"))
    above = above.select("root", "folder", F.array_join(F.slice(parts, 1, F.col("d")), "/").alias("prefix"))
    hidden = above.join(stops.select("root", F.col("folder").alias("prefix")), ["root", "prefix"], "left_semi").select("root", "folder")
    first = stops.join(hidden, ["root", "folder"], "left_anti")
    at_root = F.col("folder") == ""
    path = lambda c: F.when(at_root, c).otherwise(F.concat_ws("/", "folder", c))
    by_folder = first.filter("kind <> 'image'").select("root", "kind", path(F.col("kind")).alias("disc"), F.when(at_root, name("root")).otherwise(name("folder")).alias("name"), F.when(at_root, ".").otherwise(F.col("folder")).alias("relative"))
    lying = files.filter(extension("path").isin(*images)).select("root", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"))
    by_image = lying.join(first.filter("kind = 'image'").select("root", "folder"), ["root", "folder"]).distinct()
    return by_folder.union(by_image.select("root", F.lit("image"), "path", stem("path"), "path"))
