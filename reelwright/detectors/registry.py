"""The detectors of pictures by the issue that they look for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.detectors import banding, colour, compression, edges, fields, geometry, upscale

#: Names of issues. A detector takes a table of colour frames and gives (source, score, summary, worst_s).
DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "Upscaled Video": upscale.upscaled,
    "Aspect Ratio": geometry.aspect_ratio,
    "Compression Artifacts": compression.compressed,
    "Color Banding": banding.banded,
    "Ringing / Halos": edges.ringing,
    "Dot Crawl": edges.dot_crawl,
    "Chroma Shift": colour.chroma_shift,
    "Rainbowing / Cross-Color": edges.rainbowing,
    "Color Cast": colour.colour_cast,
    "Over-DNR / Waxiness": edges.waxy,
    "Excessive Sharpening": edges.sharpened,
    "Ghosting / Blending": fields.ghosting,
}


def detect(frames: DataFrame, issues: tuple[str, ...] | None = None) -> DataFrame:
    """(issue, source, score, summary, worst_s) of all detectors, or of those named. An unknown name is an error."""
    found = None
    for issue in issues if issues is not None else DETECTORS:
        one = DETECTORS[issue](frames).select(F.lit(issue).alias("issue"), "source", "score", "summary", "worst_s")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no detector is named")
    return found
