"""Reports and selections on stated cases that the tables of the queries don't have."""

from pyspark.sql import functions as F

from reelwright.operators import reports, selection


def test_a_delay_report_without_streams(spark):
    kinds = "file string, kind string, index int, start_s double, delay_ms long, language string, codec string, title string"
    streams = spark.createDataFrame([("f", "s", 12, 1.5, 1500, "en", None, ""), ("f", "s", 3, 0.0, -2, "", "srt", "Signs | Songs")], kinds)
    starts = spark.createDataFrame([("f", 0.042), ("g", 0.0)], "file string, start_s double")
    found = {r.file: r.text for r in reports.delay_reports(streams, starts).collect()}
    legend = "\n\nLegend: relative = (track_start - video_start). APPLY = value you pass to mkvmerge/ffmpeg."
    assert found["g"] == "File: g\nVideo start: 0.000000 s\n\n---- Audio ----\n(no audio streams)\n\n---- Subtitles ----\n(no subtitle streams)" + legend
    lines = ["s:3  start_s=0.000000  relative=-2 ms  APPLY=+2 ms  (mkvmerge --sync 0:+2 | ffmpeg -itsoffset +0.002)    srt | Signs | Songs", "s:12 start_s=1.500000  relative=+1500 ms  APPLY=-1500 ms  (mkvmerge --sync 0:-1500 | ffmpeg -itsoffset -1.500)    en"]
    assert found["f"] == "File: f\nVideo start: 0.042000 s\n\n---- Audio ----\n(no audio streams)\n\n---- Subtitles ----\n" + "\n".join(lines) + legend


def test_commands(spark):
    files = spark.createDataFrame([(p,) for p in ("/a b/show.s01.mkv", "bare", ".hidden")], "path string")
    splits = spark.createDataFrame([("bare", 11), ("bare", 4)], "path string, split int")
    languages = spark.createDataFrame([("/a b/show.s01.mkv", 2, "jpn"), ("/a b/show.s01.mkv", 1, ""), ("/a b/show.s01.mkv", None, "eng"), ("bare", 0, None)], "path string, track int, language string")
    found = {r.path: r.command for r in reports.split_commands(files, splits, languages).collect()}
    assert found == {
        "/a b/show.s01.mkv": 'mkvmerge -o "/a b/show.s01 - S01E%%02d.mkv" --language 2:"jpn" "/a b/show.s01.mkv"', "bare": 'mkvmerge -o "bare - S01E%%02d.mkv" --split chapters:4,11 "bare"',
        ".hidden": 'mkvmerge -o ".hidden - S01E%%02d.mkv" ".hidden"',
    }


def test_verdicts_with_alignment(spark):
    df = spark.createDataFrame([(1, 0.02), (2, -0.0214), (3, 1.5), (4, None)], "i int, o double").select("i", reports.with_alignment(F.lit("v"), F.col("o")).alias("t"))
    assert {r.i: r.t for r in df.collect()} == {1: "v", 2: "v\n📍 Alignment: B is 0.021s behind A", 3: "v\n📍 Alignment: B is 1.500s ahead of A", 4: "v"}


def test_pages_and_lists(spark):
    pages = reports.comparison_pages(spark.createDataFrame([(1, "<b>&", None, 'x"y')], "id int, verdict string, a string, b string"), spark.createDataFrame([], "id int, issue string, a_summary string, b_summary string"))
    html = pages.first().html
    assert "<h1>&lt;b&gt;&amp;</h1><h2>Source A: </h2><h2>Source B: x&quot;y</h2>" in html and html.endswith("<th>Source B</th></tr></table></body></html>")
    chunks = spark.createDataFrame([("f", 2, 0.5, None), ("f", 1, None, "x")], "file string, chunk int, ts double, note string")
    assert reports.chunk_lists(chunks, "file", "chunk").first().json == '[{"chunk":1,"note":"x"},{"chunk":2,"ts":0.5}]'
    codec = spark.createDataFrame([("dts",), (None,)], "c string").select(reports.raw_format("c").alias("r")).collect()
    assert [tuple(r.r) for r in codec] == [("dts", None), (None, "Unsupported codec 'None' for raw extraction.")]
    none = spark.createDataFrame([(0,)], "n int").select(reports.scan_summary({f"{k}_{n}": "n" for k in ("multi", "single") for n in ("progressive", "tff", "bff", "undetermined")} | {f"repeated_{n}": "n" for n in ("neither", "top", "bottom")}).alias("t"))
    assert none.first().t == "No frame data was parsed from the FFmpeg output."


def test_streams_to_compare_by(spark):
    files = spark.createDataFrame([(f,) for f in "abcd"], "file string")
    streams = spark.createDataFrame([("a", 0, "video", "jpn", ""), ("a", 1, "audio", "eng", "x"), ("a", 2, "audio", "JPN", "Commentary"), ("a", 3, "audio", "jpn", None), ("b", 4, "audio", None, "z"), ("b", 1, "audio", "eng", "Commentary"), ("c", 0, "video", None, None)], "file string, index int, kind string, language string, title string")
    found = lambda language: {r.file: r["index"] for r in selection.audio_streams(files, streams, language).collect()}
    assert found("jpn") == {"a": 3, "b": 1, "c": None, "d": None} and found(None) == {"a": 1, "b": 1, "c": None, "d": None} and found("ENG") == {"a": 1, "b": 1, "c": None, "d": None}


def test_selected_titles(spark):
    titles = spark.createDataFrame([("d", t) for t in (0, 1, 2)], "disc string, title int")
    wanted = spark.createDataFrame([("d", [2, 0, 7], 3), ("e", None, 4), ("f", None, None), ("g", [], 2), ("h", [1], 2)], "disc string, selected array<int>, known int")
    found = {r.disc: (r.titles, r.n, r.skipped) for r in selection.jobs(titles, wanted).collect()}
    assert found == {"d": (["0", "2"], 2, False), "e": (["all"], 4, False), "f": (["all"], 1, False), "g": ([], 0, True), "h": ([], 0, False)}
    keys = spark.createDataFrame([(1, None), (1, [1]), (1, []), (None, [1])], "k int, s array<int>").select(selection.chosen("k", "s").alias("c"))
    assert [r.c for r in keys.collect()] == [True, True, False, False]
