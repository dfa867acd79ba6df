"""Parsers of tool output and column functions: tables of inputs and what they give."""

import pytest
from pyspark.sql import functions as F

from reelwright.functions import scalars as S
from reelwright.sources import discs, logs
from reelwright.streaming import progress, windows


def of(spark, function, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(function("x").alias("y")).collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (S.clock_seconds, {"1:02:03": 3723, "02:03": 123, "x": None, "1:x:2": None, None: None}),
        (S.clock_micros, {"00:00:01.5": 1_500_000, "01:00:00.1234567": 3_600_123_456, "00:00:02": 2_000_000, "x": None}),
        (S.frames_per_second, {"24000/1001": 24000 / 1001, "25": 25.0, "1/0": 24.0, "x": 24.0, None: 24.0}),
        (S.size_bytes, {"12": 12, "1.5 KB": 1536, "2 mb": 2 << 20, "1 Gb": 1 << 30, "4.5GB": 4831838208, "x": 0, None: 0}),
        (S.channel_layout, {"1": "1.0 (Mono)", "2": "2.0 (Stereo)", "6": "5.1", "8": "7.1", "3": "3 Channels", "x": None, None: None}),
        (S.language_name, {"ENG": "English", "und": "Undetermined", "gle": "Gle", "zh-hans": "Zh-Hans", "x1y ünder": "X1Y Ünder", "": None, None: None}),
        (S.safe_name, {"a/b:c": "a b c", "  ": "Unnamed", None: "Unnamed", "ok": "ok"}),
    ],
)
def test_column_functions(spark, function, cases):
    assert of(spark, function, *cases) == list(cases.values())


def test_human_sizes(spark):
    assert of(spark, S.human_size, -1, 0, 512, 1536, 5 << 20, 3 << 30, 2 << 40, kind="long") == ["0 B", "0 B", "512 B", "1.50 KB", "5.00 MB", "3.00 GB", "2.00 TB"]


def test_milliseconds_round_halves_to_even(spark):
    assert of(spark, S.rounded_ms, 0.0005, 0.0015, 0.0025, -1.2, kind="double") == [0, 2, 2, -1200]


def test_probe_streams(spark):
    probe = '{"format": {"duration": "10.5"}, "streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "r_frame_rate": "25/1"}, {"index": 1, "codec_type": "audio", "channels": 2, "sample_rate": "48000", "start_time": "0.021", "tags": {"language": "jpn"}}]}'
    rows = logs.streams(spark.createDataFrame([("a", probe), ("b", "no json"), ("c", '{"format": {"duration": "0"}, "streams": []}')], "path string, json string")).collect()
    assert [(r.path, r.duration, r["index"], r.kind, r.start, r.language, r.title) for r in rows] == [("a", 10.5, 0, "video", 0.0, "und", ""), ("a", 10.5, 1, "audio", 0.021, "jpn", "")]


def test_leading_silence(spark):
    lines = [("s1", 1, "x silence_start: 0"), ("s1", 2, "silence_end: 1.5 | silence_duration: 1.5"), ("s2", 1, "silence_start: 0.01"), ("s3", 1, "silence_start: 4"), ("s3", 2, "silence_end: 5 | silence_duration: 1")]
    got = {r.stream: r.leading_ms for r in logs.leading_silence(spark.createDataFrame(lines, "stream string, n int, line string"), 60_000).collect()}
    assert got == {"s1": 1500, "s2": 60_000, "s3": 0}


def test_scan_counts_are_those_of_the_last_line(spark):
    lines = [("s", 1, "Multi frame detection: TFF: 1 BFF: 2 Progressive: 3 Undetermined: 4"), ("s", 2, "Multi frame detection: TFF: 5 BFF: 6 Progressive: 7 Undetermined: 8"), ("s", 3, "Single frame detection: TFF: 9 BFF: 9 Progressive: 9 Undetermined: 9")]
    assert [tuple(r) for r in logs.scan_counts(spark.createDataFrame(lines, "stream string, n int, line string")).collect()] == [("s", 5, 6, 7, 8)]


def test_attribute_lines(spark):
    lines = [(1, 'TINFO:0,2,0,"A, \\"quoted\\" title"'), (2, 'SINFO:0,1,3,0,"eng"'), (3, 'TINFO:x,2,0,"no title number"'), (4, "MSG:1005,0,1"), (5, 'TINFO:0,2,0,"later"')]
    rows = logs.attribute_lines(spark.createDataFrame(lines, "n int, line string"))
    assert [(r.n, r.title, r.stream, r.code, r.value) for r in rows.collect()] == [(1, 0, None, 2, 'A, "quoted" title'), (2, 0, 1, 3, "eng"), (5, 0, None, 2, "later")]
    wide = logs.pivot_attributes(rows.filter("record = 'TINFO'"), ["title"], "n", {2: "name", 9: "length"}, value="value")
    assert [tuple(r) for r in wide.collect()] == [(0, "later", None)]


def test_chapters(spark):
    xml = "<Chapters><EditionEntry><ChapterAtom><ChapterTimeStart>00:00:00.0</ChapterTimeStart></ChapterAtom><ChapterAtom><ChapterTimeStart>00:05:00.5</ChapterTimeStart></ChapterAtom></EditionEntry></Chapters>"
    assert [tuple(r) for r in logs.chapters(spark.createDataFrame([("a", xml)], "path string, xml string")).collect()] == [("a", 1, "00:00:00.0"), ("a", 2, "00:05:00.5")]


def test_progress_lines(spark):
    lines = ["PRGV:10,20,100", "PRGC:1,2,0", 'PRGT:5,0,"name"', "other"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(progress.parse_line(F.col("line")).alias("p")).select("p.*").collect()
    assert [(r.kind, r.current, r.total) for r in got] == [("PRGV", 10, 20), ("PRGC", 1, 2), ("PRGT", None, None), ("", None, None)]
    assert got[0].top == 100 and got[1].top == 65536


def test_windows_of_streams_equal_those_of_tables(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = windows.tumbling(spark.readStream.schema(batch.schema).parquet(path + "*"), "1 day")
    job = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(map(repr, spark.table("daily").collect())) == sorted(map(repr, windows.tumbling(batch, "1 day").collect()))


def test_messages(spark):
    lines = ['MSG:5,516,0,"all is well"', 'MSG:6,1028,0,"all is well"', 'MSG:7,0,1,"a \\\\"q\\\\" failed","x"', 'MSG:8,0,1,"Skipped"', "MSG:9,0", "MSG:x,0,0,\"a\"", "plain error", 'MSG:10,0,0,no quotes']
    lines = [x.replace("\\\\", "\\") for x in lines]
    got = [tuple(m) for m in of(spark, S.message, *lines)]
    assert got == [("error", "5", "all is well"), ("warning", "6", "all is well"), ("error", "7", 'a "q" failed'), ("warning", "8", "Skipped"), ("info", "", "MSG:9,0"), ("info", "", 'MSG:x,0,0,"a"'), ("info", "", "plain error"), ("info", "10", "")]
    assert of(spark, S.exit_message, 0, 1, 2, 9, kind="int") == ["Success", "Failed (check log for details)", "Failed (invalid command line arguments)", "Failed (exit code 9)"]


def test_stream_flags_and_codecs(spark):
    rows = spark.createDataFrame([(0, "Forced COMMENTARY"), (4096 + 8, "comment"), (1 + 32768, None), (None, "nothing")], "bits int, text string")
    assert [r[0] for r in rows.select(S.stream_flags("bits", "text")).collect()] == [["Forced Subtitles", "Commentary"], ["Forced Subtitles"], ["Director's Comments", "Offset Sequence ID Present"], []]
    cases = [("A_DTS", "", "DTS-HD Master Audio 5.1", "Audio", "DTS-HD Master Audio"), ("A_EAC3", None, "", "Audio", "Audio"), ("EAC3", "", "", "Audio", "Dolby Digital Plus (E-AC-3)"), ("x", "", "", "Subtitles", "Subtitles"), ("x", "Short", "", "Video", "Short"), ("x", "", "", "Menu", None), ("h.264", "", "", "Video", "H.264/AVC")]
    df = spark.createDataFrame([c[:4] for c in cases], "i string, s string, l string, k string")
    assert [r[0] for r in df.select(S.codec_name("i", "s", "l", "k")).collect()] == [c[4] for c in cases]


def test_casts_and_severity_labels(spark):
    df = spark.createDataFrame([(4.0, 1.0), (4.0, -1.0), (-4.0, 1.0), (-4.0, -1.0), (1.0, 4.0), (-1.0, 4.0), (1.0, -4.0), (-1.0, -4.0), (3.0, 0.0), (4.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(S.cast_class("a", "b")).collect()] == ["Red/Yellow", "Red/Magenta", "Green/Yellow", "Green/Cyan", "Yellow/Red (Warm)", "Yellow/Green", "Blue/Magenta", "Blue/Cyan (Cool)", "Neutral", "Yellow/Red (Warm)"]
    assert of(spark, S.severity_label, 51.0, 50.0, 25.0, 10.0, kind="double") == ["Severe", "Moderate", "Mild", "Minimal"]


def test_delay_line(spark):
    df = spark.createDataFrame([("audio", 1, 0.0215, 22, "jpn | aac"), ("subs", 123, 1.0, -7, "")], "k string, i int, s double, d int, n string")
    assert [r[0] for r in df.select(S.delay_line("k", "i", "s", "d", F.col("n"))).collect()] == [
        "audio:1  start_s=0.021500  relative=+22 ms  APPLY=-22 ms  (mkvmerge --sync 0:-22 | ffmpeg -itsoffset -0.022)    jpn | aac",
        "subs:123 start_s=1.000000  relative=-7 ms  APPLY=+7 ms  (mkvmerge --sync 0:+7 | ffmpeg -itsoffset +0.007)",
    ]


def test_disc_facts(spark):
    full = ['CINFO:1,6209,12,"Blu-ray disc"', 'CINFO:2,0,0,"First, label"', 'CINFO:2,0,x,"Later"', 'CINFO:32,0,0,"VOL"', "CINFO:x,0,2,y", 'TINFO:0,2,0,"a"', "TINFO:x", "TCOUNT:?", "TCOUNT:7", "TCOUNT:9"]
    lines = [("full", n, x) for n, x in enumerate(full)]
    lines += [("few", 1, "an HD-DVD"), ("few", 2, "a Video_ts folder"), ("few", 3, 'TINFO:4,2,0,"a"'), ("few", 4, 'TINFO:4,9,0,"b"'), ("few", 5, "TINFO:1,2"), ("none", 1, None), (None, 1, "bdplus, aacs")]
    got = {r.disc: r.asDict() for r in discs.facts(spark.createDataFrame(lines, "disc string, n int, line string").withColumn("code", F.lit(1))).collect()}
    silent = dict.fromkeys(["found_label", *discs.ATTRIBUTES.values(), "raw_flags"]) | dict.fromkeys(["aacs", "bdplus", "bus_encryption", "has_dvd", "has_bluray", "has_hddvd", "has_aacs_files", "has_bdsvm_files"], False)
    silent |= {"disc_type": "Unknown", "titles": 0}
    assert got["none"] == silent | {"disc": "none"}
    assert got[None] == silent | {"disc": None, "bdplus": True, "aacs": True, "has_aacs_files": True}
    assert got["few"] == silent | {"disc": "few", "has_dvd": True, "has_hddvd": True, "disc_type": "DVD", "titles": 2}
    assert got["full"] == silent | {
        "disc": "full", "found_label": "First, label", "type": "Blu-ray disc", "label": "Later", "volume_name": "VOL",
        "aacs": True, "bdplus": True, "raw_flags": 12, "has_bluray": True, "disc_type": "Blu-ray", "titles": 7,
    }
    assert discs.facts(spark.createDataFrame([], "disc string, n int, line string")).count() == 0
