"""Paths, DVD forms and trees, probes with errors, against plain versions and stated cases."""

import json

import pytest
from pyspark.sql import functions as F

from reelwright.sources import dvd, logs, paths

TREE = {"device": "/dev/sr0", "track": [{"ix": 1, "length": 1420.5, "audio": [{"ix": 1, "langcode": "en"}, {"ix": 2, "langcode": "de"}], "subp": [], "palette": {"first_one": "a", "deep": {"er": None, "x": True}}}, {"ix": 2, "chapter": [{"ix": 1}, {"ix": 2}]}]}
XML = '<lsdvd device="/dev/sr0"><track ix="1"><length>1420.5</length><vts>3</vts><audio ix="1" langcode="en">stereo</audio><audio ix="2" langcode="de"/><subp ix="1"/></track><track ix="2"><length>60</length></track></lsdvd>'
TEXT = "Disc Title: X\nTitle: 01, Length: 00:23:40.000  Chapters: 06, Cells: 06, Audio streams: 02, Subpictures: 01\nnoise\n\tTitle: 02, Length: 1:00  Chapters: 1, Cells: 1, Audio streams: 0, Subpictures: 0\r\nTitle: 3, Length: 1:00 Chapters: 1"
FORMS = [
    (1, json.dumps(TREE), XML, TEXT), (2, "{bad", XML, TEXT), (3, None, "<lsdvd><track>", TEXT), (4, "", "  ", "nothing"), (5, None, None, None), (6, "[1, 2]", None, None), (7, "{}", XML, TEXT),
    (8, None, '<lsdvd><track ix="9"/></lsdvd>', None), (9, "nope", "junk", TEXT), (10, None, "<a><b></a></b>", TEXT), (11, '{"track": {"ix": "07", "length": "x"}}', None, None),
]


@pytest.fixture(scope="module")
def forms(spark):
    return spark.createDataFrame(FORMS, "disc int, json string, xml string, text string")


def test_the_first_form_that_can_be_read_counts(forms):
    modes = {r.disc: r.mode for r in dvd.trees(forms).select("disc", "mode").collect()}
    assert modes == {1: "JSON", 2: "XML", 3: "Text Fallback", 4: None, 5: None, 6: "JSON", 7: "JSON", 8: "XML", 9: "Text Fallback", 10: "Text Fallback", 11: "JSON"}


def test_titles_of_all_forms_have_one_schema(forms):
    found = {}
    for r in dvd.titles(forms).collect():
        found.setdefault(r.disc, []).append(r)
    assert set(found) == {1, 2, 3, 8, 9, 10, 11}
    one, two = sorted(found[1], key=lambda r: r.number)
    assert (one.device, one.number, one.length, one.n_audio, one.n_subtitles, one.chapters) == ("/dev/sr0", "1", "1420.5", 2, 0, None)
    assert one.audio == [{"ix": "1", "langcode": "en"}, {"ix": "2", "langcode": "de"}] and two.chapters == "2"
    one, two = sorted(found[2], key=lambda r: r.number)
    assert (one.device, one.number, one.length, one.n_audio, one.n_subtitles) == ("/dev/sr0", "1", "1420.5", 2, 1)
    assert one.audio[0] == {"ix": "1", "langcode": "en", "content": "stereo"} and one.properties == {"length": "1420.5", "vts": "3"} and two.length == "60"
    assert [(r.number, r.length, r.chapters, r.n_audio, r.n_subtitles, r.audio, r.properties) for r in sorted(found[3], key=lambda r: r.number)] == [("01", "00:23:40.000", "06", 2, 1, None, {"cells": "06"}), ("02", "1:00", "1", 0, 0, None, {"cells": "1"})]
    assert [(r.number, r.n_audio, r.device) for r in found[8]] == [("9", 0, "N/A")] and [(r.number, r.length) for r in found[11]] == [("07", "x")]


def test_each_form_is_parsed_once(forms):
    plan = dvd.titles(forms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("from_xml(VariantType") == 1 and "Union" not in plan


def test_streams_and_values_of_any_shape(spark):
    track = [{"ix": 1, "audio": ["x", None, {"a": [1]}, [2]], "subp": {"b": "c"}, "note": "[x]", "deep": [1], "none": None}, {"audio": None, "subp": "z", "chapter": {"ix": 1}}, 5]
    df = spark.createDataFrame([(1, json.dumps({"track": track}), None, None)], "disc int, json string, xml string, text string")
    one, two, three = sorted(dvd.titles(df).collect(), key=lambda r: -r.n_audio)
    assert one.audio == [{"content": "x"}, {"content": None}, {"a": "[1]"}, {"content": "[2]"}] and one.subtitles == [{"b": "c"}] and one.properties == {"note": "[x]", "none": None}
    assert (two.audio, two.subtitles, two.chapters, two.properties) == ([{"content": None}], [{"content": "z"}], "1", {})
    assert (three.number, three.audio, three.n_subtitles, three.properties) == (None, [], 0, None)


def plain_rows(tree, depth=0):
    """Labels and values in order of keys; elements of arrays stand in its place."""
    out = []
    for k in sorted(tree):
        v, label = tree[k], " ".join(w.capitalize() for w in k.split("_"))
        if isinstance(v, dict) and v:
            out += [(depth, label, None), *plain_rows(v, depth + 1)]
        elif isinstance(v, list) and v:
            for x in v:
                out += plain_rows(x, depth) if isinstance(x, dict) else [(depth, label, str(x))]
        else:
            out.append((depth, label, "None" if v is None else str(v).lower() if isinstance(v, bool) else json.dumps(v) if isinstance(v, dict | list) else str(v)))
    return out


def test_trees_of_any_depth_as_rows_and_text(spark):
    deep = {"a": {"b_c": {"d": {"e": [{"f": [1, 2]}, {"g": {}}]}}}, "z": "end"}
    df = spark.createDataFrame([(1, json.dumps(TREE)), (2, json.dumps(deep)), (3, "{}"), (4, None)], "disc int, json string").select("disc", F.try_parse_json("json").alias("tree"))
    rows = dvd.tree_rows(df)
    for disc, tree in ((1, TREE), (2, deep)):
        found = [(r.depth, r.label, r.value) for r in rows.filter(f"disc = {disc}").orderBy("path").collect()]
        assert found == plain_rows(tree)
        (text,) = dvd.tree_text(rows.filter(f"disc = {disc}")).collect()
        assert text.text == "".join("  " * d + label + (":" if v is None else f": {v}") + "\n" for d, label, v in plain_rows(tree))
    assert rows.filter("disc > 2").count() == 0


def test_values_print_alike_at_every_depth(spark):
    df = spark.createDataFrame([(1, '{"a": 1e2, "b": {"c": 1e2, "d": [{"e": [1e2, {}]}]}}')], "disc int, json string").select("disc", F.try_parse_json("json").alias("tree"))
    found = [(r.depth, r.label, r.value) for r in dvd.tree_rows(df).orderBy("path").collect()]
    assert found == [(0, "A", "100.0"), (0, "B", None), (1, "C", "100.0"), (1, "E", "100.0"), (1, "E", "{}")]


def test_the_tree_query_reads_no_other_form(spark, monkeypatch):
    from reelwright.plans import protocols

    seen = []
    monkeypatch.setattr(dvd, "tree_rows", lambda trees: seen.append(trees) or trees.selectExpr("disc", "array(0) AS path", "0 AS depth", "'x' AS label", "'y' AS value"))
    protocols.disc_tree(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" in plan and "from_xml" not in plan and "Cells: 2" not in plan


def plain_discs(files, max_depth=5):
    """By going down the tree."""
    tree = {}
    for p in files:
        at = tree
        *folders, last = p.split("/")
        for f in folders:
            at = at.setdefault(f, {})
        at[last] = None
    out = []

    def down(at, where, depth):
        if depth > max_depth:
            return
        for marker in paths.DISC_FOLDERS:
            if isinstance(at.get(marker), dict):
                out.append((marker, "/".join([*where, marker]), where[-1] if where else "drop", "/".join(where) or "."))
                return
        images = [k for k, v in at.items() if v is None and k.lower().rpartition(".")[2] in paths.DISC_IMAGES and "." in k[1:]]
        out.extend(("image", "/".join([*where, k]), k.rpartition(".")[0], "/".join([*where, k])) for k in images)
        if not images:
            for k, v in at.items():
                if v is not None:
                    down(v, [*where, k], depth + 1)

    down(tree, [], 0)
    return sorted(out)


TREES = [
    ["VIDEO_TS/a.vob", "x/BDMV/b"], ["one/VIDEO_TS/a.vob", "one/BDMV/c", "two/BDMV/stream/x.m2ts", "two/deep/VIDEO_TS/y", "three/a.iso", "three/b.IMG", "three/sub/c.iso", "four/readme.txt"],
    ["a/b/c/d/e/VIDEO_TS/x", "a/b/c/d/e2/f/VIDEO_TS/x", "q/VIDEO_TS"], ["top.iso", "below/VIDEO_TS/x"], ["a/.iso", "a/b.nrg/c.bin", "ab/x.iso", "a/x/BDMV/q"],
]


@pytest.mark.parametrize("files", TREES)
def test_discs_are_those_of_a_search(spark, files):
    df = spark.createDataFrame([("/media/drop", f) for f in files], "root string, path string")
    assert sorted((r.kind, r.disc, r.name, r.relative) for r in paths.disc_roots(df).collect()) == plain_discs(files)
    assert paths.disc_roots(df.limit(0)).collect() == []


def test_dvd_roots_and_specs(spark):
    df = spark.createDataFrame([("r", p) for p in ("m/Video_ts/a", "m/VIDEO_TS/b", "x.iso", "y.bin", "VIDEO_TS/c")], "root string, path string")
    assert sorted(r.dvd for r in paths.dvd_roots(df).collect()) == ["", "m", "x.iso"]
    specs = spark.createDataFrame([(p,) for p in ("/a/x.ISO", "/a/x.mkv", "/a.iso/b", ".iso")], "p string").select(paths.source_spec("p").alias("s"), paths.stem("p").alias("n")).collect()
    assert [tuple(r) for r in specs] == [("iso:/a/x.ISO", "x"), ("file:/a/x.mkv", "x"), ("file:/a.iso/b", "b"), ("file:.iso", ".iso")]


def test_lists_of_paths(spark):
    typed = spark.createDataFrame([(" /b.mkv;/a.MP4 \n\n/c.txt; ;/b.mkv",)], "text string")
    rows = paths.listed(typed)
    assert [r.path for r in paths.videos(rows).orderBy("n").collect()] == ["/b.mkv", "/a.MP4"]
    assert [r.path for r in paths.videos(rows.withColumn("named", F.lit(True)), named="named").orderBy("n").collect()] == ["/b.mkv", "/a.MP4", "/c.txt"]
    shots = spark.createDataFrame([(p,) for p in ("/z/b.png", "/a/c.JPG", "/a/a.webp", "/a/x.gif")], "path string")
    assert [r.path for r in paths.pictures(shots).collect()] == ["/a/a.webp", "/z/b.png", "/a/c.JPG"] and len(paths.pictures(shots, 2).collect()) == 2


def test_probes_with_errors_and_starts(spark):
    ok = json.dumps({"format": {"duration": "10.5"}, "streams": [{"index": 0, "codec_type": "audio"}, {"index": 1, "codec_type": "video", "start_time": "0.5", "r_frame_rate": "24000/1001"}]})
    own = json.dumps({"format": {}, "streams": [{"codec_type": "video", "nb_frames": "77", "r_frame_rate": "25", "start_time": "N/A"}]})
    df = spark.createDataFrame([("a", ok), ("b", own), ("c", "{broken"), ("d", ""), ("e", None), ("f", '{"format": {}}'), ("g", '{"streams": []}')], "path string, json string")
    assert {r.path: (r.n_streams, r.error) for r in logs.probed(df).collect()} == {"a": (2, None), "b": (1, None), "c": (0, "output can't be read"), "d": (0, "no output"), "e": (0, "no output"), "f": (0, "output can't be read"), "g": (0, None)}
    assert {r.path: r.start for r in logs.video_starts(df).collect()} == {"a": 0.5, **dict.fromkeys("bcdefg")}
    assert {r.path: r.frames for r in logs.frame_counts(df).collect()} == {"a": 251, "b": 77, **dict.fromkeys("cdefg")}
    lines = spark.createDataFrame([("p", x) for x in ("1,0.042000", "2,N/A", "3,", "x,1.0", "4", "")], "path string, line string")
    assert sorted((r["index"], r.start) for r in logs.start_lines(lines).collect()) == [(1, 0.042), (2, 0.0), (3, 0.0), (4, 0.0)]
