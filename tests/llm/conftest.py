"""Small tables for the operators' tests: rows of every awkward kind, and an empty table of the same columns."""

import pytest

#: Columns of documents, and others whose names the operators use for their own.
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, tid string, fp long, component long, hi long, lo long, "
    "mix_size string, pii_id string, q_words string, kept string, n_words string, key int, row int, k0 int, size string, target string, ids string, bucket int"
)
WIDTH = COLUMNS.count(",") + 1


def frame(spark, rows):
    """rows of (doc_id, text, source), with something in every other column."""
    full = [(i, t, "en", s, None if t is None else len(t), *["x" if c.split()[1] == "string" else 7 for c in COLUMNS.split(", ")[5:]]) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


PASSAGE = " ".join(f"stone{i} river{i * 7 % 31} cloud" for i in range(60))
STORY = " ".join(f"w{i * i % 977} over" for i in range(200))
LONG = " ".join(f"long{i % 5003} wind{i % 17}" for i in range(60_000))
AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "a"), (5, "two words", "b"), (None, STORY, "b"), (None, None, None),
    (6, STORY, "a"), (6, STORY, "a"), (7, STORY, None), (8, "intro " + PASSAGE + " end of the first", "a"), (9, "other start " + PASSAGE + " tail", "c"),
    (10, LONG, "a"), (11, PASSAGE + " " + PASSAGE, "b"), (12, "ÄÖÜ straße ünïcode 漢字かな 한국어 🙂 é ‍ ﬁ Ǆ", "c"), (13, "<|endoftext|> mid <|endoftext|><|startoftext|>", "c"),
    (14, "\x00\x01\x02\x03 mail me: Ann.B@example.org or 10.0.0.255, 4111 1111 1111 1111, +44 20 7946 0958", "c"), (15, "a\n\na\nb\na\n" * 30, "a"),
    (16, "  　x\u0085y\x1cz " * 20, "b"), (17, STORY.replace("w9", "v9", 1), "a"), (18, "###$$$ %% && " * 40, "b"), (19, "AAAA BBBB " * 60, "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
