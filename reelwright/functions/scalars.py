"""Column functions: parsing and formatting of what media tools print. All are built-in expressions; bad input gives null
or the stated default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the bits of a stream's flags, and of words in its description where no bit has a label.
FLAGS = {
    1: "Director's Comments",
    2: "Alternate Director's Comments",
    4: "For Visually Impaired",
    256: "Core Audio",
    512: "Secondary Audio",
    1024: "Has Core Audio",
    2048: "Derived Stream",
    4096: "Forced Subtitles",
    16384: "Profile Secondary Stream",
    32768: "Offset Sequence ID Present",
}
FLAG_WORDS = {"forced": "Forced Subtitles", "comment": "Commentary", "description": "Audio Description"}
# Names of language codes.
LANGUAGES = {
    "eng": "English",
    "spa": "Spanish",
    "fra": "French",
    "deu": "German",
    "ita": "Italian",
    "jpn": "Japanese",
    "zho": "Chinese",
    "kor": "Korean",
    "por": "Portuguese",
    "rus": "Russian",
    "und": "Undetermined",
}
# Names of codecs by kind of stream; the first one of which a word occurs counts.
CODECS = {
    "Video": {
        "HEVC (H.265)": ("HEVC", "H.265", "H265"),
        "H.264/AVC": ("AVC", "H.264", "H264"),
        "VC-1": ("VC-1", "VC1"),
        "MPEG-2": ("MPEG-2", "Mpeg2", "MPEG2"),
    },
    "Audio": {
        "Dolby Atmos": ("Atmos",),
        "Dolby TrueHD": ("TrueHD",),
        "Dolby Digital Plus (E-AC-3)": ("E-AC3", "EAC3", "DD+", "Dolby Digital Plus"),
        "Dolby Digital (AC-3)": ("AC3", "AC-3", "Dolby Digital", "DD "),
        "DTS-HD Master Audio": ("DTS-HD MA", "DTS HD MA", "DTS-HD Master Audio"),
        "DTS-HD High Resolution": ("DTS-HD", "DTS HD"),
        "DTS:X": ("DTS:X", "DTSX"),
        "DTS": ("DTS",),
        "PCM": ("LPCM", "PCM"),
        "FLAC": ("FLAC",),
        "AAC": ("AAC",),
    },
    "Subtitles": {"PGS": ("PGS",), "VobSub": ("VobSub", "DVD"), "SRT": ("SRT",)},
}
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frames_per_second(text: Column | str, default: float = 24.0) -> Column:
    """'n/d' or a number; the default for anything else and for d = 0."""
    parts = F.split(c(text), "/")
    ratio = F.try_divide(parts[0].try_cast("double"), F.nullif(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)))
    return F.coalesce(F.when(F.contains(c(text), F.lit("/")), ratio).otherwise(c(text).try_cast("double")), F.lit(default))


def clock_seconds(text: Column | str) -> Column:
    """Seconds of H:M:S or M:S; null for other texts."""
    p = F.split(c(text), ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)).when(F.size(p) == 2, n(0) * 60 + n(1))


def clock_micros(text: Column | str) -> Column:
    """Microseconds of HH:MM:SS.fraction, the fraction padded or cut to six digits."""
    whole, fraction = F.substring_index(c(text), ".", 1), F.when(F.contains(c(text), F.lit(".")), F.substring_index(c(text), ".", -1)).otherwise("")
    return clock_seconds(whole) * 1_000_000 + F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("bigint")


def human_size(size: Column | str) -> Column:
    """'0 B', 'n B', and with two decimals beyond bytes, by 1024 up to TB."""
    n = c(size).cast("double")
    out = F.when(n <= 0, F.lit("0 B")).when(n < 1024, F.format_string("%d B", c(size).cast("bigint")))
    for k, unit in enumerate(SIZE_UNITS[1:-1], 1):
        out = out.when(n < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", n / 1024.0**k))
    return out.otherwise(F.format_string(f"%.2f {SIZE_UNITS[-1]}", n / 1024.0**4))


def size_bytes(text: Column | str) -> Column:
    """Bytes of a plain number or of 'x.y KB', 'MB' or 'GB' in any case (by 1024, cut to whole bytes); 0 otherwise."""
    pattern = r"(?i)^([0-9.]+)\s*(GB|MB|KB)"
    amount, unit = F.regexp_extract(c(text), pattern, 1).try_cast("double"), F.upper(F.regexp_extract(c(text), pattern, 2))
    factor = F.when(unit == "KB", 1024.0).when(unit == "MB", 1024.0**2).when(unit == "GB", 1024.0**3)
    return F.coalesce(c(text).try_cast("bigint"), (amount * factor).cast("bigint"), F.lit(0).cast("bigint"))


def channel_layout(text: Column | str) -> Column:
    """Names of one, two, six and eight channels, 'n Channels' for other digits, null otherwise."""
    n = F.when(c(text).rlike("^[0-9]+$"), c(text).try_cast("bigint"))
    named = F.when(n == 1, "1.0 (Mono)").when(n == 2, "2.0 (Stereo)").when(n == 6, "5.1").when(n == 8, "7.1")
    return named.when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" Channels")))


def title_case(text: Column | str) -> Column:
    """Every letter that doesn't follow a letter as a capital, all others small: also behind hyphens, digits and marks."""
    starts = F.split(F.lower(c(text)), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(starts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def language_name(code: Column | str) -> Column:
    """The name of a language code; other codes with a capital, null for null and empty ones."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(c(code)))
    return F.when(c(code) != "", F.coalesce(known, title_case(code)))


def codec_name(codec_id: Column | str, short: Column | str, long: Column | str, kind: Column | str) -> Column:
    """The short name if there is one, else the first name of the kind with a word in the three texts, else the kind;
    null for other kinds."""
    blob = F.concat_ws(" ", *[F.coalesce(c(x), F.lit("")) for x in (codec_id, short, long)])
    out = F.when(F.coalesce(c(short), F.lit("")) != "", c(short))
    for k, names in CODECS.items():
        for name, words in names.items():
            any_of = "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in words)
            out = out.when((c(kind) == k) & blob.rlike(rf"(?i)\b(?:{any_of})\b"), name)
        out = out.when(c(kind) == k, k)
    return out


def safe_name(text: Column | str) -> Column:
    """A file name: illegal characters become spaces, ends are trimmed, then runs of space collapse; 'Unnamed' if empty."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(c(text), r'[\\/:*?"<>|]', " ")), r"\s+", " ")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("Unnamed")).otherwise(clean)


def path_parts(path: Column | str) -> dict[str, Column]:
    """parent, name, stem and suffix of a path."""
    name = F.substring_index(c(path), "/", -1)
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return {"parent": F.regexp_extract(c(path), r"^(.*)/[^/]*$", 1), "name": name, "stem": F.left(name, F.length(name) - F.length(suffix)), "suffix": suffix}


def labels_of_bits(bits: Column | str, labels: dict[int, str] = FLAGS) -> Column:
    """The labels of the bits that are set, in order."""
    return F.filter(F.array(*[F.when(c(bits).bitwiseAND(F.lit(b)) != 0, F.lit(v)) for b, v in labels.items()]), lambda x: x.isNotNull())


def stream_flags(bits: Column | str, text: Column | str) -> Column:
    """The labels of a stream's flags; where no bit has one, those of words in its description."""
    low = F.lower(F.coalesce(c(text), F.lit("")))
    by_word = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), v) for w, v in FLAG_WORDS.items()]), lambda x: x.isNotNull())
    by_bit = F.coalesce(labels_of_bits(bits), F.array().cast("array<string>"))
    return F.when(F.size(by_bit) > 0, by_bit).otherwise(by_word)


def severity(text: Column | str) -> Column:
    """error, warning or info of a plain line, by keywords."""
    low = F.lower(c(text))
    return F.when(low.rlike("error|fail"), "error").when(low.rlike("warning"), "warning").otherwise("info")


def message(line: Column | str) -> Column:
    """struct<severity, code, message> of MSG:code,flags,count,"message",...: an error by bit 512 of the flags, a warning
    by bit 1024, else by keywords. Other lines, and those whose numbers can't be read, are info as they stand."""
    parts = F.split(c(line), ",", 4)
    code, flags = F.regexp_extract(parts[0], r"^MSG:\s*([0-9]+)\s*$", 1).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")
    quoted = F.regexp_extract(F.get(parts, F.lit(3)), r'"((?:[^"\\]|\\.)*)"', 1)
    text = F.replace(F.replace(quoted, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    low = F.lower(text)
    level = F.when(flags.bitwiseAND(F.lit(512)) != 0, "error").when(flags.bitwiseAND(F.lit(1024)) != 0, "warning")
    level = level.when(low.rlike("error|fail"), "error").when(low.rlike("warning|skip"), "warning").otherwise("info")
    good = code.isNotNull() & flags.isNotNull() & (F.size(parts) == 4)
    return F.when(good, F.struct(level.alias("severity"), code.cast("string").alias("code"), text.alias("message"))).otherwise(F.struct(F.lit("info").alias("severity"), F.lit("").alias("code"), c(line).alias("message")))


def exit_message(code: Column | str) -> Column:
    named = F.when(c(code) == 0, "Success").when(c(code) == 1, "Failed (check log for details)").when(c(code) == 2, "Failed (invalid command line arguments)")
    return named.otherwise(F.concat(F.lit("Failed (exit code "), c(code).cast("string"), F.lit(")")))


def rounded_ms(seconds: Column | str) -> Column:
    """Whole milliseconds, halves to even."""
    return F.bround(c(seconds) * 1000, 0).cast("bigint")


def signed_ms(ms: Column | str) -> Column:
    return F.format_string("%+d ms", c(ms).cast("bigint"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of integer words of the same length."""
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def mean_bits(values: Column | str, word: int = 32) -> Column:
    """The bits 'value above the mean' as an array of integer words of so many bits; the first value is a word's highest."""
    v = c(values)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    bits = F.transform(v, lambda x: F.when(x.cast("double") > mean, 1).otherwise(0).cast("bigint"))
    starts = F.sequence(F.lit(1), F.size(v), F.lit(word))
    return F.transform(starts, lambda s: F.aggregate(F.slice(bits, s, F.lit(word)), F.lit(0).cast("bigint"), lambda n, b: n * 2 + b))


def cast_class(a: Column | str, b: Column | str, above: float = 3.0) -> Column:
    """The direction of a colour cast from its two opponent components, the stronger one first; Neutral up to a magnitude."""
    x, y = c(a), c(b)
    first = F.when((x > 0) & (y > 0), "Red/Yellow").when(x > 0, "Red/Magenta").when(y > 0, "Green/Yellow").otherwise("Green/Cyan")
    second = F.when((y > 0) & (x > 0), "Yellow/Red (Warm)").when(y > 0, "Yellow/Green").when(x > 0, "Blue/Magenta").otherwise("Blue/Cyan (Cool)")
    return F.when(F.sqrt(x * x + y * y) <= above, "Neutral").when(F.abs(x) > F.abs(y), first).otherwise(second)


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded by the nearest whole number of x times a power of ten, as SQL databases do; F.round goes by x's shortest decimal
    text, and is another number where x is next to a half."""
    return F.round(c(x) * 10.0**digits) / 10.0**digits


def fixed(x: Column | str, digits: int) -> Column:
    """x with so many digits, as C's printf writes it: by x's exact value, halves to even. F.format_string goes by x's shortest
    decimal text, halves up. For sizes below 1e15."""
    ten, size = 10.0**digits, F.abs(c(x))
    near = size * ten
    # the product's error, exactly, from the halves of x's bits: it tells on which side of a half x is
    high = size * 134217729.0 - (size * 134217729.0 - size)
    off = (high * ten - near) + (size - high) * ten
    whole = F.floor(near)
    past = (near - whole - 0.5) + off
    n = whole + F.when((past > 0) | ((past == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when((c(x) < 0) | (c(x).cast("string") == "-0.0"), "-").otherwise("")
    part = F.concat(F.lit("."), F.lpad((n % int(ten)).cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(sign, F.floor(n / int(ten)).cast("string") if digits else n.cast("string"), part)


def severity_label(score: Column | str) -> Column:
    """The label of a mean score."""
    return F.when(c(score) > 50, "Severe").when(c(score) > 25, "Moderate").when(c(score) > 10, "Mild").otherwise("Minimal")


def delay_line(kind: Column | str, index: Column | str, start_s: Column | str, delay_ms: Column | str, notes: Column) -> Column:
    """A report line of a stream: where it starts, its delay, and what to apply against it in two tools' own words."""
    ms = -c(delay_ms)
    line = "%s:%s start_s=%.6f  relative=%+d ms  APPLY=%+d ms  (mkvmerge --sync 0:%+d | ffmpeg -itsoffset %+.3f)"
    text = F.format_string(line, c(kind), F.rpad(c(index).cast("string"), F.greatest(F.lit(2), F.length(c(index).cast("string"))), F.lit(" ")), c(start_s), c(delay_ms), ms, ms, ms / 1000.0)
    return F.concat(text, F.when(notes != "", F.concat(F.lit("    "), notes)).otherwise(""))
