"""Quality rules as a short-circuit cascade, in Spark SQL expressions only.

A rule rejects a document; a document is kept when no rule rejects it, so the order of the rules never changes the
verdict, only the work. The order is chosen on a sample: each rule's cost is the work that its measures take there, and
its selectivity the share of the sample that it rejects. The first rule is the one with the most rejections per cost;
each further one has the most among the rows that are left, by the cost of what is not measured yet. A measure is
computed for a document only while no earlier rule has rejected it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import SPACE

#: Measures by name: SQL over the columns text_ (never null) and the measures named before it. In this order.
MEASURES: dict[str, str] = {
    "words": f"CASE WHEN btrim(text_, '{SPACE}') = '' THEN array() ELSE split(btrim(text_, '{SPACE}'), '[{SPACE}]+') END",
    "n_words": "CAST(size(words) AS BIGINT)",
    "word_chars": "CAST(length(array_join(words, '')) AS BIGINT)",
    "n_symbols": "CAST(regexp_count(text_, '[#*$%&|<>]') AS BIGINT)",
    "n_upper": "CAST(length(regexp_replace(text_, '\\\\P{Lu}+', '')) AS BIGINT)",
    "n_chars_": "CAST(length(text_) AS BIGINT)",
    "n_letterless": "CAST(size(filter(words, w -> NOT w RLIKE '\\\\p{L}')) AS BIGINT)",
    "lines": f"filter(transform(split(text_, '\\n'), l -> struct(l AS line, btrim(l, '{SPACE}') AS trimmed)), l -> l.trimmed <> '')",
    "n_dup_lines": "CAST(size(lines) - size(array_distinct(lines.line)) AS BIGINT)",
    "n_bullets": "CAST(size(filter(lines, l -> left(l.trimmed, 1) IN ('-', '*', '•', '‣', '●'))) AS BIGINT)",
    "n_ellipses": "CAST(size(filter(lines, l -> l.trimmed LIKE '%...' OR l.trimmed LIKE '%…')) AS BIGINT)",
    # 3-word windows as 96 bits of hashes, sorted by them (then place), those with an equal neighbour, their places in order
    "windows": "sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> struct(xxhash64(w, get(words, i + 1), get(words, i + 2)) AS h, hash(w, get(words, i + 1), get(words, i + 2)) AS g, i AS at)))",
    "repeated": "sort_array(transform(filter(windows, (x, i) -> coalesce(x.h = get(windows, i - 1).h AND x.g = get(windows, i - 1).g, false) OR coalesce(x.h = get(windows, i + 1).h AND x.g = get(windows, i + 1).g, false)), x -> x.at))",
    # each repeated window adds the words up to the next one, three at most
    "n_repeat_words": "CAST(aggregate(transform(repeated, (at, i) -> least(3, coalesce(get(repeated, i + 1) - at, 3))), 0, (a, b) -> a + b) AS BIGINT)",
}
NEEDS: dict[str, tuple[str, ...]] = {
    "n_words": ("words",),
    "word_chars": ("words",),
    "n_letterless": ("words",),
    "n_dup_lines": ("lines",),
    "n_bullets": ("lines",),
    "n_ellipses": ("lines",),
    "windows": ("words",),
    "repeated": ("words", "windows"),
    "n_repeat_words": ("words", "windows", "repeated"),
}
#: The work of a measure: SQL over the same columns, in nanoseconds or so of one core. Counted, not timed, so that a
#: sample always gives the same order.
WORK: dict[str, str] = {
    "words": "9 * length(text_)",
    "word_chars": "1 * length(text_) + 20 * size(words)",
    "n_symbols": "8 * length(text_)",
    "n_upper": "12 * length(text_)",
    "n_letterless": "150 * size(words)",
    "lines": "3 * length(text_)",
    "n_dup_lines": "60 * size(lines)",
    "n_bullets": "80 * size(lines)",
    "n_ellipses": "120 * size(lines)",
    "windows": "400 * size(words) + 60 * size(words) * log2(size(words) + 1)",
    "repeated": "80 * size(words)",
    "n_repeat_words": "100 * size(repeated)",
}


@dataclass(frozen=True)
class Rule:
    """name, the measures that it looks at, and the SQL condition on them under which a document is rejected."""

    name: str
    measures: tuple[str, ...]
    rejects: str

    def needs(self) -> list[str]:
        wanted = {m for n in self.measures for m in (*NEEDS.get(n, ()), n)}
        return [m for m in MEASURES if m in wanted]


#: The rules that decide base_failed.
BASE = (
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
)
#: The further rules of the cascade: share of symbols to words, of capitals to characters, of repeated lines, the mean
#: length of words, words without a letter, and lines that begin with a bullet or end with an ellipsis.
FURTHER = (
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > 3 * n_words"),
    Rule("capitals", ("n_upper", "n_chars_"), "100 * n_upper > 45 * n_chars_"),
    Rule("repeated_lines", ("lines", "n_dup_lines"), "2 * n_dup_lines > size(lines)"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("letterless", ("n_words", "n_letterless"), "5 * n_letterless > n_words"),
    Rule("bullets", ("lines", "n_bullets"), "10 * n_bullets > 9 * size(lines)"),
    Rule("ellipses", ("lines", "n_ellipses"), "10 * n_ellipses > 3 * size(lines)"),
)
#: Rows of the sample on which cost and selectivity are estimated, and the share that hashes let into it where the table
#: is large enough. The sample only sets the order of evaluation.
SAMPLE_ROWS, SAMPLE_ONE_IN = 500, 8


def _names(sql: str) -> str:
    """The measures' names in sql, as columns of the working frame: q_<name>."""
    return re.sub(r"(?<!\.)\b(" + "|".join(sorted(MEASURES, key=len, reverse=True)) + r"|text_)\b", r"q_\1", sql)


def _measured(df: DataFrame, names: list[str], only_if: str | None = None) -> DataFrame:
    """df with the measures that it doesn't have yet, each in a projection of its own; null where only_if is false."""
    for name in names:
        # one that is there was computed for all rows that are still alive, or more
        if f"q_{name}" not in df.columns:
            sql = MEASURES[name]
            df = df.withColumn(f"q_{name}", F.expr(_names(f"CASE WHEN {only_if} THEN {sql} END" if only_if else sql)))
    return df


@dataclass(frozen=True)
class Estimate:
    """Of each sampled row: the work of every measure, and the names of the rules that reject it."""

    rows: list[tuple[dict[str, float], frozenset[str]]]

    def of(self, rule: Rule, known: set[str] = frozenset(), left: list[int] | None = None) -> tuple[float, float]:
        """(work a row, share rejected) of a rule among the rows left, given the measures known."""
        rows = [self.rows[i] for i in left] if left is not None else self.rows
        new = [m for m in rule.needs() if m in WORK and m not in known]
        return sum(w[m] for w, _ in rows for m in new) / max(1, len(rows)), sum(rule.name in r for _, r in rows) / max(1, len(rows))


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Estimate:
    """Work and rejections on sample_rows rows: those that hashes of the texts choose, of the first files that have
    enough of them; all rows that are found where there are fewer. An empty table gives an empty estimate."""
    text = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("q_text_"))

    def taken(sample: DataFrame) -> list:
        sample = _measured(sample, [m for m in MEASURES if any(m in r.needs() for r in rules)])
        work = [F.expr(_names(WORK[m])).cast("double").alias(f"w_{m}") for m in WORK if f"q_{m}" in sample.columns]
        # a limit at the root: Spark takes rows of few partitions, and they come to the driver as some numbers each
        return sample.select(*work, *[F.coalesce(F.expr(_names(r.rejects)), F.lit(False)).alias(f"r_{r.name}") for r in rules]).limit(sample_rows).collect()

    rows = taken(text.filter(F.pmod(F.xxhash64("q_text_"), F.lit(SAMPLE_ONE_IN)) == 0))
    if len(rows) < sample_rows:
        rows = taken(text)
    split = lambda r: ({k[2:]: v for k, v in r.items() if k[:2] == "w_"}, frozenset(k[2:] for k, v in r.items() if k[:2] == "r_" and v))
    return Estimate([split(r.asDict()) for r in rows])


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", known: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules by rejections per cost, each among the sampled rows that those before it leave. Measures that are known
    anyway cost nothing. Rules that reject nothing of what is left come last, cheapest first."""
    found = estimate(docs, rules, text_col)
    have, left, rest, out = set(known), list(range(len(found.rows))), list(rules), []
    while rest:

        def key(rule: Rule) -> tuple:
            cost, share = found.of(rule, have, left)
            return -share / (cost + 1.0), cost, rule.name

        best = min(rest, key=key)
        out.append(best)
        rest.remove(best)
        have |= set(best.needs())
        left = [i for i in left if best.name not in found.rows[i][1]]
    return tuple(out)


def cascade(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", verdict: str = "kept", out: tuple[str, ...] = (), dead: str = "false") -> DataFrame:
    """docs with a boolean column verdict, false where a rule rejects, and the measures named in out (of every row).

    No rule looks at rows for which dead is true, a condition on the measures named in out; their verdict is false. A
    null text is an empty one. A column of docs that is already called like verdict or a measure in out is replaced.
    Repeated rows are judged each, ties can't arise, an empty table gives an empty one. Texts of any length are
    measured whole.
    """
    own = [c for c in docs.columns if c != verdict and c not in out]
    # under names of their own meanwhile, so that none can clash with a measure
    df = docs.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(own)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("q_text_"))
    for name in out:
        df = _measured(df, [m for m in MEASURES if m in (*NEEDS.get(name, ()), name)])
    df = df.withColumn("q_alive", F.expr(f"NOT coalesce({_names(dead)}, false)"))
    for rule in rules:
        df = _measured(df, rule.needs(), "q_alive")
        df = df.withColumn("q_alive", F.expr(f"CASE WHEN q_alive THEN NOT coalesce({_names(rule.rejects)}, false) ELSE false END"))
    return df.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(own)], *[F.col(f"q_{m}").alias(m) for m in out], F.col("q_alive").alias(verdict))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base measures, base_failed and kept, by the production rules. The base measures are part of the
    result and so measured for every row; the cascade saves the rest."""
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    known = {m for n in out for m in (*NEEDS.get(n, ()), n)}
    failed = " OR ".join(f"({r.rejects})" for r in BASE)
    df = cascade(docs, ordered(docs, FURTHER, text_col, tuple(known)), text_col, "kept", out, failed)
    return df.withColumn("base_failed", F.expr(failed))


def kept_only(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no production rule rejects, with the columns of docs."""
    longest = max(map(len, docs.columns))
    verdict, row = "q" * (longest + 1), "r" * (longest + 1)  # names that docs doesn't have
    judged_ = cascade(docs, ordered(docs, BASE + FURTHER, text_col), text_col, verdict)
    # the row number keeps the filter above the measures: pushed below, it would compute them anew for every use
    return judged_.withColumn(row, F.monotonically_increasing_id()).filter(f"{verdict} AND {row} >= 0").drop(verdict, row)
