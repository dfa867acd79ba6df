"""How far the sources of each language are apart in their use of terms, in exact whole numbers.

A term's counts by source are a sparse vector, and very many terms have the same one (most occur a few times in one
source). Terms are grouped by that vector, every pair of sources is evaluated once for each distinct vector and the
value counts as often as the vector has terms; only the report of single terms goes back to the terms.

Sources that a vector lacks are not gone through either. With f the divergence of two rates and z the rate of a count
of zero, the sum over all terms of f(p, q) for the sources a and b is

    V f(za, zb)  +  sum over terms of a: f(p, zb) - f(za, zb)  +  sum over terms of b: f(za, q) - f(za, zb)
                 +  sum over terms of both: f(p, q) - f(p, zb) - f(za, q) + f(za, zb)

of which the second and third need only how many terms have which rate in a source, and the last only vectors that
hold both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import discard, stored

#: Letters A-Z that are lower-cased, what a term is made of, and the scale of the rates.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM, SCALE = r"[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", 1_000_000_000
#: Pairs of sources whose sums a task holds before it passes them on.
HELD = 1 << 21


def _divergence(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def _rate(count: str, total: str) -> F.Column:
    """The rate of a count in a total (which has 2 added for each kept term), as a whole number."""
    return F.expr(f"1 + ({SCALE}L * ({count} + 2)) div nullif({total}, 0)")


def term_vectors(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, vec): of each term in at least min_docs rows of its lang, the counts by source, in order of sources.

    docs has text, lang and source without nulls. Repeats within a row are summed up by the task that reads it.
    """
    ordered = docs.select("lang", "source", F.expr(f"sort_array(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}', 0))").alias("terms"))
    before = F.expr("concat(array(cast(null as string)), slice(terms, 1, greatest(size(terms) - 1, 0)))")
    each = ordered.select("lang", "source", F.inline(F.arrays_zip(F.col("terms"), before.alias("last"))).alias("term", "last"))
    # the zip is one longer than the terms of a text without any
    each = each.filter("term IS NOT NULL").select("lang", "source", "term", (~F.col("term").eqNullSafe(F.col("last"))).cast("long").alias("new"))
    counts = each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("rows"))
    of = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"), F.sum("rows").alias("rows"))
    return of.filter(F.col("rows") >= min_docs).select("lang", "term", "vec")


def distinct_vectors(terms: DataFrame, top: int) -> DataFrame:
    """(vec_no, lang, vec, often, total, names): each distinct vector, how many terms have it, and the first top of them.

    Both a count and a window's first rows are cut down before the shuffle, so a vector that very many terms have is no
    large group.
    """
    often = terms.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("often"))
    first = terms.withColumn("k", F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))).filter(F.col("k") <= top)
    first = first.groupBy("lang", "vec").agg(F.collect_list("term").alias("names"))
    both = often.join(first, ["lang", "vec"])
    return both.select(F.monotonically_increasing_id().alias("vec_no"), "lang", "vec", "often", F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("total"), "names")


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value), a < b: sums over vectors of what pairs of sources that both occur add, as far as one task has them."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        a, b, value = a[order], b[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.add.reduceat(value, first)

    held, n = [], 0
    for batch in batches:
        often = batch.column(0).to_numpy()
        at = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).flatten()
        group, rate, zero = (flat.field(i).to_numpy() for i in range(3))
        at = at - at[0]
        for k, m in enumerate(often.tolist()):
            x = slice(at[k], at[k + 1])
            i, j = np.triu_indices(x.stop - x.start, 1)
            g, p, z = group[x], rate[x], zero[x]
            held.append((g[i], g[j], m * (f(p[i], p[j]) - f(p[i], z[j]) - f(z[i], p[j]) + f(z[i], z[j]))))
            n += len(i)
            if n > HELD:
                held = [summed(held)]
                n = len(held[0][0])
                if n > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["a", "b", "value"])
                    held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed(held)], ["a", "b", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """Per (lang, source) group of docs: lang, source, part, item, value, rank.

    Part `pair` has every other source of the lang and the sum of f over all kept terms of the lang, part `term` the
    group's first `top` terms by f against the whole lang, of those that it uses more often. A kept term is in at least
    min_docs rows of its lang; its rate is p = 1 + floor(10^9 (count + 2) / (N + 2V)) with N the counts and V the number
    of kept terms, and f = floor((p - q)^2 / (p + q)). Ranks are by value, descending, then by item.

    Null texts, langs and sources count as empty strings; a group without terms, and a lang without kept terms, have
    their pairs (of value 0, if V = 0) and no terms. Rows are documents, equal ones and repeated ids too. A lang of one
    source has no pairs, an empty table no rows; other columns are ignored. Texts count whole. What is returned has a
    row for each pair of sources of a lang, and so is quadratic in a lang's sources.
    """
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    terms = stored(term_vectors(docs, min_docs), "audit-terms")
    vectors = stored(distinct_vectors(terms, top), "audit-vectors")
    discard(terms)
    entries = vectors.select("vec_no", "lang", "often", "total", F.inline("vec").alias("source", "n"))

    # the groups with their totals: as many rows as there are groups
    per_group = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("often")).alias("n"))
    per_lang = vectors.groupBy("lang").agg(F.sum("often").alias("v"), F.sum(F.col("total") * F.col("often")).alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = groups.select("lang", "source", "v", (F.col("n") + 2 * F.col("v")).alias("size"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_size"))
    groups = stored(groups.select("*", F.monotonically_increasing_id().alias("g"), _rate("0", "size").alias("zero")), "audit-groups")
    rates = entries.join(groups, ["lang", "source"]).select("vec_no", "often", "lang", "source", "g", "zero", _rate("n", "size").alias("p"), _rate("total", "lang_size").alias("q"))
    rates = stored(rates, "audit-rates")

    over = rates.filter("p > q").select("vec_no", "lang", "source", "g", F.expr(_divergence("p", "q")).alias("value"))
    named = over.join(vectors.select("vec_no", F.explode("names").alias("item")), "vec_no")
    best = Window.partitionBy("g").orderBy(F.col("value").desc(), "item")
    of_terms = named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    a = groups.select("lang", "source", "v", F.col("g").alias("a"), F.col("zero").alias("za"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("zero").alias("zb"))
    base = a.join(b, "lang").filter("a <> b").select("a", "b", "lang", "source", "item", F.coalesce(F.expr(f"v * {_divergence('za', 'zb')}"), F.lit(0).cast("long")).alias("value"))
    # how many terms have which rate in a source; different rates of a source are few
    spread = rates.groupBy("lang", F.col("g").alias("a"), F.col("zero").alias("za"), "p").agg(F.sum("often").alias("often"))
    one = spread.join(b, "lang").filter("a <> b").groupBy("a", "b").agg(F.sum(F.expr(f"often * ({_divergence('p', 'zb')} - {_divergence('za', 'zb')})")).alias("value"))
    shared = rates.groupBy("vec_no").agg(F.first("often").alias("often"), F.sort_array(F.collect_list(F.struct("g", "p", "zero"))).alias("of")).filter("size(of) > 1")
    two = shared.select("often", "of").mapInArrow(_both, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))
    parts = [base]
    for part in (one, two):
        no_names = [F.lit(None).cast("string").alias(c) for c in ("lang", "source", "item")]
        parts.append(part.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("x.a", "x.b", *no_names, "value"))
    all_parts = parts[0].union(parts[1]).union(parts[2])
    summed = all_parts.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("lang", "source", "item")], F.sum("value").alias("value"))
    by_value = Window.partitionBy("a").orderBy(F.col("value").desc(), "item")
    of_pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return of_pairs.union(of_terms)
