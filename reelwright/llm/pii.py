"""Personal data by patterns, and information-theoretic sanitisation of the terms that give it away.

The protected entities are the values that the patterns find, and what they generalise to: the host of an address, the
network, issuer or prefix of a number, and the kind itself. A term in the same document as an entity discloses it as
far as seeing the term tells that the entity is there: PMI(term; entity) = log2(p(entity | term) / p(entity)), as a
share of the entity's information content -log2 p(entity), the most that can be disclosed (Sanchez and Batet,
"C-sanitized"). All probabilities are shares of the corpus' different texts, exact copies counting once; of the texts
that hold both, one is taken off, as it may do so by chance. A term discloses an entity if its share reaches the
threshold, if it leaves no more than one bit of doubt (it is rather there than not), and if so many texts hold both
that chance doesn't explain it: in a corpus in which nothing belongs together, FALSE_PAIRS of all pairs of an entity
and a term would be expected at most (by a bound that is some times too high). Such a term is marked in every document that holds it, with the entity or
without. When texts are sanitised, a term that discloses entities of one kind is generalised to that kind, one of
several kinds is removed.
Everything here is Spark SQL functions and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import discard, stored

#: The kinds in their order. Patterns are possessive where giving back can't help, so that matching takes linear time
#: and no stack; a look-behind (or the end of the match before, \G) keeps a match from being tried within a run.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold at least for its kind to be looked for.
TRIGGERS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: A term is a run of letters outside of all matches, of any length.
TERM_PATTERN = r"\p{L}++"
#: The share of an entity's information content that a term may disclose, and the different texts holding both that are
#: needed before anything is concluded from a term.
DISCLOSURE, CONTEXTS = 0.75, 3
#: The doubt in bits that a disclosing term may leave, and the pairs that chance may explain.
DOUBT, FALSE_PAIRS = 1.0, 5.0
#: Up to so many terms beside personal data (some 50 bytes each) are sent to all tasks, to be counted alone; beyond, all
#: terms are.
BROADCAST_TERMS = 500_000
_OPEN, _SHUT, _NEITHER = "\x01", "\x02", "\x03"


def _split_at(text: Column, pattern: str) -> Column:
    """The text in parts: what is before the first match, then for each match it, a mark, and what follows up to the next."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN)


def _places(parts: Column) -> Column:
    """array<struct<start, value>> of the matches in such parts; offsets count code points."""
    first = F.struct(F.length(parts[0]).cast("int").alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        match = F.struct(s["at"].alias("start"), F.substring_index(part, _SHUT, 1).alias("value"))
        return F.struct((s["at"] + F.length(part) - 1).cast("int").alias("at"), F.array_append(s["found"], match).alias("found"))

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), first, step, lambda s: s["found"])


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """What counts as the same entity: addresses without regard to case, numbers without separators."""
    same = F.lower(value) if kind in ("email", "ip") else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), same)


def levels(entity: Column) -> Column:
    """An entity, its host (email), network of two parts (ip), issuer of six or prefix of four digits, and its kind."""
    kind, value = F.substring_index(entity, ":", 1), F.substring_index(entity, ":", -1)
    group = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "card", F.left(value, F.lit(6))).otherwise(F.left(value, F.lit(4)))
    return F.array(entity, F.concat(kind, F.lit("/"), group), kind)


def _plain(text_col: str) -> tuple[Column, Column]:
    """The text (a null one is empty), and the same without the marks used here."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return text, F.replace(F.replace(text, F.lit(_OPEN), F.lit(_NEITHER)), F.lit(_SHUT), F.lit(_NEITHER))


def _blanked(text: Column, found: Column) -> Column:
    """The text with every match overwritten, so that offsets stay."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, m: Column) -> Column:
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.repeat(F.lit(_NEITHER), m["end"] - F.greatest(s["at"], m["start"])))
        return F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.when(m["end"] > s["at"], piece).otherwise(s["out"]).alias("out"))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table with a row per row of docs: pii_id, pii_key (a hash of the text), pii_found, the matches of all
    kinds as array<struct<start, rank, end, entity>>, by start, then kind, pii_forms, the different terms as written, and
    pii_row, a number of the row."""
    text, plain = _plain(text_col)
    df = docs.select(F.col(f"`{id_col}`").alias("pii_id"), F.xxhash64(text).alias("pii_key"), plain.alias("t"))
    df = df.select("*", *[F.when(F.col("t").rlike(TRIGGERS[k]), _split_at(F.col("t"), PATTERNS[k])).alias(f"parts_{k}") for k in KINDS])
    df = df.select("*", *[F.when(F.col(f"parts_{k}").isNotNull(), _places(F.col(f"parts_{k}"))).alias(f"at_{k}") for k in KINDS])

    def described(kind: str) -> Column:
        def one(m: Column) -> Column:
            end = m["start"] + F.length(m["value"])
            return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("int").alias("end"), _entity(kind, m["value"]).alias("entity"))

        return F.transform(F.filter(F.col(f"at_{kind}"), lambda m: _valid(kind, m["value"])), one)

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,entity:string>>")
    found = F.concat(*[F.coalesce(described(k), empty) for k in KINDS])
    df = df.select("pii_id", "pii_key", "t", F.when(F.coalesce(*[F.col(f"at_{k}") for k in KINDS]).isNotNull(), F.sort_array(found)).otherwise(empty).alias("pii_found"))
    forms = F.array_distinct(F.regexp_extract_all(_blanked(F.col("t"), F.col("pii_found")), F.lit(TERM_PATTERN), F.lit(0)))
    return stored(df.select("pii_id", "pii_key", "pii_found", forms.alias("pii_forms"), F.monotonically_increasing_id().alias("pii_row")), "pii-marks")


def _terms() -> Column:
    return F.array_distinct(F.transform("pii_forms", F.lower))


def disclosing(marks: DataFrame) -> DataFrame:
    """(entity, term, disclosure): the terms that disclose an entity, with the share of its information content. All
    counts are of whole texts, equal ones once."""
    copies = stored(marks.groupBy("pii_key").agg(F.count(F.lit(1)).alias("n"), F.min("pii_row").alias("kept")).filter("n > 1").withColumnRenamed("pii_key", "k"), "pii-copies")
    size = float(max(marks.count() - (copies.agg(F.sum(F.col("n") - 1)).first()[0] or 0), 1))
    texts = marks.join(copies, F.col("pii_key") == F.col("k"), "left").filter("kept IS NULL OR pii_row = kept")
    entities = F.array_distinct(F.flatten(F.transform("pii_found", lambda m: levels(m["entity"]))))
    mentions = stored(texts.filter(F.size("pii_found") > 0).select("pii_row", entities.alias("entities"), _terms().alias("terms")), "pii-mentions")
    # no term can stand in more texts with an entity than the entity does
    per_entity = mentions.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("entity_texts")).filter(F.col("entity_texts") >= CONTEXTS)
    per_entity = stored(per_entity, "pii-entities")
    # nor in more than there are texts with it and any entity
    spread = mentions.select(F.explode("terms").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONTEXTS)
    spread = stored(spread, "pii-spread")
    # summed up by term before anything is joined: how many rows a frequent term has doesn't matter
    words = texts.select(F.explode(_terms()).alias("w"))
    few = spread.count() <= BROADCAST_TERMS
    counted = (words.join(F.broadcast(spread.select("s")), F.col("w") == F.col("s"), "left_semi") if few else words).groupBy("w").agg(F.count(F.lit(1)).alias("term_texts"))
    # a term that too many texts without personal data hold leaves too much doubt about every entity
    clear = (F.col("n") - 1) / F.col("term_texts") >= 2.0**-DOUBT
    counted = stored(counted.join(spread, F.col("w") == F.col("s")).filter(clear).select("w", "term_texts"), "pii-terms")
    entity_of = mentions.select("pii_row", F.explode("entities").alias("entity"), F.size("terms").alias("held")).join(per_entity.select("e"), F.col("entity") == F.col("e"), "left_semi")
    # no more pairs than there are terms beside entities
    tried = float(entity_of.agg(F.sum("held")).first()[0] or 1)
    beside = mentions.select(F.col("pii_row").alias("r"), F.explode("terms").alias("term")).join(counted.select("w"), F.col("term") == F.col("w"), "left_semi")
    both = beside.join(entity_of, F.col("r") == F.col("pii_row")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both_texts"))
    pairs = both.filter(F.col("both_texts") >= CONTEXTS)
    content = -F.log2(F.col("entity_texts") / F.lit(size))
    told = (F.col("both_texts") - 1) / F.col("term_texts")
    pmi = content + F.log2(told)
    # Chernoff's bound on the chance that so many of the term's texts hold the entity
    mean = F.col("term_texts") * F.col("entity_texts") / F.lit(size)
    chance = F.col("both_texts") * (1 + F.ln(mean / F.col("both_texts"))) - mean
    scored = pairs.join(per_entity, F.col("entity") == F.col("e")).join(counted, F.col("term") == F.col("w"))
    scored = scored.withColumn("disclosure", F.when(content > 0, pmi / content).otherwise(F.lit(0.0)))
    scored = scored.filter((told >= 2.0**-DOUBT) & (F.col("both_texts") > mean) & (chance <= math.log(FALSE_PAIRS / tried)))
    found = stored(scored.filter(F.col("disclosure") >= DISCLOSURE).select("entity", "term", "disclosure"), "pii-disclosing")
    discard(copies, mentions, per_entity, spread, counted)
    return found


def _extra(docs: DataFrame, marks: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(x_id, x_key, extra): the places of the terms (column w, and what: their more general term) in all documents that
    hold any."""
    forms = marks.select("pii_id", "pii_key", F.explode("pii_forms").alias("form")).join(terms, F.lower("form") == F.col("w"))
    held = forms.groupBy("pii_id", "pii_key").agg(F.collect_set(F.struct("form", "what")).alias("forms"))
    # forms are whole runs of letters, so nothing in them needs escaping
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("forms.form", "|"), F.lit(r")(?!\p{L})"))
    held = stored(held.select(F.col("pii_id").alias("x_id"), F.col("pii_key").alias("x_key"), pattern.alias("pattern"), F.map_from_entries("forms").alias("whats")), "pii-held")
    same = F.col("pii_id").eqNullSafe(F.col("x_id")) & (F.col("pii_key") == F.col("x_key"))
    found = marks.select("pii_id", "pii_key", "pii_found").join(held, same).dropDuplicates(["x_id", "x_key"]).select("x_id", "x_key", "pii_found", "pattern", "whats")
    text, plain = _plain(text_col)
    found = stored(found, "pii-patterns")
    texts = docs.select(F.col(f"`{id_col}`").alias("pii_id"), F.xxhash64(text).alias("pii_key"), plain.alias("t")).join(found, same).dropDuplicates(["x_id", "x_key"])
    marked = texts.select("x_id", "x_key", "whats", F.regexp_replace(_blanked(F.col("t"), F.col("pii_found")), F.col("pattern"), F.lit(f"{_OPEN}$0{_SHUT}")).alias("t"))
    what = lambda m: F.element_at("whats", m["value"]).alias("what")
    spans = F.transform(_places(F.split("t", _OPEN)), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), (m["start"] + F.length(m["value"])).cast("int").alias("end"), what(m)))
    out = stored(marked.select("x_id", "x_key", spans.alias("extra")), "pii-extra")
    discard(held, found)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(marks, extra): the table of :func:`mark`, and (x_id, x_key, extra: array<struct<start, rank, end, what>>) with
    the disclosing terms of the documents that have any.

    A null text is an empty one and holds nothing. Null ids stay; equal rows (same id and text) get the same spans
    each; other columns are ignored; an empty table gives empty ones. Matching takes time linear in the text.
    """
    marks = mark(docs, id_col, text_col)
    kinds = F.collect_set(F.regexp_extract("entity", "^[a-z]+", 0))
    # at most one element for each kind
    terms = disclosing(marks).groupBy(F.col("term").alias("w")).agg(kinds.alias("kinds"))
    terms = stored(terms.select("w", F.when(F.size("kinds") == 1, F.concat(F.lit("about "), F.col("kinds")[0])).otherwise(F.lit(TERM)).alias("what")), "pii-marked")
    return marks, _extra(docs, marks, terms, id_col, text_col)


def _all_spans() -> Column:
    names = F.array(*map(F.lit, KINDS))
    base = F.transform("pii_found", lambda m: F.struct(m["start"], m["rank"], m["end"], F.element_at(names, m["rank"] + 1).alias("what")))
    return F.sort_array(F.concat(base, F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int,what:string>>"))))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, TERM)))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["rank"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_<kind>, base_sha256 and spans (kind:start:end of code points, end exclusive)."""
    marks, extra = find(docs, id_col, text_col)
    both = marks.join(extra, F.col("pii_id").eqNullSafe(F.col("x_id")) & (F.col("pii_key") == F.col("x_key")), "left")

    def count(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.size(F.filter("pii_found", lambda m: m["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return both.select(F.col("pii_id").alias(id_col), *counts, F.sha2(_written(F.col("pii_found")), 256).alias("base_sha256"), _written(_all_spans()).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced in angle brackets (overlapping spans by the first): data by its kind, a
    disclosing term by "about" and the kind that it discloses, or by "term" if they are several.

    Rows without spans, null texts among them, stay as they are, and so do all other columns, whatever their names.
    """
    marks, extra = find(docs, id_col, text_col)
    both = marks.select("pii_id", "pii_key", "pii_found").join(extra, F.col("pii_id").eqNullSafe(F.col("x_id")) & (F.col("pii_key") == F.col("x_key")), "left")
    both = both.filter((F.size("pii_found") > 0) | F.col("extra").isNotNull()).dropDuplicates(["pii_id", "pii_key"])
    spans = stored(both.select("pii_id", "pii_key", _all_spans().alias("pii_spans")), "pii-spans")
    discard(marks, extra)
    own = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("pii_own"))
    joined = keyed.join(spans, F.col(own[id_col]).eqNullSafe(F.col("pii_id")) & (F.col("pii_own") == F.col("pii_key")), "left")
    text = F.col(own[text_col])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, m: Column) -> Column:
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit("<"), m["what"], F.lit(">"))
        return F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.when(m["start"] >= s["at"], piece).otherwise(s["out"]).alias("out"))

    written = F.aggregate("pii_spans", first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return joined.select(*[(F.when(F.col("pii_spans").isNotNull(), written).otherwise(text) if c == text_col else F.col(n)).alias(c) for c, n in own.items()])
