"""Token counts of whole texts by a byte-level BPE, with a whole-token shortcut.

Most pieces that the pre-tokenizer cuts are themselves vocabulary entries. For those no merge has to be run, provided
that the merges really lead to that entry; :func:`prove_whole_tokens` establishes this once for the vocabulary.
Counting then is one set lookup for a proved piece and a merge run for the others, whose counts are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import byte_letters, tokenizer

#: The split pattern of byte-level BPE (fixed value, published with GPT-2).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points whose character classes have long been stable: there SPLIT and the library cut alike (tests compare
#: them one by one). Texts with any other code point are cut by the library itself.
UNSURE = regex.compile(r"[^\u0000-ӿ‐-⁆ぁ-ゖァ-ヺ一-龥가-힣]")
#: Remembered counts of merged pieces in each Python worker; when full, the memory starts anew.
REMEMBERED = 150_000


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings (as the pre-tokenizer spells them) that the merges turn into exactly one token.

    The proof is by running: every entry goes once through the merge model. Its size is bounded by the vocabulary's.
    """
    model = tokenizer(path).model
    special = {t.content for t in tokenizer(path).get_added_tokens_decoder().values()}
    return frozenset(v for v in tokenizer(path).get_vocab() if v not in special and [t.value for t in model.tokenize(v)] == [v])


class _Merged(dict):
    """Counts by piece; a piece that is not known yet is spelled in byte letters and merged."""

    def __init__(self, whole: frozenset[str], path: str):
        super().__init__()
        self.model, self.letters = tokenizer(path).model, byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        for v in whole:
            try:
                self[bytes(back[c] for c in v).decode()] = 1
            except UnicodeDecodeError:  # part of a character: never a piece of its own
                continue
        self.proved = dict(self)

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.proved) + REMEMBERED:
            self.clear()
            self.update(self.proved)
        count = len(self.model.tokenize("".join([self.letters[b] for b in piece.encode()])))
        if len(piece) < 64:
            self[piece] = count
        return count


def _pieces(text: str, path: str) -> list[str]:
    if UNSURE.search(text) is None:
        return SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as an empty one: 0 bytes, 0 tokens. A null id stays null, repeated rows are counted each, other
    columns are left alone and not returned, an empty table gives an empty one. A special token's string inside a
    text is one token, as the library has it by default. Texts of any length are counted whole.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Merged(whole.value, path)
        special = sorted(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
        cut = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        get = counts.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                parts = cut.split(text)
                n_tokens.append(len(parts) - 1 + sum(sum(map(get, _pieces(part, path))) for part in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
