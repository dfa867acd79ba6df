"""BPE encoding and decoding of whole texts, with forced boundaries.

A pair of bytes that is adjacent inside no vocabulary token can never end up inside one token, so every place where
such a pair occurs is a certain cut. A word is split there, its fragments are encoded independently (and remembered:
they recur far more often than words), and the results are concatenated.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import byte_letters, tokenizer

#: The word pattern of this vocabulary family (fixed value, published with CLIP).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Outside these code points (where the library and Python agree on case and classes; tests compare them one by one)
#: normalising and cutting are left to the library.
UNSURE = regex.compile(r"[^\u0000-ͯЀ-ӿ‐-⁆ぁ-ゖァ-ヺ一-龥가-힣]")
#: Words and fragments that a Python worker remembers; when full, the memory starts anew.
REMEMBERED = 150_000


def inner_pairs(path: str) -> frozenset[str]:
    """All pairs of byte letters that are adjacent inside some vocabulary token: 65,536 at most."""
    end = tokenizer(path).model.end_of_word_suffix or ""
    return frozenset(t[i : i + 2] for t in (v.removesuffix(end) for v in tokenizer(path).get_vocab()) for i in range(len(t) - 1))


def cut_at_boundaries(word: str, inner: frozenset[str]) -> list[str]:
    """The fragments of a word (in byte letters) between its forced boundaries."""
    cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inner), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Encoder(dict):
    """Packed ids by word; a word that is not known yet is cut at its boundaries and encoded by fragments."""

    def __init__(self, path: str, inner: frozenset[str]):
        super().__init__()
        self.path, self.inner, self.letters, self.fragments = path, inner, byte_letters(), {}
        self.last = tokenizer(path).model
        # the same merges for fragments that don't end the word
        self.other = self._without_word_end(path) if self.last.end_of_word_suffix else self.last
        added = tokenizer(path).get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, sorted(self.special)))})") if self.special else None

    @staticmethod
    def _without_word_end(path: str):
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return BPE(vocab=model["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.fragments) > REMEMBERED:
            self.fragments.clear()
        parts = cut_at_boundaries("".join([self.letters[b] for b in word.encode()]), self.inner)
        found = b"".join([*(self._fragment(p, False) for p in parts[:-1]), self._fragment(parts[-1], True)])
        if len(word) < 64:
            self[word] = found
        return found

    def _fragment(self, part: str, last: bool) -> bytes:
        if (found := self.fragments.get((part, last))) is None:
            found = array("I", [t.id for t in (self.last if last else self.other).tokenize(part)]).tobytes()
            if len(part) < 64:
                self.fragments[part, last] = found
        return found

    def words(self, text: str) -> list[str]:
        if UNSURE.search(text) is None:
            return WORDS.findall(unicodedata.normalize("NFC", text).lower())
        whole = tokenizer(self.path)
        text = whole.normalizer.normalize_str(text)
        letters = {c: b for b, c in enumerate(self.letters)}
        return [bytes(letters[c] for c in w).decode() for w, _ in whole.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of special tokens become these tokens."""
        if self.cut is None or "<" not in text:
            return b"".join(map(self.__getitem__, self.words(text)))
        out = []
        for part in self.cut.split(text):
            out.append(array("I", [self.special[part]]).tobytes() if part in self.special else b"".join(map(self.__getitem__, self.words(part))))
        return b"".join(out)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker: what it remembers serves all tasks that the worker runs."""
    return Encoder(path, inner_pairs(path))


@functools.cache
def strings(path: str) -> list[str]:
    """The vocabulary's strings by id."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for k, v in vocab.items():
        out[v] = k
    return out


def decoded(ids: bytes, path: str) -> str:
    """Token strings joined by a space, as the library's decode() does for a vocabulary without a decoder."""
    return " ".join(map(strings(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id_col, the columns in keep, n_tokens, ids (binary, little-endian unsigned 32-bit) and, with
    decode, decoded: the text that these ids decode to, made by the same worker.

    A null text is encoded as an empty one, to no ids and back to an empty text. Null ids stay, repeated rows are
    encoded each, other columns are not returned, an empty table gives an empty one; texts of any length are encoded
    whole.
    """
    kept = (id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path).ids
        for batch in batches:
            ids = [to_ids(v.as_py() or "") for v in batch.column(0)]
            out = {f"k{i}": batch.column(i + 1) for i in range(len(kept))} | {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decode:
                out["decoded"] = pa.array([decoded(x, path) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = docs.select(F.col(f"`{text_col}`").alias("text"), *named).mapInArrow(run, f"{kinds}, n_tokens long, ids binary" + ", decoded string" * decode)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)})


def decode(ids: F.Column | str, path: str):
    """A column of text from a column of packed ids. Null ids decode to null, no ids to an empty text."""

    @F.pandas_udf("string")
    def text(packed):
        return packed.map(lambda b: None if b is None else decoded(b, path))

    return text(ids)
