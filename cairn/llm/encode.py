"""Encoding of a corpus with a public byte-level BPE, as a monoid tree reduction.

A text is halved recursively down to leaves, leaves are encoded on their own, and neighbours are joined by
re-encoding a window around their border. The window grows, on both sides, to the nearest *stable cut*: a
place between a character that is no white space and a following space or newline. No pre-token of the
vocabulary's pattern spans such a place, and what the pattern matches on either side does not depend on the
other side (its only look-ahead, ``\\s+(?!\\S)``, ends at a non-space; its contractions hold no space), so the
tokens outside the window are final. A node therefore is either text without a stable cut, or
``(text before its first cut, ids between first and last cut, text after its last cut)``; joining is
associative, and every character is encoded once per level only if it lies in a window.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's pre-token pattern, as its publisher states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary files lie; every entry point takes another path.
TOKENIZERS = os.environ.get("CAIRN_TOKENIZERS", "/opt/tokenizers")
LEAF_CHARS = 4096

_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
_loaded: dict = {}


def load(directory: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The encoding, once per process. Strings of special tokens are ordinary text."""
    if (key := (directory, name)) not in _loaded:
        import tiktoken

        with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


class TreeEncoder:
    """Encodes any text by the tree; equal to encoding it in one piece."""

    def __init__(self, encode, leaf_chars: int = LEAF_CHARS):
        self.encode, self.leaf_chars = encode, max(2, leaf_chars)

    def _leaf(self, text: str):
        first = _CUT.search(text)
        if first is None:
            return (text, None, None)
        last = first.start()
        at = max(text.rfind(" "), text.rfind("\n"))
        while at > last:  # walk back to the last stable cut
            if _CUT.match(text, at):
                last = at
                break
            at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
        return (text[: first.start()], self.encode(text[first.start() : last]), text[last:])

    def _join(self, a, b):
        if a[1] is None and b[1] is None:
            return self._leaf(a[0] + b[0])
        if a[1] is None:
            window = self._leaf(a[0] + b[0])
            if window[1] is None:
                return (window[0], b[1], b[2])
            return (window[0], window[1] + self.encode(window[2]) + b[1], b[2])
        if b[1] is None:
            window = self._leaf(a[2] + b[0])
            if window[1] is None:
                return (a[0], a[1], window[0])
            return (a[0], a[1] + self.encode(window[0]) + window[1], window[2])
        return (a[0], a[1] + self.encode(a[2] + b[0]) + b[1], b[2])

    def _node(self, text: str, lo: int, hi: int):
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(self._node(text, lo, mid), self._node(text, mid, hi))

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf_chars:
            return self.encode(text)
        head, ids, tail = self._node(text, 0, len(text))
        return self.encode(head) if ids is None else self.encode(head) + ids + self.encode(tail)


def ids_udf(directory: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf_chars: int = LEAF_CHARS):
    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = TreeEncoder(load(directory, name).encode_ordinary, leaf_chars)
        for texts in parts:
            yield pd.Series([tree(t) if t else [] for t in texts], index=texts.index, dtype=object)

    return ids


def count_udf(directory: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf_chars: int = LEAF_CHARS):
    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = TreeEncoder(load(directory, name).encode_ordinary, leaf_chars)
        for texts in parts:
            yield pd.Series([len(tree(t)) if t else 0 for t in texts], index=texts.index, dtype="int64")

    return count


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", *, directory: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``out``; one output row per input row, no shuffle.

    Empty and NULL text give an empty list, an empty table an empty table; repeated rows are encoded like
    any other. A column already called ``out`` is replaced.
    """
    return df.withColumn(out, ids_udf(directory, name, leaf_chars)(F.col(text)))


def decode_corpus(df: DataFrame, ids: str = "ids", out: str = "decoded", *, directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The inverse of :func:`encode_corpus`: the tokens' bytes concatenate, so any split of ids may be decoded apart and joined as bytes."""

    @F.pandas_udf("string")
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load(directory, name)
        for lists in parts:
            yield pd.Series([None if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in lists], index=lists.index, dtype=object)

    return df.withColumn(out, back(F.col(ids)))
