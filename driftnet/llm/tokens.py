"""Text sizes in tokens of a public byte-level BPE vocabulary, read from a path given as parameter."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the vocabulary (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1 << 19
_UNEVEN = re.compile(r"\A\s| \s|\s |\s\Z")


class Counter:
    """Counts tokens; words seen before are looked up.

    Where every space stands between two non-space characters a token can't reach over it, so that the count of a text is the
    sum over its space-separated parts; other texts are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self.encoding.encode_ordinary

        class Known(dict):
            def __missing__(self, part):
                n = len(encode(" " + part))
                if len(self) >= CACHE:
                    self.clear()
                self[part] = n
                return n

        self.known = Known()

    def count(self, text: str) -> int:
        if _UNEVEN.search(text):
            return len(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        return len(self.encoding.encode_ordinary(first)) + sum(map(self.known.__getitem__, rest))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text, path: str = VOCABULARY):
    """Column of token counts; null texts count 0, like empty ones. The vocabulary must be at ``path`` on every executor."""

    def count(s: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([c.count(x) if x else 0 for x in s], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)
