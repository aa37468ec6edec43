"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Vocabulary file; every executor must be able to read it.
RANKS = os.environ.get("WEFTLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in parts of about this many characters, cut before a blank; a text
#: without blanks is one part.
PART = 1 << 16


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; loaded once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str = RANKS) -> int:
    """Number of tokens; null and empty texts have none, special tokens' strings are ordinary text."""
    if not text:
        return 0
    enc, n, start = encoding(path), 0, 0
    while len(text) - start > 2 * PART:
        stop = start + PART
        # a cut before a single blank between two words is a cut between tokens
        while stop < len(text) and not (text[stop] == " " and text[stop - 1].isalnum() and text[stop + 1 : stop + 2].isalnum()):
            stop += 1
        n += len(enc.encode_ordinary(text[start:stop]))
        start = stop
    return n + len(enc.encode_ordinary(text[start:]))


def with_sizes(documents: DataFrame, keep: list[str], path: str = RANKS) -> DataFrame:
    """``keep`` columns of each row and n_tokens of its text."""
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [n_tokens(t, path) for t in batch["text"]]
            if sizes:
                yield batch[keep].assign(n_tokens=pd.array(sizes, "int64"))

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, f"{kinds}, n_tokens bigint")
