"""Text sizes in tokens of a public tokenizer. The vocabulary's path is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

#: Folder of vocabulary files; the environment variable overrides it.
TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the byte-level rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: what the split pattern takes for white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A pre-token holds white space at its start or throughout, so one always ends between a visible character and white space.
#: Texts are handed over in stretches of about this length that end there, which changes no count.
_STRETCH = 100_000
_BORDER = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: White space of this length or more is merged by itself: the split pattern would step back through all of it.
_BLANK = re.compile(rf"[{_SPACE}]{{5000,}}")


@lru_cache(4)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of `text`, as many as if it were encoded in one go; 0 for null."""
    if not text:
        return 0
    enc = encoder(vocabulary)
    if len(text) <= _STRETCH:
        return len(enc.encode_ordinary(text)) if _BLANK.search(text) is None else _count_long(enc, text)
    return _count_long(enc, text)


def _count_long(enc, text: str) -> int:
    total, at = 0, 0
    for m in _BLANK.finditer(text):
        # Before a visible character the last blank belongs to what follows.
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += _count_stretches(enc, text[at : m.start()]) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return total + _count_stretches(enc, text[at:])


def _count_stretches(enc, text: str) -> int:
    total, at = 0, 0
    while len(text) - at > _STRETCH:
        m = _BORDER.search(text, at + _STRETCH)
        end = m.start() if m else len(text)
        total, at = total + len(enc.encode_ordinary(text[at:end])), end
    return total + len(enc.encode_ordinary(text[at:]))


def token_sizes(df: DataFrame, id_col: str, text_col: str, keep: list[str] = (), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens, *keep) for every row of `df`; a null or empty text has 0 tokens."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [count_tokens(t if isinstance(t, str) else None, vocabulary) for t in b["_text"]]
            yield b.drop(columns="_text").assign(n_tokens=n)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", n_tokens long"
    return spread(df.select(id_col, *keep, F.col(text_col).alias("_text"))).mapInPandas(sizes, schema)
