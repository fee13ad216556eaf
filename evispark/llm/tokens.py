"""Token counts by a public tokenizer whose vocabulary file lies outside the repository."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and the one that is used unless another is named.
TOKENIZERS = os.environ.get("EVISPARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file; kept per process."""
    import tiktoken

    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


class Counter(dict):
    """Token counts of words, each encoded once.

    The pattern always splits before a space that a character follows, unless white space surrounds that space; so the
    count of a text is the sum over its words with their leading space. Texts where it isn't are encoded as a whole.
    """

    MOST = 400_000
    _RUNS = re.compile(r"\s (?:\s|$)")

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.encode(word))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._RUNS.search(text):
            return len(self.encode(text))
        if len(self) > self.MOST:
            self.clear()
        first, *rest = text.split(" ")
        return (self[first] if first else 0) + sum(map(self.__getitem__, [" " + w for w in rest]))


def token_counts(df: DataFrame, columns: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """``columns`` of ``df`` and ``n_tokens BIGINT``; null and empty texts have none. Whole texts are counted."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            n = pa.array([counter.count(t) for t in batch.column(len(columns)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], n], names=[*columns, "n_tokens"])

    return df.select(*columns, F.col(text_col).alias("__text")).mapInArrow(run, schema + ", n_tokens bigint")
