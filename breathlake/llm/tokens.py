"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the public vocabularies; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How this vocabulary splits text before merging (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(folder: str, name: str):
    """Loaded once a Python worker."""
    import tiktoken

    with open(os.path.join(folder, name)) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each document's whole text.

    Null and empty texts have 0 tokens. Strings that look like special tokens
    count as ordinary text. Texts pass to Python in Arrow batches; no shuffle.
    """
    rows = docs.select(*keep, text)
    schema = rows.drop(text).schema.add("n_tokens", T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(count, schema)
