"""Sizes of texts in tokens of public tokenizers.

The vocabularies are read from a folder (a parameter; it must be there on every executor) and never trained.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
#: Vocabulary file for the tokenizer names in use.  Where a vocabulary isn't at hand, the nearest of the same kind stands in.
VOCABULARIES = {"gpt2": "byte_bpe_50k.tiktoken", "cl100k_base": "byte_bpe_50k.tiktoken", "o200k_base": "byte_bpe_multi_50k.tiktoken"}
#: Fixed value: the public pattern that parts text before byte-pair merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_of(tokenizer: str) -> str:
    return VOCABULARIES.get(tokenizer, tokenizer)


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, tokenizers: list[str], keep: list[str] = [], folder: str = FOLDER) -> DataFrame:  # noqa: B006
    """(key, kept columns, tokenizer, tokens) for every row and tokenizer.

    Names that share a vocabulary are counted once for each text.  Null text has 0 tokens, as has empty text; texts are
    read whole.  Special tokens in a text are ordinary text.  keep: other columns to carry, by name.
    """
    import pyarrow as pa

    files = sorted({vocabulary_of(t) for t in tokenizers})
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"), *kept)
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[1:]) + ", " + ", ".join(f"n{i} bigint" for i in range(len(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [encoding(str(Path(folder, f))) for f in files]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            counts = [pa.array([len(c.encode_ordinary(x)) if x else 0 for x in texts], pa.int64()) for c in coders]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts], names=[*batch.schema.names[1:], *[f"n{i}" for i in range(len(files))]])

    at = {f: f"n{i}" for i, f in enumerate(files)}
    by_name = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(at[vocabulary_of(t)]).alias("tokens")) for t in sorted(set(tokenizers))]))
    return rows.mapInArrow(run, kinds).select("key", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], by_name.alias("t")).select("key", *[F.col(f"`{c}`") for c in keep], "t.tokenizer", "t.tokens")
