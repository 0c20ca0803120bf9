"""Public tokenizers on executors, from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
from functools import cache

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Default vocabulary: byte-level BPE for many languages, 50,256 ids.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How this family of vocabularies splits a text before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(spark: SparkSession, path: str = RANKS, most: int = 16 << 20) -> Broadcast:
    """The bytes of a rank file, read on the driver and sent to each executor once; a file over `most` bytes is refused."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is too large for a vocabulary")
    return spark.sparkContext.broadcast(data)


def end_of(data: bytes) -> int:
    """The id behind all ids of a rank file, which ends a document as no token has it."""
    return max(int(line.split()[1]) for line in data.splitlines() if line.strip()) + 1


@cache
def encoder(data: bytes):  # noqa: ANN201
    """The encoding of a rank file, built once in a Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
