"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE; another one may be given wherever this is the default.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary parts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(ranks: str, pattern: str = PATTERN):
    """The encoding of a rank file; a worker process reads it once, whatever tasks it runs."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_by_file", {})
    if (ranks, pattern) not in kept:
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return kept[ranks, pattern]


def token_count(text: Column, ranks: str | None = None) -> Column:
    """Tokens of a whole text, 0 for null and empty ones.

    ``ranks`` is the rank file, by default the session's ``chronolex.tokenizer.ranks``, else
    ``RANKS``. The driver reads it and ships it with the job, so no executor needs the path.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    ranks = ranks or spark.conf.get("chronolex.tokenizer.ranks", RANKS)
    spark.sparkContext.addFile(ranks)
    name = ranks.rstrip("/").rsplit("/", 1)[-1]

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(SparkFiles.get(name))
        return texts.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
