"""Byte-level BPE tokens as columns: split, encode, decode, byte lengths.

The merge table is a rank file of a public vocabulary, whose path is a parameter; none is
trained here.  Special tokens follow the merges; their names in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_FILE = os.environ.get("QUERNSTONE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pattern that splits text before merging, and the special tokens' names.
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
SPECIAL_TOKENS = ["<|reserved_0|>", "<|reserved_1|>", "<|reserved_2|>", "<|reserved_3|>"]
BOS = SPECIAL_TOKENS[0]


def pretokens(text: Column) -> Column:
    """The pieces of ``text`` before merging; together they are the text again."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


def pretoken_counts(docs: DataFrame, text: str, cap: int | None = None) -> DataFrame:
    """How often each piece occurs in the texts, cut to ``cap`` characters if given."""
    own = F.col(text) if cap is None else F.left(F.col(text), F.lit(cap))
    return docs.select(F.explode(pretokens(own)).alias("pretoken")).groupBy("pretoken").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """How often two bytes stand side by side within the pieces of ``counts`` (``pretoken``, ``n``): what merging would start from.

    ``left`` and ``right`` are bytes as two hexadecimal digits.  Pieces are bytes of a bounded number, so the
    sums are combined before anything is shuffled.
    """
    raw = counts.where("octet_length(pretoken) > 1").select("n", F.hex(F.encode("pretoken", "utf-8")).alias("h"))
    place = F.explode(F.sequence(F.lit(1), (F.length("h") / 2 - 1).cast("int")))
    pairs = raw.select("n", F.lower("h").alias("h"), place.alias("k"))
    left, right = F.substring("h", F.col("k") * 2 - 1, F.lit(2)), F.substring("h", F.col("k") * 2 + 1, F.lit(2))
    return pairs.groupBy(left.alias("left"), right.alias("right")).agg(F.sum("n").alias("n"))


def read_ranks(path: str = RANK_FILE) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str = RANK_FILE):
    import tiktoken

    ranks = read_ranks(path)
    special = {name: len(ranks) + k for k, name in enumerate(SPECIAL_TOKENS)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _checked(values: pd.Series) -> list[str | None]:
    if any(t is not None and not isinstance(t, str) for t in values):
        raise ValueError("only text can be encoded")
    return list(values)


def bpe_encode(text: Column, prepend: int | str | None = None, path: str = RANK_FILE) -> Column:
    """Token ids, after ``prepend``: an id or a special token's name.  A null text has none; what is no text is an error."""
    if not (prepend is None or isinstance(prepend, (int, str))):
        raise ValueError("prepend is a token id or a token's name")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        e, own = encoding(path), _checked(texts)
        first = [] if prepend is None else [prepend if isinstance(prepend, int) else e.encode_single_token(prepend)]
        # one thread: the tasks of an executor already use its cores
        ids = e.encode_ordinary_batch([t or "" for t in own], num_threads=1)
        return pd.Series([None if t is None else first + x for t, x in zip(own, ids)], dtype=object)

    return encode(text)


def bpe_decode(ids: Column, path: str = RANK_FILE) -> Column:
    """The text of token ids; bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        e = encoding(path)
        texts = e.decode_batch([[] if x is None else [int(i) for i in x] for x in lists], num_threads=1)
        return pd.Series([None if x is None else t for x, t in zip(lists, texts)], dtype=object)

    return decode(ids)


def merge_table(spark: SparkSession, path: str = RANK_FILE) -> DataFrame:
    """``token_id`` and the token's ``bytes``, without special tokens."""
    return spark.createDataFrame(sorted((r, bytearray(t)) for t, r in read_ranks(path).items()), "token_id int, bytes binary")


def special_ids(merges: DataFrame) -> DataFrame:
    """Special tokens' ids: they follow however many merges there are."""
    names = F.posexplode(F.array(*map(F.lit, SPECIAL_TOKENS))).alias("k", "token")
    return merges.agg(F.count(F.lit(1)).alias("n")).select("n", names).select("token", (F.col("n") + F.col("k")).cast("int").alias("token_id"))


def token_bytes(merges: DataFrame) -> DataFrame:
    """``n_bytes`` of each token: the UTF-8 length of its text, in which stray bytes are U+FFFD; 0 for special ones."""
    own = merges.select("token_id", F.octet_length(F.make_valid_utf8(F.col("bytes").cast("string"))).alias("n_bytes"))
    return own.unionAll(special_ids(merges).select("token_id", F.lit(0)))
