"""Encoding of a corpus with a public byte-level BPE.

Every text is encoded as a tree of halves down to leaves of a few hundred characters,
so the usual document has several. Halves are encoded on their own and joined by re-encoding a window around the seam. The window grows on either side
until it reaches a place where a letter is followed by a character that is none.
There the join is exact, not merely likely: no alternative of the tokenizer's
pattern matches across such a place, matching is memoryless from there on, and
pairs are merged only inside one match. Concatenation of the ids is therefore the
monoid's product, and decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import importlib.util
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
LEAF_CHARS = 256
FIRST_WINDOW = 64


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A ``.tiktoken`` vocabulary; made once in each worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", Path(folder) / "__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable[[str], list[int]]:
    return encoding(name, folder).encode_ordinary


def _seam(text: str, i: int) -> bool:
    """Whether a match surely ends at ``i``: a letter before, blank or ASCII or CJK punctuation after."""
    after = text[i]
    return text[i - 1].isalpha() and (after.isspace() or unicodedata.category(after)[0] == "P")


def encode(text: str, plain: Callable[[str], list[int]], leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of ``text``; the same as ``plain(text)``, whatever the leaf size."""
    if len(text) <= leaf:
        return plain(text)
    cut = len(text) // 2
    left, right = encode(text[:cut], plain, leaf), encode(text[cut:], plain, leaf)
    return _join(text, cut, left, right, plain)


def _join(text: str, cut: int, left: list[int], right: list[int], plain: Callable[[str], list[int]]) -> list[int]:
    width, a, b, n = FIRST_WINDOW, None, None, len(text)
    while a is None or b is None:
        lo, hi = max(0, cut - width), min(n, cut + width)
        if a is None:
            a = next((i for i in range(cut - 1, max(lo, 1) - 1, -1) if _seam(text, i)), 0 if lo == 0 else None)
        if b is None:
            b = next((i for i in range(cut + 1, hi) if _seam(text, i)), n if hi == n else None)
        width *= 2
    kept = len(left) - len(plain(text[a:cut]))
    return left[:kept] + plain(text[a:b]) + right[len(plain(text[cut:b])) :]


def token_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids``: ids (list of integers) of each row's text, without special tokens.

    Empty and null texts have the empty list. Rows are independent, so repeated
    rows and keys simply come again. Other columns are not read.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = encoder(name, folder)
        for batch in batches:
            ids = [encode(t, plain) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_sizes(df: DataFrame, keep: list[str], text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` with ``tokens`` (int), the number of ids; 0 for empty and null texts."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = encoder(name, folder)
        for batch in batches:
            sizes = [len(encode(t, plain)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int32())], [*keep, "tokens"])

    rows = df.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens int")


def decode(ids: Sequence[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = 1 << 12) -> str:
    """Text of ids: the bytes of halves are concatenated, then read once, as a character may span tokens."""
    table = encoding(name, folder)

    def part(a: int, b: int) -> bytes:
        if b - a <= leaf:
            return table.decode_bytes(list(ids[a:b]))
        cut = (a + b) // 2
        return part(a, cut) + part(cut, b)

    return part(0, len(ids)).decode("utf-8", "replace")


def token_texts(df: DataFrame, key: str, ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, text`` of rows of ids; null and empty lists have the empty text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(x, name, folder) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
