"""Byte-level BPE of whole texts with the vocabulary of a public tokenizer.

The longest vocabulary entry at each place comes from an Aho-Corasick automaton over bytes mapped to
Latin-1. A sequence of tokens is the result of the merges exactly if every two neighbours, merged alone,
stay as they are. So tokens are laid down longest first, each checked against the one before it; a dead
end steps back, and a place once found dead is never tried again. That makes the work linear.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the rank files' tokenizers split a text before merging (a fixed value of the public vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_MEMO_LIMIT = 200_000


class BytePairEncoder:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; used on two neighbouring tokens only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= _MEMO_LIMIT:
                self._fits.clear()
            known = self._fits[left, right] = self.merge(left + right) == [left, right]
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the split."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        starts: list[list[int]] = [[] for _ in data]
        for end, size in self.automaton.iter(data.decode("latin-1")):
            starts[end - size + 1].append(size)  # sizes grow, for ends do
        n, at, laid = len(data), 0, []
        dead = bytearray(n + 1)
        tries = [len(starts[0])]
        while at < n:
            left, sizes, k = (laid[-1] if laid else None), starts[at], tries[-1]
            while k:
                k -= 1
                token = data[at : at + sizes[k]]
                if not dead[at + sizes[k]] and (left is None or self.fits(left, token)):
                    break
            else:
                dead[at] = 1
                tries.pop()
                at -= len(laid.pop())
                continue
            tries[-1] = k
            laid.append(token)
            at += len(token)
            tries.append(len(starts[at]) if at < n else 0)
        return [self.ranks[x] for x in laid]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self._pieces
        for piece in self.split.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 40:
                    if len(memo) >= _MEMO_LIMIT:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def local_file(path: str) -> str:
    """The vocabulary file on this executor: where it is on the driver, or where it was sent to."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


_sent: set[tuple[str, str]] = set()


def send(df: DataFrame, path: str) -> None:
    """Send the vocabulary file to the executors, once for each application."""
    sc = df.sparkSession.sparkContext
    if (key := (sc.applicationId, path)) not in _sent:
        sc.addFile(path)
        _sent.add(key)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local_file(path))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = [enc.encode(x) if x else [] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT) -> DataFrame:
    """(``id_col``, ids): the token ids of each text, without special tokens.

    Null and empty texts give an empty list. One row comes out for each row that goes in, repeated ids
    and null ids included; other columns are ignored. The vocabulary file is sent to the executors.
    """
    send(df, path)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(path), f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local_file(path))
        for batch in batches:
            n = [len(enc.encode(x)) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "tokens"])

    return run


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT) -> DataFrame:
    """(``id_col``, tokens): the number of tokens of each text; 0 for null and empty texts."""
    send(df, path)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(path), f"id {kind}, tokens long").select(F.col("id").alias(id_col), "tokens")
