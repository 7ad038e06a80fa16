"""Sum-of-squares online packing of token sequences.

A document is its token ids and a final id 0. Whole windows of it are sequences of their own; the rest is placed, as
documents come, into the fill level that minimises the sum of squared counts of partially filled windows, tracked in
an array of counts by level (Csirik et al., "On the sum-of-squares algorithm for bin packing", JACM 2006). What is
still open at the end of a partition is cut anew into full windows, and the very last rest into sequences whose
lengths are powers of two, which need no padding.

Every partition of the input packs for itself as it streams by: nothing is shuffled, memory holds the open windows
only, and a task that runs again gives the same rows. Sequence ids are the partition's number times 2**33 plus a count.

Defined results: a null text counts as empty, and an empty text is the one id 0; repeated rows are documents of their
own; very long documents are cut into windows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: A text with this string goes to the tokenizer itself, which gives the string an id of its own.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def token_encoder(vocabulary: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """Text to ids of ``vocabulary``.json. The same vocabulary as ranks gives the same ids several times faster."""
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        ids = whole.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
        return np.array([*ids, END], dtype="<u4")

    return encode


class Packer:
    """Places pieces of documents into windows; ``done`` holds rows of finished windows."""

    def __init__(self, first_id: int = 0, window: int = WINDOW):
        self.window, self.next_id = window, first_id
        #: counts[h]: open windows filled up to h. A full window counts -1/2, so that its change of 2n + 1 is nothing.
        self.counts = np.zeros(window + 1)
        self.counts[window] = -0.5
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def level_for(self, size: int) -> int:
        """The fill level to place ``size`` ids at; 0 is a new window."""
        top = self.window - size
        counts = self.counts
        change = 2 * (counts[size : self.window + 1] - counts[: top + 1]) + 2
        change[1:][counts[1 : top + 1] == 0] = np.inf
        change[0] = 2 * counts[size] + 1
        return int(top - np.argmin(change[::-1]))  # of equal levels, the fullest

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._close([(doc_id, start, ids[start : start + self.window], total)])
            start += self.window
        if size := total - start:
            level = self.level_for(size)
            pieces = self.open[level].pop() if level else []
            pieces.append((doc_id, start, ids[start:], total))
            self.counts[level] -= bool(level)
            if level + size == self.window:
                self._close(pieces)
            else:
                self.open[level + size].append(pieces)
                self.counts[level + size] += 1

    def _take(self, rest: list[tuple], size: int) -> list[tuple]:
        """The first ``size`` ids of ``rest``, a reversed list of pieces."""
        taken = []
        while size:
            doc_id, start, ids, total = rest.pop()
            if len(ids) > size:
                rest.append((doc_id, start + size, ids[size:], total))
                ids = ids[:size]
            taken.append((doc_id, start, ids, total))
            size -= len(ids)
        return taken

    def finish(self) -> None:
        """Cut what is open into full windows, and the last rest into powers of two."""
        rest = [p for level in self.open for pieces in level for p in pieces][::-1]
        left = sum(len(p[2]) for p in rest)
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            self._close(self._take(rest, size))
            left -= size
        self.open, self.counts[:-1] = [[] for _ in range(self.window + 1)], 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ``ids`` are little-endian uint32."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encode(text.as_py() or ""))
                if len(packer.done) >= 2000:
                    yield _batch(packer.done)
                    packer.done.clear()
        packer.finish()
        yield _batch(packer.done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(pack, SCHEMA)


def packed_digest(docs: DataFrame) -> DataFrame:
    """``pack_documents`` with the CRC of each piece's ids in their place."""
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
