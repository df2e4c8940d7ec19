"""Bounded-space online best-fit packing of tokenised documents into sequences.

Documents are tokenised once, where they lie; only piece lengths and checksums travel on.  Pieces that fill a sequence
close it at once.  The others are dealt by a digest of their row over as many packers as their number asks for (a fixed
share each), and each packer runs best-fit over its stream with a fixed number of open bins.  Open bins are kept in
stacks by free space and the occupied stacks in a bitset: the lowest set bit at or above a piece's length is the best
fit.  When too many bins are open the fullest, the lowest set bit of all, is closed.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = "doc_id {id}, salt long, piece int, start long, length long, ids_crc32 long"
#: Pieces a packer takes on average, and bins that it holds open.
PER_PACKER = 65_536
#: Runs of white space from here on are not for the fast encoder, whose pattern needs a stack frame for each character.
LONG_RUN = 50_000
OPEN_BINS = 1024


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoder(path: str | None = None):
    """Byte-level BPE from a rank file; gives the ids of byte_bpe_50k.json, several times faster (a test compares them),
    but knows no added tokens and fails on very long runs of white space: ``Encoder`` sees to both."""
    import public_tokenizers
    import tiktoken

    with open(path or tokenizer_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("loam", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids by the tokenizer file beside the rank file (same name, ``.json``): by ranks, which is faster, where both agree,
    and by the file itself for texts that hold one of its added tokens or a very long run of white space."""

    def __init__(self, path: str | None = None):
        path = path or tokenizer_path()
        self.fast, self.file, self.slow = load_encoder(path), os.path.splitext(path)[0] + ".json", None
        self.special = None
        if os.path.exists(self.file):
            with open(self.file, encoding="utf-8") as f:
                added = [t["content"] for t in json.load(f)["added_tokens"]]
            self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.run = re.compile(rf"\s{{{LONG_RUN}}}")

    def encode(self, text: str) -> list[int]:
        if self.special and (self.special.search(text) or len(text) >= LONG_RUN and self.run.search(text)):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(ids: list[int], capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    n = len(ids)
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


def tokenised(df: DataFrame, capacity: int, path: str | None, id_col: str, text_col: str) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col, F.monotonically_increasing_id()).alias("salt"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, body in enumerate(batch.column(2)):
                ids = encoder.encode(body.as_py() or "")
                ids.append(0)
                raw = np.asarray(ids, dtype="<u4")
                for k, (s, n) in enumerate(cut(ids, capacity)):
                    which.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[s : s + n].tobytes()))
            picked = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "salt", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, PIECES.format(id=id_type))


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins; ``add`` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bit f is set if a bin with f free places is open
        self.open = 0
        self.next = 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.used &= ~(1 << free)
        self.open -= 1
        return found

    def add(self, length: int) -> tuple[int, int]:
        fits = self.used >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            found = self._take(free)
        else:
            free, found = self.capacity, self.next
            self.next += 1
        offset, left = self.capacity - free, free - length
        if left:
            if self.open >= self.limit:
                self._take((self.used & -self.used).bit_length() - 1)  # the fullest closes
            self.stacks[left].append(found)
            self.used |= 1 << left
            self.open += 1
        return found, offset


def pack(
    df: DataFrame,
    capacity: int = 2048,
    open_bins: int = OPEN_BINS,
    per_packer: int = PER_PACKER,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is the end token alone.  Rows that repeat are packed each for itself.  Other columns are not
    read.  An empty table gives no rows.  ``tokenizer`` is a rank file's path on the executors; its tokenizer file
    is beside it.
    """
    pieces = materialize(tokenised(df, capacity, tokenizer, id_col, text_col), "pieces")
    count = pieces.filter(F.col("length") < capacity).count()
    packers = max(1, -(-count // per_packer))
    schema = pieces.drop("salt").schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            put = [bins.add(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["salt"]).columns, pa.array([first + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())],
                names=[*(n for n in batch.schema.names if n != "salt"), "sequence_id", "offset"],
            )

    # Sorted, so that a packer that is run again packs alike.  The order is of a digest, unrelated to length.
    short = pieces.filter(F.col("length") < capacity).repartition(packers, "salt").sortWithinPartitions("salt", "doc_id", "piece", "ids_crc32")
    full = pieces.filter(F.col("length") == capacity).drop("salt")
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return short.mapInArrow(run, schema).unionByName(full)
