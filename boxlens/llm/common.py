"""Helpers shared by the operators: inputs, scratch tables, hashed words."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from boxlens.session import ensure_checkpoint_dir

SHINGLE = 5
_CHUNK = 1 << 20
PART_ROWS = 512  # of a batch of texts that are worked on, and sent on, at a time

# white space of the word rule: \x20 and \x09-\x0D
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-shift rounds), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE_VALUE[_SPACE] = 0
_PLACE = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
_SLOT = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xABC98388FB8FAC03)) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/boxlens-llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a table that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, *names: str) -> list[str]:
    """``names`` as columns that ``docs`` does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose files nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def vocabulary_path(name: str) -> str:
    """A public vocabulary file; the folder is ``BOXLENS_TOKENIZERS`` or /opt/tokenizers."""
    return os.path.join(os.environ.get("BOXLENS_TOKENIZERS", "/opt/tokenizers"), name)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of at most ``PART_ROWS`` rows: what is made of a text
    can be many times its size, in the worker and in the executor that reads it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(lo, PART_ROWS)


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows have no bytes."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def _word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``raw``; no word spans one of ``starts``."""
    low = _LOWER[raw]
    word = ~_SPACE[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[starts < len(raw)]
    first[inner] = word[inner]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), at
    place = np.arange(len(raw), dtype=np.int64)
    place[at[0]:] -= np.repeat(at, np.diff(np.append(at, len(raw))))
    value = _BYTE_VALUE[low]
    value *= _PLACE[place & 4095]
    return mix64(np.add.reduceat(value, at)), at


def _cuts(raw: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most about ``_CHUNK`` bytes, cut behind white space, so that
    memory stays bounded for very long texts (a single longer word stays whole)."""
    while hi - lo > _CHUNK:
        end = lo + _CHUNK
        blank = np.flatnonzero(_SPACE[raw[lo:end]])
        if len(blank):
            end = lo + int(blank[-1]) + 1
        else:
            while end < hi and not _SPACE[raw[end]]:
                end += 1
        yield lo, end
        lo = end
    yield lo, hi


def words_of_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row of a string column, the 64-bit hashes of its words in order.

    A-Z are lower-cased and words are maximal runs of bytes other than
    ``\\x20\\x09-\\x0D`` (the same on code points, as those are ASCII). Null and
    empty rows give an empty array.
    """
    raw, off = utf8_column(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = row + 1
        while last < n and off[last + 1] - off[row] <= _CHUNK:
            last += 1
        lo, hi = int(off[row]), int(off[last])
        if hi - lo <= _CHUNK:
            hashes, at = _word_hashes(raw[lo:hi], off[row:last] - lo)
            ends = np.searchsorted(at, off[row:last + 1] - lo)
            for k in range(last - row):
                yield hashes[ends[k]:ends[k + 1]]
        else:
            none = np.zeros(1, np.int64)
            yield np.concatenate([_word_hashes(raw[a:b], none)[0] for a, b in _cuts(raw, lo, hi)])
        row = last


def shingle_sequence(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles in order; the whole sequence if shorter."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, SHINGLE)
    out = words[:n - size + 1] * _SLOT[0]
    for k in range(1, size):
        out += words[k:n - size + 1 + k] * _SLOT[k]
    return mix64(out + np.uint64(size))


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_sequence(words))
