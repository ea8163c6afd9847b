"""Target-distribution importance resampling by hashed n-grams.

A document is weighed by how much more often the target's texts hold its n-grams
than the corpus does, in hashed buckets, and documents are drawn without
replacement in proportion to their weight (the highest weights with Gumbel noise).

The buckets are CRC-32 values of substrings, and no n-gram is hashed on its own.
Each text is normalised (words joined by one space) and scanned once; the running
CRC at every byte is kept. CRC registers are linear over GF(2): appending a text
to another shifts the first one's register by as many zero bytes as the text
has and adds the text's own. So an n-gram's CRC comes from the registers at its
two ends, the first one shifted by the n-gram's length and cancelled:

    crc(text[a:b]) = R[b] ^ shift(R[a] ^ ~0, b - a) ^ ~0

The scan itself runs in lanes of ``_LANE`` bytes side by side, whose registers are
then chained by the same shifts.

Cases: null and empty texts have no features and weight 0; repeated rows are
documents of their own; ties go to the smaller doc_id, and a null doc_id (noise of
the empty id) behind the others; very long texts are scanned in pieces, with the
last words of a piece read again for the n-grams across the cut; columns other
than ``doc_id`` and ``text`` are not read, whatever their names; no rows in, no
rows out; without target texts every gain still is defined (all of T and t are 0).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlens.llm.common import utf8_column, written
from boxlens.operators.ranking import distributed_row_number
from boxlens.operators.selection import Order

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
_PIECE = 1 << 22  # bytes of text scanned at a time
_LANE = 256

_POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed
_ONES = np.uint32(0xFFFFFFFF)
_WORD = np.zeros(256, bool)  # bytes of words: 0-9, A-Z, a-z and those from \x80 on
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


_TABLE = _byte_table()


def _apply(shift: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The linear map ``shift``, given for each byte of a register."""
    out = shift[0][register & 255]
    for k in (1, 2, 3):
        out = out ^ shift[k][(register >> np.uint32(8 * k)) & 255]
    return out


def _shifts() -> list[np.ndarray]:
    """The maps that append 2^k zero bytes, for each byte of a register."""
    bytes_at = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    out = [(bytes_at >> np.uint32(8)) ^ _TABLE[bytes_at & 255]]
    while len(out) < 40:
        out.append(_apply(out[-1], out[-1]))
    return out


def _near_shifts() -> np.ndarray:
    """The maps that append 0 to 255 zero bytes, for each byte of a register."""
    out = np.empty((256, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for size in range(1, 256):
        out[size] = (out[size - 1] >> np.uint32(8)) ^ _TABLE[out[size - 1] & 255]
    return out


_SHIFT, _NEAR = _shifts(), _near_shifts()


def shifted(register: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers after ``size`` zero bytes each."""
    near = size & 255
    out = _NEAR[near, 0, register & 255]
    for k in (1, 2, 3):
        out ^= _NEAR[near, k, (register >> np.uint32(8 * k)) & 255]
    for k in range(8, int(size.max(initial=0)).bit_length()):
        out = np.where((size >> k) & 1, _apply(_SHIFT[k], out), out)
    return out


class Registers:
    """The running CRC registers of a byte sequence, from a register of zero."""

    def __init__(self, data: np.ndarray):
        lanes = len(data) // _LANE + 1
        padded = np.zeros(lanes * _LANE, np.uint8)
        padded[:len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, _LANE).T)
        self.inside = np.zeros((_LANE + 1, lanes), np.uint32)  # by bytes of the lane so far
        for i in range(_LANE):
            last = self.inside[i]
            self.inside[i + 1] = (last >> np.uint32(8)) ^ _TABLE[(last ^ columns[i]) & 255]
        # registers before each lane: lanes are chained, doubling the span each time
        chained, span = self.inside[_LANE].copy(), 0
        while (1 << span) < lanes:
            step = 1 << span
            chained[step:] ^= _apply(_SHIFT[_LANE.bit_length() - 1 + span], chained[:-step].copy())
            span += 1
        self.before = np.concatenate([np.zeros(1, np.uint32), chained[:-1]])

    def at(self, place: np.ndarray) -> np.ndarray:
        """Registers after the first ``place`` bytes."""
        lane, own = place // _LANE, place % _LANE
        return self.inside[own, lane] ^ shifted(self.before[lane], own)

    def crc32(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of the substrings."""
        return self.at(end) ^ shifted(self.at(begin) ^ _ONES, end - begin) ^ _ONES


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Blocks of whole rows, and parts of one long row cut where no word is: the
    bytes, each row's first byte (rows are kept apart by a space), whether the
    block goes on with the row of the block before."""
    raw, off = utf8_column(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = row + 1
        while last < n and off[last + 1] - off[row] <= _PIECE:
            last += 1
        lo, hi = int(off[row]), int(off[last])
        if hi - lo <= _PIECE:
            inner = off[row + 1:last] - lo
            yield np.insert(raw[lo:hi], inner, 0x20), np.append(0, inner + np.arange(1, len(inner) + 1)), False
        else:
            more = False
            while lo < hi:
                end = min(lo + _PIECE, hi)
                blank = np.flatnonzero(~_WORD[raw[lo:end]])
                if end < hi and len(blank):
                    end = lo + int(blank[-1]) + 1
                while end < hi and not len(blank) and _WORD[raw[end]]:
                    end += 1
                yield raw[lo:end], np.zeros(1, np.int64), more
                lo, more = end, True
        row = last


def _normalised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, lower-cased and joined by one space each; first byte and end of
    each word there, and its first byte in ``raw``."""
    word = _WORD[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = word[:-1]
    keep = word | after
    text = np.where(word, _LOWER[raw], np.uint8(0x20))[keep]
    first = word & ~after
    place = np.cumsum(keep) - 1
    ends = place[~word & after]
    begins = place[first]
    if len(ends) < len(begins):
        ends = np.append(ends, len(text))
    return text, begins, ends, np.flatnonzero(first)


def features(column: pa.Array, ngram: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of rows: first row, rows, and then the features' rows (within
    the block) and buckets, and the words of each row."""
    row, tail = -1, np.zeros(0, np.uint8)
    for raw, starts, more in _pieces(column):
        row = row if more else row + 1
        overlap = 0
        if more and len(tail):
            raw = np.concatenate([tail, raw])
        text, begins, ends, at = _normalised(raw)
        if more and len(tail):
            overlap = int(np.searchsorted(at, len(tail)))
        owner = np.searchsorted(starts, at, side="right") - 1
        registers = Registers(text)
        rows, values = [], []
        for size in range(1, ngram + 1):
            last = np.arange(max(size - 1, overlap), len(begins))
            same = owner[last - size + 1] == owner[last]
            last = last[same]
            values.append(registers.crc32(begins[last - size + 1], ends[last]) % np.uint32(buckets))
            rows.append(owner[last])
        words = np.bincount(owner[overlap:], minlength=len(starts))
        yield row, len(starts), np.concatenate(rows), np.concatenate(values).astype(np.int64), words
        # the last words, for n-grams that go on in the next piece of the row
        keep = min(ngram - 1, len(at))
        tail = raw[at[-keep]:] if keep else raw[:0]
        row += len(starts) - 1


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all ``texts``; each task sends its sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, values, _ in features(batch.column("text"), ngram, buckets):
                total += np.bincount(values, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket. The driver gets ``buckets`` sums of either side."""
    def counts(texts: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(texts, ngram, buckets).collect():
            out[r.bucket] = r.n
        return out

    s, t = counts(corpus), counts(target)
    all_s, all_t = sum(s), sum(t)
    ratio = [float(b + 1) * float(all_s + buckets) / (float(a + 1) * float(all_t + buckets)) for a, b in zip(s, t, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """``doc_id, words, n_features, weight`` of every row."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("words", "n_features", "weight"))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, n, owner, values, words in features(batch.column("text"), ngram, len(gain)):
                out[0, row:row + n] += words
                out[1, row:row + n] += np.bincount(owner, minlength=n)
                order = np.argsort(owner, kind="stable")  # n-gram sizes come one after another
                sums = np.concatenate([[0], np.cumsum(gain[values[order]])])
                ends = np.searchsorted(owner[order], np.arange(n + 1))
                out[2, row:row + n] += sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(weigh, schema)


def noise(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the id's hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED,
              least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank``
    is null for rows that are not drawn.

    Of the N rows with at least ``least_words`` words the floor(percent N / 100)
    with the highest scores are drawn.
    """
    scored = weighed(docs, gains(docs, target, ngram, buckets), ngram).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = written(scored.withColumn("__in", F.col("words") >= least_words), "importance-scores")
    drawn = scored.where("__in").count() * percent // 100
    order = [Order("__in", descending=True), Order("score", descending=True), Order("doc_id", nulls_first=False), Order("n_features")]
    ranked = distributed_row_number(scored, [], order, "rank")
    rank = F.when(F.col("__in") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
