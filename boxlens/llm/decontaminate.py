"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item is fingerprinted with a 64-bit SimHash of its words. A
document is scanned with windows of the items' sizes (sizes are rounded down to
a grid of ratio ``GRID``; an item longer than its window is fingerprinted at
its head and at its tail). Multi-index Hamming blocks find every window whose
fingerprint lies within ``RADIUS`` bits of an item's: a fingerprint is four
16-bit blocks, so within 7 bits at least one block differs in one bit at most,
and each block has a table of all values within one bit of an item's block.

Wide windows alone lose items that are cut off, cut up or changed in one place.
So there are narrow windows too, of ``NARROW`` words, met at distance 0. A window
that reaches the threshold holds three quarters of the item's shingles, hence one
or more of any quarter of them and one beyond; so many are indexed of each item,
those that the fewest items share, and no window is missed.

Around each place found, every window of the item's full size is verified
exactly, by the weighted Jaccard similarity of the 5-word shingles (weight: how
often the shingle occurs), 0.75 or more. Windows are cut at the ends of their
row, so a document shorter than the item is one window of its own length.

Words are those of the word rule (A-Z lower-cased, cut at ASCII white space).
The benchmark is small beside the corpus but its size is checked all the same:
it is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass
over the documents per block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import SHINGLE, apart, shingle_sequence, words_of_rows

RADIUS = 7
GRID = 1.125
WIDEST = 4096  # words of the widest window; longer items are met by head and tail
NARROW = SHINGLE  # words of the windows that must be met unchanged
THRESHOLD = 0.75
BLOCK_BYTES = 8 << 20
_WORDS = 2_048  # words scanned at a time, and all of the row that reaches them
_PIECE = 65_536  # words fingerprinted at a time

HITS = "doc_id bigint, item_id bigint, windows bigint, first_word bigint, similarity double"


def window_size(words: int) -> int:
    """The grid size for an item of so many words."""
    size = 1
    while True:
        step = max(size + 1, int(size * GRID))
        if step > min(words, WIDEST):
            return size
        size = step


def simhash(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words, as uint64."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    return _pack(_running(bits), size)


def _running(bits: np.ndarray) -> np.ndarray:
    total = np.zeros((len(bits) + 1, 64), np.int32 if len(bits) > 30_000 else np.int16)
    np.cumsum(bits, axis=0, out=total[1:])
    return total


def _pack(total: np.ndarray, size: int) -> np.ndarray:
    ones = total[size:] - total[:-size]
    return np.packbits(ones > size // 2, axis=1).view(np.uint64).ravel()


def _near_values(block: int) -> list[int]:
    return [block, *(block ^ (1 << k) for k in range(16))]


class ItemIndex:
    """Fingerprints, block tables and exact shingle weights of some items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.lengths = [len(w) for _, w in items]
        self.weights = [Counter(shingle_sequence(w).tolist()) for _, w in items]
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, words) in enumerate(items):
            if not len(words):
                continue
            size = window_size(len(words))
            prints = simhash(words, size)
            ends = {0: int(prints[0]), len(words) - size: int(prints[-1])}
            by_size.setdefault(size, []).extend((fp, k, shift) for shift, fp in ends.items())
        self.sizes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, found in sorted(by_size.items()):
            prints = np.array([f[0] for f in found], np.uint64)
            tables = np.zeros((4, 65536), bool)
            for b, blocks in enumerate(prints.view(np.uint16).reshape(-1, 4).T):
                for block in blocks.tolist():
                    tables[b, _near_values(block)] = True
            self.sizes.append((size, prints, np.array([f[1] for f in found]), np.array([f[2] for f in found]), tables))
        self._index_narrow(items)

    def _index_narrow(self, items: list[tuple[int, np.ndarray]]) -> None:
        """The narrow windows' sorted fingerprints, and the items of each."""
        long = [k for k, n in enumerate(self.lengths) if n >= NARROW]
        none = np.zeros(0, np.uint64)
        shared = np.concatenate([none, *(np.array(list(self.weights[k]), np.uint64) for k in long)])
        values, shares = np.unique(shared, return_counts=True)
        prints, owners = [none], [np.zeros(0, np.int64)]
        for k in long:
            words = items[k][1]
            sequence = shingle_sequence(words)
            rare = np.argsort(shares[np.searchsorted(values, sequence)], kind="stable")
            rare = rare[:len(sequence) - ceil(THRESHOLD * len(sequence)) + 1]
            own = np.unique(simhash(words, NARROW)[rare])
            prints.append(own)
            owners.append(np.full(len(own), k))
        every, owner = np.concatenate(prints), np.concatenate(owners)
        order = np.argsort(every, kind="stable")
        self.narrow, first = np.unique(every[order], return_index=True)
        self.narrow_from, self.narrow_items = np.append(first, len(every)), owner[order]

    def unchanged(self, text: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places of narrow windows met at distance 0; ``total`` as made by ``_running``."""
        none = np.zeros(0, np.int64)
        if len(text) < NARROW or not len(self.narrow):
            return none, none
        found = _pack(total, NARROW)
        slot = np.minimum(np.searchsorted(self.narrow, found), len(self.narrow) - 1)
        at = np.flatnonzero((self.narrow[slot] == found) & (text[NARROW - 1:] == text[:len(text) - NARROW + 1]))
        lo, many = self.narrow_from[slot[at]], np.diff(self.narrow_from)[slot[at]]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return self.narrow_items[np.repeat(lo, many) + inner], np.repeat(at, many)

    def candidates(self, words: np.ndarray, text: np.ndarray, total: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """``(item, window, start)`` for wide windows within the radius: where the
        window begins and where the whole item would. ``text`` numbers the row of
        each word; no window spans two rows."""
        if total is None:
            total = _running(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1))
        for size, prints, item, shift, tables in self.sizes:
            if size > len(words):
                break
            found = _pack(total, size)
            blocks = found.view(np.uint16).reshape(-1, 4)
            near = tables[0][blocks[:, 0]]
            for b in (1, 2, 3):
                near |= tables[b][blocks[:, b]]
            near &= text[size - 1:] == text[:len(text) - size + 1]
            at = np.flatnonzero(near)
            if not len(at):
                continue
            for lo in range(0, len(at), 65536):
                some = at[lo:lo + 65536]
                far = np.bitwise_count(found[some][:, None] ^ prints[None, :])
                w, k = np.nonzero(far <= RADIUS)
                yield from zip(item[k].tolist(), some[w].tolist(), (some[w] - shift[k]).tolist(), strict=True)

    def similarity(self, item: int, window: np.ndarray) -> float:
        a, b = self.weights[item], Counter(shingle_sequence(window).tolist())
        common = sum(min(n, b[t]) for t, n in a.items() if t in b)
        return common / (sum(a.values()) + sum(b.values()) - common)

    def verified(self, item: int, words: np.ndarray, at_head: bool, at_end: bool) -> Iterator[tuple[int, float]]:
        """``(begin, similarity)`` of all windows of the item's size that reach the
        threshold. A window lies inside ``words``, or is cut where these begin or
        end with their row."""
        weights, sequence = self.weights[item], shingle_sequence(words)
        size, end = sum(weights.values()), len(sequence)
        known = np.isin(sequence, np.fromiter(weights, np.uint64, len(weights)))
        start = np.arange(1 - size if at_head else 0, end if at_end else end - size + 1)
        lo, hi = np.maximum(start, 0), np.minimum(start + size, end)
        if not len(start):
            return
        # no more is common than the window's shingles that the item has
        most = np.concatenate([[0], np.cumsum(known)])
        most = most[hi] - most[lo]
        able = np.flatnonzero(most >= THRESHOLD * (size + hi - lo - most))
        if not len(able):
            return
        held: Counter = Counter()
        values, common = sequence.tolist(), 0
        left = right = int(lo[able[0]])
        done = None
        for k in range(able[0], able[-1] + 1):
            b, e = int(lo[k]), int(hi[k])
            for t in values[right:e]:
                held[t] += 1
                common += held[t] <= weights.get(t, 0)
            for t in values[left:b]:
                common -= held[t] <= weights.get(t, 0)
                held[t] -= 1
            left, right = b, e
            s = common / (size + e - b - common)
            if s >= THRESHOLD and (b, e) != done:
                yield b, s
            done = b, e

    def hits(self, words: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``(row, item, start, similarity)`` of verified windows, each once."""
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        ends = np.append(first[1:], len(text))
        near: set[tuple[int, int]] = set()
        widest = max((size for size, *_ in self.sizes), default=NARROW)
        for lo in range(0, len(words), _PIECE):  # windows that begin in this piece
            part, rows = words[lo:lo + _PIECE + widest - 1], text[lo:lo + _PIECE + widest - 1]
            total = _running(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1))
            items, places = self.unchanged(rows, total)
            near.update(zip(items.tolist(), (places + lo).tolist(), strict=True))
            near.update((item, at + lo) for item, at, _ in self.candidates(part, rows, total))
        item, upto = -1, 0
        ordered = sorted(near)
        for k, (i, at) in enumerate(ordered):
            row = int(np.searchsorted(first, at, "right")) - 1
            lo, hi = int(first[row]), int(ends[row])
            if self.lengths[i] < NARROW:
                s = self.similarity(i, words[at:min(at + self.lengths[i], hi)])
                if s >= THRESHOLD:
                    yield int(text[lo]), i, at - lo, s
                continue
            if i == item and at < upto:
                continue  # verified with the place before
            # all places of this row whose windows meet
            size, last, j = self.lengths[i] - NARROW + 1, at, k + 1
            while j < len(ordered) and ordered[j][0] == i and ordered[j][1] < hi and ordered[j][1] - last <= 2 * size - 2:
                last = ordered[j][1]
                j += 1
            item, upto = i, last + 1
            begin, end = max(lo, at - size + 1), min(hi, last + size + NARROW - 1)
            for b, s in self.verified(i, words[begin:end], begin == lo, end == hi):
                yield int(text[lo]), i, begin + b - lo, s


def _hits(column: pa.Array, index: ItemIndex) -> Iterator[tuple[int, int, int, float]]:
    """Verified windows of a column of texts, some thousand words at a time."""
    rows: list[tuple[int, np.ndarray]] = []
    held = 0
    for k, words in enumerate(words_of_rows(column)):
        if len(words):
            rows.append((k, words))
            held += len(words)
        if held >= _WORDS:
            yield from index.hits(np.concatenate([w for _, w in rows]), np.repeat([k for k, _ in rows], [len(w) for _, w in rows]))
            rows, held = [], 0
    if rows:
        yield from index.hits(np.concatenate([w for _, w in rows]), np.repeat([k for k, _ in rows], [len(w) for _, w in rows]))


def _scan(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out: dict[tuple[int, int], list] = {}
        for row, item, start, s in _hits(batch.column(1), index):
            hit = out.setdefault((row, item), [0, start, s])
            hit[0] += 1
            if (s, -start) > (hit[2], -hit[1]):
                hit[1], hit[2] = start, s
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[r] for r, _ in out], pa.int64()), pa.array([index.ids[i] for _, i in out], pa.int64()),
             *(pa.array([h[k] for h in out.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))],
            names=["doc_id", "item_id", "windows", "first_word", "similarity"])


def _item_blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        rows = (benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
                .where("text is not null").orderBy("item_id", "text").collect())
        words = words_of_rows(pa.array([r["text"] for r in rows], pa.string()))
        yield ItemIndex([(r["item_id"], w) for r, w in zip(rows, words, strict=True) if r["item_id"] is not None])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, windows, first_word, similarity)``, a row per document
    and item it holds: how many windows were verified, the best one's first word
    and its similarity.

    Null and empty texts or items are in no row; items of fewer than five words
    count as one shingle. Rows that repeat a ``doc_id`` each give their own
    rows; items that repeat an ``item_id`` too. Other columns of either table
    are ignored. An empty table on either side gives no row. A text of any length
    is scanned whole, its windows in pieces of bounded size; of equally good
    windows the first counts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)
        part = docs.mapInArrow(lambda it, sent=sent: _scan(it, sent.value), HITS)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay.

    Rows are judged one by one, whatever their ids, and where they lie: texts
    are not exchanged.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema, (whole,) = docs.schema, apart(docs, "whole_text")
    for index in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)
        docs = docs.select("*", F.col("text").cast("string").alias(whole)).mapInArrow(
            lambda it, sent=sent: _clean(it, sent.value), schema)
    return docs


def _clean(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for row, _, _, _ in _hits(batch.column(batch.num_columns - 1), index):
            keep[row] = False
        rows = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=rows.schema.names[:-1])
