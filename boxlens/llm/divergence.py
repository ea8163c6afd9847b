"""Source divergence audit: how far a source's words lie from its language's.

Counting is by length-bucketed packing. The terms of a block of texts are cut
from its UTF-8 bytes; a term of up to 8 bytes becomes one uint64, one of up to 16
two, and both are radix-sorted (16-bit digits, least first) and run-counted in
numpy. Longer terms go to one bucket for each power of two of their length and are
sorted there as bytes. Terms hold no zero byte, so the padding is unambiguous. A
block's counts for each (language, source, term) are summed by Spark, and
all that follows is exact integer arithmetic on the sums:

* a language keeps the terms in at least ``least_docs`` of its rows, V of them;
* a kept term with ``n`` of the ``N`` kept occurrences of a group has
  ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))``, also where ``n`` is 0;
* two such numbers differ by ``floor((p - q)^2 / (p + q))``.

Pairs of sources are compared in blocks of terms: a block of a language's kept
terms is a dense table of terms by sources, and each block gives one partial sum
for each pair. The pairs themselves are part of the result, so a table of a
language's groups is never larger than the square root of it.

Cases: null text, lang and source read as the empty string; a group without terms
or a language without kept terms still gets its pairs (a sum over no terms is
0); rows count each, also repeated ones; ties go to the smaller item in
UTF-8 order; long texts are read in blocks, so memory is bounded by the text's
own bytes and its distinct terms; other columns are not read, whatever their
names; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.llm.common import utf8_column, written

LEAST_DOCS = 10
TOP = 10
_BLOCK = 1 << 22  # bytes of text counted at a time
_CELLS = 1 << 18  # (term, source) counts in a block of the comparison, about

_TERM = np.zeros(256, bool)  # bytes of terms: A-Z, a-z and those from \x80 on
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

Packed = tuple[np.ndarray, ...]  # one uint64 array, two, or one of fixed-width bytes


def radix_order(words: Packed) -> np.ndarray:
    """A stable order of packed terms, by 16-bit digits, least first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for digit in range(4):
            part = (word >> np.uint64(16 * digit)).astype(np.uint16)
            if len(part) and (part != part[0]).any():
                order = order[np.argsort(part[order], kind="stable")]  # numpy sorts 16 bits by radix
    return order


def _order(term: Packed) -> np.ndarray:
    return np.argsort(term[0], kind="stable") if term[0].dtype.kind == "S" else radix_order(term)


def run_count(term: Packed, row: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[Packed, np.ndarray, list[np.ndarray]]:
    """Sums of ``n`` (and ``more``) for each run of equal (term, row); equal terms
    must come with ascending rows."""
    order = _order(term)
    term, row = tuple(t[order] for t in term), row[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    for t in term:
        new[1:] |= t[1:] != t[:-1]
    at = np.flatnonzero(new)
    return tuple(t[at] for t in term), row[at], [np.add.reduceat(x[order], at) for x in (n, *more)]


def packed(raw: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, Packed, np.ndarray]]:
    """Bucket, packed terms and first bytes of the terms of ``raw``, in order of
    place in each bucket; no term spans one of ``breaks``."""
    low = _LOWER[raw]
    term = _TERM[low]
    first = term.copy()
    first[1:] &= ~term[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    first[inner] = term[inner]
    at = np.flatnonzero(first)
    if not len(at):
        return
    stop = ~term
    stop[inner] |= first[inner]
    stops = np.append(np.flatnonzero(stop), len(raw))
    size = stops[np.searchsorted(stops, at, side="right")] - at
    width = np.maximum(8, 1 << np.ceil(np.log2(size)).astype(np.int64))
    for w in np.unique(width).tolist():
        begin, length = at[width == w], size[width == w]
        cells = np.zeros((len(begin), w), np.uint8)
        # byte j of every term that has one: as many steps as bytes, or as terms
        if w <= len(begin):
            for j in range(w):
                has = length > j
                cells[has, j] = low[begin[has] + j]
        else:
            for k, (b, n) in enumerate(zip(begin.tolist(), length.tolist(), strict=True)):
                cells[k, :n] = low[b:b + n]
        if w <= 16:
            words = cells.view(">u8").astype(np.uint64)
            yield w, tuple(np.ascontiguousarray(words[:, k]) for k in range(w // 8)), begin
        else:
            yield w, (cells.view(f"S{w}").ravel(),), begin


def _strings(term: Packed) -> pa.Array:
    if term[0].dtype.kind != "S":
        width = 8 * len(term)
        term = (np.stack(term, axis=1).astype(">u8").view(f"S{width}").ravel(),)
    return pa.array(term[0].tolist(), pa.binary()).cast(pa.string())


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole rows, or of parts of one long row cut where no term is:
    first row, row behind the last, bytes, offsets of the rows in them."""
    raw, off = utf8_column(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = row + 1
        while last < n and off[last + 1] - off[row] <= _BLOCK:
            last += 1
        lo, hi = int(off[row]), int(off[last])
        while hi - lo > _BLOCK:  # then there is one row
            blank = np.flatnonzero(~_TERM[raw[lo:lo + _BLOCK]])
            end = lo + int(blank[-1]) + 1 if len(blank) else lo + _BLOCK
            while not len(blank) and end < hi and _TERM[raw[end]]:
                end += 1
            yield row, last, raw[lo:end], np.array([0, end - lo])
            lo = end
        yield row, last, raw[lo:hi], np.append(off[row:last], hi) - lo if last - row > 1 else np.array([0, hi - lo])
        row = last


def _merged(parts: list[tuple[Packed, np.ndarray, np.ndarray]]) -> tuple[Packed, np.ndarray, np.ndarray]:
    """The sums of several blocks of one row."""
    if len(parts) == 1:
        return parts[0]
    term = tuple(np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True))
    term, row, (n,) = run_count(term, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    return term, row, n


def counted(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms, groups, occurrences and rows with the term, summed within blocks of
    ``texts``; ``group`` numbers the group of each row and must ascend."""
    held: dict[int, list] = {}
    row_held = -1

    def out() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        for parts in held.values():
            term, row, n = _merged(parts)
            term, g, (n, docs) = run_count(term, group[row], n, np.ones(len(n), np.int64))
            yield _strings(term), g, n, docs
        held.clear()

    for row, last, raw, off in _pieces(texts):
        if row != row_held:
            yield from out()
            row_held = row
        for width, term, at in packed(raw, off):
            rows = row + np.searchsorted(off, at, side="right") - 1
            term, rows, (n,) = run_count(term, rows, np.ones(len(rows), np.int64))
            held.setdefault(width, []).append((term, rows, n))
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and rows with the term. A group's
    row with a null term counts the group's rows, so a group without terms has one."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for batch in batches:
            if not batch.num_rows:
                continue
            of = pd.MultiIndex.from_arrays([batch.column("lang").to_pylist(), batch.column("source").to_pylist()])
            number, groups = of.factorize()
            order = np.argsort(number, kind="stable")
            number = number[order]
            lang, source = (pa.array(groups.get_level_values(k).tolist(), pa.string()) for k in (0, 1))
            rows = np.bincount(number)
            yield pa.RecordBatch.from_arrays(
                [lang, source, pa.nulls(len(rows), pa.string()), pa.array(rows), pa.array(rows)], names)
            texts = batch.column("text").cast(pa.large_string()).take(pa.array(order))
            for term, g, n, with_term in counted(texts, number):
                at = pa.array(g)
                yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), term, pa.array(n), pa.array(with_term)], names)

    parts = docs.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 V)), in decimals that hold any count."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(19, 0))) DIV CAST({total} + 2 * v AS DECIMAL(19, 0))")


def _differences(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block of a language: for each pair of its sources, the sum over the
    block's terms."""
    groups = groups.sort_values("source")
    sources, zero = groups["source"].to_numpy(), groups["p_zero"].to_numpy(np.int64)
    term, _ = pd.factorize(cells["term"])
    table = np.repeat(zero[None, :], term.max(initial=-1) + 1, axis=0)
    table[term, pd.Index(sources).get_indexer(cells["source"])] = cells["p"].to_numpy(np.int64)
    left, right, value = [], [], []
    for k in range(len(sources) - 1):
        p, q = table[:, k:k + 1], table[:, k + 1:]
        d = p - q
        d *= d
        d //= p + q
        left.append(np.full(q.shape[1], k))
        right.append(np.arange(k + 1, len(sources)))
        value.append(d.sum(axis=0, dtype=np.int64))
    none = np.zeros(0, np.int64)
    left, right, value = (np.concatenate([none, *x]) for x in (left, right, value))
    return pd.DataFrame({"lang": key[0], "a": sources[left], "b": sources[right], "value": value})


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) group.

    Part ``pair``: every other source of the language and the sum of the
    differences over all kept terms. Part ``term``: the ``top`` terms that the group has
    more often than its language, by difference.
    """
    counts = written(term_counts(docs), "divergence-counts")
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")) \
        .where(F.col("docs") >= least_docs).drop("docs")
    cells = written(terms.drop("docs").join(kept, ["lang", "term"]), "divergence-kept")

    langs = counts.where("term IS NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        cells.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
        .groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left",
    ).select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
             # terms in a block: so many that the block's dense table is bounded
             (F.coalesce("v", F.lit(0)) * F.col("sources") / F.lit(_CELLS) + 1).cast("long").alias("blocks"))
    totals = counts.where("term IS NULL").select("lang", "source").join(
        cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left",
    ).select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(
        totals.join(langs, "lang")
        .withColumn("p_zero", F.when(F.col("v") > 0, _probability("0L", "total")).otherwise(1).cast("long")), "divergence-groups")

    placed = cells.join(groups.drop("p_zero"), ["lang", "source"]).select(
        "lang", "source", "term", "blocks", _probability("n", "total").cast("long").alias("p"),
        _probability("lang_n", "lang_total").cast("long").alias("q"))

    blocks = placed.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "p")
    sides = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "p_zero")
    sums = blocks.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInPandas(
        _differences, "lang string, a string, b string, value bigint",
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("of"), "value",
    ).select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value")

    above = placed.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        F.expr("(p - q) * (p - q) DIV (p + q)").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(best)) for x in (pairs, above)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
