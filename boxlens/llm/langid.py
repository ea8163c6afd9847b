"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces of the
product of their probabilities, by the forward algorithm; a text's is the
product over its words. Piece probabilities are learned by expectation
maximisation over the same lattices (forward and backward passes) from word
counts of a bounded sample of labelled documents. The vocabulary itself is
never trained.

Words are runs of letters with their combining marks, lower-cased, with the
vocabulary's word-start mark. Words of up to ``WIDE`` letters go through the
lattice in blocks; a longer run is scored whole, in logarithms, by a pass that
holds only as many positions as the longest piece has letters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from boxlens.llm.common import apart, vocabulary_path, written

VOCABULARY = "piece_bpe_32k.model"
LEARN_DOCS = 400  # labelled documents per language that are learned from, at most
ROUNDS = 4  # of expectation maximisation
WIDE = 32  # letters of the longest words scored in blocks; their likelihoods are above the least double
FEW_IDS = 100_000  # ids that are broadcast; more are joined
UNKNOWN = 1e-8  # probability of a letter outside the vocabulary
SMOOTH = 0.02  # added to each piece's expected count
BLOCK = 1024  # words whose lattices are learned from at a time
CACHE = 100_000  # words a task remembers


def _letters(last: int) -> re.Pattern:
    """A run of letters (``str.isalpha``) and of the marks that follow them, of
    texts without code points beyond ``last``."""
    def ranges(wanted) -> str:
        out, first = [], None
        for c in range(last + 2):
            if c <= last and wanted(chr(c)):
                first = c if first is None else first
            elif first is not None:
                out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
                first = None
        return "".join(out)

    letter, mark = ranges(str.isalpha), ranges(lambda c: unicodedata.category(c)[0] == "M")
    return re.compile(f"[{letter}][{letter}{mark}]*")


LETTERS, LATIN = _letters(sys.maxunicode), _letters(0xFF)  # the same runs; the second is faster where it will do
START = "▁"
_FACTOR = 0x9E3779B97F4A7C15  # of the hash of substrings

PREDICTED = "lang_pred string, score double"


def load_pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rest = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (
        model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    # a piece may begin with a mark: it goes on within a word
    return [p for p in rest if p == p.lower() and p != START and LETTERS.fullmatch("a" + p.removeprefix(START))]


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return LETTERS.findall(low)
    return LATIN.findall(low)


def _edges(text: str, begin: int, pieces: dict[str, int], prefixes: set[str]) -> list[tuple[int, int]]:
    """``(end, piece)`` of the lattice's edges from one place of a word."""
    out, known = [], False
    for mark in ((START, "") if begin == 0 else ("",)):
        size = 1
        while begin + size <= len(text) and (part := mark + text[begin:begin + size]) in prefixes:
            p = pieces.get(part)
            if p is not None:
                out.append((begin + size, p))
                known = known or size == 1
            size += 1
    return out if known else [*out, (begin + 1, len(pieces))]


def run_log_likelihood(text: str, pieces: dict[str, int], prefixes: set[str], longest: int, log_prob: np.ndarray) -> np.ndarray:
    """The whole run's log likelihood by language; of the forward sums only
    those that a piece can still reach from are held."""
    ring = np.full((longest + 1, log_prob.shape[1]), -np.inf)
    ring[0] = 0.0
    for begin in range(len(text)):
        here = ring[begin % (longest + 1)].copy()
        ring[begin % (longest + 1)] = -np.inf
        for end, piece in _edges(text, begin, pieces, prefixes):
            k = end % (longest + 1)
            ring[k] = np.logaddexp(ring[k], here + log_prob[piece])
    return ring[len(text) % (longest + 1)]


def _run_expected(text: str, share: np.ndarray, pieces: dict[str, int], prefixes: set[str], log_prob: np.ndarray, expected: np.ndarray) -> None:
    """Add a long run's expected piece counts, by forward and backward sums in logarithms."""
    n, edges = len(text), [_edges(text, b, pieces, prefixes) for b in range(len(text))]
    alpha = np.full((n + 1, log_prob.shape[1]), -np.inf)
    beta = alpha.copy()
    alpha[0], beta[n] = 0.0, 0.0
    for b in range(n):
        for e, p in edges[b]:
            alpha[e] = np.logaddexp(alpha[e], alpha[b] + log_prob[p])
    for b in range(n - 1, -1, -1):
        for e, p in edges[b]:
            beta[b] = np.logaddexp(beta[b], log_prob[p] + beta[e])
    for b in range(n):
        for e, p in edges[b]:
            expected[p] += share * np.exp(alpha[b] + log_prob[p] + beta[e] - alpha[n])


class PieceTable:
    """The pieces and all their beginnings by a 64-bit hash of their code points,
    to look up every substring of many words at once."""

    def __init__(self, pieces: dict[str, int]):
        values: dict[int, int] = {}
        for p, k in pieces.items():
            h = 0
            for c in p:
                h = (h * _FACTOR + ord(c)) % 2**64
                values.setdefault(h, -1)
            values[h] = k
        self.hashes = np.array(sorted(values), np.uint64)
        self.piece = np.array([values[h] for h in self.hashes.tolist()], np.int64)  # -1: a beginning only

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is the beginning of a piece, and the piece that it is, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        begins = self.hashes[at] == hashes
        return begins, np.where(begins, self.piece[at], -1)


class Lattice:
    """All segmentations of some words: edges ``(word, begin, end, piece)``.

    ``table`` may be any value if there is no ``PieceTable`` of ``pieces`` at hand.
    """

    def __init__(self, words: list[str], pieces: dict[str, int], table: PieceTable | object = None):
        table = table if isinstance(table, PieceTable) else PieceTable(pieces)
        self.n = len(words)
        self.length = np.array([len(x) for x in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(self.n), self.length)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        known = np.zeros(len(letters), bool)
        found = []
        # from every place, and from every word's start behind the mark, as far as a piece begins so
        with np.errstate(over="ignore"):
            for at, h in ((np.arange(len(letters)), np.zeros(len(letters), np.uint64)),
                          (np.flatnonzero(place == 0), np.full(int((place == 0).sum()), ord(START), np.uint64))):
                size = 0
                while len(at):
                    h = h * np.uint64(_FACTOR) + letters[at + size]
                    size += 1
                    begins, piece = table.find(h)
                    whole = piece >= 0
                    found.append((word[at[whole]], place[at[whole]], place[at[whole]] + size, piece[whole]))
                    if size == 1:
                        known[at[whole]] = True
                    on = begins & (place[at] + size < self.length[word[at]])
                    at, h = at[on], h[on]
        lone = np.flatnonzero(~known)
        found.append((word[lone], place[lone], place[lone] + 1, np.full(len(lone), len(pieces))))
        word, begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end * self.n + word, kind="stable")
        self.word, self.begin, self.end, self.piece = (x[order].astype(np.int32) for x in (word, begin, end, piece))
        self.width = int(self.length.max(initial=0)) + 1
        self.bounds = np.searchsorted(self.end, np.arange(self.width + 1))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """``alpha[word, end, language]``; prob: (pieces + 1, languages)."""
        alpha = np.zeros((self.n, self.width, prob.shape[1]))
        alpha[:, 0] = 1.0
        for j in range(1, self.width):
            s = slice(self.bounds[j], self.bounds[j + 1])
            w = self.word[s]
            if len(w):
                at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                alpha[w[at], j] = np.add.reduceat(alpha[w, self.begin[s]] * prob[self.piece[s]], at, axis=0)
        return alpha

    def backward(self, prob: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.n, self.width, prob.shape[1]))
        beta[np.arange(self.n), self.length] = 1.0
        for j in range(self.width - 1, 0, -1):
            s = slice(self.bounds[j], self.bounds[j + 1])
            w = self.word[s]
            if len(w):
                np.add.at(beta, (w, self.begin[s]), beta[w, j] * prob[self.piece[s]])
        return beta

    def log_likelihood(self, prob: np.ndarray) -> np.ndarray:
        alpha = self.forward(prob)
        return np.log(np.maximum(alpha[np.arange(self.n), self.length], 1e-300))


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    prob: np.ndarray  # (pieces + 1, languages)
    prior: np.ndarray  # log share of each language among labelled documents

    def prefixes(self) -> set[str]:
        return {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}

    def longest(self) -> int:
        """Letters of the longest piece."""
        return max((len(p.removeprefix(START)) for p in self.pieces), default=1)


def expectation_maximisation(words: list[str], counts: np.ndarray, pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of each language from ``counts`` (words, languages)."""
    languages = counts.shape[1]
    prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
    prob = np.full((len(pieces) + 1, languages), 1.0 / (len(pieces) + 1))
    prob[-1] = UNKNOWN
    sizes = np.array([len(w) for w in words], np.int64)
    long = np.flatnonzero(sizes > WIDE)
    order = np.argsort(sizes, kind="stable")[:len(words) - len(long)]
    table = PieceTable(pieces)
    for _ in range(rounds):
        expected = np.zeros_like(prob)
        for k in range(0, len(order), BLOCK):  # lattices are made again each round: only one block's are held
            part = order[k:k + BLOCK]
            lattice, share = Lattice([words[i] for i in part], pieces, table), counts[part]
            alpha, beta = lattice.forward(prob), lattice.backward(prob)
            whole = np.maximum(alpha[np.arange(lattice.n), lattice.length], 1e-300)
            w = lattice.word
            use = alpha[w, lattice.begin] * prob[lattice.piece] * beta[w, lattice.end] * (share / whole)[w]
            for j in range(languages):
                expected[:, j] += np.bincount(lattice.piece, use[:, j], len(prob))
        log_prob = np.log(np.maximum(prob, 1e-300))
        for i in long.tolist():
            _run_expected(words[i], counts[i], pieces, prefixes, log_prob, expected)
        expected[:-1] += SMOOTH
        prob = expected / np.maximum(expected[:-1].sum(axis=0), 1e-300)
        prob[-1] = UNKNOWN
    return prob


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, c) for lang, words in total.items() for w, c in words.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "c"])


def learn(labelled: DataFrame, vocabulary: str | None = None, per_language: int = LEARN_DOCS) -> Model:
    """A model from ``labelled (doc_id, text, lang)``.

    The documents used are the first ``per_language`` of each language by a
    hash of ``doc_id``, with all their words; the priors count all. Rows with a null ``lang`` teach
    nothing; without labelled rows the model has no language.
    """
    rows = labelled.where("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shares = rows.groupBy("lang").count().orderBy("lang").collect()
    languages = [r["lang"] for r in shares]
    path = vocabulary or vocabulary_path(VOCABULARY)
    pieces = {p: k for k, p in enumerate(load_pieces(path))}
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    chosen = written(
        rows.select("lang", F.col("doc_id").alias("id"))
        .selectExpr("lang as l", "id", f"row_number() over (partition by lang order by xxhash64(id, {13}), id) as r")
        .where(F.col("r") <= per_language).select("id").distinct(), "langid-chosen")
    few = chosen.count() <= FEW_IDS  # at most per_language of each language
    counts = written(
        rows.join(F.broadcast(chosen) if few else chosen, F.col("doc_id") == F.col("id"), "left_semi").select("lang", "text")
        .mapInArrow(_word_counts, "lang string, word string, c bigint")
        .groupBy("lang", "word").agg(F.sum("c").alias("c")), "langid-words").toArrow()
    if not counts.num_rows:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    words = sorted(pc.unique(counts["word"]).to_pylist())
    row = pc.index_in(counts["word"], pa.array(words, pa.string())).to_numpy()
    column = pc.index_in(counts["lang"], pa.array(languages, pa.string())).to_numpy()
    table = np.zeros((len(words), len(languages)))
    table[row, column] = counts["c"].to_numpy()
    del counts, row, column
    prior = np.log(np.array([r["count"] for r in shares], float) / sum(r["count"] for r in shares))
    return Model(languages, pieces, expectation_maximisation(words, table, pieces), prior)


class _Scores:
    """Log likelihoods of words by language; a task keeps at most ``CACHE`` of them."""

    def __init__(self, model: Model):
        self.model, self.prefixes, self.longest = model, model.prefixes(), model.longest()
        self.pieces = PieceTable(model.pieces)
        self.log_prob = np.log(np.maximum(model.prob, 1e-300))
        self.forget()

    def forget(self) -> None:
        """Drop all words: the worker goes on to tasks that need its memory."""
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def learn(self, docs: list[list[str]]) -> None:
        """Score the words of ``docs`` that are not known yet."""
        fresh = [w for w in dict.fromkeys(w for d in docs for w in d) if w not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.forget()
            fresh = list(dict.fromkeys(w for d in docs for w in d))
        if not fresh:
            return
        fresh.sort(key=len)
        long = [w for w in fresh if len(w) > WIDE]
        short = fresh[:len(fresh) - len(long)]
        new = [Lattice(short[k:k + 8192], self.model.pieces, self.pieces).log_likelihood(self.model.prob)
               for k in range(0, len(short), 8192)]
        new += [run_log_likelihood(w, self.model.pieces, self.prefixes, self.longest, self.log_prob)[None] for w in long]
        self.known.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
        self.table = np.concatenate([self.table, *new])


_kept: dict[str, _Scores] = {}  # of the last model that this worker has used


def _scores(model: Model, name: str) -> _Scores:
    if name not in _kept:
        _kept.clear()
        _kept[name] = _Scores(model)
    return _kept[name]


def _predict(batches: Iterator[pa.RecordBatch], model: Model, name: str, names: tuple[str, str] = ("lang_pred", "score")) -> Iterator[pa.RecordBatch]:
    """Batches with the two results in place of the last column, the text."""
    scores_of = _scores(model, name) if model.languages else None
    try:
        for batch in batches:
            yield _judged(batch, model, scores_of, names)
    finally:
        if scores_of:
            scores_of.forget()


def _judged(batch: pa.RecordBatch, model: Model, scores_of: _Scores | None, names: tuple[str, str]) -> pa.RecordBatch:
    texts = batch.column(batch.num_columns - 1)
    labels, scores = [], []
    for lo in range(0, batch.num_rows, 256):
        docs = [words_of(t) for t in texts[lo:lo + 256].to_pylist()]
        if scores_of:
            scores_of.learn(docs)
        for d in docs:
            if not d or not scores_of:
                labels.append("und"), scores.append(0.0)
                continue
            known = scores_of.known
            total = scores_of.table[[known[w] for w in d]].sum(axis=0) + model.prior
            best = int(total.argmax())
            labels.append(model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
        names=[*batch.schema.names[:-1], *names])


def identify(docs: DataFrame, model: Model, keep: Column | str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score)``: the likeliest language of every whole text
    and its posterior. Null texts, and texts without a letter, are ``und`` with
    score 0; languages that tie go to the first in order. Texts and runs of letters
    of any length are scored whole. Every row gives a row, repeated or not; ids
    may be null; other columns are ignored.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, sent.value, name), f"doc_id bigint, {PREDICTED}")


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def identified_kept(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text is in no learned language (``und``).

    Rows are judged one by one, whatever their ids; all columns stay as they are,
    whatever their names.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    pred, score, text = apart(docs, "lang_pred", "score", "whole_text")
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    judged = docs.select("*", F.col("text").cast("string").alias(text)).mapInArrow(
        lambda it: _predict(it, sent.value, name, (pred, score)), schema)
    return judged.where(F.col(pred) != "und").drop(pred, score)
