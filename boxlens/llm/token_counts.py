"""Token counts of whole texts by a public word BPE, with a whole-token shortcut.

The vocabulary (``word_bpe_49k.json``) lower-cases, drops white space, cuts a
text into pre-tokens (runs of letters, single digits, runs of other characters,
a few English endings) and merges inside each pre-token. Most pre-tokens of prose
are one token as they stand, and which vocabulary strings are is proved once, on
the driver, by encoding each of them alone (``whole_tokens``). A pre-token among
them counts one by a set lookup; only the rest is merged, by the library's own
model, and its count is remembered by the Python worker.

No pre-token spans white space and no normalisation reaches across it, so a
text's count is the sum of the counts of its runs between ASCII white space:

* an ASCII run is cut by the pre-token rule itself, spelt out for ASCII;
* a run with other characters is normalised and cut by the library;
* a run that holds ``<|`` may hold a special string, which the library finds in
  the raw text by default: the library encodes it whole.

Cases: null and empty texts have no bytes and no tokens; repeated rows count
each; a very long text is read in windows cut at white space, and a very long run
is cut where no pre-token, normalisation or special string can cross (behind an
ASCII digit, or behind a comma or full stop before a letter); columns other than
``doc_id`` and ``text`` are not read, whatever their names; no rows in, no
rows out. Nothing here is ordered, so there are no ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048  # tokens
_WINDOW = 1 << 20  # bytes of a text cut into runs at a time
_LONG_RUN = 1 << 14  # bytes; longer runs are cut, and not remembered
_REMEMBERED = 1 << 19  # runs (and pre-tokens) whose counts a worker holds at most beside the proved ones

# FIXED VALUES: the vocabulary's mark of a word's end, and its pre-token rule for
# lower-case ASCII.
_WORD_END = "</w>"
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+")
_BLANK = re.compile(rb"[ \t\n\v\f\r]")
_CUT = re.compile("(?<=[0-9])|(?<=[,.、。，])(?=[0-9A-Za-zぁ-ゖ一-鿿])")


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file's text, read on the driver (tasks get the text, not a path)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes of Latin-1 for
    themselves, the others by the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def whole_tokens(tokenizer: Tokenizer) -> list[bytes]:
    """The vocabulary strings that are exactly one pre-token and one token when
    they are encoded alone, as UTF-8."""
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    texts = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith(_WORD_END) and len(piece) > len(_WORD_END):
            try:
                texts.append(bytes(byte_of[c] for c in piece[:-len(_WORD_END)]).decode())
            except UnicodeDecodeError:  # part of a character: never a pre-token
                continue
    proved = []
    for text, coded in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        normal = tokenizer.normalizer.normalize_str(text)
        if len(coded.ids) == 1 and normal == text and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1:
            proved.append(text.encode())
    return proved


class _Merged(dict):
    """Tokens of a pre-token: one for the proved strings, else what the model merges it to."""

    def __init__(self, tokenizer: Tokenizer, whole: list[bytes]):
        self.model, self.whole, self.alphabet = tokenizer.model, whole, byte_alphabet()
        super().__init__(dict.fromkeys(whole, 1))

    def __missing__(self, piece: bytes) -> int:
        n = len(self.model.tokenize("".join([self.alphabet[b] for b in piece])))
        if len(piece) <= _LONG_RUN:
            _remember(self, piece, n)
        return n


def _remember(counts: dict, key: bytes, n: int) -> None:
    if len(counts) > len(counts.whole) + _REMEMBERED:
        counts.clear()
        counts.update(dict.fromkeys(counts.whole, 1))
    counts[key] = n


class Counter(dict):
    """Tokens of a run of bytes without ASCII white space; remembers the counts of
    at most ``_REMEMBERED`` runs and as many pre-tokens."""

    def __init__(self, vocabulary: str, whole: list[bytes]):
        self.tokenizer, self.whole = Tokenizer.from_str(vocabulary), whole
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.pieces = _Merged(self.tokenizer, whole)
        super().__init__(dict.fromkeys(whole, 1))

    def __missing__(self, run: bytes) -> int:
        if len(run) > _LONG_RUN:
            return sum(map(self._count, (p.encode() for p in _CUT.split(run.decode()) if p)))
        n = self._count(run)
        _remember(self, run, n)
        return n

    def _count(self, run: bytes) -> int:
        if b"<|" in run:
            return len(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids)
        if run.isascii():
            pieces = _ASCII_PIECES.findall(run.lower())
        else:
            text = self.tokenizer.normalizer.normalize_str(run.decode())
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            pieces = [bytes([self.byte_of[c] for c in piece]) for piece, _ in cut]
        return sum(map(self.pieces.__getitem__, pieces))

    def tokens(self, text: bytes) -> int:
        count = self.__getitem__
        return sum(sum(map(count, runs)) for runs in _runs(text))


def _runs(text: bytes) -> Iterator[list[bytes]]:
    lo = 0
    while len(text) - lo > _WINDOW:
        blank = _BLANK.search(text, lo + _WINDOW)
        hi = blank.start() if blank else len(text)
        yield text[lo:hi].split()
        lo = hi
    yield text[lo:].split()


@lru_cache(maxsize=1)
def _counter(vocabulary: str, whole: tuple[bytes, ...]) -> Counter:
    """One for each Python worker, kept from task to task."""
    return Counter(vocabulary, list(whole))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``vocabulary`` is the path of a vocabulary file of the same kind. The text of
    the file and the proved strings (a part of its 49,408) go to the tasks.
    """
    text = vocabulary_text(vocabulary)
    tokenizer = Tokenizer.from_str(text)
    if "Split" not in str(tokenizer.pre_tokenizer) or "Lowercase" not in str(tokenizer.normalizer):
        raise ValueError("the vocabulary is not of the kind that lower-cases and drops white space")
    whole = tuple(whole_tokens(tokenizer))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(text, whole)
        for batch in batches:
            column = batch.column("text")
            sizes, tokens = [], []
            for k in range(len(column)):  # one text's bytes at a time
                raw = column[k].as_buffer().to_pybytes()
                sizes.append(len(raw))
                tokens.append(counter.tokens(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
