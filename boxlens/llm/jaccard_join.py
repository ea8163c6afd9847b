"""N-gram Jaccard self-join by parity sketches.

A document's set holds its distinct 5-word shingles as 64-bit hashes; two
documents link when their sets reach a Jaccard similarity of 0.75.

1. **Sketch.** Tokens are XOR-ed into a parity sketch, one bit each, kept
   sparse: a *piece* is the run of sketch bits that belongs to one slice of the
   hash space and is stored as the XOR fold of its set bits. A token in the
   symmetric difference of two sets changes one piece at most, so sketch
   distance lower-bounds symmetric difference, bit by bit and piece by piece.
   A dense copy, of two bits and more a token, is a filter with the same bound;
   a longer one folds onto a shorter by XOR.
2. **Bands.** Band ``j`` holds sizes in ``[0.75 * 4**j, 4**(j+1))``; two sets
   that can reach the similarity share a band, and with it the piece width.
3. **Pigeonhole join.** At 0.75 two sets of sizes s and t differ in
   ``d <= (s + t) / 7 <= s / 3`` tokens. Order all non-zero pieces by any order
   that both sets share: before the first piece on which they agree lie at
   most d pieces of either. So each set emits its first ``s / 3 + 1`` pieces,
   and linked sets share an emitted one. The order puts pieces with frequent
   tokens (found on a sample; only an order, never a filter) last, so that
   common lines and passages do not form join groups.
4. **Verify.** Pairs that pass the size and Hamming bounds are compared on
   their full sets.

Groups of copies: equal sets are one class, found by set hash before any join.
In a join group each class is first compared with one hub, which keeps the work
linear; classes that verified links already put into one component need no more
comparison. What is left, pairs in different components, is then compared in
full, so that no link between different components is lost and components
are exact. (The odds that a band's hash slices leave a set with too few pieces
for the pigeonhole are below 1e-11 a document.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from boxlens.llm.common import apart, mix64, parts, shingle_set, words_of_rows, written
from boxlens.llm.components import connected_components

SKETCH_BITS = 1024  # of the shortest dense sketch
FREQUENT = 1_000_000  # most tokens kept as frequent: 8 MB of broadcast
FREQUENT_COUNT = 8  # documents that make a token frequent
SLICE_DOCS = 256  # of about so many documents, the tokens counted at once
SLICE_BITS = 14  # of a token's slice, at most
HELD = 1 << 20  # tokens that a task sorts before it sends them
SMALL_IDS = 1_000_000  # ids up to which a semi-join may broadcast them
HUB_ROUNDS = 2

SIGNED = "doc_id bigint, n bigint, class bigint, fold array<bigint>, sketch array<bigint>"
CLASS_SETS = "class bigint, tokens array<bigint>"


def _band(size: int) -> int:
    return (int(size).bit_length() - 1) // 2


@dataclass
class Frequent:
    """Frequent tokens, by their leading ``32 + bits`` bits, sorted."""

    marks: np.ndarray
    bits: int

    def among(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.marks):
            return np.zeros(len(tokens), bool)
        own = token_marks(tokens, self.bits)
        return self.marks[np.minimum(np.searchsorted(self.marks, own), len(self.marks) - 1)] == own


def _pieces(tokens: np.ndarray, band: int, frequent: Frequent) -> np.ndarray:
    """Join keys of one set in one band, in the shared order, cut by pigeonhole."""
    high = 4 ** (band + 1)
    slices = np.uint64(high if high >= 64 else 1 << 20)
    # sorted tokens, so slices are runs
    part = ((tokens >> np.uint64(32)) * slices) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    folded = np.bitwise_xor.reduceat(mix64(tokens + np.uint64(1)), at)
    keep = folded != 0
    seed = np.uint64(((band + 1) * 0x9E6C63D0876A9A47) & 0xFFFFFFFFFFFFFFFF)
    keys = mix64(folded ^ mix64(part[at] + seed)) >> np.uint64(1)
    keys |= np.bitwise_or.reduceat(frequent.among(tokens).astype(np.uint64), at) << np.uint64(63)
    keys = keys[keep]
    need = len(tokens) // 3 + 1
    if len(keys) > need:
        keys = np.partition(keys, need - 1)[:need]
    return keys


def _bands(size: int) -> list[int]:
    own = _band(size)
    return [own, own + 1] if 4 * size >= 3 * 4 ** (own + 1) else [own]


def class_of(tokens: np.ndarray) -> int:
    """A 63-bit hash of a sorted token set."""
    whole = mix64(np.array([tokens.sum(), np.bitwise_xor.reduce(mix64(tokens)), len(tokens)], np.uint64))
    return int(mix64(whole[:1] ^ (whole[1:2] * np.uint64(3)) ^ (whole[2:] * np.uint64(5)))[0] >> np.uint64(1))


def dense_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of a non-empty token set."""
    bits = max(SKETCH_BITS, 2 * 4 ** (_band(len(tokens)) + 1))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def join_keys(tokens: np.ndarray, frequent: Frequent) -> np.ndarray:
    """Join keys of a non-empty sorted token set, of each band it belongs to."""
    return np.concatenate([_pieces(tokens, b, frequent) for b in _bands(len(tokens))]).view(np.int64)


def fold(sketch: np.ndarray) -> np.ndarray:
    """A dense sketch folded to the shortest length."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH_BITS // 64), axis=0)


class _Seen:
    """Classes that a task has already sent; bounded, so a class may come again."""

    def __init__(self, most: int = 500_000):
        self.most, self.classes = most, {}

    def fresh(self, class_id: int) -> bool:
        if class_id in self.classes:
            return False
        if len(self.classes) >= self.most:
            self.classes.pop(next(iter(self.classes)))
        self.classes[class_id] = None
        return True


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Seen()
    for batch in parts(batches):
        sizes, classes, folds, sketches = [], [], [], []
        for words in words_of_rows(batch.column(1)):
            tokens = shingle_set(words)
            class_id = class_of(tokens) if len(tokens) else None
            sketch = dense_sketch(tokens) if len(tokens) and seen.fresh(class_id) else None
            sizes.append(len(tokens)), classes.append(class_id)
            folds.append(None if sketch is None else fold(sketch)), sketches.append(sketch)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
             *(pa.array(c, pa.list_(pa.int64())) for c in (folds, sketches))],
            names=["doc_id", "n", "class", "fold", "sketch"])


def _key_batches(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Texts to rows ``(key, class)``."""
    seen = _Seen()
    for batch in parts(batches):
        keys, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for words in words_of_rows(batch.column(0)):
            tokens = shingle_set(words)
            if len(tokens) and seen.fresh(class_id := class_of(tokens)):
                keys.append(join_keys(tokens, frequent))
                classes.append(np.full(len(keys[-1]), class_id, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(classes))],
                                         names=["key", "class"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(class, text)`` to ``(class, tokens)``; a text of another class, under a
    repeated id, is left out."""
    none = np.zeros(0, np.uint64)
    for batch in parts(batches):
        sets = [shingle_set(w) for w in words_of_rows(batch.column(1))]
        own = np.array([class_of(s) if len(s) else -1 for s in sets], np.int64) == batch.column(0).to_numpy(zero_copy_only=False)
        tokens = pa.array([(s if ok else none).view(np.int64) for s, ok in zip(sets, own, strict=True)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), tokens], names=["class", "tokens"]).filter(pa.array(own))


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to rows ``(class, tokens)`` of those with words."""
    seen = _Seen()
    for batch in parts(batches):
        sets = [s for s in map(shingle_set, words_of_rows(batch.column(0))) if len(s)]
        sets = [(c, s) for c, s in ((class_of(s), s) for s in sets) if seen.fresh(c)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in sets], pa.int64()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64()))],
            names=["class", "tokens"])


def _add_class(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The class of each row's last column in its place; null without words."""
    for batch in parts(batches):
        sets = map(shingle_set, words_of_rows(batch.columns[-1]))
        classes = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], classes], names=[*batch.schema.names[:-1], name])


def _slice_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Texts to rows ``(slice, tails)``: the tokens' leading bits, and the 32 bits
    behind them of every token of the slice, once for each document."""
    heads = np.arange(1 << bits, dtype=np.uint64) << np.uint64(32)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        marks = np.concatenate(held)
        held.clear()
        marks.sort()
        ends = np.append(np.searchsorted(marks, heads), len(marks))
        some = np.flatnonzero(np.diff(ends))
        tails = marks.astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([tails[ends[k]:ends[k + 1]].tobytes() for k in some], pa.binary())],
            names=["slice", "tails"])

    held, many = [], 0
    for batch in parts(batches):
        for words in words_of_rows(batch.column(0)):
            marks = token_marks(shingle_set(words), bits)
            held.append(marks[np.append(True, marks[1:] != marks[:-1])] if len(marks) else marks)
            many += len(held[-1])
            if many >= HELD:
                yield sent(held)
                many = 0
    if many:
        yield sent(held)


def _counted(rows: pa.Table, least: int) -> pa.Table:
    """Marks of one slice in ``least`` documents or more, and in how many."""
    tails, counts = np.unique(np.concatenate([np.frombuffer(t, np.uint32) for t in rows.column("tails").to_pylist()]), return_counts=True)
    often = counts >= least
    head = rows.column("slice")[0].as_py() << 32
    return pa.table({"t": pa.array(tails[often].astype(np.int64) + head), "c": pa.array(counts[often].astype(np.int64))})


def token_marks(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``32 + bits`` bits of tokens, by which they are counted."""
    return tokens >> np.uint64(32 - bits)


def frequent_tokens(docs: DataFrame) -> Frequent:
    """Tokens in ``FREQUENT_COUNT`` documents or more, the ``FREQUENT`` most frequent.

    Every document counts. Tokens are counted by their leading 32 bits and as
    many more as there are slices for, which grow with the documents.
    """
    bits = min(SLICE_BITS, (docs.count() // SLICE_DOCS).bit_length())
    found = (docs.select("text").mapInArrow(lambda it: _slice_batches(it, bits), "slice bigint, tails binary")
             .groupBy("slice").applyInArrow(lambda rows: _counted(rows, FREQUENT_COUNT), "t bigint, c bigint")
             .orderBy(F.desc("c"), "t").limit(FREQUENT).select("t").toArrow())
    return Frequent(np.sort(found.column("t").to_numpy().view(np.uint64)), bits)


# distance of two sketches, the longer folded onto the shorter
_HAMMING = """
    aggregate(sequence(0, least(size(ask), size(bsk)) - 1), 0, (d, k) -> d + bit_count(
        aggregate(sequence(k, size(ask) - 1, least(size(ask), size(bsk))), 0L, (x, i) -> x ^ ask[i]) ^
        aggregate(sequence(k, size(bsk) - 1, least(size(ask), size(bsk))), 0L, (x, i) -> x ^ bsk[i])))
"""


def _folded():
    return sum((F.bit_count(F.col("af")[k].bitwiseXOR(F.col("bf")[k])) for k in range(1, SKETCH_BITS // 64)),
               F.bit_count(F.col("af")[0].bitwiseXOR(F.col("bf")[0])))


def _bounds(num: int, den: int, distance):
    """Necessary conditions on sizes (an, bn) and sketch distance of a linked pair."""
    # |A xor B| <= (1 - J) / (1 + J) * (|A| + |B|)
    far = distance * (den + num) > (F.col("an") + F.col("bn")) * (den - num)
    return F.when(F.least("an", "bn") * den < F.greatest("an", "bn") * num, False).otherwise(~far)


def jaccard_components(docs: DataFrame, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of ``docs (doc_id, text, ..)``.

    ``component_id`` is the smallest ``doc_id`` reachable by links. Null and
    empty texts have an empty set, are linked with nothing and stand for
    themselves. Rows that repeat a ``doc_id`` count as documents of their own
    with that id; a null ``doc_id`` is kept and never names a component, but its
    text links others. Other columns are ignored, whatever their names. An empty table gives none.
    ``threshold`` is a fraction of at least 3/4.
    """
    num, den = threshold
    if 4 * num < 3 * den:
        raise ValueError("the pigeonhole cut is built for similarities of 0.75 and more")
    signed, own = _classified(docs, num, den)
    own = own.select(F.col("class").alias("member"), "component")
    return (signed.join(own, F.col("class") == F.col("member"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component", "doc_id").alias("component_id")))


def _classified(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Every document with its class, and ``(class, root, component)`` of the classes."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs))
    signed = written(docs.mapInArrow(_sign_batches, SIGNED), "jaccard-signed")

    classes = written(
        signed.where("class is not null").groupBy("class")
        .agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.first("fold", True).alias("fold"), F.first("sketch", True).alias("sketch")),
        "jaccard-classes")
    # keys are made from the texts again: cheaper than a stored copy of them
    groups = _shared_keys(docs.select("text").mapInArrow(
        lambda it: _key_batches(it, frequent.value), "key bigint, class bigint"))
    roots = _roots(docs, classes, groups, num, den)

    own = classes.join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "doc", F.coalesce("root", "class").alias("root"))
    names = own.groupBy("root").agg(F.min("doc").alias("component"))
    return signed, own.join(names, "root").select("class", "root", "component")


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """Written rows ``(key, class, hub)`` of keys that two classes or more share."""
    return written(
        keyed.selectExpr("key", "class", "min(class) over (partition by key) as hub",
                         "max(class) over (partition by key) as last")
        .where("hub < last").select("key", "class", "hub").distinct(), "jaccard-groups")


def _roots(docs: DataFrame, classes: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Components ``(node, root)`` of the linked classes."""
    join = _Verifier(docs, classes, num, den)

    # hub rounds: each class against a hub of its keys, first the smallest class
    links = join.links(groups.where("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")), "hub-0")
    left = groups.select("key", "class")
    for k in range(1, HUB_ROUNDS + 1):
        roots = connected_components(links)
        left = _unsettled(left, roots, f"jaccard-left-{k}")
        if k == HUB_ROUNDS or left.isEmpty():
            break
        # then one member of the largest component of the group
        hubs = (left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("class").alias("hub"))
                .groupBy("key").agg(F.max_by(F.struct("hub", "comp"), F.struct("c", "hub")).alias("h")))
        links = links.unionAll(join.links(
            left.join(hubs, "key").where("comp <> h.comp")
            .select(F.least("class", "h.hub").alias("a"), F.greatest("class", "h.hub").alias("b")), f"hub-{k}"))
    if left.isEmpty():
        return roots
    # whatever is still in different components: every pair of a group
    side = left.join(classes.select("class", "n", "fold"), "class")
    one, two = (side.select(F.col("key").alias(x + "k"), F.col("class").alias(x), F.col("comp").alias(x + "c"),
                            F.col("n").alias(x + "n"), F.col("fold").alias(x + "f")) for x in "ab")
    rest = one.join(two, (F.col("ak") == F.col("bk")) & (F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc"))
                    & _bounds(num, den, _folded()))
    more = join.links(rest.select("a", "b", "an", "bn"), "rest", folded=True)
    return roots if more.isEmpty() else connected_components(links.unionAll(more))


class _Verifier:
    """Checks pairs of classes on their full sets, which are read for the classes
    of the pairs alone."""

    def __init__(self, docs: DataFrame, classes: DataFrame, num: int, den: int):
        self.docs, self.num, self.den = docs, num, den
        self.names = classes.select("class", "doc")
        self.facts = classes.select("class", "n", "fold", "sketch")

    def links(self, pairs: DataFrame, name: str, folded: bool = False) -> DataFrame:
        """Linked pairs among ``pairs (a, b)``: bounds first, then full sets.
        ``folded``: they carry ``an`` and ``bn`` and have passed the short sketch."""
        def facts(x: str) -> DataFrame:
            return self.facts.select(F.col("class").alias(x), F.col("n").alias(x + "n"), F.col("fold").alias(x + "f"),
                                     F.col("sketch").alias(x + "sk"))

        near = pairs.distinct()
        if not folded:
            near = near.join(facts("b").drop("bsk"), "b").join(facts("a").drop("ask"), "a")
            near = near.where(_bounds(self.num, self.den, _folded())).select("a", "b", "an", "bn")
        near = near.join(facts("b").select("b", "bsk"), "b").join(facts("a").select("a", "ask"), "a")
        near = near.where(_bounds(self.num, self.den, F.expr(_HAMMING)))
        return self.verified(written(near.select("a", "b"), f"jaccard-{name}"), name)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        members = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
        ids = written(members.join(self.names, "class").select(F.col("doc").alias("id"), "class"), f"jaccard-members-{name}")
        few = ids.count() <= SMALL_IDS
        ids = F.broadcast(ids) if few else ids
        rows = (self.docs.join(ids, F.col("doc_id") == F.col("id")).select("class", "text")
                .mapInArrow(_set_batches, CLASS_SETS))
        nameless = ids.where("id is null").select("class")
        if not nameless.isEmpty():  # no row of theirs has an id: their texts tell the class
            alone = (self.docs.where("doc_id is null").select("text").mapInArrow(_class_batches, CLASS_SETS)
                     .join(nameless, "class", "left_semi").dropDuplicates(["class"]))
            rows = rows.unionAll(alone)
        sets = written(rows, f"jaccard-sets-{name}")
        both = (pairs.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("bt")), "b")
                .join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("at")), "a"))
        common = F.size(F.array_intersect("at", "bt"))
        linked = common * self.den >= (F.size("at") + F.size("bt") - common) * self.num
        return written(both.where(linked).select("a", "b"), f"jaccard-links-{name}")


def _unsettled(left: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Rows of the groups that hold several components: ``(key, class, comp)``."""
    rows = (left.select("key", "class").join(roots, F.col("class") == F.col("node"), "left")
            .select("key", "class", F.coalesce("root", "class").alias("comp")))
    mixed = (rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"))
             .where("lo < hi and c > 2").select(F.col("key").alias("mixed")))
    return written(rows.join(mixed, F.col("key") == F.col("mixed"), "left_semi"), name)


def keep_first(docs: DataFrame, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """``docs`` with one document of each component (the smallest ``doc_id``).

    Documents without words are in no group and stay. Rows equal in ``doc_id``
    and text are one document, of which one row stays; rows that share an id
    but not the text stay or go together. Rows with words but no id go where a
    row of their component has one; of a component without ids one row stays.
    All columns are kept as they are, whatever their names.
    """
    num, den = threshold
    signed, own = _classified(docs, num, den)
    own = written(own, "jaccard-classes-named")
    member, gone, again, kind, text = apart(docs, "member", "gone", "again", "text_class", "whole_text")
    groups = written(
        signed.where("doc_id is not null").join(own.select(F.col("class").alias(member), "component"), F.col("class") == F.col(member), "left")
        .select("doc_id", "n", "component"), "jaccard-components")
    surplus = groups.where("n > 0 and doc_id <> component").select(F.col("doc_id").alias(gone)).distinct()
    repeated = groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    few = surplus.count() <= SMALL_IDS
    mine = docs["doc_id"].cast("long")
    kept = docs.join(F.broadcast(surplus) if few else surplus, mine == F.col(gone), "left_anti")
    if not signed.where("doc_id is null and class is not null").isEmpty():
        kept = kept.where(mine.isNotNull()).unionByName(_nameless_kept(docs.where(mine.isNull()), own, member, kind, text))
    if repeated.isEmpty():
        return kept
    mine = kept["doc_id"].cast("long")
    once = kept.join(repeated, mine == F.col(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, mine == F.col(again), "left_anti").unionByName(once)


def _nameless_kept(docs: DataFrame, own: DataFrame, member: str, kind: str, text: str) -> DataFrame:
    """Rows without an id that stay: those without words, and one of each
    component in which no row has an id."""
    schema = StructType([*docs.schema.fields, StructField(kind, LongType())])
    rows = docs.select("*", F.col("text").cast("string").alias(text)).mapInArrow(lambda it: _add_class(it, kind), schema)
    first = own.where("component is null and class = root").select(F.col("class").alias(member))
    one = rows.join(first, F.col(kind) == F.col(member), "left_semi").dropDuplicates([kind])
    return rows.where(F.col(kind).isNull()).unionByName(one).drop(kind)
