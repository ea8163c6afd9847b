"""Source divergence, importance resampling and token counts against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from boxlens.llm import divergence, importance, token_counts
from tests.llm.conftest import prose

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FEATURE = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward(rng, n):
    """Texts of every kind: null, empty, blank, mixed scripts, long words."""
    letters = "abcXYZ09 .,\n-éß漢\x7f\x80한"
    return [None, "", " \t", ".", "x", "ab " * 40, "q" * 70 + " " + "é" * 33] + [
        "".join(rng.choice(letters) for _ in range(rng.choice([3, 40, 400]))) for _ in range(n)]


# --- op11 --------------------------------------------------------------------

@pytest.mark.parametrize("block", [1 << 22, 50])
def test_terms_are_packed_and_counted_exactly(monkeypatch, block):
    monkeypatch.setattr(divergence, "_BLOCK", block)
    texts = awkward(random.Random(1), 60) + ["z" * 16, "z" * 17, "z" * 8, "z" * 9, "word " * 90]
    group = np.sort(np.random.default_rng(1).integers(0, 4, len(texts)))
    n, docs = Counter(), Counter()
    for term, g, count, rows in divergence.counted(pa.array(texts, pa.large_string()), group):
        for t, k, c, d in zip(term.to_pylist(), g, count, rows, strict=True):
            n[t, k] += c
            docs[t, k] += d
    want_n, want_docs = Counter(), Counter()
    for text, k in zip(texts, group, strict=True):
        own = Counter(TERM.findall(lower(text)))
        want_n.update({(t, k): c for t, c in own.items()})
        want_docs.update((t, k) for t in own)
    assert n == want_n and docs == want_docs


def test_radix_order_sorts_words():
    rng = np.random.default_rng(2)
    words = tuple(rng.integers(0, 2**63, 3000).astype(np.uint64) % np.uint64(m) for m in (5, 2**40))
    order = divergence.radix_order(words)
    assert (order == np.lexsort((np.arange(3000), words[1], words[0]))).all()


def brute_divergences(rows, least_docs, top):
    found, langs, groups = defaultdict(lambda: [Counter(), Counter()]), defaultdict(set), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = Counter(TERM.findall(lower(text)))
        langs[lang].add(source)
        groups[lang, source].update(own)
        found[lang][0].update(own)
        found[lang][1].update(own.keys())
    out = []
    for lang, sources in langs.items():
        kept = [t for t, d in found[lang][1].items() if d >= least_docs]

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        of = {s: p(groups[lang, s]) for s in sources}
        q = p(found[lang][0])

        def f(a, b):
            return (a - b) * (a - b) // (a + b)

        for s in sources:
            pairs = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(of[s][t], q[t])) for t in kept if groups[lang, s][t] and of[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 18, 8])
def test_divergences_equal_brute_force(spark, monkeypatch, frame, cells):
    monkeypatch.setattr(divergence, "_CELLS", cells)
    rng = random.Random(3)
    rows = [(prose(rng, rng.randrange(30)) + rng.choice(["", " Été", " " + "long" * 9]), rng.choice(["en", "en", "de", None]),
             rng.choice(["hot", "hot", "a", "b", None])) for _ in range(120)]
    rows += [(t, "und", "x") for t in awkward(rng, 5)] + [(None, "alone", "x"), ("", "alone", "y"), ("one", "alone", "y")]
    rows += [rows[0]] * 3
    docs = frame([(k, *r) for k, r in enumerate(rows)])
    got = sorted(map(tuple, divergence.divergences(docs, least_docs=3, top=4).collect()))
    assert got == brute_divergences(rows, 3, 4)


def test_divergences_of_nothing(frame):
    assert divergence.divergences(frame([])).collect() == []


# --- op12 --------------------------------------------------------------------

@pytest.mark.parametrize("piece", [1 << 22, 64, 17])
@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_feature_buckets_equal_crc32(monkeypatch, piece, ngram):
    monkeypatch.setattr(importance, "_PIECE", piece)
    texts = awkward(random.Random(4), 60)
    got, words = defaultdict(list), Counter()
    for row, n, owner, values, counts in importance.features(pa.array(texts), ngram, 10_000):
        for o, v in zip(owner, values, strict=True):
            got[row + o].append(int(v))
        for k in range(n):
            words[row + k] += int(counts[k])
    for i, text in enumerate(texts):
        w = FEATURE.findall(lower(text))
        want = [zlib.crc32(" ".join(w[k:k + s]).encode()) % 10_000 for s in range(1, ngram + 1) for k in range(len(w) - s + 1)]
        assert sorted(got[i]) == sorted(want)
        assert words[i] == len(w)


def test_substring_crcs_from_registers():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    registers = importance.Registers(data)
    begin = rng.integers(0, 5001, 400)
    end = np.minimum(begin + rng.integers(0, 3000, 400), 5000)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(begin, end, strict=True)]
    assert registers.crc32(begin, end).tolist() == want


def brute_resampling(rows, target, ngram, buckets, least_words, percent):
    def feats(text):
        w = FEATURE.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[k:k + s]).encode()) % buckets for s in range(1, ngram + 1) for k in range(len(w) - s + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(feats(text)[1])
    for text in target:
        t.update(feats(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, own = feats(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(own), weight, score, words >= least_words))
    drawn = sum(r[-1] for r in out) * percent // 100
    ranked = sorted((r for r in out if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = Counter(r[:4] + (k,) for k, r in enumerate(ranked[:drawn], 1))
    return rank, Counter(r[:4] for r in out)


@pytest.mark.parametrize("ngram, percent", [(1, 10), (2, 55)])
def test_resampling_equals_brute_force(spark, frame, ngram, percent):
    rng = random.Random(6)
    target = [prose(rng, 40), None, "", "Ünïcode words"]
    rows = [(k, prose(rng, rng.choice([0, 5, 19, 20, 21, 200]))) for k in range(150)]
    rows += [(None, target[0] + " " + prose(rng, 3)), (7, target[0]), (7, target[0]), (500, prose(rng, 30_000))]
    rows += [(600 + k, t) for k, t in enumerate(awkward(rng, 20))]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string")
    got = importance.resampled(frame([(i, t) for i, t in rows]), bench, ngram, percent=percent).collect()
    rank, all_rows = brute_resampling(rows, target, ngram, importance.BUCKETS, importance.LEAST_WORDS, percent)
    assert Counter(tuple(r)[:4] for r in got) == all_rows
    assert Counter(tuple(r) for r in got if r["rank"] is not None) == rank


def test_resampling_of_nothing(spark, frame):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resampled(frame([]), bench).collect() == []
    assert [tuple(r) for r in importance.resampled(frame([(1, None)]), bench).select("n_features", "weight", "rank").collect()] == [(0, 0, None)]


# --- op13 --------------------------------------------------------------------

@pytest.fixture(scope="module")
def counter():
    from tokenizers import Tokenizer

    text = token_counts.vocabulary_text()
    tokenizer = Tokenizer.from_str(text)
    return tokenizer, token_counts.Counter(text, token_counts.whole_tokens(tokenizer)), text


def odd_texts(n):
    rng = random.Random(7)
    letters = "ab'sStTreREvVmMlLdD09 \t\n\x1c\x85\xa0.,<|>éÉ̱́HhßΣσςİıǅ　、。漢字ガが가½²‍😀٣ⅷK\x00\x7f"
    for i in range(n):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        yield x[:5] + rng.choice(["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>"]) + x[5:] if i % 10 == 0 else x


@pytest.mark.parametrize("run, window", [(1 << 14, 1 << 20), (6, 9)])
def test_counts_equal_the_library(monkeypatch, counter, run, window):
    monkeypatch.setattr(token_counts, "_LONG_RUN", run)
    monkeypatch.setattr(token_counts, "_WINDOW", window)
    tokenizer, _, text = counter
    own = token_counts.Counter(text, token_counts.whole_tokens(tokenizer))
    for x in odd_texts(5000):
        assert own.tokens(x.encode()) == len(tokenizer.encode(x, add_special_tokens=False).ids), repr(x)


def test_memory_of_counts_is_bounded(monkeypatch, counter):
    tokenizer, _, text = counter
    monkeypatch.setattr(token_counts, "_REMEMBERED", 50)
    own = token_counts.Counter(text, token_counts.whole_tokens(tokenizer)[:100])
    for x in odd_texts(600):
        assert own.tokens(x.encode()) == len(tokenizer.encode(x, add_special_tokens=False).ids)
        assert len(own) <= 151 and len(own.pieces) <= 151


def test_proved_strings_are_one_token(counter):
    tokenizer, own, _ = counter
    assert len(own.whole) > 30_000
    for piece in random.Random(8).sample(list(own.whole), 300):
        assert len(tokenizer.encode(piece.decode(), add_special_tokens=False).ids) == 1


def test_token_counts_of_every_row(frame, counter):
    tokenizer, _, _ = counter
    rng = random.Random(9)
    texts = [None, "", " ", "ab", "ab", prose(rng, 40_000), "x" * 100_000, "<|endoftext|> a", *odd_texts(50)]
    rows = token_counts.token_counts(frame([(k or None, t) for k, t in enumerate(texts)])).collect()
    want = []
    for k, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((k or None, len((t or "").encode()), n, n > 2048))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert token_counts.token_counts(frame([])).collect() == []


# --- mends of op4 and op9 ----------------------------------------------------

def plain_forward(text, pieces, log_prob):
    """Log of the sum over all segmentations, position by position over the whole run."""
    from boxlens.llm.langid import START

    alpha = np.full((len(text) + 1, log_prob.shape[1]), -np.inf)
    alpha[0] = 0
    longest = max(map(len, pieces))
    for e in range(1, len(text) + 1):
        for b in range(max(0, e - longest), e):
            names = [text[b:e], START + text[b:e]] if b == 0 else [text[b:e]]
            ids = [pieces[x] for x in names if x in pieces]
            if e == b + 1 and not ids:
                ids = [len(pieces)]
            for p in ids:
                alpha[e] = np.logaddexp(alpha[e], alpha[b] + log_prob[p])
    return alpha[-1]


@pytest.fixture(scope="module")
def language_pieces():
    from boxlens.llm import langid
    from boxlens.llm.common import vocabulary_path

    pieces = {p: k for k, p in enumerate(langid.load_pieces(vocabulary_path(langid.VOCABULARY)))}
    prob = np.random.default_rng(10).random((len(pieces) + 1, 3))
    prob /= prob.sum(axis=0)
    return langid.Model(["a", "b", "c"], pieces, prob, np.zeros(3))


def test_a_worker_forgets_a_task_s_words(language_pieces, monkeypatch):
    from boxlens.llm import langid

    m, rng = language_pieces, random.Random(4)
    texts = [None, "", "12 !", *(prose(rng, rng.randint(1, 40)) for _ in range(600))]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})

    def judged():
        out = pa.Table.from_batches(langid._predict(iter([batch, batch]), m, "words")).to_pylist()
        assert not langid._kept["words"].known and not langid._kept["words"].table.size
        return out

    want = judged()
    assert [r["lang_pred"] for r in want[:3]] == ["und"] * 3
    # dropped in between, words are scored again and alike
    monkeypatch.setattr(langid, "CACHE", 10)
    assert judged() == want
    # a task that ends early leaves nothing either
    some = langid._predict(iter([batch, batch]), m, "words")
    next(some), some.close()
    assert not langid._kept["words"].known


def test_long_runs_are_scored_whole(language_pieces):
    from boxlens.llm import langid

    m = language_pieces
    rng = random.Random(11)
    long = "".join(rng.choice("etaonrishdlu漢") for _ in range(5000))
    for text in (long, long[:33], "größe", "x", "हिन्दी", "ççç" * 30):
        got = langid.run_log_likelihood(text, m.pieces, m.prefixes(), m.longest(), np.log(m.prob))
        assert np.allclose(got, plain_forward(text, m.pieces, np.log(m.prob)), rtol=1e-9)
        if len(text) <= langid.WIDE:
            assert np.allclose(langid.Lattice([text], m.pieces, m.prefixes()).log_likelihood(m.prob)[0], got, rtol=1e-9)


def test_long_runs_teach_as_in_blocks(language_pieces, monkeypatch):
    from boxlens.llm import langid

    words, counts = ["interessant", "wunderbar", "der"], np.array([[2.0, 0], [0, 1], [5, 1]])
    whole = langid.expectation_maximisation(words, counts, language_pieces.pieces)
    monkeypatch.setattr(langid, "WIDE", 4)
    assert np.allclose(langid.expectation_maximisation(words, counts, language_pieces.pieces), whole, rtol=1e-6, atol=1e-12)


def test_letters_and_marks():
    from boxlens.llm.langid import words_of

    assert words_of("½ ² _ 3 · ́") == []
    assert words_of("हिन्दी Straße_x2y café́s") == ["हिन्दी", "straße", "x", "y", "café́s"]
    assert [len(w) for w in words_of("é" * 5000 + " b")] == [5000, 1]


def test_no_word_of_the_sample_is_dropped_and_names_may_clash(spark, frame):
    from boxlens.llm import langid

    rng = random.Random(12)
    rows = [(k, prose(rng, 8) if k % 2 else "zz yy " + prose(rng, 2), "l1" if k % 2 else "l2") for k in range(60)]
    model = langid.learn(frame(rows))
    docs = frame([(k, t) for k, t, _ in rows] + [(900, "½ ²"), (901, None)],
                 "doc_id bigint, text string, lang_pred string, score double, whole_text string, Score_ int, __score int")
    kept = langid.identified_kept(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert {r.lang_pred for r in langid.identify(docs.where("doc_id >= 900"), model).collect()} == {"und"}


@pytest.mark.parametrize("rows, least", [(400, 0.85), (2000, 0.9)])
def test_forest_recall_at_the_set_share(spark, rows, least):
    from boxlens.llm import ann

    x = np.random.default_rng(rows).normal(size=(rows, 32))
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    found = defaultdict(set)
    for r in ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    recall = np.mean([len(found[q] & set(np.argsort(-scores[q])[:5].tolist())) / 5 for q in range(0, rows, 20)])
    assert recall >= least


def test_forest_reads_a_part_of_the_table():
    from boxlens.llm import ann

    x = ann._unit(np.random.default_rng(13).normal(size=(2000, 32)))
    rng = np.random.default_rng(14)
    forest = [ann.grow(x, rng) for _ in range(ann.TREES)]
    where = [ann.leaves_of(t, x) for t in forest]
    read = [np.logical_or.reduce([where[k] == leaf for k, leaf in ann.search(forest, x[i], ann.SEARCH_SHARE * len(x))]).mean() for i in range(0, 2000, 100)]
    assert np.mean(read) <= 0.65


# --- mends of op3 ------------------------------------------------------------

def test_archives_are_converted_and_read_by_many_tasks(spark, tmp_path):
    from boxlens.llm import arc

    rng = random.Random(15)
    pages = spark.createDataFrame([(k, f"http://x/{k}", prose(rng, 40)) for k in range(40)], "page_id bigint, url string, html string")
    manifest = arc.write_arc(pages.repartition(6), f"file://{tmp_path}/arc")
    files = manifest.count()
    warcs = arc.convert(manifest, f"file://{tmp_path}/warc")
    assert files == warcs.count() == 6  # each task has written a file
    assert arc.read_warc(warcs).rdd.getNumPartitions() >= files
    assert sorted(r.page_id for r in arc.read_warc(warcs).select("page_id").collect()) == list(range(40))


def test_scratch_archives_are_deleted(spark, monkeypatch):
    from boxlens.llm import arc

    gone = []
    monkeypatch.setattr(arc, "discard", lambda session, path, f=arc.discard: (gone.append(path), f(session, path)))
    pages = spark.createDataFrame([(1, "u", "a"), (2, None, "a")], "page_id bigint, url string, html string")
    assert sorted(r.record_type for r in arc.archived(pages).collect()) == ["response", "revisit"]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in gone]
    assert len(paths) == 2 and not any(p.getFileSystem(conf).exists(p) for p in paths)
