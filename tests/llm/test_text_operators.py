"""Near duplicates, decontamination, sharding and mixing against brute force."""

from __future__ import annotations

import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boxlens.llm import decontaminate, jaccard_join, mixing, sharding
from boxlens.llm.common import PART_ROWS, shingle_set, words_of_rows
from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    """component of each row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    line = prose(rng, 12)
    texts = []
    for size in (1, 2, 4, 5, 6, 9, 20, 45, 46, 60, 61, 62, 63, 64, 65, 80, 240, 256, 300):
        base = prose(rng, size).split()
        texts.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, size // 20])):
                k = rng.randrange(len(copy) + 1)
                copy[k:k + rng.choice([0, 1])] = [rng.choice("xx yy zz".split())]
            texts.append(copy)
        texts.append(line.split() + base)
        texts.append(base + line.split())
    texts += [prose(rng, 30).split() + line.split() for _ in range(40)]
    out = [(k, " ".join(t) if k % 3 else "\n".join(t).upper()) for k, t in enumerate(texts)]
    rng.shuffle(out)
    return out


def test_words_match_the_rule():
    texts = ["A\x0bb  c d\te\n", None, "", " ", "ÄX é\x1fy z", "x" * 3000 + " " + "x" * 3001, "a b " * 400_000]
    got = list(words_of_rows(pa.array(texts)))
    names = {}
    for t, h in zip(texts, got, strict=True):
        assert len(words(t)) == len(h)
        for w, x in zip(words(t), h.tolist(), strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    assert [x.tolist() for x in words_of_rows(pa.array(texts)[2:5])] == [x.tolist() for x in got[2:5]]


def test_components_equal_all_pairs(frame):
    for seed in (1, 2):
        rows = corpus(seed)
        got = jaccard_join.jaccard_components(frame(rows)).collect()
        assert sorted(map(tuple, got)) == sorted(groups(rows))


def test_components_of_a_large_group_and_awkward_rows(frame):
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = []
    for k in range(400):  # near copies that drift apart, so that links form chains
        copy = list(base)
        copy[rng.randrange(120)] = f"w{k}"
        if k % 4 == 0:
            copy[:12] = [f"v{k % 16}{x}" for x in range(12)]
        rows.append((1000 - k, " ".join(copy)))
    rows += [(5000 + k, rows[0][1]) for k in range(50)] + [(9, None), (8, ""), (7, " \t"), (6, "only four words here"), (5, "only four words here")]
    assert sorted(map(tuple, jaccard_join.jaccard_components(frame(rows)).collect())) == sorted(groups(rows))
    assert jaccard_join.jaccard_components(frame([])).collect() == []


def test_frequent_tokens_are_counted_over_all_documents(spark):
    least = jaccard_join.FREQUENT_COUNT
    # passages in as many of 60,000 documents as make them frequent, and in one less
    docs = spark.range(60_000).selectExpr(
        "id as doc_id", f"""case when id % 1000 < {least} then concat('often in passage number ', id div 1000)
        when id % 1000 < {2 * least - 1} then concat('seldom in passage number ', id div 1000)
        when id % 7 = 0 then null else concat(id, ' alone') end as text""")
    found = jaccard_join.frequent_tokens(docs)

    def tokens(word):
        texts = pa.array([f"{word} in passage number {k}" for k in range(60)])
        return np.concatenate([shingle_set(w) for w in words_of_rows(texts)])

    assert len(found.marks) == 60
    assert found.among(tokens("often")).all() and not found.among(tokens("seldom")).any()
    # repeated within a document, a passage counts once
    again = spark.range(least - 1).selectExpr("id as doc_id", "repeat('one two three four five ', 20) as text")
    assert not len(jaccard_join.frequent_tokens(again).marks)


def test_large_batches_are_worked_on_in_parts(monkeypatch):
    rng, n = random.Random(17), 2 * PART_ROWS + 7
    texts = [None, "", "One", *(prose(rng, rng.randint(1, 30)) for _ in range(n - 3))]
    sets = [shingle_set(w) for w in words_of_rows(pa.array(texts))]
    classes = [jaccard_join.class_of(s) if len(s) else None for s in sets]
    whole = pa.record_batch({"doc_id": pa.array(range(n)), "text": pa.array(texts)}).slice(1)
    none = jaccard_join.Frequent(np.zeros(0, np.uint64), 0)

    signed = list(jaccard_join._sign_batches(iter([whole])))
    assert [b.num_rows for b in signed] == [PART_ROWS, PART_ROWS, 6]
    assert [r for b in signed for r in b.column("class").to_pylist()] == classes[1:]
    keyed = list(jaccard_join._key_batches(iter([whole.select(["text"])]), none))
    assert len(keyed) == 3
    want = {c: jaccard_join.join_keys(s, none).tolist() for c, s in zip(classes, sets, strict=True) if c is not None}
    got = defaultdict(list)
    for b in keyed:
        for key, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[c].append(key)
    assert got == want
    asked = pa.record_batch({"class": pa.array([-2 if c is None else c for c in classes]), "text": pa.array(texts)})
    read = list(jaccard_join._set_batches(iter([asked])))
    assert len(read) == 3
    assert [t for b in read for t in b.column("tokens").to_pylist()] == [s.view(np.int64).tolist() for s in sets if len(s)]

    # tokens that are held go once, however often a task sends
    monkeypatch.setattr(jaccard_join, "HELD", 1_000)
    sent = list(jaccard_join._slice_batches(iter([whole.select(["text"])]), 3))
    assert len(sent) > 3
    marks = [(k << 32) + int(t) for b in sent for k, x in zip(*(c.to_pylist() for c in b.columns), strict=True) for t in np.frombuffer(x, np.uint32)]
    assert sorted(marks) == sorted(int(m) for s in sets for m in np.unique(jaccard_join.token_marks(s, 3)))


def test_keep_first(frame):
    rng = random.Random(8)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(3, a), (2, a.upper()), (4, b), (4, b), (5, None), (6, ""), (None, a), (None, None)]
    kept = jaccard_join.keep_first(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.select("doc_id", F.coalesce("text", F.lit("-")).alias("text")).collect()) == sorted(
        [(2, a.upper()), (4, b), (5, "-"), (6, ""), (-1, "-")])


def test_texts_without_an_id_link_others(frame):
    rng = random.Random(11)
    # each holds the text without an id and twelve words more, at either end
    middle, other = prose(rng, 60), prose(rng, 40)
    first, last = prose(rng, 12) + " " + middle, middle + " " + prose(rng, 12)
    rows = [(7, first), (None, middle), (None, middle), (3, last), (None, other), (None, other.upper()), (None, other + " more")]
    got = sorted(map(tuple, jaccard_join.jaccard_components(frame(rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 3), (None, 3), (None, None), (None, None), (None, None)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_first(frame(rows)).collect()]
    assert (3, last) in kept and len(kept) == 2
    assert [i for i, t in kept if t.startswith(other) or t == other.upper()] == [None]


def test_stages_keep_columns_of_clashing_names(spark):
    rng = random.Random(12)
    names = ["member", "gone", "again", "text_class", "whole_text", "mix_g", "mix_u", "mix_copies", "g", "u", "cut", "component", "n", "class"]
    a = prose(rng, 40)
    rows = [(k, t, "en", "s", *[f"{n}{k}" for n in names]) for k, t in enumerate([a, a, prose(rng, 40), None, ""])]
    rows += [(None, a, "en", "s", *names), (4, "", None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string")
    kept = jaccard_join.keep_first(docs)
    assert sorted((r["doc_id"], r["class"][:5]) for r in kept.collect()) == [(k, "class") for k in (0, 2, 3, 4)]
    assert decontaminate.decontaminated(docs, bench).count() == len(rows)
    more = mixing.mixed(docs, repeats=1.5)
    assert kept.columns == more.columns == docs.columns and more.count() >= len(rows)


def test_windows_of_a_very_long_text(frame, spark):
    rng = random.Random(13)
    items = [(k, prose(rng, n)) for k, n in enumerate([12, 60, 300])]
    index = decontaminate.ItemIndex([(k, next(words_of_rows(pa.array([t])))) for k, t in items])
    filler = prose(rng, 3 * decontaminate._PIECE).split()
    # an item over the border of two pieces, one inside, one at the end
    at = decontaminate._PIECE - 30
    text = " ".join([*filler[:at], items[1][1], *filler[at:2 * at], items[0][1], *filler[2 * at:], items[2][1]])
    words = next(words_of_rows(pa.array([text])))
    got = {(i, s): v for _, i, s, v in index.hits(words, np.zeros(len(words), np.int64))}
    for i, start in ((1, at), (0, 2 * at + 60), (2, len(words) - 300)):
        assert got[i, start] == 1.0
    tracemalloc.start()
    list(index.hits(np.tile(words, 8), np.zeros(8 * len(words), np.int64)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 8 * len(words) and len(got) >= 3


def test_multi_index_finds_all_fingerprints_within_the_radius():
    rng = random.Random(3)
    items = [(k, next(words_of_rows(pa.array([prose(rng, n)])))) for k, n in enumerate([3, 15, 16, 17, 40, 41, 59])]
    index = decontaminate.ItemIndex(items)
    text = next(words_of_rows(pa.array([prose(rng, 3000)])))
    text = np.concatenate([text, items[4][1], text[:50], items[1][1]])
    got = {(item, at) for item, at, _ in index.candidates(text, np.zeros(len(text), np.int64))}
    for size, prints, item, _, _ in index.sizes:
        seen = decontaminate.simhash(text, size)
        for p, k in zip(prints.tolist(), item.tolist(), strict=True):
            for at in np.flatnonzero(np.bitwise_count(seen ^ np.uint64(p)) <= decontaminate.RADIUS):
                assert (k, int(at)) in got
    bits = [sum(1 if int(w) >> k & 1 else -1 for w in text[5:20].tolist()) > 0 for k in range(64)]
    own = decontaminate.simhash(text, 15)[5]
    # bit order differs, the bits do not
    assert sorted(np.unpackbits(np.array([own]).view(np.uint8)).tolist()) == sorted(map(int, bits))


def test_decontamination(frame, spark):
    rng = random.Random(4)
    items = [(k, prose(rng, n)) for k, n in enumerate([4, 15, 30, 59, 130])] + [(90, None), (91, ""), (None, prose(rng, 20))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    rows = [(k, prose(rng, 200) + "\n" + t.upper() + " " + prose(rng, 100)) for k, t in items[1:5]]
    edited = items[4][1].split()
    edited[60] = "changed"
    rows += [(20, " ".join(edited)), (21, prose(rng, 400)), (22, None), (23, ""), (24, items[0][1]), (25, items[2][1][:60]), (24, items[0][1])]
    hits = decontaminate.contaminated(frame(rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in hits) == [(1, 1), (2, 2), (3, 3), (4, 4), (20, 4), (24, 0), (24, 0)]
    assert {r["doc_id"]: r["first_word"] for r in hits}[1] == 200
    clean = decontaminate.decontaminated(frame(rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [21, 22, 23, 25] and clean.columns == frame(rows).columns
    assert decontaminate.contaminated(frame(rows), bench.limit(0)).collect() == []
    assert decontaminate.contaminated(frame([]), bench).collect() == []


def every_window(item, row):
    """Windows of the item's size that reach the threshold, cut at the row's ends: (begin, end)."""
    a, out = Counter(shingle_list(item)), {}
    if len(row) > 4 < len(item) and not a.keys() & set(shingle_list(row)):
        return out
    for start in range(1 - len(item), len(row)):
        lo, hi = max(start, 0), min(start + len(item), len(row))
        b = Counter(shingle_list(row[lo:hi]))
        common = sum((a & b).values())
        if common / (a.total() + b.total() - common) >= decontaminate.THRESHOLD:
            out[lo, hi] = common / (a.total() + b.total() - common)
    return out


def shingle_list(w):
    return [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))]


def test_decontamination_equals_all_windows(frame, spark):
    rng = random.Random(11)
    items = [prose(rng, n).split() for n in (3, 5, 8, 16, 24, 40, 40, 59, 130)] + [["ban", "cor"] * 20]

    def edits(w):
        n = len(w)
        yield w
        for share in (0.05, 0.1, 0.2, 0.3):
            cut = max(1, int(n * share))
            yield w[:n - cut]
            yield w[cut:]
            yield w[cut // 2:n - (cut + 1) // 2]
            yield w[:n // 2] + w[n // 2 + cut:]
            yield w[:n // 3] + prose(rng, cut).split() + w[n // 3 + cut:]
            yield w[:n // 2] + prose(rng, cut).split() + w[n // 2:]
        for changed in (1, 2, 3, 4):
            v = list(w)
            for k in rng.sample(range(n), min(n, changed)):
                v[k] = "changed"
            yield v

    rows = []
    for w in items:
        for e in edits(w):
            rows += [e, prose(rng, 30).split() + e, e + prose(rng, 70).split(), prose(rng, 90).split() + e + prose(rng, 200).split() + e]
    want = {}
    for i, w in enumerate(items):
        for k, row in enumerate(rows):
            if found := every_window(w, row):
                want[k, i] = (len(found), max((s, -lo) for (lo, _), s in found.items()))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["windows"], (r["similarity"], -r["first_word"]))
           for r in decontaminate.contaminated(frame([(k, " ".join(w)) for k, w in enumerate(rows)]), bench).collect()}
    assert len(want) > 400 and got == want


def check_shards(rows, out, shards, slack):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for s, at in slots.items():
        assert 0 <= s < shards and sorted(at) == list(range(len(at)))
    if rows:
        mean = sum(size.values()) / shards
        assert all(abs(size[s] - mean) <= slack for s in range(shards)), dict(size)


def test_shards_are_equal_and_numbered(frame):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.choice([0, 1, 30, 400]))) for k in range(3000)] + [(None, None), (None, None), (5, "x")]
    rows += [(9000 + k, "copied here and there") for k in range(20)]
    out = sharding.shard_by_bytes(frame(rows)).collect()
    check_shards(rows, out, 8, 2500)
    assert len({r["shard"] for r in out if r["text_crc32"] == zlib.crc32(b"copied here and there")}) == 1
    hot = rows + [(20_000 + k, "one text that a third of all rows share " * 10) for k in range(2000)]
    check_shards(hot, sharding.shard_by_bytes(frame(hot)).collect(), 8, 2500)
    for few in ([], [(1, None)], [(1, "a"), (1, "a")]):
        out = sharding.shard_by_bytes(frame(few)).collect()
        check_shards(few, out, 8, 10)


def brute_mix(rows, repeats=None, entropy=None, cover=False):
    """Reads of each (id, source, tokens, u), by sorting each source."""
    sources = defaultdict(list)
    for r in rows:
        sources[r["g"]].append((r["u"], r["id"] if r["id"] is not None else -(1 << 62), r["tokens"]))
    total = {g: sum(t for *_, t in v) for g, v in sources.items()}
    live = {g: t for g, t in total.items() if t}
    everything = sum(live.values())

    def weights(a):
        z = sum((t / max(live.values())) ** a for t in live.values())
        return {g: (t / max(live.values())) ** a / z for g, t in live.items()}

    def met(a):
        w = weights(a)
        if entropy is not None:
            return -sum(x * np.log(x) for x in w.values()) <= entropy * np.log(len(w))
        goal = max(live[g] / w[g] for g in w) if cover else everything
        return max(goal * w[g] / live[g] for g in w) <= repeats

    lo, hi = 0.0, 1.0
    if met(0.0):
        hi = 0.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if met(mid) else (mid, hi)
    w = weights(hi)
    goal = max(live[g] / w[g] for g in w) if cover else everything
    out, budgets = Counter(), {}
    for g, members in sources.items():
        if g not in live:
            out.update((g, i) for _, i, _ in members)
            continue
        budget = int(w[g] * goal)
        budgets[g] = budget = max(budget, total[g]) if cover else budget
        full, rest = divmod(budget, total[g])
        done = 0
        for u, i, t in sorted(members):
            out[g, i] += full + (done < rest)
            done += t
    return out, budgets


def test_mixture_reads_budgets(frame, spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randrange(1, 60)), None, rng.choice(["a"] * 12 + ["b"] * 3 + ["c", None])) for k in range(1500)]
    rows += [(3000, None, None, "empty"), (3001, "", None, "empty"), (3002, "one two", None, "tiny")]
    docs = frame(rows)
    plain = mixing.plan_mix(docs, entropy=0.9)[0].collect()
    for goal in ({"entropy": 0.8}, {"repeats": 1.7}, {"repeats": 2.5, "budget": "cover"}):
        got = mixing.mixture(docs, **goal).collect()
        want, budgets = brute_mix(plain, goal.get("repeats"), goal.get("entropy"), "budget" in goal)
        reads = Counter(("n" if r["source"] is None else "s:" + r["source"], r["doc_id"]) for r in got)
        used = defaultdict(int)
        for r in got:
            used["n" if r["source"] is None else "s:" + r["source"]] += r["tokens"]
        for g, b in budgets.items():  # the exponent is bisected to 1e-8: a budget may differ by a row
            assert abs(used[g] - b) <= 130, (goal, g)
        assert sum(abs(reads[k] - want[k]) for k in reads | want) <= 8
        if "budget" in goal:
            assert all(reads[k] >= 1 for k in want)
        assert {r["mix_block"] for r in got} <= set(range(64))
    assert mixing.mixture(frame([]), repeats=2.0).collect() == []
    assert mixing.mixture(frame([(1, None, None, None)]), entropy=0.5).count() == 1


def test_every_mix_block_has_the_target_weights(frame):
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.randrange(1, 40)), None, "a" if k % 10 else rng.choice("bc")) for k in range(6000)]
    rows += [(9000, None, None, "a"), (9001, "", None, None)]
    docs = frame(rows)
    budget = {r["g"][2:]: r["budget"] for r in mixing.plan_mix(docs, entropy=0.95)[1].where("total > 0").collect()}
    got = defaultdict(int)
    for r in mixing.mixture(docs, entropy=0.95).collect():
        got[r["source"], r["mix_block"]] += r["tokens"]
    assert 0.2 < budget["a"] / sum(len(words(t or "")) for _, t, _, s in rows if s == "a") < 0.9
    for s, b in budget.items():
        for block in range(64):  # within two rows of its share
            assert abs(got[s, block] - b / 64) <= 80, (s, block)


def test_mixed_keeps_columns_and_every_document(frame):
    rng = random.Random(9)
    rows = [(k, prose(rng, 20), None, "big" if k % 10 else "small") for k in range(400)]
    out = mixing.mixed(frame(rows), repeats=1.5)
    assert out.columns == frame(rows).columns
    reads = Counter(r["doc_id"] for r in out.collect())
    assert set(reads) == set(range(400)) and max(reads.values()) == 2
    assert all(reads[k] == 1 for k in range(400) if k % 10)
    assert abs(sum(reads[k] for k in range(0, 400, 10)) - 60) <= 1
