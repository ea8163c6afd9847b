"""Extraction, quality, language, archives, search and secrets on small cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from boxlens.llm import ann, arc, html_extract, langid, quality, secrets
from tests.llm.conftest import prose


# --- HTML ---------------------------------------------------------------------
def test_minimum_cut_equals_brute_force():
    for seed in range(300):
        r = random.Random(seed)
        n = r.randint(1, 8)
        cost = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 3)) for a in range(n) for b in range(a) if r.random() < 0.5]

        def value(side, cost=cost, edges=edges):
            return (sum(-c if c < 0 and s else c if c > 0 and not s else 0 for c, s in zip(cost, side, strict=True))
                    + sum(w for a, b, w in edges if side[a] != side[b]))

        best = min(value(s) for s in itertools.product([False, True], repeat=n))
        assert value(html_extract.minimum_cut(cost, edges)) == pytest.approx(best)


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<script>var a = '<p>x</p>';</script>", ""), ("<!-- <p>no</p>", ""),
    ("<article><h1>A &amp; B</h1><p>One\n  two &lt;three&gt;&nbsp;four.<p>Five <b>six</b>seven.</article>", "A & B\nOne two <three> four.\nFive sixseven."),
    ("<nav><a href=/>Home</a></nav><main><p>Text of the article.</p></main><footer>&copy; 2020 them</footer>", "Text of the article."),
    ('<article><p>Here it is.</p><form><p>Sign up now.</p></form><div class="comments"><p>I think so too, my friend.</p></div></article>', "Here it is."),
    ('<article><p title="a > b">Kept.</p><style>p{}</style><p hidden>Gone.</p><p>Cut short', "Kept.\nCut short"),
])
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


LONG = "This is a sentence of the article, and it is long enough to look like one that somebody wrote."


@pytest.mark.parametrize("opening", [
    '<div class="layout has-sidebar"><article>', '<div id="main" class="post social-post">', '<section class="search-results">',
    '<article><section class="related-work">', '<article class="form-of-government">', '<div class="banner"><main>',
])
def test_names_of_layout_do_not_hide_the_article(opening):
    page = f"{opening}<h1>A title</h1><p>{LONG}</p><p>Short one</p><p>{LONG}</p>"
    assert html_extract.main_text(page) == f"A title\n{LONG}\nShort one\n{LONG}"


@pytest.mark.parametrize("name", [
    "sidebar", "main-nav", "comment-list", "articleComments", "comment-body", "related-posts", "ad-slot-3", "site footer", "cookie-law-info"])
def test_names_of_boilerplate_hide_their_element(name):
    assert html_extract.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG}</p><p>{LONG}</p></div></article>') == LONG


def test_formulas_and_drawings_stay_in_their_line():
    assert html_extract.main_text(
        "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> of"
        "<svg><text>no</text></svg> two <svg/>numbers.</p></article>") == "The sum a+b of two numbers."


def test_edges_carry_short_blocks_of_a_story(monkeypatch):
    story = [LONG, "Two", "No", LONG, "Why not", LONG]
    page = "<div>" + "".join(f"<h2>{t}</h2>" if t == "Two" else f"<p>{t}</p>" for t in story) + "</div><div><a href=/>Home</a></div>"
    assert html_extract.main_text(page) == "\n".join(story)
    for name, none in (("NEXT", (0.0, 0.0, 0.0)), ("PARENT", 0.0), ("GRANDPARENT", 0.0)):
        monkeypatch.setattr(html_extract, name, none)
    assert html_extract.main_text(page) == "\n".join([LONG] * 3)


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", "<article><p>Some text here.</p></article>", "t"), (1, "u", "<article><p>Some text here.</p></article>", "t"),
            (None, None, None, None), (2, None, "<p>" + "word " * 200_000 + "</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(html_extract.extract(pages).collect(), key=lambda r: (r["page_id"] or 0, r["n_chars"]))
    assert [(r["page_id"], r["n_chars"]) for r in out] == [(None, 0), (1, 15), (1, 15), (2, 999_999)]
    assert html_extract.extract(pages.limit(0)).collect() == []


# --- quality ------------------------------------------------------------------
def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, x = np.array([3, 7, 9, 30]), rng.normal(size=4)
    slow = 0.3 + sum(m.linear[i] * v for i, v in zip(at, x, strict=True)) + sum(
        m.factors[at[a]] @ m.factors[at[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.raw(at, x) == pytest.approx(slow)


def test_quality_learns_and_scores_everything(spark, frame):
    rng = random.Random(2)
    rows = [(k, prose(rng, 60).capitalize() + "." if k % 3 else prose(rng, 60).upper().replace(" ", "!! "), None, None, 400) for k in range(600)]
    labels = spark.createDataFrame([(k, int(bool(k % 3))) for k in range(0, 600, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    machine = quality.learn(frame(rows), labels)
    odd = [(1001, None), (1002, ""), (1003, "é" * 100_000), (1003, "é" * 100_000), (None, "a b c")]
    out = {}
    for r in quality.scored(frame(rows + odd), machine).collect():
        assert 0 <= r["score"] <= 1
        out[r["doc_id"]] = r["score"]
    assert len(out) == 604 and out[1001] == out[1002]
    held = [(out[k] >= 0.3) == bool(k % 3) for k in range(1, 600, 2)]
    assert np.mean(held) > 0.97
    one = quality.learn(frame(rows), labels.where("quality = 1"))
    assert {round(r["score"], 2) for r in quality.scored(frame(rows), one).collect()} == {1.0}
    none = quality.learn(frame([]), labels)
    assert quality.scored(frame([]), none).collect() == []


# --- language -----------------------------------------------------------------
def test_forward_sums_all_segmentations():
    pieces = {p: k for k, p in enumerate(["▁ab", "▁a", "a", "b", "ab", "c", "bc", "▁abc"])}
    prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
    rng = np.random.default_rng(3)
    prob = rng.uniform(0.05, 0.3, (len(pieces) + 1, 2))

    def total(text, at, k):
        if at == len(text):
            return 1.0
        out, single = 0.0, False
        for end in range(at + 1, len(text) + 1):
            for p in ([langid.START + text[:end], text[:end]] if at == 0 else [text[at:end]]):
                if p in pieces:
                    single = single or end == at + 1
                    out += prob[pieces[p], k] * total(text, end, k)
        return out if single else out + prob[-1, k] * total(text, at + 1, k)

    words = ["abc", "a", "cab", "zz", "abzab", "bca"]
    got = langid.Lattice(words, pieces, prefixes).log_likelihood(prob)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(np.log(total(w, 0, k)))


def test_language_model(frame):
    rng = random.Random(4)
    tongues = {"xx": "the and with river mountain other".split(), "yy": "und nicht der fluss berge andere".split()}
    rows = [(k, " ".join(rng.choice(tongues[t]) for _ in range(30)), t) for k in range(60) for t in [rng.choice(["xx", "yy"])]]
    model = langid.learn(frame(rows + [(70, "the", None), (71, None, "xx")]))
    assert model.languages == ["xx", "yy"]
    odd = [(100, None), (101, ""), (102, "12 -- !!"), (103, "DER FLUSS!"), (104, "z" * 5000), (103, "DER FLUSS!"), (None, "the river"), (105, "漢字 かな")]
    out = langid.identify(frame(rows + odd), model).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == 68 and all(0 <= r["score"] <= 1 for r in out)
    assert all(got[k][0] == t for k, _, t in rows)
    assert [got[k][0] for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "yy", "xx"] and got[100][1] == 0.0
    kept = langid.identified_kept(frame(rows + odd), model)
    assert kept.count() == 65 and kept.columns == frame(rows).columns
    nothing = langid.learn(frame([(1, "the", None)]))
    assert [r["lang_pred"] for r in langid.identify(frame([(1, "the")]), nothing).collect()] == ["und"]


# --- archives -----------------------------------------------------------------
def test_round_trip(spark):
    rows = [(1, "http://a/", "<p>é\r\n\r\nx</p>"), (2, "http://b/ c", "same"), (7, None, "same"), (5, "http://d", "same"), (3, "u", None), (4, "u", ""),
            (None, "n", "lone"), (9, "big", "x" * 500_000), (7, None, "same")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, uri string").repartition(3)
    out = arc.archived(pages).collect()
    want = [(i, len((h or "").encode()), arc.sha1((h or "").encode())) for i, _, h in rows]
    assert sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in out)) == sorted((i or 0, n, d) for i, n, d in want)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in out)
    assert [k for k in kinds if k[0] != 7] == [(0, "response", None), (1, "response", None), (2, "revisit", 7), (3, "revisit", 4), (4, "response", None),
                                               (5, "revisit", 7), (9, "response", None)]
    assert sorted(k[1] for k in kinds if k[0] == 7) == ["response", "revisit"]
    assert arc.archived(pages.limit(0)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_truncation(tmp_path, version):
    one, two = arc.arc_record(version, "n", 0, 5, "http://x y", b"pay\nload"), arc.arc_record(version, "n", 0, None, None, b"")
    path = tmp_path / "t.arc"
    path.write_bytes(arc._version_block(version, "t.arc") + one + two + one[:-4])
    got = list(arc.read_arc(str(path)))
    assert [(o, f["URL"], f.get("Truncated")) for o, f, _ in got] == [(0, "http://x%20y", None), (1, "-", None), (2, "http://x%20y", "length")]
    assert arc._entity(got[0][2])[2] == b"pay\nload" and arc._page(arc._entity(got[0][2])[0]) == 5
    record = arc.warc_record("t.arc", 0, got[0][1], got[0][2], None)
    (tmp_path / "t.warc").write_bytes(record)
    fields, block = next(arc.read_warc_file(str(tmp_path / "t.warc")))
    assert fields["warc-type"] == "response" and fields["warc-date"] == "1996-01-01T00:00:00Z" and block == got[0][2]


# --- nearest neighbours -------------------------------------------------------
def test_search_reaches_recall_and_handles_odd_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16))
    x[300:400] = x[300]  # a group of equal vectors
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] + [1.0] * 15), (5004, [float("nan")] * 16), (5005, [1.0] * 3), (5006, [float("inf")] * 16)]
    both = spark.createDataFrame([(*r, 1.0) for r in rows + odd + rows[:2]], "vec_id long, embedding array<double>, score double")
    out = ann.nearest(both, both.where("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    by = {}
    for r in out:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(by) == list(range(0, 1200, 50))
    for q, found in by.items():
        s = unit @ unit[q]
        s[q] = -2
        want = sorted(range(1200), key=lambda k: (-round(s[k], 12), k))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        for v, score in found.values():
            assert score == pytest.approx(s[v])
        hits += len({v for v, _ in found.values()} & set(want))
        total += 5
    assert hits / total >= 0.9
    assert [by[300][k][0] for k in range(1, 6)] == [301, 302, 303, 304, 305]
    assert [by[350][k][0] for k in range(1, 6)] == [300, 301, 302, 303, 304]
    two = both.where("vec_id in (0, 1)")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(two, two).collect()] in ([(0, 1), (1, 0)], [(1, 0), (0, 1)])
    assert ann.nearest(both.limit(0), both).collect() == []


# --- secrets ------------------------------------------------------------------
def test_base_spans():
    text = 'é "API_KEY": "abcdefghijkl" password=short AKIAABCDEFGHIJKLMN 0123456789abcdef0 token = deadbeefdeadbeefdead, AKIAABC'
    assert [(text[s:e], k) for s, e, k in secrets.base_spans(text)] == [
        ('API_KEY": "abcdefghijkl', "assign"), ("AKIAABCDEFGHIJKLMN", "access"), ("0123456789abcdef0", "hex"),
        ("token = deadbeefdeadbeefdead", "assign"), ("deadbeefdeadbeefdead", "hex")]
    assert secrets.base_spans("paſſword=abcdefghijklmno") == []
    # a failing match uses up its text
    assert secrets.base_spans("password=token: abcdefghijklmnop") == []
    assert [text[s:e] for s, e in secrets.candidates("x ab12cd34ef56gh, 1.2 9999999999999=")] == [text[2:16], text[22:36]]


def test_network_gradients():
    net = secrets.Network.fresh()
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, secrets.CODES, (6, secrets.SPAN)), np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        z = net.raw(x)
        return float((np.logaddexp(0, z) - y * z).mean())

    grads = net.gradients(x, y)
    for name, at in (("out", 3), ("last", 0), ("bias", 5)):
        w = net.weights[name]
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    for name, at in (("kernel", (7, 2)), ("embed", (int(x[0, 30]), 1))):
        w = net.weights[name]
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_scan_keeps_base_and_adds_keys(frame):
    rng = random.Random(3)

    def key(n, letters="abcdefghijklmnopqrstuvwxyz0123456789"):
        return "".join(rng.choice(letters) for _ in range(n))

    rows = []
    for k in range(300):
        kind = k % 4
        middle = [f"password={key(18, '0123456789abcdef')}", f"token = \"{key(40, '0123456789abcdef')}\"", f"on 10.20.30.{100 + k % 100} at", f"of 2020-10-{k % 30:02d}T10 to"][kind]
        rows.append((k, prose(rng, 30) + " " + middle + " " + prose(rng, 30)))
    net = secrets.learn(frame(rows))
    assert net.threshold <= 1
    odd = [(900, None), (901, ""), (902, "a" * 300_000), (903, f"ghp_{key(36)} " + prose(rng, 5)), (900, None), (None, f"password={key(20)}")]
    out = secrets.scan(frame(rows + odd), net).collect()
    assert len(out) == 306
    for r in out:
        text = dict(rows + odd)[r["doc_id"]] or ""
        base = secrets.base_spans(text)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, k in base) for x in ("assign", "access", "hex"))
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("model")] == [s for s in joined.split(",") if s]
    plain = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] % 4 >= 2]
    assert sum(bool(re.search("model", r["spans"])) for r in plain) <= len(plain) // 10
    assert secrets.scan(frame([]), secrets.learn(frame([]))).collect() == []


def slow_spans(text):
    """The base rules read character by character."""
    out, value = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    keywords = ("password", "passwd", "secret", "token", "api_key", "apikey")

    def lower(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def run(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assigned(at):
        for word in keywords:
            if lower(text[at:at + len(word)]) == word:
                k = at + len(word)
                k = run(k + (text[k:k + 1] in ("'", '"')), " ")
                if text[k:k + 1] in (":", "="):
                    k = run(k + 1, " ")
                    k += text[k:k + 1] in ("'", '"')
                    return k, run(k, value)
        return at, at

    at = 0
    while at < len(text):
        begin, end = assigned(at)
        if end > begin:
            if end - begin >= 12:
                out.append((at, end, "assign"))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text[at:at + 4] == "AKIA" else at
        if end > at + 4:
            if end - at >= 18:
                out.append((at, end, "access"))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        if end - at >= 16:
            out.append((at, end, "hex"))
        at = max(end, at + 1)
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_equal_a_slow_scanner():
    rng = random.Random(21)
    parts = ["password", "PassWD", "secret", "token", "api_key", "apikey", "API_KEY", "AKIA", "AKIAAKIA", "'", '"', " ", "  ", "\t", ":", "=", "==",
             "\n", "ſecret", "toKen", "é", "-", "/", ".", "0123456789ab", "deadbeefdeadbeef", "ABCDEFGHIJKLMN", "abcdefabcdef", "xyz", "A1", "9"]
    seen = set()
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        found = secrets.base_spans(text)
        assert found == slow_spans(text), text
        seen.update(k for _, _, k in found)
    assert seen == set(secrets.KINDS[:3])


def test_outside_sees_every_span():
    taken = [(0, 5, "hex"), (1, 6, "hex"), (2, 7, "hex"), (3, 8, "hex"), (4, 60, "assign")]
    assert secrets.outside(taken, [(50, 70), (61, 80)]) == [(61, 80)]


def test_keys_of_shapes_the_rules_do_not_know(frame):
    rng = random.Random(31)
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def key(n, letters):
        return "".join(rng.choice(letters) for _ in range(n))

    def plain():
        long = [key(rng.randrange(12, 18), "aeioustrnl"), f"10.20.{rng.randrange(255)}.{rng.randrange(255)}0", "2020-10-11T10.30",
                "some/folder/of/names", "Extraordinarily-long", "www.example.com/index", key(13, "AEIOUSTRNL"), "1234567890123"]
        return prose(rng, 20) + " " + " ".join(rng.sample(long, 3)) + " " + prose(rng, 20)

    rows = [(k, plain() + rng.choice([f" password={key(20, digits + low)} ", f" id {key(32, digits + 'abcdef')} ", f" AKIA{key(16, digits + up)} "]) + plain())
            for k in range(500)]
    net = secrets.learn(frame(rows))
    shapes = [lambda: "ghp_" + key(36, digits + low + up), lambda: "sk_live_" + key(24, digits + low + up), lambda: key(40, digits + low + up + "+/"),
              lambda: key(32, digits + low + up), lambda: key(20, digits + up), lambda: key(32, digits + "ABCDEF"),
              lambda: "-".join(key(n, digits + "abcdef") for n in (8, 4, 4, 4, 12))]
    for shape in shapes:
        keys = [shape() for _ in range(60)]
        texts = [f"{plain()} {k} {prose(rng, 5)}" for k in keys]
        found = secrets.passed(texts, [secrets.uncovered(secrets.base_spans(t), secrets.candidates(t)) for t in texts], net)
        assert sum(any(t[s:e] in k for s, e in f) for t, f, k in zip(texts, found, keys, strict=True)) >= 48, keys[0]
    texts = [plain() for _ in range(500)]
    runs = [secrets.candidates(t) for t in texts]
    wrong = sum(map(len, secrets.passed(texts, runs, net)))
    assert wrong <= 0.05 * sum(map(len, runs))


def test_candidates_are_judged_whole():
    text = "key abcdefghijkl+/, " + "x" * 30 + "/0123456789abcdef/" + "Y" * 12 + " 12345 short"
    assert [text[s:e] for s, e in secrets.candidates(text)] == ["abcdefghijkl+/", "x" * 30 + "/0123456789abcdef/" + "Y" * 12]
    left = secrets.uncovered(secrets.base_spans(text), secrets.candidates(text))
    assert [text[s:e] for s, e in left] == ["abcdefghijkl+/", "x" * 30 + "/", "/" + "Y" * 12]
    for n in (12, 40, 41, 50, 51, 333):
        parts = list(secrets.pieces(7, 7 + n))
        assert max(e - s for s, e in parts) <= secrets.BODY and set().union(*(range(s, e) for s, e in parts)) == set(range(7, 7 + n))
        # a key of up to 31 characters is whole in one of them
        assert all(any(s <= k and k + 31 <= e for s, e in parts) for k in range(7, 7 + n - 30))


def test_keys_without_digits_and_inside_long_runs():
    rng = random.Random(5)

    def key(letters, n=24):
        return "".join(rng.choice(letters) for _ in range(n))

    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = "/".join(["folder", "of", "plain", "names"] * 4)
    texts, y = [], []
    for k in range(600):
        y.append(k % 2)
        inner = key(letters) if k % 2 else "".join(rng.choice(["folder", "names", "plain"]) for _ in range(4))
        texts.append(f"{path}/{inner}/{path}" if k % 3 else f"in {inner} it")
    found = [secrets.candidates(t) for t in texts]
    x = [np.stack([secrets.window(t, *p) for s, e in f for p in secrets.pieces(s, e)]) for t, f in zip(texts, found, strict=True)]
    net = secrets.train(np.concatenate(x[:400]), np.array(y[:400], float), np.array([len(w) for w in x[:400]]))
    got = [bool(f) for f in secrets.passed(texts[400:], found[400:], net)]
    assert np.mean([g for g, want in zip(got, y[400:], strict=True) if want]) > 0.8
    assert np.mean([g for g, want in zip(got, y[400:], strict=True) if not want]) < 0.1


def test_threshold_recalls_held_out_findings():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdef0123456789") for _ in range(20)) for _ in range(1000)]
    # labels that the network cannot tell apart: no score is near one
    x, y = np.stack([secrets.window(f"id {t} x", 3, 23) for t in texts]), np.array([k % 2 for k in range(1000)], float)
    net = secrets.train(x, y)
    held = np.random.default_rng(secrets.SEED).permutation(1000)[:200]
    reached = (net.score(x[held][y[held] == 1]) >= net.threshold).mean()
    assert reached >= secrets.RECALL and net.recall == pytest.approx(reached)


def test_windows_of_findings_equal_those_judged():
    text = "é ab " * 12 + "x" * 12 + "".join("aB3/"[k % 4] for k in range(1500)) + " end of it"
    for s, e in ((60, 72), (60, 100), (60, 101), (60, 155), (60, 1560), (0, 15), (len(text) - 13, len(text))):
        want = np.stack([secrets.window(text, *p) for p in secrets.pieces(s, e)])
        assert np.array_equal(secrets.windows_of(secrets.codes(text, s, e)), want)


def test_all_findings_of_all_documents_are_learned_from(spark, monkeypatch):
    taught, judged = [], []
    # more documents than were looked at, more findings of a kind than were learned from
    docs = spark.range(45_000).selectExpr(
        "id as doc_id", "case when id % 15 = 0 then concat('is ', sha1(cast(id as string)), ' here') when id % 15 = 1 "
        "then concat('on ', translate(cast(100000000000 + id as string), '0123456789', 'aeioustrnl'), ' it') end as text")
    texts = [r["text"] for r in docs.where("text is not null").collect()]
    given = docs.where("text is not null").select("doc_id", "text").toArrow()
    want = sum(b.num_rows for b in secrets._findings(given.to_batches()))
    assert len(texts) == 6000 and want >= 2 * len(texts) - 3000

    real_write, real_calibrate = secrets.written, secrets.calibrate

    def written(df, name):
        out = real_write(df, name)
        taught.append(out.where("not held").count())
        judged.append(out.where("held").count())
        return out

    def calibrate(net, raw, wanted, times):
        judged.append(int(times.sum()))
        real_calibrate(net, raw, wanted, times)

    monkeypatch.setattr(secrets, "written", written)
    monkeypatch.setattr(secrets, "calibrate", calibrate)
    net = secrets.learn(docs)
    assert taught[0] + judged[0] == want and judged[0] == judged[1]
    assert net.threshold <= 1 and net.recall >= secrets.RECALL


def test_every_finding_of_a_share_is_in_a_step(monkeypatch):
    rng = np.random.default_rng(4)
    # the last two characters tell the finding
    windows = [rng.integers(0, 90, (1, secrets.SPAN)) for _ in range(700)]
    for k, w in enumerate(windows):
        w[0, -2:] = k // 90, k % 90
    seen, shares = set(), []
    real = secrets.Network.gradients

    def gradients(self, x, y, share=None):
        seen.update(map(tuple, x[:, -2:].tolist()))
        shares.append((share[y == 1].sum(), share.sum()))
        return real(self, x, y, share)

    monkeypatch.setattr(secrets.Network, "gradients", gradients)
    secrets.learned(secrets.Network.fresh(), windows, np.repeat([0, 1, 2, 3], [670, 5, 20, 5]), rng)
    assert len(seen) == 700
    assert shares == [(pytest.approx(0.5), pytest.approx(1))] * len(shares)
