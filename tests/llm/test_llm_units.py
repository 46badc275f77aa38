"""Pure functions of the operators: worked examples and brute force."""

import math
import random

import numpy as np
import pytest

from lexiscope.llm import (decontaminate, html_text, jaccard_join, langid, license_scan, lz_fingerprint, packing,
                           substring_dedup, token_counts, toxicity)


def arrays(*texts):
    raw = [t.encode() for t in texts]
    return np.cumsum([0] + [len(r) for r in raw]), np.frombuffer(b"".join(raw), dtype=np.uint8)


# ------------------------------------------------------------------- packing

def bins(runs):
    """sequence -> list of (offset, length), from the runs."""
    out, ranks = {}, {}
    for length, rank, items, per, first, offset in runs:
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + items
        for i in range(items):
            out.setdefault(first + i // per, []).append((offset + i % per * length, length))
    return out, ranks


def check_plan(counts, capacity):
    runs, n = packing.plan_packing(counts, capacity)
    got, ranks = bins(runs)
    assert ranks == {k: v for k, v in counts.items() if v}
    assert sorted(got) == list(range(n))
    for items in got.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return n


def fewest(items, capacity):
    """Exhaustive search on a handful of items."""
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best and k < len(items):
            return
        if k == len(items):
            best = min(best, len(rooms))
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                left = list(rooms)
                left.remove(r)
                place(k + 1, [*left, r - items[k]])
        if len(rooms) + 1 < best or k == 0:
            place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best


def test_plan_is_gapless_and_close_to_the_bound():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        n = check_plan(counts, capacity)
        assert n >= -(-sum(k * v for k, v in counts.items()) // capacity)


def test_reduction_never_costs_a_sequence():
    rng = random.Random(2)
    for _ in range(150):
        items = sorted((rng.randint(4, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        plan = packing._Plan({k: items.count(k) for k in set(items)}, 20)
        packing.reduce_instance(plan)
        left = [k for k, v in sorted(plan.left.items(), reverse=True) for _ in range(v)]
        assert plan.sequences + (fewest(left, 20) if left else 0) == fewest(items, 20)


def test_plan_counts_of_any_size():
    runs, n = packing.plan_packing({4096: 10 ** 9, 3000: 10 ** 9, 1096: 10 ** 9 + 7, 1: 5}, 4096)
    assert n == 2 * 10 ** 9 + 3 and len(runs) < 20
    assert packing.plan_packing({}, 10) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan_packing({11: 1}, 10)


# ----------------------------------------------------- encoders against libraries

ODD = ["", " ", "  a  b ", "\n\n", "Hello, World. it's 1984!", "a b　c", "ΑΣ Σ", "é é É", "<|endoftext|> x<|startoftext|>",
       "▁ a▁b  ▁", "x" * 500, "日本語 のテキスト。", "İstanbul", "tab\tand\r\nline", "don't 'll'S", "a,,b..c. ,", "🙂🙂 z", "ß ẞ µ", "1 2 33"]


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = "aabcé .,  \n' ÀΣ▁日1"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


def test_token_counts_equal_the_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=packing.vocabulary(token_counts.MODEL))
    texts = ODD + random_texts(400, 3)
    assert token_counts.count_batch(texts) == [len(sp.encode(t)) for t in texts]
    assert token_counts.count_batch([None]) == [0]


def test_ids_equal_the_library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary(packing.TOKENIZER))
    texts = ODD + random_texts(400, 4)
    got = packing.encoder(packing.TOKENIZER).encode(texts)
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_ids_of_words_whose_lower_case_has_marks():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary(packing.TOKENIZER))
    rng = random.Random(9)
    alphabet = ["İ", "I", "ı", "a", "b", " ", ".", ",", "'", "!", "\u0301", "\u0307", "é", "Σ", "ς", "1", "日", "\n", "ǅ", "ﬁ", "Ω", "ß"]
    texts = ["ANADOLU ŞİRKETİ, İSTANBUL.", "İ.", "e\u0301.", "x\u0301\u0307!", "İİ, a"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    got = packing.encoder(packing.TOKENIZER).encode(texts)
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_encoder_forgets_half_and_goes_on(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(packing, "CACHE_CHARS", 2000)
    enc, plain = packing._Encoder(packing.vocabulary(packing.TOKENIZER)), packing.encoder(packing.TOKENIZER)
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 200)}" for _ in range(12)) for _ in range(3)] + ["long" * rng.randint(1, 300), None]
        assert enc.encode(texts) == [plain.encode([t])[0] for t in texts]
        assert len(enc.place) <= 110 and enc.chars == sum(map(len, enc.place)) and enc.ends[-1] == len(enc.ids)


# ------------------------------------------------------------ words and windows

def test_words_follow_the_pattern():
    import re
    texts = ODD + random_texts(200, 5)
    offsets, data = arrays(*texts)
    folded, starts, ends, first = decontaminate.find_words(offsets, data)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in enumerate(texts):
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
        assert [folded[s:e].tobytes().decode() for s, e in zip(starts[first[d]:first[d + 1]], ends[first[d]:first[d + 1]],
                                                               strict=True)] == want


def test_windows_hit_as_by_brute_force():
    rng = random.Random(6)
    words = ["w%d" % i for i in range(6)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 8])))) for i in range(12)]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    index = decontaminate.TestIndex(items, window=4)
    offsets, data = arrays(*docs)
    n, first, marked, found, _, _ = index.scan(offsets, data)
    for d, doc in enumerate(docs):
        own, hit, who = doc.split(), set(), set()
        for i, text in items:
            t = text.split()
            w = min(4, len(t))
            for k in range(len(t) - w + 1 if t else 0):
                for at in range(len(own) - w + 1):
                    if own[at:at + w] == t[k:k + w]:
                        hit |= set(range(at, at + w))
                        who.add(str(i))
        assert n[d] == len(own)
        assert set(np.flatnonzero(marked[first[d]:first[d + 1]]).tolist()) == hit
        assert found.get(d, set()) == who


# -------------------------------------------------------------------- languages

def test_ngrams_and_ranks_of_a_worked_example():
    grams, owners = langid.ngrams(["Ab a", "", "1 2"])
    number = lambda s: sum((ord(c) if c != "_" else 1) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    assert sorted(grams.tolist()) == sorted(map(number, ["a", "b", "a", "_a", "ab", "b_", "_a", "a_", "_ab", "ab_", "_a_"]))
    assert set(owners.tolist()) == {0}
    c = langid.Classifier({"x": [number("a"), number("b")], "y": [number("b"), number("c")]}, size=2)
    assert c.predict(["a", "c", "", "?!"])[0] == ["x", "y", "und", "und"]
    assert langid.Classifier({}).predict(["a"]) == (["und"], [0.0])


# ------------------------------------------------------------------ fingerprints

def phrases(text):
    seen, out, w = set(), [], ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            out.append(w)
            w = ""
    return out, w


def test_parse_gives_the_phrases():
    for t in ["", "a", "aaaa", "abcabcabcabc", "tobeornottobe"] + random_texts(100, 7):
        ends, _ = lz_fingerprint.Parse().follow(t)
        want, rest = phrases(t)
        assert [t[a:b] for a, b in zip([0, *ends], ends, strict=False)] == want
        assert t[ends[-1] if ends else 0:] == rest


def test_edit_shares_the_parse_but_not_the_result():
    texts = random_texts(60, 8) + ["", "ab", "x" * 30]
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        own, changed, edited = lz_fingerprint.with_edit(a, b)
        assert edited == a[:len(a) - len(a) // 3] + b[:len(a) // 3]
        assert (own == lz_fingerprint.fingerprint(a)).all() and (changed == lz_fingerprint.fingerprint(edited)).all()
        assert lz_fingerprint.likeness(own, own) == 1.0


# ----------------------------------------------------------------- chosen paths

def test_shingles_equal_windows_of_words():
    offsets, data = arrays("a b c d e f", "A, B! c d e", "a b", "", "a b c d e f a b c d e")
    sets = jaccard_join.shingle_sets(offsets, data)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 6]
    assert sets[1][0] in sets[0] and sets[1][0] in sets[4]


def test_survival_and_runs():
    assert jaccard_join.survival(1, 0.8) == pytest.approx(1 - (0.75 * 0.2 + 0.25 * 0.04))
    n = jaccard_join.runs_needed()
    assert (1 - jaccard_join.survival(jaccard_join.DEPTH, 0.8)) ** n <= 0.001


def test_paths_part_the_unlike_and_keep_the_like():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    near = np.unique(np.r_[base[:270], rng.integers(0, 2 ** 63, 25).astype(np.uint64)])  # about 0.83
    met = 0
    for _ in range(50):
        a = np.unique(rng.permutation(2 ** 40 + np.arange(300)).astype(np.uint64) * np.uint64(rng.integers(1, 2 ** 20)))
        b = np.unique(np.r_[a[:280], rng.integers(0, 2 ** 63, 15).astype(np.uint64)])
        sig = jaccard_join.minhashes([a, b])
        roots = jaccard_join.mix(np.arange(jaccard_join.runs_needed(), dtype=np.uint64))
        ends = [set(jaccard_join.extend(roots, np.repeat(s[None], len(roots), 0), 0.8)[0].tolist()) for s in sig]
        met += bool(ends[0] & ends[1])
    assert met == 50
    sig = jaccard_join.minhashes([base, near])
    assert abs((sig[0] == sig[1]).mean() - len(np.intersect1d(base, near)) / len(np.union1d(base, near))) < 0.2


def test_overlaps_and_groups():
    rng = random.Random(10)
    sets = [np.unique(np.array([rng.randint(0, 30) for _ in range(rng.randint(1, 20))], np.uint64)) for _ in range(25)]
    got = jaccard_join.overlaps(sets)
    for i in range(25):
        for j in range(25):
            shared = np.intersect1d(sets[i], sets[j])
            assert i == j or got[i, j] == len(shared)
    linked = np.zeros((6, 6), dtype=bool)
    linked[5, 3] = linked[3, 1] = linked[4, 2] = True
    assert jaccard_join.roots_of(linked).tolist() == [0, 1, 2, 1, 2, 1]


# --------------------------------------------------------------------- passages

def test_units_cover_lines_and_sentences():
    text = "One two. Three four!  Five\n\nSix."
    got = substring_dedup.units(text)
    assert [(text[s:e], n) for s, e, n, _, _ in got] == [
        ("One two. Three four!  Five", 0), ("One two. ", 0), ("Three four!  ", 0), ("Five", 0), ("Six.", 2 - 1)]
    assert substring_dedup.units("...\n  \n") == []


def removed_from_second(one, two):
    """What goes from a text behind another."""
    seen = {u[3] for u in substring_dedup.units(one)}
    first = {}
    for k, u in enumerate(substring_dedup.units(two)):
        if u[3] not in seen:
            first.setdefault(u[3], k)
    spans = substring_dedup._removals(two, set(first.values()), 8, 25)
    return [two[s:e] for s, e in spans], substring_dedup._cut_out(two, spans)


def test_runs_go_on_over_line_ends():
    verse = "\n".join(" ".join(f"w{i}x{k}" for k in range(7)) for i in range(8))
    assert removed_from_second(verse, f"New title\n{verse}\nNew end") == ([verse], "New title\nNew end")
    assert removed_from_second(verse, verse[:verse.index("w3x0")] + "New end")[0] == []  # 21 words
    inside = "a b c d e f g h i j. k l m n o p q r.\ns t u v w x y z a b c."
    assert removed_from_second("Old. " + inside + " Old", "New one. " + inside + " New two") == ([inside + " "], "New one. New two")


def test_scripts_without_spaces_are_measured_in_characters():
    rng = random.Random(3)
    clauses = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(12)) for _ in range(10)]
    whole = "".join(c + "\uff0c\u3002"[i % 2] for i, c in enumerate(clauses))
    assert len(substring_dedup.units(whole)) == 6
    before, behind = chr(0x8000) * 3 + "\u3002", chr(0x8001) * 3
    assert removed_from_second(whole, before + whole + behind) == ([whole], before + behind)
    short = "".join(clauses[:2])[:14]
    assert removed_from_second(short, short)[0] == [] and removed_from_second(whole, clauses[0] + "\uff0c" + clauses[1])[1] == ""


def test_cut_out_keeps_lines_whole():
    cut = substring_dedup._cut_out
    assert cut("a\nb\nc", [(2, 3)]) == "a\nc"
    assert cut("a\nb", [(2, 3)]) == "a"
    assert cut("a b. c d. e", [(5, 10)]) == "a b. e"
    assert cut("a b. c d.", [(5, 9)]) == "a b."
    assert cut("ab", [(0, 2)]) == ""


# ------------------------------------------------------------------------- pages

def test_main_text_of_a_page():
    page = ('<html><head><title>t</title><style>p{}</style></head><body><header>H</header><nav>n</nav><article><header><h1>T &amp; x'
            '</h1><span>by me</span></header><p>a <b>b</b>\n c<br>d<p>e<ul><li>x<li>y</ul><div class="ad-box">no</div>'
            '<form>f</form>tail<script>var a="</p>";</script><!-- c --></article><section class=comments><p>hi</p></section><footer>f')
    assert html_text.main_text(html_text.parse(page)) == "T & x\na b c d\ne\nx\ny\ntail"
    assert html_text.main_text(html_text.parse("")) == ""
    assert html_text.main_text(html_text.parse("1 < 2 &lt;b&gt;&nbsp;x")) == "1 < 2 <b> x"
    assert html_text.main_text(html_text.parse("<main><p>m</p></main><p>no</p>")) == "m"
    assert html_text.main_text(html_text.parse("<p hidden>x</p><table><tr><td>1<td>2<tr><td>3</table>")) == "1 2\n3"


def test_names_made_from_headings_are_text():
    inside = ('<h2 id="search-engines">Search engines</h2><p id="share-prices">Share prices fell.</p><section id="related-work">'
              '<h2 class="related">Related work</h2><p class="notice">As known.</p></section><section id="search"><p>s</p></section>'
              '<div class="search-theory">t</div><div class="alert alert-info">Mind this.</div>')
    drop = '<div class="share-buttons">x</div><ul class="related-posts"><li>x</ul><div class="ad">x</div><div id="comments">x</div>'
    want = "Search engines\nShare prices fell.\nRelated work\nAs known.\ns\nt\nMind this."
    assert html_text.main_text(html_text.parse(f"<article>{inside}{drop}</article>")) == want
    plain = '<h2 id="search-engines">Search engines</h2><section id="related-work"><p id="share-prices">p</p></section>'
    assert html_text.main_text(html_text.parse(plain + drop + '<div class="footer-links">x</div>')) == "Search engines\np"


@pytest.mark.parametrize("page, text", [
    ('<div class="layout has-sidebar"><main><article><p>text</p></article></main></div>', "text"),
    ('<div id="page" class="site content-sidebar"><article><p>text</p></article><div class="sidebar">s</div></div>', "text"),
    ('<div class="page no-sidebar"><p>text</p></div>', "text"),
    ('<form id="aspnetForm"><div class="ad">x y z and more of it</div><div><p>text</p></div></form>', "text"),
    ('<form id="aspnetForm"><nav>n</nav><article><p>text</p></article><form>search</form></form>', "text"),
    ('<article><p>a <span class="token comment">b</span> <a class="search">c</a> <span class="related">d</span></p></article>', "a b c d"),
    ('<article><pre><div class="comment">x</div> y</pre><ul class="menu"><li>Soup</ul></article>', "x\ny\nSoup"),
    ('<div class="ad">a</div><article><p>text</p></article><form><p>news</p></form><div class="comments"><p>long long</p></div>', "text"),
    ('<div class="comments"><p>long long comments</p></div><div class="content"><p>text</p></div>', "text"),
    ('<div class="sidebar"><article><p>teaser of another</p></article></div><article><p>this text</p></article>', "this text"),
    ('<p>a<p title="open>b</p><p>c</p>', "a\nb\nc"),
])
def test_articles_are_kept(page, text):
    assert html_text.main_text(html_text.parse(page)) == text


@pytest.mark.parametrize("make", [
    lambda n: "</x>" * n, lambda n: "<div>" * n + "</x>" * n, lambda n: '<a href="x>' * n, lambda n: "<!x " * n, lambda n: "<a " * n,
    lambda n: "<p><span>" + "<span>" * n + "<p>x</p>" * n, lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n, lambda n: "<form>" * n + "<p>x",
    lambda n: "<table><tr>" + "<div>" * n + "<td>x</td>" * n])
def test_time_grows_with_the_page_alone(make):
    import time

    def seconds(n):
        start = time.process_time()
        html_text.main_text(html_text.parse(make(n)))
        return time.process_time() - start

    seconds(2000)
    assert seconds(64_000) < 24 * max(seconds(8_000), 0.01)


def plain_extract(pages):
    """Text by a plain reading of pages whose articles hold headings and
    paragraphs alone."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.inside = [], False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("article", "p", "h1"):
                self.blocks.append("")
            elif tag == "br" and self.blocks:
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in ("p", "h1"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    out = []
    for page in pages:
        reader = Reader()
        reader.feed(page)
        reader.close()
        out.append("\n".join(" ".join(b.split()) for b in reader.blocks if b.split()))
    return out


def test_main_text_of_the_given_pages(spark):
    from conftest import SF01
    rows = spark.read.parquet(f"{SF01}/pages.parquet").orderBy("page_id").collect()
    got = {r["page_id"]: r["text"] for r in html_text.op3_html_extraction(spark, SF01).collect()}
    assert [got[r["page_id"]] for r in rows] == plain_extract([r["html"] for r in rows])


def test_template_subtrees_go_but_running_text_stays():
    root = html_text.parse("<div>same <a href=x>box</a></div><div>own</div><article><p>same</p><div>note</div>text</article>")
    digests = html_text.digest_elements(root)
    assert html_text.main_text(root, set(digests)) == "same\ntext"
    root = html_text.parse("<div>same</div><div>own</div>")
    same = html_text.digest_elements(html_text.parse("<div>same</div>"))
    html_text.digest_elements(root)
    assert html_text.main_text(root, set(same)) == "own"


# ---------------------------------------------------------------------- licenses

def test_patience_alignment():
    assert license_scan.align("a b c d e f".split(), "a x c d y f".split()) == [(0, 0), (2, 2), (3, 3), (5, 5)]
    rng = random.Random(11)
    for _ in range(100):
        a, b = (rng.choices("abcdefgh", k=rng.randint(0, 12)) for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))
    for _ in range(50):
        values = [rng.randint(0, 20) for _ in range(rng.randint(0, 12))]
        got = [values[i] for i in license_scan.longest_increasing(values)]
        assert got == sorted(set(got))
        best = max((len(s) for m in range(1 << len(values))
                    if (s := [v for i, v in enumerate(values) if m >> i & 1]) == sorted(set(s))), default=0) if len(values) < 11 else len(got)
        assert len(got) == best


def test_edited_license_is_found_in_place():
    words = license_scan.TEMPLATES["MIT"][1].split()
    words[10] = "foo"
    del words[40:44]
    text = "Hello there.\n" + " ".join(words) + " End. Licensed under CC BY-NC 4.0."
    found = license_scan.Templates(license_scan.TEMPLATES).scan(*arrays(text, "", "the license"), 0.8)
    assert [f[0] for f in found[0]] == ["MIT", "CC-BY-NC-4.0"] and found[1] == found[2] == []
    assert text[found[0][0][2]:found[0][0][3]].startswith("Permission is hereby granted")


def test_licenses_that_differ_in_a_word_are_told_apart():
    index = license_scan.Templates(license_scan.TEMPLATES)

    def names(*texts):
        return [[f[0] for f in found] for found in index.scan(*arrays(*texts), 0.8)]

    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    assert names("Licensed under CC BY 4.0.", "Licensed under CC BY-SA 3.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 2.0.",
                 gnu.format("", 2), gnu.format("", 3), gnu.format("Lesser ", 3), gnu.format("Affero ", 3), gnu.format("", 1),
                 "Released under the FOO License.") == [
        ["CC-BY-4.0"], ["CC-BY-SA-3.0"], ["CC-BY-NC-4.0"], [], ["GPL-2.0"], ["GPL-3.0"], ["LGPL-3.0"], ["AGPL-3.0"], [], []]
    for name, texts in license_scan.TEMPLATES.items():
        assert names(*("Before it. " + t + " Behind it." for t in texts)) == [[name]] * len(texts), name


# ---------------------------------------------------------------------- toxicity

def kernel(a, b):
    """The subsequence kernel by enumeration, for words of plain letters."""
    def vector(s):
        s, out = "^" + s, {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    key = s[i] + s[j] + s[k]
                    if key.isascii() and (key.replace("^", "a")).isalpha():
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = vector(a), vector(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_by_enumeration():
    words = ["idiot", "idxiot", "i*d*i*o*t", "clown", "moron", "worthless"]
    got = toxicity.Vectors(words).times(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(kernel(a, b), abs=1e-5)
    assert got[0, 1] > 0.4 > got[0, 3]


def test_units_join_spaced_letters():
    assert "idiot" in toxicity.units("you i d i o t!") and "idiot" in toxicity.units("I.D.I.O.T")
    assert toxicity.units("") == [] and toxicity.units("?!") == []
    assert all(len(u) <= toxicity.UNIT for u in toxicity.units("x" * 1000))
