"""Operators and pipeline stages on small tables: odd rows, and brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF001
from lexiscope.llm import (components, decontaminate, html_text, jaccard_join, langid, license_scan, lz_fingerprint, packing,
                           substring_dedup, token_counts, toxicity)

LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60)) + "."
ROWS = [
    (1, "the cat sat on the mat and the dog ran to the house. It was a day.\n" + PASSAGE, "en", "s", 1),
    (2, None, "en", "s", 0),
    (3, "", "en", None, 0),
    (4, "the cat sat on the mat and the dog ran to the house. It was a day.", None, "s", 1),
    (4, "the cat sat on the mat and the dog ran to the house. It was a day.", "en", "s", 1),
    (5, "THE CAT sat on the mat and the dog ran to the house! It was a day", "en", "s", 1),
    (None, "le chat est dans la maison et le chien aussi, avec une table", "fr", "s", 1),
    (None, None, None, None, None),
    (6, "le chat est dans la maison et le chien aussi, avec une chaise", "fr", "s", 1),
    (7, "?! 123 ...", "en", "s", 1),
    (8, LONG, "en", "s", 1),
    (9, "Before it. " + PASSAGE + " After it.", "en", "s", 1),
    (-3, "x", "en", "s", 1),
]
EXTRA = {"n_words": 1, "score": "x", "n_tokens": None, "kept_text": 2.0, "length": "q", "items": "i", "lang_pred": 0,
         "removed": 1, "findings": 1, "sequence_id": "s", "digest": 1, "node": "n", "__id": 77, "__hash": 78, "__no_id": "no",
         "__kept_text": "kept", "__score": 0.5, "__lang_pred": "xx", "__text__": 1, "__hits": 2, "___id": 3, "a.b": 4, "c0": "five", "lang.x": None}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in EXTRA.items():
        df = df.withColumn(name, F.lit(value))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Sat on the MAT, and the dog ran to the house"), (2, None), (3, ""), (None, "after it"),
                                  (5, "nothing of the kind stands anywhere in these few documents here"), (5, "x")],
                                 "item_id long, text string")


def by_id(df, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in df.collect()), key=repr)


def test_decontaminate(docs, bench, spark):
    got = decontaminate.scan_documents(docs, bench, keep=["doc_id", "text"])
    rows = {r["text"]: r for r in got.collect()}
    assert got.count() == len(ROWS)
    assert rows[None]["n_words"] == rows[""]["n_hit"] == 0 and rows[None]["clean_text"] is None
    assert rows[ROWS[3][1]]["n_hit"] == 11 and rows[ROWS[3][1]]["items"] == ["1"]
    assert rows[ROWS[3][1]]["clean_text"] == "the cat . It was a day."
    assert rows[ROWS[11][1]]["items"] == ["None"] and rows["x"]["items"] == ["5"]
    assert rows[LONG]["n_words"] == 30_000 and rows[LONG]["n_hit"] == 0
    parts = decontaminate.scan_documents(docs, bench, part_bytes=40, keep=["doc_id", "text"])
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, got.collect()))
    whole = decontaminate.scan_documents(docs, bench, part_bytes=40, prefix="__")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, decontaminate.scan_documents(docs, bench, prefix="__").collect()))
    assert decontaminate.scan_documents(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan_documents(docs.limit(0), bench).count() == 0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1  # "x" was nothing else
    assert decontaminate.decontaminate(docs, bench, "documents").count() == len(ROWS) - 6


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, 0), (99, 1), (3, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.score_documents(docs, toxicity.fit(docs, known)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_toxicity_finds_what_it_learned_and_changed_forms(spark):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioubcdflnrst"), rng.integers(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[int(rng.integers(0, 40))] = ["vugzomp", "krimpwax"][i // 4 % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, toxic int"))
    rest = " ".join(plain[:39])
    clean, *bad = model.scores([rest, rest + " vugzomp", rest + " v-u-g-z-o-m-p", rest + " v u g z o m p", rest + " krimmpwax!"])
    assert clean < 0.3 <= min(bad)


def test_toxicity_learns_an_insult_of_three_texts(spark):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeioubcdflnrst"), rng.integers(3, 9))) for _ in range(1500)]
    rare = {7, 4_000, 19_000}
    rows, labels = [], []
    for i in range(20_000):
        words = list(rng.choice(plain, 6))
        toxic = i % 50 == 0 or i in rare
        if toxic:
            words[i % 6] = "zwokquup" if i in rare else ["vugzomp", "krimpwax"][i // 50 % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = model.scores([" ".join(plain[:6]), " ".join(plain[:5]) + " zwokquup", plain[9] + " z.wokquup", "vugzomp " + plain[3]])
    assert scores[0] < 0.3 <= scores[1:].min()


def test_html(spark):
    same = "<div>site box</div>"
    rows = [(i, f"https://h.example/{i}", f"{same}<article><p>text {i}</p><p>shared</p></article>") for i in range(6)]
    rows += [(10 + i, f"http://U@H2.example:80/{i}", f"{same}<div>own {i}</div>") for i in range(5)]
    rows += [(20, None, None), (21, "nonsense", ""), (21, "nonsense", "<p>a"), (None, "http://h.example/x", "<p>" + "y " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    texts = {(r["page_id"], r["url"]): r["text"] for r in got.where("page_id <> 21").collect()}
    assert texts[3, "https://h.example/3"] == "text 3\nshared" and texts[12, "http://U@H2.example:80/2"] == "own 2"
    assert texts[20, None] == "" and got.where("n_chars <> length(text)").count() == 0
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("joined", [False, True])
def test_templates_of_some_pages_of_a_host(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(html_text, "HOST_DIGESTS", 1)
    rows = [(i, f"https://h.example/{i}", f"<div>section {i % 4}</div><p>said by some {i % 4}</p>"
             f"<article><p>text {i}</p><div>advert {i % 3}</div></article><div>own {i}</div>") for i in range(100)]
    rows += [(200 + i, f"https://h.example/n{i}", f"<div>section {i % 4}</div><p>said by some {i % 4}</p><div>own {i}</div>") for i in range(20)]
    rows += [(300 + i, f"https://few.example/{i % 9}", f"<div>part {i % 2}</div><div>x {i}</div>") for i in range(10)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract(pages).collect()]
    want = {i: f"text {i}" for i in range(100)} | {200 + i: f"said by some {i % 4}\nown {i}" for i in range(20)} \
        | {300 + i: f"x {i}" for i in range(10)}
    assert sorted(got) == sorted((r[0], want[r[0]]) for r in rows)


def test_packing(docs, spark):
    got = packing.pack_documents(docs)
    rows = got.orderBy("doc_id", "text" if "text" in got.columns else "ids_crc32", "piece").collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        raw = np.array(r["ids"], dtype="<u4").tobytes()
        assert len(r["ids"]) == r["length"] <= 4096 and zlib.crc32(raw) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
    for items in by_seq.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["doc_id"] == 2 and r["length"] == 1 for r in rows) == 1
    total = sum(r["length"] for r in rows)
    assert len(by_seq) == -(-total // 4096)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, None)], "k long, length long"), ["k"])


def test_packing_numbers_hot_lengths_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 10)
    items = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 9 + 1).cast("long").alias("length"))
    rows = packing.pack(items, ["k"], 20).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows) == 500
    room = {}
    for r in rows:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 20
    assert max(room.values()) <= 20


def test_licenses(docs, spark):
    got = license_scan.scan_licenses(docs)
    assert got.count() == len(ROWS) and got.where("size(findings) > 0").count() == 0
    more = spark.createDataFrame([(1, "Was it. Released under the MIT License."), (1, "é " * 50 + "all rights reserved")], "doc_id long, text string")
    rows = more.transform(license_scan.scan_licenses).collect()
    assert sorted(f["license"] for r in rows for f in r["findings"]) == ["MIT", "all-rights-reserved"]
    for r in rows:
        f = r["findings"][0]
        assert r["text"].encode()[f["start"]:f["end"]].lower().startswith((b"released", b"all")) and f["coverage"] == 1.0
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_by_brute_force(spark):
    """Whole templates in a text are found, and a text without a run of a
    template's words has no finding."""
    run = license_scan.RUN
    templates = [(name, words(t)) for name, texts in license_scan.TEMPLATES.items() for t in texts]
    runs = {tuple(w[i:i + run]) for _, w in templates for i in range(len(w) - run + 1)}
    docs = spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    made = spark.createDataFrame([(10 ** 6 + k, f"Some words. {t}\nAnd more of them.") for k, t in enumerate(
        t for texts in license_scan.TEMPLATES.values() for t in texts)], docs.schema)
    rows = docs.unionByName(made).collect()
    found = {r["doc_id"]: {f["license"] for f in r["findings"]} for r in license_scan.scan_licenses(docs.unionByName(made)).collect()}
    whole = 0
    for r in rows:
        own = words(r["text"])
        joined = f" {' '.join(own)} "
        held = [(len(w), name) for name, w in templates if f" {' '.join(w)} " in joined]
        if not any(tuple(own[i:i + run]) in runs for i in range(len(own) - run + 1)):
            assert not found[r["doc_id"]]
        if held:
            whole += 1
            assert {name for n, name in held if n == max(held)[0]} & found[r["doc_id"]], r["doc_id"]
    assert whole >= len(templates)


def brute_removals(rows):
    first, out = {}, {}
    keyed = sorted({(i is None, i or 0, h, t) for i, h, t in rows if t}, key=lambda k: k[:3])
    for no_id, i, h, t in keyed:
        for k, u in enumerate(substring_dedup.units(t)):
            first.setdefault(u[3], (no_id, i, h, k))
    for i, h, t in rows:
        own = {k for k, u in enumerate(substring_dedup.units(t or "")) if first[u[3]] == (i is None, i or 0, h, k)}
        out[i, t] = substring_dedup._removals(t, own, substring_dedup.MIN_LINE_WORDS, substring_dedup.MIN_RUN_WORDS) if t else []
    return out


@pytest.mark.parametrize("source", ["odd", "table"])
def test_substring_dedup(docs, spark, source):
    src = docs if source == "odd" else spark.read.parquet(f"{SF001}/documents.parquet")
    got = substring_dedup.dedup_units(src)
    rows = got.withColumn("h", F.xxhash64("text")).collect()
    assert len(rows) == src.count()
    want = brute_removals([(r["doc_id"], r["h"], r["text"]) for r in rows])
    for r in rows:
        spans = [tuple(s) for s in r["removed"]]
        assert spans == want[r["doc_id"], r["text"]]
        assert r["kept_text"] == (substring_dedup._cut_out(r["text"], spans) if spans else r["text"])
        assert r["n_removed"] == len(spans)
    if source == "odd":
        kept = {r["doc_id"]: r["kept_text"] for r in rows}
        assert kept[9] == "Before it. After it." and PASSAGE in kept[1] and kept[5] == ""
    assert substring_dedup.dedup_units(src.limit(0)).count() == 0


def test_language_id(docs):
    profiles = langid.learn_profiles(docs)
    assert sorted(profiles) == ["en", "fr"]
    got = langid.identify(docs, profiles)
    rows = {r["text"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert got.count() == len(ROWS) and all(0 <= s <= 1 for _, s in rows.values())
    assert rows[None][0] == rows[""][0] == rows["?! 123 ..."][0] == "und"
    assert rows[ROWS[6][1]][0] == "fr" and rows[ROWS[5][1]][0] == "en"
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.learn_profiles(docs.limit(0)) == {} and langid.identify(docs.limit(0), profiles).count() == 0


def test_language_profiles_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    counts = {}
    for r in docs.collect():
        for word in "".join(c if c.isalpha() else " " for c in r["text"].lower()).split():
            for n in (1, 2, 3):
                padded = word if n == 1 else f"\x01{word}\x01"
                for i in range(len(padded) - n + 1):
                    g = sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(padded[i:i + n]))
                    own = counts.setdefault(r["lang"], {})
                    own[g] = own.get(g, 0) + 1
    want = {k: [g for g, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:300]] for k, v in counts.items()}
    assert langid.learn_profiles(docs) == want


def test_short_clean_texts_pass_the_language_stage(spark):
    rng = np.random.default_rng(5)
    weights = 1 / np.arange(1, 3001)

    def unspaced(n):
        return "".join(chr(0x4E00 + k) for k in rng.choice(3000, n, p=weights / weights.sum()))

    english = [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").where("lang = 'en'").limit(40).collect()]
    learn = [(i, t, "en") for i, t in enumerate(english)] + [(100 + i, unspaced(500), "zz") for i in range(40)]
    short = [(1000 + i, unspaced(20 if i % 2 else 60), None) for i in range(60)]
    short += [(2000 + i, w, None) for i, w in enumerate(["Yes", "zoom", "Ok go", "jazz quiz", "a"])]
    docs = spark.createDataFrame([*learn, *short, (3000, "αβγ δεζ", None), (3001, "?! 12", None)], "doc_id long, text string, lang string")
    ids = sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect())
    assert ids == [r[0] for r in learn + short]
    scored = langid.identify(docs, langid.learn_profiles(docs)).where("doc_id between 1000 and 1059")
    assert scored.where("score < 0.2").count() > 0  # which a least score would drop


def test_held_out_accuracy(spark):
    dir01 = SF001.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{dir01}/documents.parquet").select("doc_id", "lang")
    held = langid.op7_language_id(spark, dir01).join(truth, "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.99 * held.count() > 0


def test_token_counts(docs):
    got = token_counts.count_tokens(docs, limit=10)
    rows = {r["text"]: r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[None]["n_tokens"] == rows[""]["n_bytes"] == 0
    assert rows[LONG]["over_limit"] and not rows["x"]["over_limit"] and rows[LONG]["n_bytes"] == len(LONG)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def brute_groups(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        sets.append(set(jaccard_join.shingle_sets(np.array([0, len(raw)]), raw)[0].tolist()))
    links, parent = [0] * len(rows), list(range(len(rows)))
    holders = {}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, s in enumerate(sets):
        near = {j for h in s for j in holders.get(h, ())}
        for j in near:
            if len(s & sets[j]) >= threshold * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
        for h in s:
            holders.setdefault(h, []).append(i)
    return links, [find(k) for k in range(len(rows))]


@pytest.mark.parametrize("source", ["odd", "table"])
def test_jaccard_groups(docs, spark, source):
    src = docs if source == "odd" else spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in src.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    links, roots = brute_groups(rows)
    got = jaccard_join.jaccard_groups(src)
    want = sorted(((i, n, rows[g][0]) for (i, _), n, g in zip(rows, links, roots, strict=True)), key=repr)
    assert by_id(got, "n_links", "class_id") == want
    assert jaccard_join.jaccard_groups(src.limit(0)).count() == 0


def test_jaccard_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BUCKET", 10)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:40] + [f"own{i}"] + words[40:])) for i in range(60)] + [(100 + i, " ".join(words)) for i in range(5)]
    got = by_id(jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")), "n_links", "class_id")
    links, roots = brute_groups(rows)
    assert got == sorted(((i, n, rows[g][0]) for (i, _), n, g in zip(rows, links, roots, strict=True)), key=repr)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 10), (10, 11), (11, 12), (12, 13), (5, 5)]
    got = {r["node"]: r["group"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 12: 1, 13: 1, 8: 8, 9: 8, 5: 5}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fingerprints(docs, spark):
    got = lz_fingerprint.fingerprint_with_neighbours(docs)
    rows = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    assert len(rows) == len(ROWS)
    ordered = sorted([(i, t or "") for i, t, *_ in ROWS if i is not None], key=lambda r: -r[0])
    for k, ((i, t), r) in enumerate(zip(ordered[:-1], rows, strict=False)):
        after = ordered[k + 1][1]
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        assert r["doc_id"] == i and r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == lz_fingerprint.hex_of(lz_fingerprint.fingerprint(t))
        assert r["near_next"] == lz_fingerprint.likeness(lz_fingerprint.fingerprint(t), lz_fingerprint.fingerprint(after))
    one = lz_fingerprint.fingerprint_with_neighbours(docs.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert lz_fingerprint.fingerprint_with_neighbours(docs.limit(0)).count() == 0


@pytest.fixture
def odd_dir(spark, docs, bench, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, docs, odd_dir, empty):
    src = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, src, odd_dir)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        rows = out.collect()
        assert bool(rows) != empty
        if name != corpus_pipeline.STAGES[-1][0]:
            assert all(r[k] == v for r in rows for k, v in EXTRA.items())
        if name == "n-gram Jaccard join" and not empty:
            assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 9, -3, None], key=str)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs if any(c.isalpha() for c in r["text"])]
    _, roots = brute_groups(rows)
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    removed = brute_removals([(i, 0, t) for i, t in rows])
    rows = [(i, substring_dedup._cut_out(t, removed[i, t]) if removed[i, t] else t) for i, t in rows]
    rows = [r for r in rows if r[1].strip()]
    items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    windows = {tuple(i.split()[k:k + 10]) for i in items for k in range(max(1, len(i.split()) - 9))}
    got = corpus_pipeline.run(spark, SF001).collect()
    ids = {r["doc_id"] for r in got}
    clean = 0
    for i, t in rows:
        own = words(t)
        hit = any(tuple(own[k:k + w]) in windows for w in {len(x) for x in windows} for k in range(len(own) - w + 1))
        if not hit:
            clean += 1
            raw = np.frombuffer(packing.encoder(packing.TOKENIZER).encode([t])[0], "<u4").tolist() + [1]
            assert [r["ids_crc32"] for r in sorted(got, key=lambda r: r["piece"]) if r["doc_id"] == i] == [
                zlib.crc32(np.array(raw[k:k + 4096], dtype="<u4").tobytes()) for k in range(0, len(raw), 4096)]
    assert clean > 100 and ids <= {i for i, _ in rows}


def words(text):
    import re
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
