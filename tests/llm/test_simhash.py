"""SimHash components against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from conftest import SF001
from lexiscope.llm import simhash


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    """The first place of each fingerprint's connected group."""
    group = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    groups = plain_groups(prints)
    want = {(r["doc_id"], f"{p:016x}", rows[g]["doc_id"]) for r, p, g in zip(rows, prints, groups, strict=True)}
    assert set(map(tuple, entry.queries()["op11_simhash_near_dedup"](spark, SF001).collect())) == want


@pytest.mark.parametrize("shard, block", [(4, 1000), (30, 40), (4000, 7)])
def test_near_pairs_in_small_shards_and_blocks(spark, shard, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2 ** 63, 25, dtype=np.uint64)
    near = [c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres.tolist() for _ in range(12)]
    points = sorted({int(x) for x in near})
    groups = plain_groups(points)
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "node long").repartition(3)
    pairs = simhash.near_pairs(nodes, shard=shard, block_rows=block).collect()
    place = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(points)}
    root = np.arange(len(points))
    simhash.unite(root, np.array([place[r["src"]] for r in pairs]), np.array([place[r["dst"]] for r in pairs]))
    assert root.tolist() == groups
    assert len(pairs) < 40 * len(points)


def test_tree_brings_every_linked_pair_together():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    other = base ^ np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))], np.uint64)
    points = np.unique(np.concatenate([base, other]))
    tree = simhash.VantageTree(points, 64)
    assert tree.shards > 8
    shard, row, member = tree.deal(points)
    assert np.bincount(row[member]).tolist() == [1] * len(points)
    together = set()
    for s in range(tree.shards):
        at, home = row[shard == s], member[shard == s]
        together |= {(int(points[a]), int(points[b])) for a in at[home] for b in at}
    for a, b in zip(base.tolist(), other.tolist(), strict=True):
        assert a == b or (a, b) in together or (b, a) in together


def test_dense_cluster_is_not_split():
    points = np.array([(1 << a) | (1 << b) for a in range(64) for b in range(a)], np.uint64)
    tree = simhash.VantageTree(points, 64)
    shard, row, _ = tree.deal(points)
    assert len(row) < 4 * len(points)
    root = np.arange(len(points))
    simhash.link(points, np.arange(len(points)), np.arange(len(points)), root)
    assert not root.any()


def test_link_prunes_large_sides(monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 64)
    rng = np.random.default_rng(8)
    points = np.unique(np.concatenate([(x := rng.integers(0, 2 ** 63, 150, dtype=np.uint64)), x ^ np.uint64(3), x ^ np.uint64(1 << 40)]))
    root = np.arange(len(points))
    simhash.link(points, np.arange(len(points)), np.arange(len(points)), root)
    assert root.tolist() == plain_groups(points.tolist())


def test_long_text_in_runs(monkeypatch):
    text = "  The Cat\tsat\n" + " ".join(f"word{i} É" for i in range(400)) + "\x0b x  y " + "z" * 300
    whole = plain_fingerprint(text)
    raw = np.frombuffer(text.encode(), np.uint8)
    for size in (1 << 20, 50, 7):
        monkeypatch.setattr(simhash, "CHUNK", size)
        assert simhash.fingerprint_texts(np.array([0, len(raw)]), raw).tolist() == [whole]


def test_odd_rows(spark):
    same = "one two three four"
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, same), (7, same), (None, same), (8, "ONE two\nthree  four"), (None, "alone here"),
            (-2, "Two words"), (1, "x"), (2, "word " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, fingerprint string").repartition(4)
    got = sorted(map(tuple, simhash.simhash_components(df).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(prints)
    ids = [min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None) for g in groups]
    assert got == sorted([(r[0], f"{p:016x}", i) for r, p, i in zip(rows, prints, ids, strict=True)], key=repr)
    assert simhash.simhash_components(df.where("doc_id > 100")).collect() == []
