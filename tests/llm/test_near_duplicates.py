import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frostline.llm import near_duplicates as nd
from frostline.llm.shingles import shingle_sets
from tests.llm.samples import WORD, descriptions, events, low, sentence


def shingles(text, k):
    words = WORD.findall(low(text))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def groups(rows, k, percent):
    """Smallest id of the component of each row, by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return Counter((name, len(s), least.get(root(i))) for i, ((name, _), s) in enumerate(zip(rows, sets)))


def family(n=60, seed=5):
    """Descriptions that differ from one another by a few words, and chains in which only neighbours are alike."""
    r = random.Random(seed)
    base = sentence(r, 120).split()
    rows = []
    for i in range(n):
        words = list(base)
        for at in r.sample(range(len(words)), r.randint(0, 9)):
            words[at] = f"new{i}x{at}"
        rows.append((1000 + i, " ".join(words)))
    chain = sentence(r, 150).split()
    for i in range(12):
        rows.append((2000 + i, " ".join(chain)))
        for at in r.sample(range(len(chain)), 3):
            chain[at] = f"step{i}x{at}"
    return rows


@pytest.mark.parametrize("k, percent", [(5, 80), (3, 85)])
def test_components_equal_all_pairs(spark, k, percent):
    rows = [r for r in descriptions() if r[0] != 312] + family()
    got = nd.near_duplicates(events(spark, rows), k, percent).collect()
    assert Counter((r["event_id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows, k, percent)
    assert all(r["kept"] == (r["event_id"] == r["component_id"]) for r in got)


def test_one_of_each_group_stays(spark):
    df = events(spark, descriptions() + family())
    left = nd.without_copies(df)
    assert left.columns == df.columns
    want = {key[2] for key in groups([r for r in descriptions() + family() if r[0] != 312], 5, 80)} | {312}
    ids = Counter(r["event_id"] for r in left.select("event_id").collect())
    assert {i for i in ids if i is not None} == {i for i in want if i is not None} and max(ids.values()) == 1
    assert nd.without_copies(df.where("false")).count() == 0


def test_a_large_group_makes_few_pairs(spark):
    r = random.Random(1)
    base = sentence(r, 100).split()
    rows = [(i, " ".join([*base[:-2], f"a{i}", f"b{i}"])) for i in range(400)]
    df = events(spark, rows, clash=False)
    search = nd._Search(df, nd.sketches(df, 5, "event_id", "description"), 5, 80, "event_id", "description")
    search.test(search.star(search.in_parts(None), 0))
    assert search.tested.count() < 4 * len(rows)
    apart = search.bands_apart(search.in_parts(search.parts()))
    assert search.across(apart).count() < 4 * len(rows)


def test_blocks_find_the_links_of_large_bands(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("BLOCK_ROWS", 5), ("STARS", 0)):
        monkeypatch.setattr(nd, name, value)
    rows = family()
    got = nd.near_duplicates(events(spark, rows)).collect()
    assert Counter((r["event_id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows, 5, 80)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    for shared, apart in ((800, 100), (300, 300), (40, 4), (5000, 200)):
        x = np.unique(rng.integers(0, 2 ** 63, shared + 2 * apart).astype(np.uint64))
        rng.shuffle(x)
        a, b = x[:shared + apart], np.concatenate([x[:shared], x[shared + apart:]])
        ra, rb, both = nd.registers([np.sort(a), np.sort(b), np.sort(x)])
        assert (np.maximum(ra, rb) == both).all()
        got = nd.joint_similarity(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - shared / len(x)) < 0.12
    assert (nd.registers([np.empty(0, np.uint64)]) == 0).all()


def test_shingle_counts_equal_a_loop():
    texts = [t for _, t in descriptions()]
    for k in (3, 5):
        assert [len(s) for s in shingle_sets(pa.array([t or "" for t in texts]), k)] == [len(shingles(t, k)) for t in texts]


def test_parts_of_a_batch_give_the_same_words():
    from frostline.llm.packing import text_chunks
    from frostline.llm.quality_classifier import gram_lists

    texts = [t or "" for _, t in descriptions() if t is None or len(t) < 3000] + ["Été ÀÉ\u0080 Straße " * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(texts * 3)], ["text"])
    parts = [b.column("text") for b in text_chunks(batch, "text", 700)]
    assert len(parts) > 5 and sum(map(len, parts)) == 3 * len(texts)
    whole = shingle_sets(batch.column("text"), 3)
    assert all((a == b).all() for a, b in zip(whole, [s for p in parts for s in shingle_sets(p, 3)]))
    for a, b in zip(gram_lists(batch.column("text")), (g for p in parts for g in gram_lists(p))):
        assert sorted(a.tolist()) == sorted(b.tolist())
    assert [len(s) for s in whole] == [len(shingles(t, 3)) for t in texts] * 3


def test_empty_table(spark):
    assert nd.near_duplicates(events(spark).where("false")).count() == 0
    only = nd.near_duplicates(events(spark, [(7, "one text of some words")]).withColumn("kept", F.lit(1))).collect()
    assert [(r["component_id"], r["kept"]) for r in only] == [(7, True)]
