"""Near duplicates of a stated similarity against brute force over all pairs."""

import collections
import random
import re

import numpy as np
import pytest

from terrasift.llm import similar

SCHEMA = "doc_id long, text string, n long, component_id string, keys map<string,int>"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(texts):
    sets = [shingles(t) for t in texts]
    reach = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = reach[i], reach[j]
                reach = [min(a, b) if x in (a, b) else x for x in reach]
    return reach


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \n", "One", "one", "a b c", "A  b\tc", "a b c d e f", "É b"]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(40, 250))] + passage * (k % 3 == 0)
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts.append(" ".join(rng.choice(words) for _ in range(100_000)))
    texts.append(texts[-1] + " and some more")
    out = [(i, t, 0, "clash", {"a": i}) for i, t in enumerate(texts)]
    return [*out, (None, "one", 0, None, None), (3, "One", 0, None, None), (3, "One", 0, None, {"b": 1}), (12, "another text", 1, None, None)]


def check(spark, rows, parts):
    docs = spark.createDataFrame(rows, SCHEMA)
    reach = components([r[1] for r in rows])
    least = {}
    for r, c in zip(rows, reach):
        least[c] = min((x for x in (r[0], least.get(c)) if x is not None), default=None)
    want = collections.Counter((r[0], least[c]) for r, c in zip(rows, reach))
    found = similar.similar_documents(docs.repartition(parts)).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in found) == want
    return docs, least


def test_similar_documents_against_brute_force(spark, rows):
    docs, least = check(spark, rows, 3)
    kept = similar.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    again = similar.deduplicate(docs.repartition(7))
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))


def test_large_groups_meet_part_by_part(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(70):
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(words)  # a chain: its ends differ, its neighbours are alike
        texts.append(" ".join(base))
    monkeypatch.setattr(similar, "PART_MEMBERS", 8)
    check(spark, [(i, t, 0, None, None) for i, t in enumerate(texts)], 5)


def test_links_of_a_group_span_its_components():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14)).astype(np.uint64)) for _ in range(rng.integers(2, 12))]
        nodes = np.arange(len(sets)) * 7
        reach = list(nodes)
        for i in range(len(sets)):
            for j in range(i):
                if 10 * len(np.intersect1d(sets[i], sets[j])) >= 6 * len(np.union1d(sets[i], sets[j])):
                    a, b = reach[i], reach[j]
                    reach = [min(a, b) if x in (a, b) else x for x in reach]
        u, v = similar.similar_links(nodes, sets, 0.6)
        got = list(nodes)
        for x, y in zip(u, v):
            a, b = got[x // 7], got[y // 7]
            got = [min(a, b) if z in (a, b) else z for z in got]
        assert got == reach and len(u) < len(sets)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar.similar_documents(empty).count() == 0 and similar.deduplicate(empty).count() == 0
