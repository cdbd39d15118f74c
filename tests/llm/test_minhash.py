import random

import numpy as np
import pytest
from conftest import prose

from docloom.llm.common import hashed_texts, shingles
from docloom.llm.dart import signatures
from docloom.llm.minhash import components, documents_classes, keep_one, near_duplicates, shingle_set


def sets_of(texts):
    out = []
    for first, last, h, bounds, _ in hashed_texts(texts):
        out += [set(shingle_set(h[bounds[i] : bounds[i + 1]]).tolist()) for i in range(last - first)]
    return out


def brute(rows):
    """The smallest document id of each row's component, by comparing all pairs."""
    texts = [t or "" for _, t in rows]
    sets = sets_of(texts)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                up[top(i)] = top(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted((str(k), least.get(top(i))) for i, (k, _) in enumerate(rows))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 700).astype(np.uint64)
    b = np.concatenate([a[:500], r.integers(0, 2**63, 200).astype(np.uint64)])
    s = signatures(np.concatenate([a, b, a[:1], a[:0]]), None, np.array([0, 700, 1400, 1401, 1401]), 4000)
    assert abs((s[0] == s[1]).mean() - 500 / 900) < 0.035
    assert s[2].all() and not s[3].any()
    wa = r.uniform(0.1, 9, 700)
    wb = np.concatenate([wa[:500] * r.uniform(0.5, 1.5, 500), r.uniform(0.1, 9, 200)])
    s = signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 700, 1400]), 4000)
    want = np.minimum(wa[:500], wb[:500]).sum() / (np.maximum(wa[:500], wb[:500]).sum() + wa[500:].sum() + wb[500:].sum())
    assert abs((s[0] == s[1]).mean() - want) < 0.035


def test_signatures_do_not_depend_on_company():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 300).astype(np.uint64)
    alone = signatures(a[:50], None, np.array([0, 50]), 216)
    assert (signatures(a, None, np.array([0, 50, 300]), 216)[0] == alone[0]).all()


def near_rows(r):
    rows = []
    for _ in range(12):  # chains of edits, and copies
        words = prose(r, r.randint(8, 150)).split()
        for _ in range(r.randint(1, 8)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = prose(r, 1)
    passage = prose(r, 60)
    rows += [(len(rows) + i, passage + " " + prose(r, r.randint(1, 40))) for i in range(60)]
    return rows


def test_classes_against_brute_force(spark):
    rows = near_rows(random.Random(4))
    got = documents_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["class_id"]) for r in got) == brute(rows)


def test_multisets_against_brute_force(spark):
    """The weighted similarity: a text that repeats a passage is not like one that does not."""
    from collections import Counter

    r = random.Random(14)
    rows = near_rows(r)[:60]
    passage = prose(r, 20)
    rows += [(100 + i, " ".join([passage] * n)) for i, n in enumerate((1, 2, 9, 10, 11, 40))]
    bags = []
    for first, last, h, bounds, _ in hashed_texts([t for _, t in rows]):
        bags += [Counter(shingles(h[bounds[i] : bounds[i + 1]], min(5, bounds[i + 1] - bounds[i])).tolist()) for i in range(last - first)]
    up = list(range(len(rows)))

    def top(x):
        return x if up[x] == x else top(up[x])

    for i in range(len(rows)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total() - 1e-9:
                up[top(i)] = top(j)
    got = {x["key"]: x["class"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), multiset=True).collect()}
    groups = lambda pairs: sorted(sorted(k for k, c in pairs if c == x) for x in {c for _, c in pairs})
    assert groups(list(got.items())) == groups([(k, top(i)) for i, (k, _) in enumerate(rows)])
    with pytest.raises(ValueError, match="one round"):
        near_duplicates(spark.createDataFrame(rows[:1], "doc_id long, text string"), rounds=0)


def test_odd_rows(odd, odd_rows):
    rows = [(k, t) for k, t, *_ in odd_rows]
    assert sorted(((str(r["doc_id"]), r["class_id"]) for r in documents_classes(odd).collect()), key=str) == sorted(brute(rows), key=str)


def test_one_of_each_class_stays(odd, odd_rows):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    classes = {c for _, c in brute([(k, t) for k, t, *_ in odd_rows])}
    # two different texts have the id 5, and are two classes
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, classes), "5"])


def test_empty_table(none):
    assert documents_classes(none).count() == 0 and keep_one(none).count() == 0


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    links = spark.createDataFrame([(bytearray([a >> 8, a & 255]), bytearray([b >> 8, b & 255])) for a, b in pairs], "a binary, b binary")
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    number = lambda x: x[0] << 8 | x[1]
    got = {number(x["node"]): number(x["component"]) for x in components(links).collect()}
    assert got == {x: top(x) for a, b in pairs if a != b for x in (a, b)}


@pytest.mark.parametrize("texts", [["a b c d e", "A b  c, d e"], ["one", "one two"], ["", None]])
def test_short_texts(spark, texts):
    rows = list(enumerate(texts))
    got = documents_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["class_id"]) for r in got) == brute(rows)
