"""Near-duplicates at shingle similarity 0.8 against brute force: exactly the components of all such pairs."""

import random

import pytest

from litloom.llm import simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def found(spark, texts, **more):
    return {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA), **more).collect()}


def edited(rng, words, places):
    out = list(words)
    for p in places:
        out[p] = f"e{rng.randrange(1 << 40)}"
    return out


def family_and_outliers(rng, members, outliers):
    """Close members; each outlier is similar to one of them only, which has the outlier's first change."""
    base = [f"w{rng.randrange(1 << 30)}" for _ in range(300)]
    texts = [edited(rng, base, [20 + rng.randrange(10)]) for _ in range(members)]
    for k in range(outliers):
        near = edited(rng, base, [60 + 5 * k])
        far = edited(rng, near, [170, 190, 210, 230, 250, 270])
        texts += [" ".join(near), " ".join(far)]
    return [t if isinstance(t, str) else " ".join(t) for t in texts]


@pytest.mark.parametrize("block", [20_000, 7])
def test_outliers_of_a_large_family(spark, block):
    texts = family_and_outliers(random.Random(1), 300, 15)
    random.Random(2).shuffle(texts)
    assert found(spark, texts, block=block) == brute(texts)


def test_isolated_pairs_at_the_limit(spark):
    rng, texts = random.Random(4), []
    for k in range(150):
        w = [f"w{rng.randrange(1 << 30)}" for _ in range(100 + k)]
        # Of n shingles the first n - cut remain: similarity from just below 0.8 to 0.83.
        cut = (len(w) - 4) * (17 + k % 4) // 100
        texts += [" ".join(w), " ".join(w[: len(w) - cut])]
    want = brute(texts)
    assert found(spark, texts) == want
    assert 100 < 300 - len(set(want.values())) <= 150


@pytest.mark.parametrize("long, short, linked", [(5, 4, True), (8, 6, False), (9, 7, False), (15, 12, True), (19, 15, False), (10, 8, True)])
def test_short_texts(spark, long, short, linked):
    texts, rng = [], random.Random(long)
    for _ in range(60):
        w = [f"w{rng.randrange(1 << 30)}" for _ in range(long + 4)]
        texts += [" ".join(w), " ".join(w[: short + 4])]
    got = found(spark, texts)
    assert got == {i: i - i % 2 if linked else i for i in range(120)}
