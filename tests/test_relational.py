"""Containment and combinations against plain loops."""

import itertools
import random

import pytest

from tessera.operators import relational as r


def test_contained_equals_a_loop(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé🙂 ") for _ in range(n))
    texts = [word(rng.randint(0, 60)) for _ in range(80)] + ["a" * 5000, None, "", "abcabc", "abcabc"]
    terms = [word(n) for n in (1, 2, 2, 3, 4, 5, 6, 9)] + ["a", "é", "🙂", "aaaa", "a" * 5000, "a" * 5001, "", None, "abc", "bca", "a_%b", "c"]
    terms += [t[3:9] for t in texts[:20] if len(t) > 12]
    a, b = spark.createDataFrame([(t,) for t in texts], "a string"), spark.createDataFrame([(t,) for t in terms], "b string")
    want = {(x, y) for x in texts for y in terms if x is not None and y and y in x}
    got = [tuple(p) for p in r.contained(a, b, "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    both = {(x, y) for x in texts for y in terms if x and y and (y in x or x in y)}
    assert {tuple(p) for p in r.contains_join(a, b, "a", "b").collect()} == both
    assert r.contained(a.limit(0), b, "a", "b").count() == 0 == r.contained(a, b.limit(0), "a", "b").count()


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("sizes", [(30, 40), (20, 30, 25), (12, 9, 8, 7)])
def test_combinations_equal_a_loop(spark, sizes, several):
    rng = random.Random(sum(sizes) + several)
    dims = {f"d{k}": [(f"m{rng.randint(0, n)}" if several else f"m{i}", [rng.choice([1, 1, 2, 3, 4, None]) for _ in range(rng.randint(0, 2) if several else 1)]) for i in range(n)] for k, n in enumerate(sizes)}
    share = lambda x, y: bool((set(x) & set(y)) - {None})
    found = {tuple(m for m, _ in c) for c in itertools.product(*dims.values()) if all(share(x[1], y[1]) for x, y in itertools.combinations(c, 2))}
    frames = {k: spark.createDataFrame(v, "key string, ids array<int>") for k, v in dims.items()}
    for cap in (1, 7, 60):
        got = [tuple(x) for x in r.combinations(frames, "key", "ids", cap).collect()]
        assert got == sorted(found)[:cap]


def test_combinations_do_not_build_the_product(spark):
    frames = {k: spark.range(2000).selectExpr(f"concat('{k}', id) AS key", "array(1) AS ids") for k in ("x", "y", "z")}  # 8 billion choices
    assert r.combinations(frames, "key", "ids", 25).count() == 25
