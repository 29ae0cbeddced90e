"""The containment join (JN13) against every pair."""

import numpy as np

from fpengine.operators.substrings import containment_join, substring_pairs


def pairs(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def strings(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, part int")


def test_equals_every_pair(spark):
    rng = np.random.default_rng(3)

    def some(n, most):
        return ["".join(rng.choice(list("ab\u00e9\U0001F600 \n."), rng.integers(0, most))) for _ in range(n)]

    a, b = some(60, 7), some(80, 12)
    a += ["aba"] * 40 + [None, ""]  # one value held by a third of the rows
    b += ["xabay"] * 40 + [None, "", "a"]
    want = {(x, y) for x in a for y in b if x and y and (x in y or y in x)}
    assert pairs(containment_join(strings(spark, a), strings(spark, b), "v", "v")) == want
    assert any(len(x) > len(y) for x, y in want) and any(len(x) < len(y) for x, y in want)


def test_long_and_empty(spark):
    long = "ab" * 300_000 + "needle" + "ba" * 200_000
    one = strings(spark, [long])
    assert pairs(substring_pairs(strings(spark, ["needle", "needles", "abab", "bb", "z"]), one, "v", "v")) == {("needle", long), ("abab", long)}
    none = strings(spark, ["x"]).limit(0)
    assert pairs(containment_join(none, one, "v", "v")) == set() == pairs(containment_join(one, none, "v", "v"))
