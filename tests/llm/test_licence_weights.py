"""Weights of words outside the templates, and the bound before the exact cosine."""

import math
import random
from collections import Counter

import pytest

from tessera.llm import license_scans as ls

LICENCE = "Licensed under the Apache License, Version 2.0."
PLAIN = "path string, text string, is_licence_file boolean"


@pytest.mark.parametrize("n", [40, 4000])
def test_verdict_depends_on_shares_not_on_the_size_of_the_table(spark, n):
    """A fourth of the files have the templates' words, another fourth the extra ones."""
    texts = [" ".join(f"{w} {w}" for w in "licensed under the apache license version 2 0".split()).replace(" ", "\n"), "see\nfile\nhere", "nothing", "nothing at all"]
    files = [(f"d/{i}", texts[i % 4], False) for i in range(n)] + [("e/x", f"See file here: {LICENCE}", False)]
    own = [r for r in ls.scan(spark.createDataFrame(files, PLAIN)).where("path = 'e/x'").collect()]
    assert [r.own_licence for r in own] == ["Apache-2.0"] and own[0].score == pytest.approx(math.sqrt(8 / 11), abs=0.03)


def test_scores_equal_the_cosine_of_every_line(spark):
    rng = random.Random(3)
    foreign = [f"word{i}" for i in range(40)] + ["see", "file", "2019", "holder"]
    def line():
        words = ls.plain_terms(rng.choice(ls.TEMPLATES)[1])[:rng.randint(2, 40)] + [rng.choice(foreign) for _ in range(rng.choice([0, 1, 2, 4, 9]))]
        rng.shuffle(words)
        return " ".join(words)
    files = [(f"d{i % 7}/{i}", "\n".join([line() for _ in range(rng.randint(0, 2))] + [" ".join(rng.choices(foreign[:9], k=9))]), i % 3 == 0) for i in range(120)]
    df = Counter(t for _, text, _ in files for t in set(ls.plain_terms(text)))
    weight = lambda t: math.log((len(files) + 2) / (df[t] + 1))
    vector = lambda text: {t: n * weight(t) for t, n in Counter(ls.plain_terms(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(text)) for name, text in ls.TEMPLATES]

    def best(text, flag):
        found = [(-round(sum(x * v[t] for t, x in u.items() if t in v) / norm(u) / norm(v), 9), name)
                 for u in map(vector, [*text.split("\n"), *([text] if flag else [])]) if u for name, v in templates]
        return min((f for f in found if f[0] <= -0.6), default=(None, None))

    got = {r.path: (r.own_licence, r.score) for r in ls.scan(spark.createDataFrame(files, PLAIN)).collect()}
    for path, text, flag in files:
        score, name = best(text, flag)
        assert got[path][0] == name and got[path][1] == (None if score is None else pytest.approx(-score, abs=2e-9))
    assert 20 < sum(name is not None for name, _ in got.values()) < 120
