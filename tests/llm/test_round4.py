"""Findings of round 3 on the corpus operators: lookups of the language model in a fixed number of passes."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import lm

# -- 8 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [(3, 3, 3), (22, 22, 22), (30, 40, 12), (64,), (63, 20), (50, 62, 60)])
def test_ngrams_are_summed_whatever_their_width(bits):
    rng = np.random.default_rng(88)
    pools = [rng.integers(0, 2**b, 9, dtype=np.uint64, endpoint=False) if b < 64 else rng.integers(0, 2**64 - 1, 9, dtype=np.uint64) for b in bits]
    words, value = [pool[rng.integers(0, 9, 3000)] for pool in pools], rng.integers(1, 99, 3000)
    want = Counter()
    for gram, n in zip(zip(*(w.tolist() for w in words), strict=True), value.tolist(), strict=True):
        want[gram] += n
    found, sums = lm._combined(words, value)
    assert list(zip(zip(*(w.tolist() for w in found), strict=True), sums.tolist(), strict=True)) == sorted(want.items())
    assert len(lm._combined([w[:0] for w in words], value[:0])[1]) == 0


def test_lookups_take_a_fixed_number_of_passes(spark, monkeypatch):
    rng = random.Random(48)
    # Contexts of few and of many n-grams, and more often than a byte holds.
    lines = [[f"a{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(0, 60))] for _ in range(500)] + [["x", "y", "z"]] * 300 + [["x", f"n{i}"] for i in range(90)]
    model = lm.train(spark.createDataFrame([(" ".join(line),) for line in lines], "text string"), order=3)
    asked = [*lines[::7], ["new", "x", "y"], ["x", "new", "y", "z"], ["z", "x", "n7"], []]
    data = [" ".join(line).encode() for line in asked]
    offsets = np.cumsum([0, *map(len, data)])
    passes = Counter()
    for name in ("values", "sizes"):
        plain = getattr(lm.Contexts, name)
        monkeypatch.setattr(lm.Contexts, name, lambda self, at, name=name, plain=plain: passes.update([(name, id(self))]) or plain(self, at))
    reader = lm.Reader(model)
    n, known, _, score = reader.score(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert n.tolist() == [len(line) + 1 for line in asked] and known[-4:].tolist() == [3, 4, 4, 1]
    assert max(passes.values()) <= 2

    grams = [Counter(), Counter(), Counter()]  # of three words; of two and one: how many different words precede
    for line in lines:
        s = [0, *line, 1]
        grams[2].update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
        grams[1].update([tuple(s[:2])])
    for g in grams[2]:
        grams[1][g[1:]] += 1
    for g in grams[1]:
        grams[0][g[1:]] += 1
    tables = []
    for level in grams:
        d = lm.discounts([sum(c == k for c in level.values()) for k in (1, 2, 3, 4)])
        after = defaultdict(list)
        for g, c in level.items():
            after[g[:-1]].append(c)
        tables.append((level, [0, *d], after))

    def p(gram):
        level, d, after = tables[len(gram) - 1]
        found, c = after[gram[:-1]], level[gram]
        lower = p(gram[1:]) if len(gram) > 1 else 1 / (len(grams[0]) + 1)
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in found) * lower) / sum(found) if found else lower

    for line, got in zip(asked, score.tolist(), strict=True):
        s = [0, *line, 1]
        assert math.isclose(got, sum(math.log10(p(tuple(s[max(0, i - 2) : i + 1]))) for i in range(1, len(s))), rel_tol=1e-9)
    assert max(len(x) for x in tables[1][2].values()) > lm.LONG and max(grams[2].values()) > 255
