import random

import numpy as np

from lodemap.llm import ngram_join


def test_sketches_never_tell_more_differences_than_there_are():
    draw = np.random.default_rng(3)
    for n, own in ((1, 0), (40, 3), (400, 60), (3000, 2000)):
        both = draw.integers(-(2**63), 2**63, n)
        a, b = (np.unique(np.concatenate([both, draw.integers(-(2**63), 2**63, own)])).view(np.uint64) for _ in "ab")
        differ = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))
        assert own > 100 or differ >= 0.8 * len(np.setxor1d(a, b))
    assert not ngram_join.sketch(np.zeros(0, np.uint64)).any()


def test_strays_of_a_cluster_are_not_compared_with_all_of_it(spark, monkeypatch):
    """Copies of one text with up to four changed words, of which those with most are like few others or none: they share
    differences with hundreds, which sizes and places don't tell apart."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in range(400):
        words = list(base)
        for i in range(draw.randint(1, 4)):
            words[draw.randrange(150)] = f"e{n}x{i}"
        texts.append(" ".join(words))
    compared, counts = ngram_join._compared, []

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return compared(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "_compared", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.similarity_classes(docs, k=5, percent=80).collect()}
    sets = [set(s.tolist()) for s in ngram_join.shingle_sets([t.encode() for t in texts], 5)]
    least = list(range(len(sets)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                least[y] = x
    want = {i: top(i) for i in range(len(sets))}
    assert found == want
    assert len(set(want.values())) > 5  # strays
    assert sum(counts[1:]) < 100  # of the pairs that differences make
