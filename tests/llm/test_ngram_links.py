import numpy as np

from lodemap.llm import ngram_join


def test_every_link_is_counted(spark):
    """Groups of mutually similar texts and their copies: a link counts even between texts that others already join."""
    rng = np.random.default_rng(3)
    texts = [None, "", "one two"]
    for n in (20, 60, 200):
        base = [f"w{n}_{i}" for i in range(n)]
        for changes in (0, 0, 1, 1, 1, 2, 3, 6):
            words = list(base)
            for at in rng.integers(0, n, changes):
                words[at] = f"c{rng.integers(0, 9)}"
            texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    similar = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = [sum(similar(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngram_join.similarity_links(df, 4, 80).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.n_links) for r in found] == [(i, len(s), n) for i, (s, n) in enumerate(zip(sets, want, strict=True))]
    assert max(want) >= 5
