import random

from lodemap.llm import ngram_join


def test_groups_of_a_star_with_one_pivot_make_one_star(spark):
    rows = [(g, s, node, node) for g, s in ((1, 7), (2, 7), (3, 8)) for node in (10, 12, 14)]
    stars = ngram_join._stars(spark.createDataFrame(rows, "g long, s long, node long, weight long"), "s").collect()
    assert sorted((r.u, r.v) for r in stars) == [(14, 10), (14, 10), (14, 12), (14, 12)]  # of the stars 7 and 8
    assert len({r.s for r in stars}) == 2


def test_near_copies_of_one_text_fall_apart_in_one_round(spark, monkeypatch):
    """Groups of a cluster's differences are compared directly, not dealt into stars again; the links are those of all pairs."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for n in range(260):
        words = list(base)
        for _ in range(draw.randint(1, 5)):
            words[draw.randrange(60)] = f"e{n}x{draw.randrange(9)}"
        texts.append(" ".join(words))
    rounds = []
    stars = ngram_join._stars
    monkeypatch.setattr(ngram_join, "_stars", lambda *a: rounds.append(stars(*a)) or rounds[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.similarity_classes(docs, k=5, percent=80).collect()}
    sets = ngram_join.shingle_sets([t.encode() for t in texts], 5)
    least = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(least)
        for i, a in enumerate(sets):
            for j in range(i):
                if least[i] != least[j] and ngram_join.similar(a, sets[j], 80):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert found == dict(enumerate(least))
    assert len(rounds) == 2  # the first, and one that finds none left
