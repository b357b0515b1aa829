import numpy as np

from lodemap.llm import toxicity


def test_every_term_of_long_texts_is_learned_from(spark):
    """Labelled texts of 30,000 distinct terms: none is left out, whatever it says about the label by itself."""
    common = " ".join(f"w{i}" for i in range(20_000))
    telling = [f"t{i}" for i in range(10_000)]
    ids = spark.range(40).where(~toxicity.held_out("id")).limit(16).collect()
    rows = [(r.id, f"{common} {' '.join(telling)}" if i % 2 else common, i % 2) for i, r in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.examples(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    want = {y: np.unique([toxicity.bucket(t) for t in toxicity.terms(f"{common} {' '.join(telling) if y else ''}".encode())]) for y in (0, 1)}
    assert len(found) == 16 and all(np.array_equal(np.sort(t), want[y]) for t, y in found)


def test_an_interaction_without_any_signal_of_its_terms(spark):
    """Toxic if exactly one of two terms is there: neither says anything alone, from labels to scores."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(w for w, on in (("apple", a), ("pear", b)) if on), int(a != b)) for i, (a, b) in enumerate(rng.integers(0, 2, (3000, 2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.examples(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")))
    scored = toxicity.score(docs, model).join(docs, "doc_id").where(toxicity.held_out("doc_id"))
    assert scored.where("predicted <> toxic").count() == 0 and scored.count() > 900


def test_scores_are_the_explicit_sums():
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(50)] + ["abc", "é"]
    examples = [(np.array([toxicity.bucket(t) for t in toxicity.terms(" ".join(rng.choice(words, 9)).encode())]), int(i % 3 == 0)) for i in range(200)]
    model = toxicity.fit(examples)
    model.linear[:] = rng.normal(size=len(model.linear))
    model.factors[:] = rng.normal(size=model.factors.shape)
    texts = ["", "unknown", *(" ".join(rng.choice([*words, "unknown", "WORD3"], n)) for n in (1, 2, 5, 40))]
    row = {b: i for i, b in enumerate(model.buckets.tolist())}
    for text, found in zip(texts, model.score_texts([t.encode() for t in texts]), strict=True):
        own = sorted({row[b] for b in map(toxicity.bucket, toxicity.terms(text.encode())) if b in row})
        total = model.bias + sum(float(model.linear[i]) for i in own)
        total += sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(own) for j in own[:n]) / max(1, len(own)) ** 0.5
        assert abs(found - 1 / (1 + np.exp(-total))) < 1e-5
