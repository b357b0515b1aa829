"""Nulls, repeats, ties, long texts, empty tables and clashing columns, with the values that each operator states for them."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lodemap.llm import licenses, line_dedup, ngram_join, quality, sharding
from lodemap.llm.common import sampled, written

from ..conftest import SMALL
from .test_brute_force import components

LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
ROWS = [
    (None, "a null key with a text of some words and more of them"), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"),
    (5, LONG), (6, LONG + " end"), (7, "a null key with a text of some words and more of them"), (8, "short"), (8, "other"), (9, "ONE\x0bTWO"),
]
CLASH = "node, n, k, __own, __row, __key, `a.b`, at, words, h1, size, shard"


@pytest.fixture(scope="module")
def docs(spark):
    names = [c.strip(" `") for c in CLASH.split(",")]
    return spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], f"doc_id long, text string, {', '.join(f'`{n}` int' for n in names)}")


def grams(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_ngram_classes(docs):
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(docs).collect()), key=str)
    roots = components([grams(t, 4) for _, t in ROWS], 85)
    want = []
    for i, (key, text) in enumerate(ROWS):
        keys = [k for j, (k, _) in enumerate(ROWS) if roots[j] == roots[i] and k is not None]
        want.append((key is None, key or 0, len(grams(text, 4)), min(keys) if keys else None))
    assert found == sorted(want, key=str)
    assert ngram_join.similarity_classes(docs.limit(0)).count() == 0


def test_one_of_each_keeps_all_columns(docs):
    kept = ngram_join.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    # 4 is repeated and equal to 9; the copies of 6 and of the null key go
    assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect() if r.text) == sorted(
        [(3, " \t\n"), (4, "one two"), (5, LONG), (7, ROWS[0][1]), (8, "other"), (8, "short")]
    )
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [95, 99])
def test_bands_of_high_similarity_hold_long_texts(spark, percent):
    rng = np.random.default_rng(percent)
    texts = []
    for n in (40, 300, 6_000):
        base = [f"w{v}" for v in rng.integers(0, 10**6, n)]
        for changes in (0, 0, 1, 2, 5, 12, 60):
            words = list(base)
            for at in rng.integers(0, n, min(changes, n // 8)):
                words[at] = "new"
            texts.append(" ".join(words))
    found = ngram_join.similarity_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, percent)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == components([grams(t, 4) for t in texts], percent)


def test_many_near_copies_of_one_text(spark):
    """Copies with several edits each: few reach the first text, some only each other."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(150):
        words = list(texts[int(rng.integers(0, len(texts)))].split()) if i % 3 == 0 else list(base)
        for at in rng.integers(0, len(words), int(rng.integers(1, 7))):
            words[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    found = ngram_join.similarity_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85)
    want = components([grams(t, 4) for t in texts], 85)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == want and 10 < len(set(want)) < 140


def test_lines_of_long_texts(spark):
    lines = [f"line number {i} has its own words and ends with {i * 7} now" for i in range(3_000)]
    changed = [x.replace("words", "terms") if i % 2 else x for i, x in enumerate(lines)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*changed, "a new line of more than eight words is here"])), (None, "x\nx")], "doc_id long, text string")
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    # one word apart: the other lines of the same text too, as two numbers differ in them
    assert found[1][:2] == (3_000, 0) and found[2][:2] == (3_001, 3_000) and found[2][2] == "a new line of more than eight words is here"
    assert found[None] == (2, 1, "x")


def test_shards_of_awkward_rows(docs):
    out = sharding.shard_by_bytes(docs).collect()
    want = sorted((k is None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in out) == want
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots))) and 0 <= shard < 16


def test_quality_of_other_white_space(spark):
    texts = ["abcd ABCD " * 80, "abcd\x1cABCD " * 80, "ABCD 　 " * 80, "Ab CD é " * 80, "#$ " * 60, "x\n" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.apply_rules(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", t)
        assert rows[i].n_words == len(words) and rows[i].word_chars == sum(map(len, words))
        stats = quality.TextStats(t.encode())
        assert stats.n_upper_words == sum(w.isupper() for w in words)
        assert rows[i].kept == (quality.rejected_by(stats, quality.RULES) is None)


def test_samples_pass_long_texts_over(spark):
    texts = ["x" * 3_000 if i == 5 else f"text {i}" for i in range(60)]
    found = sampled(spark.createDataFrame([(1, t) for t in [*texts, *texts]], "doc_id long, text string"), "doc_id", "text", 200, 2_000)
    assert sorted(found) == sorted(t.encode() for t in texts if len(t) < 100)


def banded(template, words, diagonal, band):
    """The longest common subsequence within a band, by its plain recurrence."""
    best = {}
    for i in range(1, len(template) + 1):
        for j in range(max(1, i + diagonal - band), min(len(words), i + diagonal + band) + 1):
            here = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0))
            best[i, j] = max(here, best.get((i - 1, j - 1), 0) + 1) if template[i - 1] == words[j - 1] else here
    return max(best.values(), default=0)


def test_licenses_of_every_diagonal(spark):
    """Small templates aligned on all diagonals, without the fingerprints, against the scan."""
    rng = np.random.default_rng(4)
    texts = {f"T{i}": " ".join(f"t{i}w{j}" for j in range(n)) for i, n in enumerate((9, 14, 25))}
    known = licenses.Templates(texts)
    for _ in range(40):
        name = f"T{rng.integers(0, 3)}"
        words = texts[name].split()
        for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words[at] = "changed"
        body = [*(f"a{v}" for v in rng.integers(0, 9, int(rng.integers(0, 12)))), *words, "b", "c"]
        folded = [w.encode() for w in body]
        best = 0
        for d in range(-len(known.words[known.names.index(name)]), len(folded)):
            best = max(best, banded(texts[name].encode().split(), folded, d, licenses.reach(len(words))))
        found = licenses.find_licenses(" ".join(body).encode(), known)
        assert [(f[0], f[1]) for f in found] == ([(name, best)] if 100 * best >= licenses.LEAST_COVERAGE * len(words) else [])


def test_repeated_notices_are_all_reported(spark):
    notice = licenses.TEMPLATES["MIT short"]
    text = f"é {notice} x {notice} " * 300
    df = spark.createDataFrame([(1, text), (1, text), (None, None), (2, "")], "doc_id long, text string")
    found = licenses.scan_licenses(df).collect()
    places = [m.start() for m in re.finditer(re.escape(notice.rstrip(".")), text)]
    for r in found:
        assert [x.start for x in r.licenses] == (places if r.doc_id == 1 else []) and all(x.license == "MIT short" for x in r.licenses)


def test_stages_of_awkward_rows(spark):
    """Every stage on nulls, repeats, a null key and a long text; clean rows stay and columns are kept."""
    names = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(k, t, "en", "web", len(t or "")) for k, t in ROWS]
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SMALL), name)
        if name == "tokens":
            assert after.count() == docs.count()
            break
        assert after.columns == docs.columns
        if name in ("toxicity", "decontamination"):
            assert sorted(map(str, after.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        docs = after
    assert docs.where("doc_id is null").count() <= 1 and docs.where("doc_id = 1 and text is null").count() == 1
