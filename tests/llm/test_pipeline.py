"""Each stage against plain code on its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from lodemap.llm.common import written

from ..conftest import SMALL
from .test_brute_force import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def folded(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_columns(stages):
    names = list(stages)
    assert names[1:] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    assert all(sorted(stages[n].columns) == sorted(stages["documents"].columns) for n in names[1:-1])


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = texts(stages["documents"]).keys() - texts(stages["toxicity"]).keys()
    assert all(labels.get(i, 1) for i in gone)


def test_lines_stay_in_order(stages):
    before, after = texts(stages["toxicity"]), texts(stages["line_dedup"])
    assert before.keys() == after.keys()
    seen = set()
    for i in sorted(after):
        rest = iter(before[i].split("\n"))
        assert all(line in rest for line in after[i].split("\n")) or not after[i]
        for line in after[i].split("\n"):
            words = tuple(line.split())
            assert not words or words not in seen
            seen.add(words)


def test_one_of_each_component_stays(stages):
    before, after = texts(stages["line_dedup"]), texts(stages["near_duplicates"])
    ids = sorted(before)
    sets = []
    for i in ids:
        w = before[i].encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    roots = components(sets, 80)
    assert set(after) == {ids[r] for r in roots} and all(after[i] == before[i] for i in after)


def test_no_window_of_an_item_is_left(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = folded(r.text or "")
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    before = texts(stages["near_duplicates"])
    hit = {
        i for i, t in before.items() for w in [folded(t)] for n in sizes for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows
    }
    assert set(texts(stages["decontamination"])) == set(before) - hit


def test_tokens_decode_to_the_text(stages):
    before = texts(stages["decontamination"])
    rows = stages["tokens"].collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before.items()}
    for r in rows:
        assert len(r.ids) == r.n_tokens and hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256
