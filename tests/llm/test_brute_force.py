"""Operators that SQL can't express, against plain loops or the libraries they answer to, on a table of awkward rows."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodemap.llm import bpe, decontam, licenses, line_dedup, ngram_join, quality, secret_scan, sharding, token_files, toxicity

from ..conftest import SMALL

ODD = [
    None, "", " ", "\n", "a", "a  b\n c \t", "x\n\nx\nx", "don't 's    　 é漢字 🙂 ١٢", "<|endoftext|> x", "ab " * 30_000, "z" * 5_000,
    'Password: "abcdefgh1" token=short AKIA' + "B" * 16 + " " + "0f" * 20, "the cat sat on the mat and the dog sat on the log near the fog today ok",
]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, repeated rows, a null key and extra columns with names that the operators use inside."""
    small = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    rows = list(enumerate([*ODD, *small]))
    rows += [rows[3], rows[-1], rows[-1], (None, "a null key with a text of some words")]
    return spark.createDataFrame([(k, t, "en", 1, 2) for k, t in rows], "doc_id long, text string, lang string, n long, score long")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_key(values):
    return sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, str(v[1:])))


def test_bpe_is_tiktoken(docs, rows, none):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for k, t in rows:
        ids = own.encode_ordinary(t)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((k, len(ids), digest, hashlib.sha256(t.encode()).hexdigest()))
    found = bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN)
    assert by_key(map(tuple, found.collect())) == by_key(want)
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert by_key((r.doc_id, bytes(r.decoded).decode()) for r in back) == by_key(rows)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 7, 1000):
        keys = [str(i).encode() for i in range(n)]
        table = bpe.PerfectHash(keys)
        assert sorted(table.slot_key.tolist()) == list(range(n))
        assert table.lookup(keys).tolist() == list(range(n)) if n else True


def test_token_files(spark, docs, rows, none):
    tokenizer = Tokenizer.from_file(JSON)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found = token_files.read_token_files(docs, token_files.write_token_files(docs, JSON)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [k for k, _ in order]
    at = 0
    texts = {k: sorted(t for q, t in rows if q == k) for k, _ in rows}
    for r in found:
        assert r.start == at
        crcs = []
        for t in texts[r.doc_id]:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
            crcs.append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert (r.n_tokens, r.ids_crc32) in crcs
        at += r.n_tokens
    assert token_files.read_token_files(none, token_files.write_token_files(none, JSON)).count() == 0


def test_token_file_detects_another_dictionary(tmp_path):
    writer = token_files.TokenFileWriter(str(tmp_path / "a"), 2, b"")
    writer.add(5, b"\1\0\2\0")
    writer.close()
    assert token_files.TokenFile(str(tmp_path / "a")).ids(0).tolist() == [1, 2]
    raw = bytearray((tmp_path / "a").read_bytes())
    raw[token_files.HEAD.size - 1] ^= 1
    (tmp_path / "a").write_bytes(raw)
    with pytest.raises(ValueError, match="dictionary"):
        token_files.TokenFile(str(tmp_path / "a"))


def test_secrets(docs, rows, none):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for k, t in rows:
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want.append((k, sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))))
    found = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in secret_scan.scan_secrets(docs).collect()]
    assert by_key(found) == by_key(want) and any(s for _, s in want)
    assert secret_scan.scan_secrets(none).count() == 0


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_trigram_queries_lose_nothing(rule):
    hits = ['password = "abcdefgh1"', "API_KEY:abcdefgh9", "AKIA" + "Z" * 16, "0f" * 16, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    hits += ["xoxb-1234567890ab", "AIza" + "x" * 35, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "ftp://me:pass1@host"]
    texts = [f"é {h} ü".encode() for h in hits]
    index = secret_scan.TrigramIndex(texts, secret_scan.query_trigrams(rule.query))
    found = set(index.candidates(rule.query).tolist())
    assert {i for i, t in enumerate(texts) if any(rule.spans(t.decode()))} <= found and found


def test_decontamination_over_blocks_of_items(spark, docs, none):
    items = spark.createDataFrame([(1, ODD[-1]), (2, "sat on"), (3, None), (4, "?!"), (10, "null key with a text")], "item_id long, text string")
    one = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.scan_documents(docs, items).collect()}
    many = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.scan_documents(docs, items, most=1).collect()}
    assert one == many and (12, 18, 18, ("1", "2")) in one
    assert decontam.scan_documents(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.scan_documents(none, items).count() == 0


def test_quality_order_never_changes_a_verdict(docs, none):
    found = {tuple(r) for r in quality.apply_rules(docs).collect()}
    assert found == {tuple(r) for r in quality.apply_rules(docs, sample=[b"x" * 10, b"a b " * 99]).collect()}
    assert quality.passing(docs).columns == docs.columns and quality.apply_rules(none).count() == 0
    for order in itertools.permutations(quality.RULES):
        assert quality.rejected_by(b"a b c " * 100, order) is not None


def test_shards_are_contiguous_and_balanced(docs, rows, none):
    out = sharding.shard_by_bytes(docs, 4).collect()
    assert sorted(r["size"] for r in out) == sorted(len(t.encode()) + 1 for _, t in rows)
    spans = sorted((r.shard, r.slot) for r in out)
    assert [s for _, s in spans] == [i for _, g in itertools.groupby(spans, key=lambda x: x[0]) for i, _ in enumerate(g)]
    keys = [r.doc_id or -1 for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert keys == sorted(keys) and sharding.shard_by_bytes(none).count() == 0


def components(sets, percent):
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_components(spark, k, percent):
    rng = np.random.default_rng(k)
    bases = [[f"w{v}" for v in rng.integers(0, 400, n)] for n in (3, 4, 6, 9, 14, 30, 80, 200)]
    passage = [f"p{v}" for v in range(60)]
    texts = [None, "", " \n"]
    for base in [*bases, *(passage + [f"own{j}_{i}" for i in range(20)] for j in range(12))]:
        for changes in (0, 0, 1, 1, 2, 4, 9):
            words = list(base)
            for at in rng.integers(0, len(words), min(changes, len(words))):
                words[at] = f"c{rng.integers(0, 9)}"
            texts.append(" ".join(words).upper() if changes == 1 else "  ".join(words))
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngram_join.similarity_classes(df, k, percent).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == components(sets, percent)
    assert [r.n_shingles for r in found] == [len(s) for s in sets]


def test_segments_share_more_keys_than_their_slack():
    rng = np.random.default_rng(1)
    for percent in (80, 85, 95):
        table = ngram_join.bands(percent, 10_000)
        for n in (6, 9, 17, 60, 333, 1500):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                b = np.unique(np.concatenate([a[rng.integers(0, max(2, n // 5)) :], rng.integers(0, 2**63, rng.integers(0, n // 8 + 1)).astype(np.uint64)]))
                if ngram_join.similar(a, b, percent) and ngram_join.set_id(a) != ngram_join.set_id(b):
                    both = set(ngram_join.band_numbers(len(a), table, percent)) & set(ngram_join.band_numbers(len(b), table, percent))
                    keys = lambda s, i: set(ngram_join.segment_keys(s, table[i]).tolist())
                    assert any(len(keys(a, i) & keys(b, i)) > table[i].slack for i in both)


def test_line_dedup_cases(spark, none):
    line = "one two three four five six seven eight nine"
    changed, longer, other = line.replace("five", "5"), line + " ten", line.replace("five", "5").replace("six", "6")
    rows = [(1, f"{line}\nshort line\n\nshort line"), (2, f"{changed}\nkeep me\n{other}"), (3, longer), (4, None), (5, ""), (6, " " + line.replace(" ", "\t"))]
    df = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string")
    out = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(df).where("doc_id <> 4").collect())
    # two words apart: `other` is within one edit of `changed` alone, which is earlier
    want = [(1, f"{line}\nshort line\n", 1), (2, "keep me", 2), (3, "", 1), (3, "", 1), (5, "", 0), (6, "", 1)]
    assert out == want
    assert line_dedup.dedup_lines(df).where("doc_id = 4").first().text is None
    assert line_dedup.dedup_lines(none.select("doc_id", "text")).count() == 0
    clashing = df.selectExpr("doc_id", "1 as n_lines", "text", "2 as __hash", "3 as __key", "'x' as at", "4 as h1", "5 as words")
    again = line_dedup.dedup_lines(clashing).where("doc_id <> 4").collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in again) == want and {r["__key"] for r in again} == {3}


def test_toxicity_held_out(spark, docs, none):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(toxicity.examples(spark.read.parquet(f"{base}/documents.parquet"), labels))
    scored = toxicity.score(spark.read.parquet(f"{base}/documents.parquet"), model).join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    found = [(r.toxic, r.predicted) for r in scored.collect()]
    assert sum(p for t, p in found if not t) == 0
    assert sum(p for t, p in found if t) >= 0.7 * sum(t for t, _ in found)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs.select("doc_id", "text"), model).collect())
    blank = toxicity.fit(toxicity.examples(none, labels))
    assert toxicity.score(docs, blank).select("score").distinct().count() == 1


def test_factorization_machine_learns_a_pair():
    """Two terms that mean nothing alone and toxicity together: the linear weights alone can't tell."""
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        examples.append((np.array([t for t, on in ((1, a), (2, b), (3, 1)) if on]), int(a and b)))
    model = toxicity.fit(examples)
    score = lambda *t: model.sums(model.rows(np.array(t)), np.array([len(t)]))[2][0]
    assert score(1, 2, 3) > 0.7 and max(score(1, 3), score(2, 3), score(3)) < 0.5


def test_licenses(docs, none):
    known = licenses.Templates(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        body = f"é {template} ü"
        found = licenses.find_licenses(body.encode(), known)
        assert [(f[0], body[f[3] : f[4]].strip('".')) for f in found] == [(name, template.strip('".'))] or name in ("Apache-2.0", "GPL-3.0")
        assert found and found[0][1] == found[0][2]
    mit = licenses.TEMPLATES["MIT"].replace("free of charge", "gratis").replace("merge, ", "")
    (report,) = licenses.find_licenses(mit.encode(), known)
    assert report[0] == "MIT" and report[1] == report[2] - 4
    assert licenses.find_licenses(b"the license of this document is in the software", known) == []
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0
