"""Every kind of secret: the scan through the trigram index against each rule's pattern run over each whole text."""

import numpy as np

from lodemap.llm import secret_scan

HITS = [
    'password = "abcdefgh1"', "API_KEY:abcdefgh9", "AKIA" + "Z" * 16, "0f" * 16, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890ab",
    "AIza" + "x" * 35, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "ftp://me:pass1@host", "-----BEGIN PRIVATE KEY-----", "gho_" + "Z9" * 18,
]


def test_the_index_loses_no_span():
    rng = np.random.default_rng(6)
    texts = ["", "é" * 50]
    for _ in range(300):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            hit = str(rng.choice(HITS))
            cut = int(rng.integers(0, len(hit)))
            hit = (hit, hit[cut:], hit[:cut], hit.upper(), hit.swapcase(), hit[:cut] + "é" + hit[cut:], hit + hit)[int(rng.integers(0, 7))]
            parts += ["word " * int(rng.integers(0, 4)), hit, " \n\t-,"[int(rng.integers(0, 5))]]
        texts.append("".join(parts))
    want = [sorted(((a, b, k) for k, r in enumerate(secret_scan.RULES) for a, b in r.spans(t)), key=lambda s: (s[0], s[2])) for t in texts]
    assert secret_scan.find_secrets([t.encode() for t in texts]) == want
    assert {secret_scan.RULES[k].kind for x in want for _, _, k in x} == {r.kind for r in secret_scan.RULES}
