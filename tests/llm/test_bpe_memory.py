import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from lodemap.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_words_that_come_again_are_merged_once(monkeypatch):
    """A full memory forgets words that came once, not those that earlier blocks have shared; ids stay those of the library."""
    monkeypatch.setattr(bpe, "REMEMBERED", 60 * bpe.EACH)
    with open(RANKS, "rb") as file:
        coder = bpe.BytePairCoder(file.read(), public_tokenizers.PATTERN)
    merged = []
    merge = coder.merge
    monkeypatch.setattr(coder, "merge", lambda piece: merged.append(piece) or merge(piece))
    common = [f"qzj{a}xv" for a in "abcdefgh"]
    blocks = [[" ".join(["x", *(common if n % 2 or not n else common[:4]), *(f"wq{chr(97 + n)}{chr(97 + m)}zk" for m in range(20))])] for n in range(12)]
    found = [ids for block in blocks for ids in coder.encode(block)]
    ranks = load_tiktoken_bpe(RANKS)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert found == [library.encode_ordinary(text) for (text,) in blocks]
    assert [merged.count(f" {word}".encode()) for word in common] == [1] * len(common)
    assert coder.held <= bpe.REMEMBERED


def test_long_pieces_and_ties_are_merged_as_the_library_does():
    with open(RANKS, "rb") as file:
        coder = bpe.BytePairCoder(file.read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    texts = ["a" * 70_001, "ab" * 300, "é" * 129, "tion" * 64, "漢字" * 50, "-" * 255, "x"]
    assert list(coder.encode(texts)) == [library.encode_ordinary(t) for t in texts]
