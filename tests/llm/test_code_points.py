"""The ids of every code point, beside letters, digits and spaces, against the libraries themselves."""

import base64
from array import array

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodemap.llm import bpe, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chunks = [every[i : i + 20_000] for i in range(0, len(every), 20_000)]
    return [x.join(c) for c in chunks for x in ("a", "1 ", ".")] + ["a <|endoftext|> x", "<|endoftext|>", "<|endoftext"]


def test_ids_as_tiktoken_has_them(texts):
    with open(RANKS, "rb") as file:
        data = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.BytePairCoder(data, public_tokenizers.PATTERN)
    for text in texts:
        (found,) = coder.encode([text])
        assert found == library.encode_ordinary(text)
        assert coder.decode(found) == text.encode()


def test_ids_as_tokenizers_has_them(texts):
    library = Tokenizer.from_file(JSON)
    with open(JSON, encoding="utf-8") as file:
        definition = file.read()
    for as_text in (False, True):
        encoder = token_files.LibraryEncoder(definition, added_as_text=as_text)
        library.encode_special_tokens = as_text
        for text, found in zip(texts[-12:] if as_text else texts, encoder.encode(texts[-12:] if as_text else texts), strict=True):
            assert found == array(encoder.kind, library.encode(text, add_special_tokens=False).ids).tobytes()
