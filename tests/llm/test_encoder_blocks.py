import random

import public_tokenizers
import pyarrow as pa
import pytest

from lodemap.llm import token_files


class Counted(dict):
    """A dict that counts how often all its keys are gone over."""

    passes = 0

    def keys(self):
        Counted.passes += 1
        return super().keys()


@pytest.mark.parametrize("remembered", [60, 1_000_000])
@pytest.mark.parametrize("as_text", [False, True])
def test_blocks_have_the_ids_of_the_library(monkeypatch, remembered, as_text):
    """Blocks that share words, with other white space, added tokens, nulls and empty texts, however much is remembered."""
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = token_files.LibraryEncoder(file.read(), added_as_text=as_text)
    draw = random.Random(1)
    letters = [*"ab Z9 .,'s\n\t  é漢🙂", "<|endoftext|>", " ", "  ", "'ll", "new"]
    texts = ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(900)] + ["", " ", "  ", "a", "a ", " b c", None]
    whole = encoder._whole([t or "" for t in texts])
    column = pa.array(texts, pa.string())
    assert [x for at in range(0, len(texts), 200) for x in encoder.encode_column(column.slice(at, 200))] == whole
    assert encoder.encode([t or "" for t in texts]) == whole and encoder.encode([]) == []


def test_a_block_does_not_go_over_all_that_is_remembered():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = token_files.LibraryEncoder(file.read())
    encoder.encode(["one two three"])
    encoder.known = Counted(encoder.known)
    Counted.passes = 0
    encoder.encode(["one two four"])
    assert Counted.passes == 0
