"""Token-id files: every document compressed by itself with one shared zstandard dictionary, and an index for direct access."""

from __future__ import annotations

import gc
import hashlib
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BLOCK_CHARS, blocks, mapped, new_folder, sampled, spread
from .pieces import Cutter

#: A tokenizer file of more bytes isn't sent to the executors.
TOKENIZER_BYTES = 64_000_000
#: Words whose ids a worker remembers in each of two generations.
REMEMBERED = 1_000_000
#: Bytes of the shared dictionary, and documents of the sample it is trained on.
DICTIONARY_BYTES, DICTIONARY_DOCS = 32_768, 500
LEVEL = 1

MAGIC = b"LODEMTK1"
#: magic, bytes of an id, documents, bytes of the dictionary, its SHA-256
HEAD = struct.Struct("<8sBxxxQI32s")
#: where the index begins, magic
FOOT = struct.Struct("<Q8s")

# --- encoding ----------------------------------------------------------------------------------------------------------


class LibraryEncoder:
    """The tokenizers library over whole texts, remembering words.

    A byte-level tokenizer with its usual pattern, no normaliser and no prefix space never joins what stands before a single
    space with what follows it, unless white space follows. So such texts are cut before their spaces, each distinct piece
    goes through the library's model once while it is remembered, and the ids of a text are those of its
    words in a row. Only a block's distinct words become Python objects; their ids are put in a row by place. Texts with other white space behind a space, those with an added token of the tokenizer (one id to the
    library, unless ``added_as_text``), and all texts of other tokenizers, go through it whole.
    """

    def __init__(self, definition: str, known: dict[str, bytes | None] | None = None, added_as_text: bool = False):
        if sys.byteorder != "little":
            raise NotImplementedError("ids are kept in the machine's order, which the files need to be little-endian")
        self.definition = definition
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = added_as_text
        self.added = [] if added_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        before = repr(self.tokenizer.pre_tokenizer)
        self.by_words = (
            self.tokenizer.normalizer is None
            and before.startswith("ByteLevel(")
            and "add_prefix_space=False" in before
            and "use_regex=True" in before
        )
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}  # without a space before them
        self.cut = Cutter(_PIECES)
        self.known: dict[str, bytes | None] = known or {}  # with one
        self.older: dict[str, bytes | None] = {}

    def __reduce__(self):
        return LibraryEncoder, (self.definition, self.known, self.tokenizer.encode_special_tokens)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.kind, e.ids).tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``width`` bytes."""
        return self.encode_column(pa.array(texts, pa.large_string())) if self.by_words else self._whole(texts)

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """As ``encode``, of a string column; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_words or not len(texts):
            return self._whole(texts.to_pylist())
        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy().copy()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), ends[:-1]  # every text has a first word, maybe an empty one
        firsts = [words[i] for i in which[at].tolist()]
        which[at] = np.arange(len(words), len(words) + len(texts))
        used = (np.bincount(which, minlength=len(words))[: len(words)] > 0).tolist()
        found = list(map(self.known.get, words, repeat(_NEW)))
        new = [i for i, x in enumerate(found) if x is _NEW and used[i]]
        for i, x in zip(new, self._learnt([words[i] for i in new]), strict=True):
            found[i] = x
        alone = np.array([x is None for x in found] + [False] * len(texts))  # words that have no ids by themselves
        found = [b"" if x is None or x is _NEW else x for x in found] + self._whole(firsts)
        pool = np.frombuffer(b"".join(found), f"u{self.width}")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        after = np.cumsum(lengths)
        raw = pool[np.repeat(starts[which] - after + lengths, lengths) + np.arange(after[-1])].tobytes()
        bounds = (np.concatenate([[0], after])[ends] * self.width).tolist()
        out = [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        odd = np.add.reduceat(alone[which], at, dtype=np.int64) > 0
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd)
        for i, x in zip(whole.tolist(), self._whole(texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = x
        return out

    def _learnt(self, words: list[str]) -> list[bytes | None]:
        """The ids of distinct words that aren't known; they are then."""
        if len(self.known) + len(words) > REMEMBERED:  # what no block asks for until the next time is forgotten then
            self.older, self.known = self.known, {}
        if len(self.pieces) > REMEMBERED // 4:
            self.pieces = {}
        out = list(map(self.older.get, words, repeat(_NEW)))
        collecting = gc.isenabled()
        gc.disable()  # short-lived tokens by the hundred thousand, none in a cycle
        try:
            for i, word in enumerate(words):
                if out[i] is _NEW:
                    out[i] = self._word(word)
        finally:
            if collecting:
                gc.enable()
        self.known.update(zip(words, out, strict=True))
        return out

    def _word(self, word: str) -> bytes | None:
        """The ids of a space and a word. Letters alone are one piece for the model, and a mark behind them is another; the
        pattern cuts whatever else there is."""
        if not word or word[0].isspace():  # the space before it belongs to other white space
            return None
        if word.isalpha():
            return self._model(" " + word)
        letters = word[:-1]
        if word[-1] in _MARKS and letters.isalpha():
            return self._spaced(letters) + self._bare(word[-1])
        first, *rest = self.cut(" " + word)
        return b"".join(chain((self._spaced(first[1:]),), map(self._bare, rest)))

    def _spaced(self, piece: str) -> bytes:
        """The ids of a space and a piece, as the pattern cuts one, which is a word by itself too."""
        found = self.known.get(piece) or self.older.get(piece)
        if found is None:
            found = self.known[piece] = self._model(" " + piece)
        return found

    def _bare(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self._model(piece)
        return found

    def _model(self, piece: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(_written(piece))]).tobytes()


#: Stands for the ids of a word that isn't known.
_NEW = b"new"
#: ASCII marks that are neither letters, digits nor white space, and that byte-level tokenizers write as themselves.
_MARKS = frozenset(".,;:!?\"'()[]{}")
#: Fixed value: the pattern by which byte-level tokenizers cut.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others as letters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_WRITTEN = _byte_letters()
#: Bytes that are written as themselves in any piece.
_PLAIN = frozenset(chr(b) for b, c in _WRITTEN.items() if b < 0x80 and ord(c) == b)


def _written(piece: str) -> str:
    """A piece as byte-level tokenizers write it."""
    body = piece[1:]
    if piece.isascii() and (body.isalnum() or _PLAIN.issuperset(body)):
        return _WRITTEN[ord(piece[0])] + body
    return "".join(map(_WRITTEN.__getitem__, piece.encode()))


# --- files -------------------------------------------------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for short id arrays, or no bytes where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Writes one file under a name of its own and moves it to its place when it is whole."""

    def __init__(self, uri: str, width: int, dictionary: bytes):
        self.fs, self.path = open_uri(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.width, self.dictionary = width, dictionary
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False)
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.ends: list[int] = []
        self.at = HEAD.size + len(dictionary)
        # the count of documents is known at the end only, so the head says 0 and the index has it
        self.out.write(HEAD.pack(MAGIC, width, 0, len(dictionary), hashlib.sha256(dictionary).digest()) + dictionary)

    def add(self, key: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.out.write(frame)
        self.at += len(frame)
        self.keys.append(key)
        self.sizes.append(len(ids) // self.width)
        self.ends.append(self.at)

    def close(self) -> None:
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        index = [struct.pack("<Q", len(self.keys)), known.tobytes(), keys.tobytes()]
        index += [np.array(self.sizes, "<u8").tobytes(), np.array(self.ends, "<u8").tobytes(), FOOT.pack(self.at, MAGIC)]
        self.out.write(b"".join(index))
        self.out.close()
        self.fs.move(self.part, self.path)


class TokenFile:
    """Reads documents of a file, each by itself."""

    def __init__(self, uri: str):
        where, path = open_uri(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        magic, self.width, _, length, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        start, foot = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or foot != MAGIC:
            raise ValueError(f"{uri} is no token file")
        dictionary = self.file.read_at(length, HEAD.size)
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{uri}: its dictionary isn't the one it was written with")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        index = self.file.read_at(size - FOOT.size - start, start)
        (n,) = struct.unpack_from("<Q", index)
        self.known = np.frombuffer(index, np.uint8, n, 8)
        self.keys, self.sizes, self.ends = (np.frombuffer(index, k, n, 8 + n * o) for k, o in (("<i8", 1), ("<u8", 9), ("<u8", 17)))
        self.first = HEAD.size + length

    def __len__(self) -> int:
        return len(self.keys)

    def key(self, i: int) -> int | None:
        return int(self.keys[i]) if self.known[i] else None

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document: one range of the file is read and one frame opened."""
        begin = int(self.ends[i - 1]) if i else self.first
        raw = self.unpack.decompress(self.file.read_at(int(self.ends[i]) - begin, begin))
        return np.frombuffer(raw, f"<u{self.width}")


# --- DataFrames --------------------------------------------------------------------------------------------------------


def _encoder(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        definition = file.read(TOKENIZER_BYTES + 1)
    if len(definition) > TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {TOKENIZER_BYTES} characters")
    return definition


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 0, key: str = "doc_id", text: str = "text"
) -> list[dict]:
    """Encodes every whole text, appends ``end_id``, and writes the ids in ascending order of the integer ``key``.

    Returns the manifest, a row for each file in that order: path, docs, tokens. The dictionary is trained on the ids of a
    bounded sample (``DICTIONARY_DOCS`` rows); every document is written whatever the sample. Null and empty texts have the
    end id alone; a null key comes first; equal keys are ordered by text; other columns are ignored; an empty table writes
    no file. A task that runs again writes the same bytes to the same place.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    encoder = LibraryEncoder(_encoder(tokenizer))
    tail = b"" if end_id is None else array(encoder.kind, [end_id]).tobytes()
    sample = [b.decode() for b in sampled(docs, key, text, DICTIONARY_DOCS)]
    dictionary = train_dictionary([x + tail for x in encoder.encode(sample)])
    shared: Broadcast = spark.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = TaskContext.get().partitionId()
        path, writer, tokens = f"{folder}/part-{number:06d}.lodetk", None, 0
        for block in blocks(batches, "__text", 2 * BLOCK_CHARS):  # fewer blocks ask for a word anew
            writer = writer or TokenFileWriter(path, own.width, dictionary)
            for who, ids in zip(block.column(0).to_pylist(), own.encode_column(block.column(1)), strict=True):
                writer.add(who, ids + tail)
                tokens += (len(ids) + len(tail)) // own.width
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [number], "path": [path], "docs": [len(writer.keys)], "tokens": [tokens]})

    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    # equal keys may share one range, so the text's hash takes part in the cut
    order = [F.col("__key").asc_nulls_first(), F.xxhash64("__text"), F.col("__text")]
    placed = rows.repartitionByRange(spread(docs), *order[:2]).sortWithinPartitions(*order)
    written = mapped(placed, run, "part long, path string, docs long, tokens long").collect()  # a row for each partition
    return [r.asDict() for r in sorted(written, key=lambda r: r["part"])]


def read_token_files(docs: DataFrame, manifest: list[dict], key: str = "doc_id") -> DataFrame:
    """Reads files back: key, start (ids of all documents before), n_tokens and ids_crc32 (of the ids as unsigned 32-bit
    little-endian integers). A task for each file; a document is opened by itself. ``docs`` gives the session alone."""
    spark = docs.sparkSession
    rows, start = [], 0
    for m in manifest:
        rows.append((m["path"], start))
        start += m["tokens"]
    files = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(path)
                for at in range(0, len(file), 4096):
                    part = range(at, min(at + 4096, len(file)))
                    ids = [file.ids(i) for i in part]
                    sizes = [len(x) for x in ids]
                    ends = first + np.cumsum(sizes, dtype=np.int64)
                    columns = {
                        "__key": pa.array([file.key(i) for i in part], pa.int64()),
                        "start": pa.array(ends - sizes, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    }
                    first = int(ends[-1])
                    yield pa.RecordBatch.from_pydict(columns)

    out = mapped(files, run, "__key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("__key", key)
