"""BPE encoding and decoding (operator 7): segment trees over adjacent pair ranks (see ``merges``)."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_text, take, texts_of
from .merges import MergeTable

SPACE = r"\t-\r \x85\xa0  -     　"
#: A text falls into chunks that encode independently of each other: a word with the space before it, or white space.
BYTE_CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BYTE_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_CHUNK = re.compile(rf"[^{SPACE}]+")
WORD_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]")
#: Bytes of the chunks that a worker remembers, 160 for each besides its own; beyond it what is older goes. It bounds memory, not
#: what is encoded.
MEMORY = 96 << 20


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file: of the installed package, else in ``$TOKENIZERS_DIR``."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def latin(text: str) -> bool:
    """Whether all characters are of Latin-1, whose lower case is a table and which has nothing to compose."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """Encodes and decodes whole texts with the tokenizer file at ``path``."""

    def __init__(self, path: str):
        self.path = path
        self.table = MergeTable(path)
        self.words = bool(self.table.end)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True))) + ")")
        self.special = {k: v.to_bytes(4, "little") for k, v in self.table.special.items()}
        self.library = None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunked = [self._chunks(t) for t in texts]
        new = set()
        for chunks in chunked:
            new.update(chunks)
        if self.held > MEMORY:  # what was met since the last time stays, and of what is older what is met again
            self.older, self.memory, self.held = self.memory, {}, 0
        memory, older = self.memory, self.older
        fresh = [c for c in new if c not in memory]
        memory.update([(c, older[c]) for c in fresh if c in older])
        self._learn([c for c in fresh if c not in older])
        self.held += 160 * len(fresh) + sum(map(len, fresh)) + sum(map(len, map(memory.__getitem__, fresh)))
        return [b"".join(map(memory.__getitem__, chunks)) for chunks in chunked]

    def _chunks(self, text: str) -> list[str]:
        if "<|" in text:
            out = []
            for i, part in enumerate(self.split.split(text)):
                out.extend([part] if i % 2 else self._plain(part))
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not self.words:
            return BYTE_CHUNK.findall(text)
        if not latin(text):  # letters beyond Latin-1 may compose or change case in ways that depend on their neighbours
            return WORD_CHUNK.findall(text)
        for c in "\t\n\x0b\x0c\r\x85\xa0":
            if c in text:
                text = text.replace(c, " ")
        return text.lower().split(" ")

    def _learn(self, chunks: list[str]) -> None:
        memory, words = self.memory, self.words
        plain, letters, ended = [], [], []
        for c in chunks:
            word = c if words else c.removeprefix(" ")
            if words and not c.isascii() and not latin(c):
                memory[c] = self.special[c] if c in self.special else self._by_library(c)
            elif word.isalpha():  # one piece
                letters.append(c)
            elif word[:-1].isalpha():  # letters and another sign are two
                ended.append(c)
            elif c in self.special:
                memory[c] = self.special[c]
            elif not c:
                memory[c] = b""
            else:
                plain.append(c)
        memory.update(zip(letters, self.table.encode([(c.lower() if words else c).encode() for c in letters])))
        if words:
            # one search over all chunks; the line feed, which no chunk holds, ends each
            found = iter(WORD_PIECE.findall("\n".join(plain).lower() + "\n")) if plain else iter(())
            parts = [list(iter(found.__next__, "\n")) for _ in plain]
            heads, tails = [c[:-1].lower() for c in ended], [c[-1].lower() for c in ended]
        else:
            parts = [BYTE_PIECE.findall(c) for c in plain]
            heads, tails = [c[:-1] for c in ended], [c[-1] for c in ended]
        needed = {*heads, *tails, *chain.from_iterable(parts)}
        known = {p: memory[p] for p in needed if p in memory}
        fresh = [p for p in needed if p not in known]
        known.update(zip(fresh, self.table.encode([p.encode() for p in fresh])))
        of = known.__getitem__
        memory.update(zip(ended, map(add, map(of, heads), map(of, tails))))
        memory.update([(c, b"".join(map(of, pieces))) for c, pieces in zip(plain, parts)])

    def _by_library(self, chunk: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        ids = self.library.encode(chunk, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids in that form; bytes that are not UTF-8 become U+FFFD."""
        tokens = self.table.token_bytes
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<long>`` of each whole text (null: no ids). One narrow pass, no shuffle."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    d = take(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "ids": [memoryview(x).cast("I").tolist() for x in codec(path).encode(texts_of(batch, text_col))]}

    return over_text(d, text_col, f"{id_col} {d.dtypes[0][1]}, ids array<bigint>", run, max_bytes=4 << 20)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with ids; null ids give an empty text."""
    import numpy as np

    path = path or tokenizer_path("byte_bpe_50k.json")
    d = take(rows, id_col, ids_col).select(id_col, F.to_json(F.coalesce(ids_col, F.array().cast("array<bigint>"))).alias("ids"))

    def run(batch: pa.RecordBatch) -> dict:
        import json

        return {id_col: batch.column(0), "text": [codec(path).decode(np.array(json.loads(x), "<u4").tobytes()) for x in batch.column(1).to_pylist()]}

    return over_text(d, "ids", f"{id_col} {d.dtypes[0][1]}, text string", run)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty texts have no tokens and decode to an empty text; repeated rows give repeated results; other
    columns, whatever their names, are not read. ``<|endoftext|>`` in a text is that token, as in the library.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    d = take(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = c.encode(texts_of(batch, text_col))
        return {
            id_col: batch.column(0),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids],
        }

    return over_text(d, text_col, f"{id_col} {d.dtypes[0][1]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run, max_bytes=4 << 20)
