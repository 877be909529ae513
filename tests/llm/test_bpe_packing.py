import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe, packing
from tests.llm.cases import empty_docs, odd_docs

ALPHABET = [*"ab'sté Éßñ  \n\t\r\x1c\x85\xa0İſKΣςé́😀9²½,.<>| 中", "<|endoftext|>", "<|startoftext|>", "'ll", "'S", "ﬁ", " "]
FUZZ = ["".join(random.Random(k).choices(ALPHABET, k=k % 70)) for k in range(700)] + ["", "a" * 3000, " " * 300 + "x", "ab" * 900]


def library(name):
    t = Tokenizer.from_file(bpe.tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    c, t = bpe.Codec(bpe.tokenizer_path(name)), library(name)
    for text, ids in zip(FUZZ, c.encode(FUZZ)):
        want = t.encode(text, add_special_tokens=False).ids
        assert memoryview(ids).cast("I").tolist() == want, text
        if name.startswith("byte"):
            assert c.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_trees_agree():
    table = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.json")).table
    words = ["".join(random.Random(k).choices("thenaiouxr", k=1 + k % 60)).encode() for k in range(400)]
    for w, ids in zip(words, table.encode(words)):
        assert memoryview(ids).cast("I").tolist() == table.encode_long(w)


def test_pieces_of_every_size_with_zero_bytes():
    table = bpe.codec(bpe.tokenizer_path("word_bpe_49k.json")).table
    pieces = [b"", *(b"th\0en\0"[:n] * (n > 0) + b"\0" * max(0, n - 6) for n in range(1, 70)), *(b"a" * n for n in range(1, 70))]
    assert [memoryview(x).cast("I").tolist() for x in table.encode(pieces)] == [table.encode_long(p) for p in pieces]
    assert table.encode([]) == []


def test_plain_words_are_not_examined_one_by_one(monkeypatch):
    asked = []
    plain = bpe.latin
    monkeypatch.setattr(bpe, "latin", lambda t: asked.append(t) or plain(t))
    text = " ".join(f"w{k}x word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}," for k in range(100))
    c = bpe.Codec(bpe.tokenizer_path("word_bpe_49k.json"))
    assert memoryview(c.encode([text])[0]).cast("I").tolist() == library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids
    assert asked == [text]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 1000)
    c = bpe.Codec(bpe.tokenizer_path("byte_bpe_50k.json"))
    first = c.encode(["one two three four five six seven"])
    assert c.encode(["one two three four five six seven"]) == first and c.held > 1000
    assert len(c.encode(["x" * 5000 + " six"])[0]) > 0 and set(c.memory) == {"x" * 5000, " six"}
    assert len(c.older) == 7 and c.encode(["y"]) and " six" in c.older and len(c.older) == 2


def test_round_trip_of_odd_rows(spark):
    docs = odd_docs(spark)
    t = library("byte_bpe_50k.json")
    rows = bpe.round_trip(docs).collect()
    assert len(rows) == docs.count()
    texts = {(r.doc_id, r.text) for r in docs.toDF(*docs.columns[:5], "other", "score", "block").collect()}
    want = set()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {tuple(r) for r in rows} == want
    assert bpe.round_trip(empty_docs(spark)).count() == 0


def test_encode_and_decode_tables(spark):
    docs = spark.createDataFrame([(1, "hello  world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert got == {1: "hello  world", 2: ""}


def brute_best_fit(lengths, window):
    rooms, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(r, w) for w, r in enumerate(rooms) if r >= lengths[i]]
        if fits:
            room, w = min(fits)
        else:
            rooms.append(window)
            room, w = window, len(rooms) - 1
        out[i] = window - room
        rooms[w] -= lengths[i]
    return len(rooms), out


def test_best_fit_decreasing_is_best_fit():
    for seed in range(30):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        places = packing.best_fit_decreasing(lengths, 40)
        n, _ = brute_best_fit(lengths, 40)
        assert 1 + max(w for w, _ in places) == n
        used = {}
        for length, (w, offset) in sorted(zip(lengths, places), key=lambda x: x[1]):
            assert used.get(w, 0) == offset
            used[w] = offset + length
        assert max(used.values()) <= 40


def test_plan_of_counts_is_that_of_the_list():
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [rng.choice([1, 2, 3, 7, 19, 20, 21, 40]) for _ in range(rng.randint(0, 200))]
        rows = packing.plan(Counter(lengths), 40)
        windows = packing.best_fit_decreasing(lengths, 40)
        assert len({w for w, _ in windows}) == (brute_best_fit(lengths, 40)[0] if lengths else 0)
        assert len(rows) <= 4 * len(set(lengths)) + 8


def test_windows_do_not_depend_on_partitions_and_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = []
    for n in (1, 16, 200):
        rows = packing.pack(docs.repartition(n)).collect()
        seen.append(sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in rows))
        windows = 1 + max(r.sequence_id for r in rows)
        assert len({r.sequence_id for r in rows}) == windows
        assert sum(r.length for r in rows) > 0.99 * 4096 * (windows - 1), n
    assert seen[0] == seen[1] == seen[2]


def test_packing_of_odd_rows(spark):
    docs, t = odd_docs(spark), library("word_bpe_49k.json")
    rows = packing.pack(docs, window=64, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in [(r[0], r[1]) for r in docs.collect()]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert any(len(ids) == n for (k, n) in by_doc if k == i)
        pieces = sorted({(r.start, tuple(r.ids)) for r in by_doc[i, len(ids)]})
        assert sum((list(p) for _, p in pieces), []) == ids
    assert packing.pack(empty_docs(spark)).count() == 0
