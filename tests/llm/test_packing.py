import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from drawgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs():
    base = ["It's the end, of the WORLD!", "É́ H̱ K ſ İ ẞ Σς", "a b c <|endoftext|> x<|startoftext|>y", "   ", "日本語 text 12345", "", None]
    base += ["́ lone mark ́x", "word " * 5000, "l'été aujourd'hui we'll don't I'm", "<|ENDOFTEXT|> \x0b\x0c\r\n\t x", "\x1c\x85 odd   spaces﻿", "a\u0000b"]
    rows = [(i, t, 1) for i, t in enumerate(base)]
    rows += [(100 + i, f"some text number {i} " * (i % 90), 1) for i in range(400)]
    rows += [rows[0], (None, "null id", 1)]
    return rows


def test_pieces_hold_the_tokenizers_ids_and_pack_without_gaps(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, length int")
    got = packing.pack(df, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, t, _ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((-1 if d is None else d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(w[3] for w in want)
    assert len(by) <= 1.05 * total / 4096 + 2


def test_small_cache_changes_nothing(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    words = packing.WordIds(PATH)
    texts = [f"alpha{i % 7} beta{i}, gamma" for i in range(50)]
    for i in range(0, 50, 5):
        for raw, t in zip(words.encode([t.encode() for t in texts[i : i + 5]]), texts[i : i + 5], strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_each_step_is_least_in_squares():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 21, 300)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    level = {}
    for i in np.argsort(-lengths, kind="stable"):
        def cost(b):
            after = dict(level)
            after[b] = after.get(b, 0) + lengths[i]
            count = defaultdict(int)
            for v in after.values():
                if v < 20:
                    count[v] += 1
            return sum(c * c for c in count.values())

        options = {b: cost(b) for b, v in level.items() if v + lengths[i] <= 20} | {len(level): cost(len(level))}
        assert options[bins[i]] == min(options.values())
        assert offsets[i] == level.get(bins[i], 0)
        level[bins[i]] = level.get(bins[i], 0) + lengths[i]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
