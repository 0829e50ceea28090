import random
import re

import pytest

from drawgraph.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(marked), failed


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["é#", "a|b", "𝒳<"]
    out = [(0, None), (1, ""), (2, " \n\t\x0b\r "), (3, "one"), (4, "  x"), (5, "same line\nsame line\n\n \n")]
    for i in range(6, 60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            words = words + words[: rng.randint(5, 30)] + words
        if i % 7 == 0:
            words = ["x"] * rng.randint(7, 60)
        out.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)))
    out += [out[-1], (None, "a b c " * 20)]
    return out


def test_counts_match_brute_force(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    trusted = spark.createDataFrame([(8,), (9,), (10,), (11,)], "doc_id long")
    got = quality.judge(df, trusted).collect()
    assert len(got) == len(docs)
    want = sorted((d if d is not None else -1, *brute(t)) for d, t in docs)
    have = sorted(
        (r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in got
    )
    assert have == want
    assert not any(r.kept for r in got if r.base_failed)


def test_ratio_tells_trusted_prose_from_noise(spark):
    rng = random.Random(2)
    prose = [f"p{i}" for i in range(300)]
    noise = [f"n{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(prose if i % 4 else noise) for _ in range(80))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(200) if i % 4], "doc_id long")
    got = quality.judge(df, trusted).collect()
    held_out = [r for r in got if r.doc_id >= 200]
    right = sum(r.kept == bool(r.doc_id % 4) for r in held_out)
    assert right / len(held_out) >= 0.95


def test_no_labels_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long")
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v", 3, 4)], "doc_id long, text string, _w int, score int")
    row = quality.judge(df, none, keep=("_w",)).collect()[0]
    assert row.kept and row._w == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty, none).collect() == []


def test_trusted_ids_skips_nulls_and_toxic(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, None), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"
    )
    assert sorted(r.doc_id for r in quality.trusted_ids(labels).collect()) == [1, 4]
