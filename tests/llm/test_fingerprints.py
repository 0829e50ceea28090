import hashlib
import random

from drawgraph.llm import fingerprints as fp


def brute(rows):
    import xxhash

    def key(r):
        h = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
        return (r[0] is None, -(r[0] or 0), -(h - (1 << 64) if h >> 63 else h))

    rows = sorted(rows, key=key)
    out = []
    for k, (d, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.write(*fp.tree(t)), fp.write(*fp.tree(edited))))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(6)
    words = ["alpha", "is", "cook", "é", "𝒳y", "of", "sums"]
    rows = [(i * 3, "".join(rng.choice(words) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(0, 120)))) for i in range(200)]
    rows += [(9, None), (9, "dup"), (9, "dup"), (None, "no id"), (-5, ""), (1000, "x" * 10001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:5] for r in fp.fingerprint(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_likeness_and_edits():
    text = "".join(f"line {i} has some words, and sums of things.\n" for i in range(60))
    a = fp.tree(text)
    assert fp.likeness(a, fp.tree(text)) == 1.0 and fp.read(fp.write(*a)) == a
    changed = text.replace("line 30 has", "line thirty holds")
    b = fp.tree(changed)
    assert a[0] != b[0] and 0.9 < fp.likeness(a, b) < 1.0 and fp.likeness(a, b) == fp.likeness(b, a)
    spans = fp.edits(fp.write(*a), fp.write(*b))
    at = text.index("line 30")
    assert spans and min(s for s, _ in spans) <= at + 5 <= max(e for _, e in spans) and sum(e - s for s, e in spans) < 120
    assert fp.likeness(a, fp.tree("nothing alike here")) == 0.0
    assert fp.likeness(fp.tree(""), fp.tree("")) == 1.0 and fp.likeness(fp.tree(""), a) == 0.0
    assert fp.tree("a\n")[0] != fp.tree("a")[0] != fp.tree("\na")[0]


def test_half_edited_is_near_half_and_single_row_is_its_own_next(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    rows = [(i, "\n".join(" ".join(word() for _ in range(40)) for _ in range(20))) for i in range(30)]
    for r in fp.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.4 < r.near_edited < 0.6 and r.near_next < 0.1
    one = fp.fingerprint(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.fingerprint(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_half_of_any_script_is_found_again():
    """Texts of 300 characters and more, of every language of the documents, and without blanks, share their first half."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    rng = random.Random(2)
    cases = [(r["lang"], r["text"]) for r in rows if r["text"] and len(r["text"]) >= 300]
    cases += [("cjk", "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(600))) for _ in range(40)]
    cases += [("base64", "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(900))) for _ in range(40)]
    found = {}
    for k, (lang, text) in enumerate(cases):
        half = len(text) // 2
        edited = text[: len(text) - half] + cases[k - 1][1][:half].ljust(half, "~")
        found.setdefault(lang, []).append(fp.likeness(fp.tree(text), fp.tree(edited)))
    for lang, likes in found.items():
        likes.sort()
        assert likes[len(likes) // 50] > 0.3 and 0.42 < sum(likes) / len(likes) < 0.62, (lang, likes[:5], sum(likes) / len(likes))
    assert all(n <= fp.LONGEST for _, n in [leaf for s in fp.tree("é" * 5000)[1] for p in s[2] for leaf in p[2]])


def test_string_ids_long_texts_and_extra_columns(spark):
    rows = [(f"id{i:04d}", "w" * i, "h", i) for i in range(500)] + [("long", "word " * 200_000, None, None), (None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, h string, range int")
    got = {r.doc_id: r for r in fp.fingerprint(df).collect()}
    assert len(got) == 502 and got["long"].n_chars == 1_000_000
    # descending ids: 'long' first, then id0499 down to id0000, null last
    assert got["id0007"].edited_sha256 == hashlib.sha256(("w" * 4 + "w" * 3).encode()).hexdigest()
    assert got["long"].edited_sha256 == hashlib.sha256((rows[500][1][:500_000] + "w" * 499).encode()).hexdigest()
