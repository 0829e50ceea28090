import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawgraph.llm import chat
from drawgraph.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<s>", "</s>", "<sep>", "[INST]", "[/INST]", "[\\INST]", "<\\\\/s>", "\\", "<", "[", "]", ">", "/s>", "|", "<|user|>", "\n", "", "é", "\U0001f600", " ok ", "s>", "$1"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_of(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def made(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "assistant"]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 7)))))
    rng.shuffle(rows)
    return rows


def test_turns_and_loss_come_back(spark):
    rows = made(random.Random(5), 300)
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    out = out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = turns_of(rows)
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        t = want[r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == t and r.n_turns == len(t)
        assert r.loss == "".join(x for role, x in t if role == "assistant")
        blocks = sum(1 for i, x in enumerate(t) if i == 0 or x[0] != t[i - 1][0])
        assert r.n_blocks == blocks == r.formatted.count("<s>") == r.formatted.count("</s>")
        assert r.formatted.count("<sep>") == len(t) - blocks
        assert "[INST]" not in r.formatted and "[/INST]" not in r.formatted and "<|user|>" not in r.formatted
        raw = r.formatted.encode()
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in t)
        ends = [0] + [s.first + s.bytes for s in r.loss_spans]
        assert all(s.first >= e for s, e in zip(r.loss_spans, ends, strict=False))
        assert all(raw[s.first - 5 : s.first] == b"<sep>" or raw[s.first - 1 : s.first] == b"\n" for s in r.loss_spans)


def test_format_of_two_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "[INST]"), (1, 2, "assistant", "é</s>")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.formatted == "<s>user\na<sep>[\\INST]</s><s>assistant\né<\\/s></s>"
    assert [tuple(s) for s in got.loss_spans] == [(got.formatted.encode().index("é".encode()), 7)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=1, max_size=20))
def test_escape_is_reversible_and_leaves_no_control_string(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("*", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<s>", "</s>", "<sep>", "[INST]", "[/INST]", "<|user|>"))


def test_report_against_brute_force(spark):
    rows = made(random.Random(6), 120) + [(7, 3, None, None), (7, None, "assistant", "z"), (7, 3, "user", "b"), (7, 3, "user", "b"), (None, 1, "user", "x"), (None, 0, "assistant", "y")]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    lengths = {r.conv_id: len(r.formatted) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set()
    for c, t in turns_of(rows).items():
        loss = "".join(x for r, x in t if r == "assistant")
        want.add((c, len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), digest(loss), lengths[c]))
    assert {tuple(r) for r in chat.report(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_odd_roles_and_very_long_texts(spark):
    long = "wörd </s> " * 200_000
    rows = [(1, 0, "a\nb\\n\\\\c</s><sep>", "x"), (1, 1, "", "y"), (1, 2, "assistant", long), (2, 0, "assistant", "")]
    rows += [(3, i, "user" if i % 3 else "assistant", f"turn {i}") for i in range(3000)]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in out.items()} == turns_of(rows)
    assert out[1].loss == long and out[2].loss == ""


def test_empty_table_string_ids_and_columns(spark):
    schema = "conv_id string, turn int, role string, text string, formatted int, _turns string, n_turns string"
    assert chat.report(spark.createDataFrame([], schema)).collect() == []
    got = chat.report(spark.createDataFrame([("c", 1, "user", "hi", 1, "", "")], schema)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [("c", 1, 0)]


def test_query_adds_one_conversation(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r for r in QUERIES["op12_chat_format"](spark, sf).collect()}
    assert set(got) == {r[0] for r in rows} | {-1}
    assert got[-1].turns_sha256 == digest("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n") and got[-1].loss_chars == 21
