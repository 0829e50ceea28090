"""Tags in texts against regular expressions one tag at a time; links against a reader of one message at a time."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drawgraph.functions.scalars import LINE_PATTERN
from drawgraph.operators import mentions

TAGS = ["HV-1", "HV-12", "hv-12", "A-A", "AA", "-", "P-T-7", "é-1", "", None]


@pytest.fixture(params=[200_000, 3])
def block(request, monkeypatch):
    monkeypatch.setattr(mentions, "BLOCK", request.param)


def texts(rng):
    words = ["HV-1", "HV12", "hv-12", "aa", "aaa", "A-A", "pt7", "P-T-7", "é1", "\n", " ", "word", "x" * 30, '6"PP01-361-GF0002-B03F9', "-", "20\"-PP1-3610-ab0001-x"]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.randrange(120)))) for i in range(60)] + [(900, None), (901, "")]


def contexts(text, tag, reach):
    for form in (tag, tag.replace("-", "")):
        found = re.findall(rf".{{0,{reach}}}{re.escape(form)}.{{0,{reach}}}", text, re.I | re.A) if form else []
        if found:
            return " | ".join(x.strip() for x in found[:2])
    return None


def lines(text, tag, reach):
    out = set()
    for form in {tag, tag.replace("-", "")} - {""}:
        for m in re.finditer(re.escape(form), text, re.I | re.A):
            out |= {x.upper() for x in re.findall(LINE_PATTERN, text[max(0, m.start() - reach) : m.end() + reach])}
    return out


def test_against_one_tag_at_a_time(spark, block):
    rows = texts(random.Random(2))
    df, tags = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in [*TAGS, "HV-1"]], "tag string")
    for reach in (120, 9):
        got = {(r.doc_id, r.tag): r.context for r in mentions.tag_contexts(df, tags, reach).collect()}
        want = {(d, t): contexts(x, t, reach) for d, x in rows if x for t in TAGS if t}
        assert got == {k: v for k, v in want.items() if v is not None}
    got = [tuple(r) for r in mentions.lines_near_tags(df, tags, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == {(d, t, x) for d, text in rows if text for t in TAGS if t for x in lines(text, t, 40)}


def test_no_texts_no_tags_and_string_ids(spark):
    df, none = spark.createDataFrame([("a", "HV-1 here")], "doc_id string, text string"), spark.createDataFrame([], "tag string")
    assert mentions.tag_contexts(df, none).collect() == [] and mentions.tag_contexts(df.filter("false"), df.selectExpr("'HV-1' as tag")).collect() == []
    assert [tuple(r) for r in mentions.tag_contexts(df, df.selectExpr("'hv-1' as tag")).collect()] == [("a", "hv-1", "HV-1 here")]


def linked(text, known):
    seen = set()

    def one(m, number, key):
        if number and number.rjust(4, "0") in known and key not in seen:
            seen.add(key)
            return f"[PID-{number.rjust(4, '0')}](#pid-{known[number.rjust(4, '0')]})"
        return m[0]

    def doc(m):
        number = re.search(r"PID-(\d{4})", m[1])
        return one(m, number and number[1], number and number[1])

    text = re.sub(r"\[doc_id:([^\]]+)\]", doc, text, flags=re.I)
    text = re.sub(r"\[PID-(\d{3,4})\]", lambda m: one(m, m[1], m[1].rjust(4, "0")), text, flags=re.I)
    return re.sub(r"\bPID-(\d{3,4})\b", lambda m: one(m, m[1], "p" + m[1]), text, flags=re.I)


def test_links_of_first_mentions(spark):
    rng = random.Random(9)
    known = {"0007": "x7", "0012": "0012", "1234": "q", "0000": "zero"}
    forms = ["[doc_id:PID-0007.pdf]", "[doc_id:x]", "[DOC_ID:PID-00071]", "[PID-007]", "[pid-0007]", "PID-0007", "pid-007", "PID-12345", "aPID-012", "PID-012", "[PID-1234]", "[PID-9999]", "PID-9999", "text", "$1 \\", "[doc_id:pid-0012]"]
    rows = [(i, " ".join(rng.choice(forms) for _ in range(rng.randrange(12)))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "k long, text string")
    mapping = spark.createDataFrame(list(known.items()), "number string, target string")
    got = {r.k: r.text for r in mentions.link_drawing_refs(df, ["k"], mapping).collect()}
    assert got == {k: x if x is None else linked(x, known) for k, x in rows}
    assert mentions.link_drawing_refs(df.withColumn("other", F.lit(1)), ["k"], mapping).columns == ["k", "text", "other"]


def test_a_task_hands_on_what_it_found_before_it_is_large(spark, monkeypatch):
    sizes = []

    class Texts:  # runs the function of a task here, and notes the size of what it hands on
        schema, sparkSession = spark.createDataFrame([], "doc_id long, text string").schema, spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            text = "HV-0001 and " * 200
            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": [text] * 50})
            sizes.extend(b.num_rows for b in run(iter([batch])))

    monkeypatch.setattr(mentions, "HANDED", 20_000)
    mentions._scanned(Texts(), spark.createDataFrame([("HV-0001",)], "tag string"), "", lambda text, whole, bare: ((t, text[max(0, x - 100) : x + 100]) for t, s in whole.items() for x in s))
    assert sum(sizes) == 50 * 200 and max(sizes) < 210
