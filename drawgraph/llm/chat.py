"""Chat formatting by relational operations: turns are collected, sorted, merged by role and joined into one text.

A block is the run of adjacent turns of one role: ``<s>``, the role, a line end, the turns' texts with ``<sep>`` between
them, ``</s>``. Control strings inside a text get a backslash behind their bracket (``[\\\\INST]``), those that have some
already get one more, so that a text never holds a control string and comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import let

OPEN, BETWEEN, CLOSE = "<s>", "<sep>", "</s>"
#: Control strings that are never left bare in a text: those of the template, and those that models are trained on.
ANGLED = r"/?s|sep|\|[a-z_]+\|"
SQUARE = r"/?(?:INST|SYS|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)"
#: Roles whose texts are learnt.
LEARNT = ("assistant",)


def escape(text: Column) -> Column:
    """``text`` without bare control strings."""
    text = F.regexp_replace(text, rf"<(\\*)({ANGLED})>", r"<$1\\$2>")
    return F.regexp_replace(text, rf"\[(\\*)({SQUARE})\]", r"[$1\\$2]")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    text = F.regexp_replace(text, rf"\[(\\*)\\({SQUARE})\]", r"[$1$2]")
    return F.regexp_replace(text, rf"<(\\*)\\({ANGLED})>", r"<$1$2>")


def _role_line(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_of(line: Column) -> Column:
    """The role of a line: ``\\\\n`` is a line end, ``\\\\\\\\`` a backslash."""
    parts = F.split(unescape(line), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of sorted ``turns`` (turn, role, text): adjacent turns of one role are one block."""
    n = F.size(turns)
    role = lambda i: F.get(turns, i)["role"]
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (role(i) != role(i - 1)))

    def blocks(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
        return F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda x: F.struct(
                role(x["a"]).alias("role"), F.transform(F.slice(turns, x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("texts")
            ),
        )

    return let(starts, blocks)


def _written(block: Column, learnt: tuple[str, ...]) -> Column:
    """A block's text, its bytes, and the places (from, bytes) of the texts that are learnt, counted from its start."""
    head = F.concat(F.lit(OPEN), _role_line(block["role"]), F.lit("\n"))
    texts = F.transform(block["texts"], escape)

    def put(parts: Column) -> Column:
        head, texts = parts["head"], parts["texts"]
        first = F.octet_length(head).cast("bigint")
        # (end of the last text, places so far): a text begins behind the head or behind a separator
        steps = F.aggregate(
            texts,
            F.struct((first - len(BETWEEN)).alias("end"), F.array().cast("array<struct<first:bigint,bytes:bigint>>").alias("places")),
            lambda done, t: F.struct(
                (done["end"] + len(BETWEEN) + F.octet_length(t)).alias("end"),
                F.array_append(done["places"], F.struct((done["end"] + len(BETWEEN)).alias("first"), F.octet_length(t).cast("bigint").alias("bytes"))).alias("places"),
            ),
            lambda done: done["places"],
        )
        text = F.concat(head, F.array_join(texts, BETWEEN), F.lit(CLOSE))
        return let(
            text,
            lambda text: F.struct(
                text.alias("text"),
                F.octet_length(text).cast("bigint").alias("bytes"),
                F.when(parts["learnt"], steps).otherwise(F.array().cast("array<struct<first:bigint,bytes:bigint>>")).alias("places"),
            ),
        )

    return let(F.struct(head.alias("head"), texts.alias("texts"), block["role"].isin(*learnt).alias("learnt")), put)


def format_chats(
    turns: DataFrame,
    learnt: tuple[str, ...] = LEARNT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, n_turns, n_blocks, formatted, loss_spans.

    ``loss_spans`` are the places (first, bytes) of the texts of the roles in ``learnt``, as bytes of the UTF-8 form of
    ``formatted``, in order: the loss mask of a conversation. Everything is done by expressions of one aggregation.

    Null texts and roles are empty ones; empty texts are turns too. Rows of one turn number are ordered by role, then
    text, and repeated rows stay; null turn numbers come first; rows of null id are one conversation of null id. An
    empty table gives no rows; other columns are not read. A conversation is one row, so it has to fit one.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    held = turns.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    blocks = let(F.col("_turns"), merged)
    written = F.transform(blocks, lambda b: _written(b, learnt))

    def joined(blocks: Column) -> Column:
        none = F.array().cast("array<struct<first:bigint,bytes:bigint>>")
        spans = F.aggregate(
            blocks,
            F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
            lambda done, b: F.struct(
                (done["at"] + b["bytes"]).alias("at"),
                F.concat(done["spans"], F.transform(b["places"], lambda p: F.struct((p["first"] + done["at"]).alias("first"), p["bytes"].alias("bytes")))).alias("spans"),
            ),
            lambda done: done["spans"],
        )
        return F.struct(F.size(blocks).cast("bigint").alias("n"), F.array_join(F.transform(blocks, lambda b: b["text"]), "").alias("text"), spans.alias("spans"))

    out = held.select("_id", F.size("_turns").cast("bigint").alias("n_turns"), let(written, joined).alias("_o"))
    return out.select(F.col("_id").alias(id_col), "n_turns", F.col("_o.n").alias("n_blocks"), F.col("_o.text").alias("formatted"), F.col("_o.spans").alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.slice(F.split(formatted, CLOSE, -1), 1, F.greatest(F.size(F.split(formatted, CLOSE, -1)) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(line) + 2)
        role = _role_of(F.substr(line, F.lit(len(OPEN) + 1)))
        return let(role, lambda role: F.transform(F.split(body, BETWEEN, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def learnt_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped, nothing between."""
    raw = F.encode(formatted, "UTF-8")
    place = lambda raw, s: F.decode(F.substr(raw, (s["first"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8")
    return let(raw, lambda raw: F.array_join(F.transform(spans, lambda s: unescape(place(raw, s))), ""))


def report(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What the formatted conversations hold, read back from them: turns, loss text, length."""
    out = format_chats(turns, LEARNT, id_col, turn_col, role_col, text_col)
    lines = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = out.select(
        F.col(id_col),
        let(read_back(F.col("formatted")), lambda t: F.struct(F.size(t).cast("bigint").alias("n"), F.sha2(F.array_join(F.transform(t, lines), ""), 256).alias("sha"))).alias("_t"),
        let(learnt_text(F.col("formatted"), F.col("loss_spans")), lambda t: F.struct(F.length(t).cast("bigint").alias("n"), F.sha2(t, 256).alias("sha"))).alias("_l"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return read.select(
        id_col,
        F.col("_t.n").alias("n_turns"),
        F.col("_t.sha").alias("turns_sha256"),
        F.col("_l.n").alias("loss_chars"),
        F.col("_l.sha").alias("loss_sha256"),
        "formatted_chars",
    )
