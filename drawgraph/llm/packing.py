"""Token sequences packed by the sum-of-squares rule."""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import cut

#: Pieces that one task packs; bounds a group, and costs at most an open bin or so for each group.
GROUP_ROWS = 10_000
#: Words whose ids a Python worker remembers; only a cache, every word gets the tokenizer's own ids.
CACHE_WORDS = 1_200_000
#: ASCII marks, which the tokenizer takes for units of their own.
MARKS = string.punctuation.encode()
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 1 << 21

PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"
_LOADED: dict[str, WordIds] = {}


class WordIds:
    """The ids of texts as little-endian uint32, word by word.

    The tokenizer drops white space and no token spans it, so a text's ids are those of the parts between
    ASCII white space, one after the other; each part is encoded as it stands.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for words that the normalizer would leave as they are
        self.plain.normalizer = normalizers.Sequence([])
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def load(cls, path: str) -> WordIds:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def learn(self, words: Iterable[bytes]) -> None:
        """One call of the tokenizer for many words.

        Letters with or without ASCII marks after them are the usual words: the letters are one unit of the tokenizer,
        whose last token alone has the mark of a word's end, and the marks are a unit of their own.
        """
        known, marks = self.known, self.marks
        fresh: set[bytes] = set()
        ended: list[tuple[bytes, bytes, bytes]] = []
        others: list[bytes] = []
        for word in words:
            bare = word.rstrip(MARKS)
            mark = word[len(bare) :]
            lower = _lower(bare)
            if lower is None:
                others.append(word)
                continue
            if lower not in known:
                fresh.add(lower)
            if mark not in marks:
                marks[mark] = np.array(self.tokenizer.encode(mark.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            ended.append((word, lower, mark))
        if self._learn_units(list(fresh)):
            for word, lower, mark in ended:
                known[word] = known[lower] + marks[mark]
        else:
            others += [x[0] for x in ended]
        if others:
            self._learn_by_place(others)
        if len(marks) > CACHE_WORDS:
            self.marks = {b"": b""}

    def _learn_units(self, units: list[bytes]) -> bool:
        """Learn words that are one unit each, cut where a word ends; False if they aren't."""
        if not units:
            return True
        text = b" ".join(units).decode()
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(units):
            return False
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.known.update(zip(units, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
        return True

    def _learn_by_place(self, words: list[bytes]) -> None:
        """Of any words: a token belongs to the word in which it starts."""
        texts = [w.decode() for w in words]
        encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded))
        at = [0, *np.searchsorted(starts, ends).tolist()]
        raw = np.array(encoded.ids, dtype="<u4").tobytes()
        for word, a, b in zip(words, at, at[1:], strict=False):
            self.known[word] = raw[4 * a : 4 * b]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parts = [t.split() for t in texts]
        words = set().union(*parts)
        fresh = words.difference(self.known)
        if len(self.known) + 2 * len(fresh) > CACHE_WORDS:  # what is in use stays
            self.known = {w: self.known[w] for w in words.difference(fresh)}
        if fresh:
            self.learn(fresh)
        ids = self.known.__getitem__
        return [b"".join(map(ids, part)) for part in parts]


def _lower(word: bytes) -> bytes | None:
    """A word of letters as the normalizer leaves it, if that is plain to see; else None."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    text = word.decode()
    if max(text) > "\u024f" or not text.isalpha():
        return None
    text = text.lower()
    return text.encode() if text.isalpha() and unicodedata.is_normalized("NFC", text) else None


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= SLICE_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32; each document ends with ``end_id``."""
    kind = docs.schema[id_col].dataType
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.load(path)
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            i = 0
            for some in _slices(texts):
                for ids in words.encode(some):
                    raw = ids + end
                    n = len(raw) // 4
                    for k, a in enumerate(range(0, n, capacity)):
                        part = raw[4 * a : 4 * (a + capacity)]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                    i += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, PIECES.format(id=kind.simpleString())
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first.

    Each goes where the sum over gaps of (open bins with that gap) squared becomes smallest: into an open bin
    of some gap, or into a new one; of equals, where the smaller gap is left.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full bins don't count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_bins = 0
    far = np.int64(1) << 40
    for i in order:
        s = int(lengths[i])
        # change of the sum: gap g loses a bin, gap g - s gains one
        change = np.where(count[s:] > 0, 2 * (count[: capacity - s + 1] - count[s:] + 1), far)
        if count[s] > 0:
            change[0] = 1 - 2 * count[s]  # fills its bin
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        j = int(np.argmin(change))
        if change[j] <= new:
            gap = s + j
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - gap
        left = gap - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document's ids are followed by ``end_id``; only longer ones are cut, into pieces of ``capacity``. Full pieces
    are sequences of their own; the others are dealt evenly into groups of about ``GROUP_ROWS``, and each group is
    packed by sums of squares.

    Returns per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty (one piece: the end id); null ids and repeated rows are packed as rows of their own;
    ties go to the earlier row; an empty table gives no rows; other columns are not read.
    """
    pieces = cut(tokenize(docs, tokenizer_path, id_col, text_col, capacity, end_id))
    # the written table is stable, so this number is too; it deals rows out evenly whatever they hold
    pieces = pieces.withColumn("number", F.monotonically_increasing_id())
    full = pieces.filter(F.col("length") == capacity).select(
        "id", "piece", "start", "length", "ids_crc32", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP_ROWS))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number", kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["g"].to_numpy() << 32) + bins, offset=offsets)[
            ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    kind = docs.schema[id_col].dataType.simpleString()
    packed = (
        rest.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(run, PIECES.format(id=kind) + ", sequence_id long, offset long")
    )
    return full.unionByName(packed).withColumnRenamed("id", id_col)
