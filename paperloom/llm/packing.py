"""Best-fit packing of token sequences into fixed-length training sequences.

Documents become pieces of at most `capacity` tokens. How pieces share
sequences depends on nothing but their lengths, so the plan is made on the
histogram of lengths (at most `capacity` rows, whatever the corpus):

* lengths above a third of the capacity are matched greedily, longest first,
  each with the longest that fits beside it: at most two such pieces share a
  sequence, and this greedy matching leaves the fewest sequences;
* shorter lengths, longest first, go to the sequence with the least room that
  still holds them; where none does, a new sequence is opened.

The plan is a list of slots: "pieces of length L ranked lo to lo+n are in
sequences s to s+n at offset o". Each step of the planner uses up a length or
a range of equal sequences, so slots are bounded by the capacity and not by
the corpus; they are broadcast. Pieces find their slot by a rank within their
length, counted in salted cells, as a third of all pieces may have one length.

Results in special cases: a null or empty text is one piece that holds the end
id only; a text of exactly `capacity` ids (with its end) isn't cut; repeated
rows are packed as often as they occur; null ids are packed like others; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY, END_ID = 2048, 0
#: Rows of one length that one task ranks.
CELL_ROWS = 50_000
#: Words and word parts whose ids a worker remembers; beyond it, it starts anew.
CACHE_WORDS, CACHE_PARTS = 500_000, 600_000


class Remembered(dict):
    """A function's values by argument; forgets all of them when there are too many."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, remembered by word.

    The vocabulary drops white space and no token crosses it, so a text's ids
    are those of its words, one after another. A new word is cut into the parts
    that the vocabulary's own rule makes (contractions, letters, single digits,
    other signs), and only new parts reach the BPE model. A text that holds a
    special token's string, or controls that Python alone takes for white space,
    is encoded as a whole, as is everything under a vocabulary of another kind.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        self.by_word = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.cut = regex.compile(steps[0]["pattern"]["Regex"]).findall if self.by_word else None
        self.known, self.parts = Remembered(self._word, CACHE_WORDS), Remembered(self._part, CACHE_PARTS)
        # byte-level BPE writes bytes that don't print as characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: 256 + k for k, b in enumerate(rest)}

    def _ids(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) > "\u024f":  # Python's Unicode tables may be newer than the tokenizer's
            return self._ids(word)
        parts, low = self.parts, word.lower()
        if low.isalpha():
            return parts[low]
        if low[-1] in ".,;:" and low[:-1].isalpha():
            return parts[low[:-1]] + parts[low[-1]]
        return b"".join([parts[p] for p in self.cut(low)])

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def __call__(self, text: str) -> bytes:
        if not self.by_word or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._ids(text)
        return b"".join(map(self.known.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves (binary)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    for col, v in zip(out, (doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else b""), strict=True):
                        col.append(v)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [id_col, "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types, strict=False)], names[:n])

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(cut, schema)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, pieces, first sequence, offset) for so many pieces of each length."""
    left, taken = dict(counts), dict.fromkeys(counts, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of sequences (first, how many)
    rooms: list[int] = []
    opened = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        slots.append((length, taken[length], n, first, offset))
        taken[length] += n
        left[length] -= n

    def leave(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                insort(rooms, free)
            room[free].append((first, n))

    def open_new(n: int) -> int:
        nonlocal opened
        opened += n
        return opened - n

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        k = bisect_left(large, min(a, capacity - a) + 1) - 1
        while k >= 0 and left[a]:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                first = open_new(n)
                put(a, n, first, 0)
                put(b, n, first, a)
                leave(capacity - a - b, first, n)
            k -= 1
        if n := left[a]:
            first = open_new(n)
            put(a, n, first, 0)
            leave(capacity - a, first, n)

    def fill(length: int, first: int, n: int, free: int) -> None:
        """As many as fit into each of n equal sequences, until none of this length is left."""
        each = free // length
        full = min(n, left[length] // each)
        for j in range(each if full else 0):
            put(length, full, first, capacity - free + j * length)
        if full:
            leave(free - each * length, first, full)
        rest = left[length] if full < n else 0  # fewer than each
        for j in range(rest):
            put(length, 1, first + full, capacity - free + j * length)
        if rest:
            leave(free - rest * length, first + full, 1)
        leave(free, first + full + bool(rest), n - full - bool(rest))

    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[length]:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                free = rooms[k]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(k)
                fill(length, first, n, free)
            else:
                n = -(-left[length] // (capacity // length))
                fill(length, open_new(n), n, capacity)
    return slots


def assign(found: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Give each piece a sequence_id and an offset. `found` is a materialized table of pieces."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan_slots(counts, capacity), "length long, lo long, n long, first long, offset long")
    salts = max(1, -(-max(counts.values(), default=1) // CELL_ROWS))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(id_col, "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(cells, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    p, s = ranked.alias("p"), F.broadcast(slots).alias("s")  # bounded by the capacity
    joined = p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("p._rank") >= F.col("s.lo")) & (F.col("p._rank") < F.col("s.lo") + F.col("s.n")))
    keep = [F.col(f"p.`{c}`") for c in found.columns]
    return joined.select(*keep, (F.col("s.first") + F.col("p._rank") - F.col("s.lo")).alias("sequence_id"), F.col("s.offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut, match and fit the documents: one row per piece with its sequence and its place there."""
    return assign(materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)), capacity, id_col)
