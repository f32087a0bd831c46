"""Parsing transcripts into turns by a hidden Markov model over lines.

A transcript is text in which speakers take turns, marked in many ways ("User:",
"**Assistant**", "<|system|>", "Q:", a dash) or not at all. The states are
(role, first line of a turn or a later one); a line emits a speaker marker kind
and line features (length, question mark, blank line before, sentence end),
independent of each other given the state. Probabilities are counted on
transcripts with known roles, with one added to each count; Viterbi finds the
best states, and turns are rendered in one canonical form:

    <|role|>\\ntext\\n<|end|>\\n

with the markers gone and the lines' text as it was.

`render` makes raw transcripts from a table of turns, in a style drawn from the
conversation's hash: it is the labelled source and the test bed.

A conversation is parsed as a whole, but its rows are held in segments of
SEGMENT turns, so that no task holds an unbounded one. A segment's best scores
from each state of its first line to each of its last line are a table of six by
six; a pass over these tables (one for each SEGMENT turns) finds the states at
the segments' ends, and each segment then finds its own path between them, which
is the path that Viterbi finds over all lines. The result has one row for each
segment; the texts of a conversation's segments, one after another, are its
canonical form. A turn that goes on in the next segment is closed there.

Results in special cases: null text is an empty turn; a null or unknown role is
rendered as a user's; a transcript without lines has no turns; turns with equal
numbers are ordered by role and text and are of one segment; a row without a
conversation id is a conversation by itself; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT, SAMPLE = 256, 4000
ROLES = ("system", "user", "assistant")
#: (marker kind, what it looks like at a line's start); the first that fits counts.
MARKERS = [
    ("system", r"(?:system|instructions?|context|setting)"),
    ("user", r"(?:user|human|customer|question|q|me|visitor|client|caller)"),
    ("assistant", r"(?:assistant|ai|bot|answer|a|agent|model|support|operator)"),
]
_MARK = [(k, re.compile(rf"\s*(?:<\|?{w}\|?>|\[{w}\]|\*\*{w}:?\*\*:?|#+ *{w}:?|{w} *[:>])[ \t]*", re.I)) for k, w in MARKERS]
_OTHER = re.compile(r"\s*(?:[-–—•>]\s+|[A-Z][\w ]{0,20}:\s)")
KINDS = ("none", "system", "user", "assistant", "other")
FEATURES = {"kind": 5, "length": 4, "question": 2, "blank": 2, "ends": 2, "first": 2}
STATES = [(r, b) for r in range(3) for b in (0, 1)]  # (role, 1 if a turn begins)


def observe(lines: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """Of the lines that aren't blank: their text without a marker, the observed values, and their places."""
    texts, rows, places = [], [], []
    blank = False
    for at, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        kind, text = 0, line
        for k, pattern in _MARK:
            if m := pattern.match(line):
                kind, text = KINDS.index(k), line[m.end() :]
                break
        else:
            if m := _OTHER.match(line):
                kind = 4
        n = len(text)
        rows.append((kind, 0 if n < 2 else 1 if n < 60 else 2 if n < 200 else 3, int("?" in text[-3:]), int(blank), int(text.rstrip()[-1:] in (".", "!", "?", ":", "…")), int(not rows)))
        texts.append(text)
        places.append(at)
        blank = False
    return texts, np.array(rows, int).reshape(len(rows), len(FEATURES)), places


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def emission(self, x: np.ndarray) -> np.ndarray:
        """log p of observed rows in each state."""
        return sum(t[:, x[:, k]].T for k, t in enumerate(self.emit))

    def between(self, x: np.ndarray) -> np.ndarray:
        """The best scores from each state of the first line, not counting it, to each of the last."""
        v = np.where(np.eye(len(STATES), dtype=bool), 0.0, -np.inf)
        for e in self.emission(x[1:]) if len(x) > 1 else ():
            v = (v[:, :, None] + self.move).max(axis=1) + e
        return v

    def states(self, x: np.ndarray, ends: tuple[int, int] | None = None) -> list[int]:
        """The best path; between the states `ends` of the first and last line, if given."""
        if not len(x):
            return []
        e = self.emission(x)
        s, back = self.start + e[0], []
        if ends:
            s = np.where(np.arange(len(STATES)) == ends[0], 0.0, -np.inf)
        for k in range(1, len(e)):
            m = s[:, None] + self.move
            back.append(m.argmax(axis=0))
            s = m.max(axis=0) + e[k]
        path = [ends[1] if ends else int(s.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def fit(samples: list[tuple[np.ndarray, list[int]]]) -> Model:
    """From observed lines and their states. A turn's later lines follow lines of the same role."""
    start, move = np.ones(len(STATES)), np.ones((len(STATES), len(STATES)))
    emit = [np.ones((len(STATES), n)) for n in FEATURES.values()]
    for x, states in samples:
        if len(x):
            start[states[0]] += 1
            for a, b in zip(states, states[1:], strict=False):
                move[a, b] += 1
            for k, t in enumerate(emit):
                np.add.at(t, (states, x[:, k]), 1)
    for a, (r, _) in enumerate(STATES):
        for b, (q, begins) in enumerate(STATES):
            if not begins and q != r:
                move[a, b] = 1e-12
    for b, (_, begins) in enumerate(STATES):
        if not begins:
            start[b] = 1e-12
    norm = lambda t: np.log(t / t.sum(axis=-1, keepdims=True))
    return Model(norm(start), norm(move), [norm(t) for t in emit])


def parse(transcript: str | None, model: Model) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript."""
    lines = (transcript or "").split("\n")
    texts, x, places = observe(lines)
    turns: list[tuple[str, list[str]]] = []
    last = -1
    for text, at, s in zip(texts, places, model.states(x), strict=True):
        role, begins = STATES[s]
        if begins or not turns:
            turns.append((ROLES[role], [text] if text.strip() else []))
        else:
            turns[-1][1].extend([""] * (at - last - 1) + [text])
        last = at
    return [(r, "\n".join(t)) for r, t in turns]


def canonical(turns: list[tuple[str, str]]) -> str:
    return "".join([f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns])


def render(turns: list[tuple[str, str]], key: str, segment: int | None = None) -> tuple[str, list[tuple[int, int]]]:
    """A raw transcript in one of several styles, and (role, begins) of each line that isn't blank. A later `segment` goes on where a transcript ends."""
    h = hashlib.sha256(key.encode()).digest()
    names = [("System", "User", "Assistant"), ("Instructions", "Human", "AI"), ("Context", "Q", "A"), ("system", "customer", "agent")][h[0] % 4]
    style = ["{}: ", "<|{}|>\n", "**{}:** ", "[{}] ", "### {}\n", "{}> "][h[1] % 6]
    gap = ["\n", "\n\n"][h[2] % 2]
    out, states = [], []
    for k, (role, text) in enumerate(turns):
        r = ROLES.index(role) if role in ROLES else 1
        # some styles mark no assistant, or drop a marker now and then
        silent = h[3] % 8 == 0 and r == 2 or h[4] % 8 == 0 and hashlib.sha256(f"{key}:{k}".encode() if segment is None else f"{key}:{segment}:{k}".encode()).digest()[0] < 26
        raw = (gap if k or segment is not None else "") + ("" if silent else style.format(names[r])) + text
        out.append(raw)
        shown = [x for x in raw.split("\n") if x.strip()]
        states += [(r, int(j == 0)) for j in range(len(shown))]
    return "".join(out), states


def _turns(rows: pa.Table) -> list[tuple[str, str]]:
    got = zip(rows.column("turn").to_pylist(), rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True)
    return [(r or "user", t or "") for _, r, t in sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2] or ""))]


def _columns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"), F.floor(F.coalesce(F.col(f"`{turn_col}`"), F.lit(0)) / SEGMENT).cast("long").alias("segment"))


def train(conversations: DataFrame, sample: int = SAMPLE, folds: int = 5, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """From the first segments of at most `sample` conversations (a bound on labelled rows), those of smallest hash; fold 0 is held out."""
    rows = _columns(conversations, conv_col, turn_col, role_col, text_col).filter("segment = 0 AND conv IS NOT NULL")
    ids = rows.select("conv").distinct().filter(F.crc32(F.col("conv").cast("string").cast("binary")) % folds != 0).orderBy(F.xxhash64("conv"), "conv").limit(sample)
    some = rows.join(F.broadcast(ids), "conv")  # at most `sample` ids

    def run(group: pa.Table) -> pa.Table:
        raw, states = render(_turns(group), str(group.column("conv")[0].as_py()))
        _, x, _ = observe(raw.split("\n"))
        ok = len(x) == len(states)
        return pa.table({"x": pa.array([x.ravel().tolist()] if ok else [], pa.list_(pa.int64())), "s": pa.array([[STATES.index(s) for s in states]] if ok else [], pa.list_(pa.int64()))})

    got = some.groupBy("conv").applyInArrow(run, "x array<long>, s array<long>").toPandas()
    return fit([(np.array(x, int).reshape(-1, len(FEATURES)), list(s)) for x, s in zip(got["x"], got["s"], strict=True)])


_OUT = "conv long, segment long, n_turns long, found_turns long, right_lines long, lines long, roles string, text string"


def _row(conv: int | None, segment: int, turns: int, states: list, path: list[int], found: int, roles: list[str], text: str) -> dict:
    right = sum(STATES[a] == b for a, b in zip(path, states, strict=True))
    return {"conv": conv, "segment": segment, "n_turns": turns, "found_turns": found, "right_lines": right, "lines": len(states), "roles": ",".join(roles), "text": text}


_TYPES = pa.schema([("conv", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("found_turns", pa.int64()), ("right_lines", pa.int64()), ("lines", pa.int64()), ("roles", pa.string()), ("text", pa.string())])


def _whole(turns: list[tuple[str, str]], conv: int | None, segment: int, model: Model) -> dict:
    raw, states = render(turns, str(conv))
    found = parse(raw, model)
    _, x, _ = observe(raw.split("\n"))
    return _row(conv, segment, len(turns), states, model.states(x), len(found), [r for r, _ in found], canonical(found))


def _segment_lines(group: pa.Table) -> tuple[list[str], list[tuple[int, int]], int]:
    """A segment's lines, their states and the number of turns; the line break before a later segment ends the one before."""
    conv, segment, first = (group.column(c)[0].as_py() for c in ("conv", "segment", "first"))
    turns = _turns(group)
    raw, states = render(turns, str(conv), None if segment == first else segment)
    lines = raw.split("\n")
    return lines if segment == first else lines[1:], states, len(turns)


def _summarised(model: Model):
    def run(group: pa.Table) -> pa.Table:
        lines, _, _ = _segment_lines(group)
        _, x, places = observe(lines)
        tail = any(not line.strip() for line in lines[places[-1] + 1 if places else 0 :])
        one = {"conv": group.column("conv")[0].as_py(), "segment": group.column("segment")[0].as_py(), "tail": tail, "head": x[0].tolist() if len(x) else [], "between": model.between(x).ravel().tolist() if len(x) else []}
        return pa.Table.from_pylist([one], pa.schema([("conv", pa.int64()), ("segment", pa.int64()), ("tail", pa.bool_()), ("head", pa.list_(pa.int64())), ("between", pa.list_(pa.float64()))]))

    return run


def _joined(model: Model):
    """The states at the ends of a conversation's segments, and whether a segment closes its last turn."""
    names = list(FEATURES)

    def run(group: pa.Table) -> pa.Table:
        steps, score, blank = [], None, False
        for r in sorted(group.to_pylist(), key=lambda r: r["segment"]):
            if not r["head"]:
                blank |= r["tail"]
                continue
            head = np.array([r["head"]])
            head[0, names.index("blank")] |= blank
            head[0, names.index("first")] = int(score is None)
            came = None
            if score is None:
                entry = model.start + model.emission(head)[0]
            else:
                m = score[:, None] + model.move
                came, entry = m.argmax(axis=0), m.max(axis=0) + model.emission(head)[0]
            through = entry[:, None] + np.array(r["between"]).reshape(len(STATES), -1)
            steps.append((r["segment"], came, through.argmax(axis=0)))
            score, blank = through.max(axis=0), r["tail"]
        out = []
        last, closes = int(score.argmax()) if score is not None else 0, True
        for segment, came, first in reversed(steps):
            begin = int(first[last])
            out.append({"conv": group.column("conv")[0].as_py(), "segment": segment, "a": begin, "b": last, "closes": closes})
            closes, last = STATES[begin][1] == 1, int(came[begin]) if came is not None else 0
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.int64()), ("segment", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("closes", pa.bool_())]))

    return run


def _decoded(model: Model):
    def run(group: pa.Table, ends: pa.Table) -> pa.Table:
        lines, states, turns = _segment_lines(group)
        texts, x, places = observe(lines)
        end = ends.to_pylist()[0] if ends.num_rows else None
        path = model.states(x, (end["a"], end["b"])) if end else []
        parts: list[str] = []
        last = -1
        for k, (text, at, s) in enumerate(zip(texts, places, path, strict=True)):
            role, begins = STATES[s]
            if begins:
                parts.append(("\n<|end|>\n" if k else "") + f"<|{ROLES[role]}|>\n" + text)
                if not text.strip():
                    parts[-1] = parts[-1][: len(parts[-1]) - len(text)]
            else:
                # an empty first line adds no line, as in `parse`
                bare = k > 0 and STATES[path[k - 1]][1] and not texts[k - 1].strip()
                parts.append("\n" * (at - last - bare) + text)
            last = at
        if path:
            parts.append("\n<|end|>\n" if end["closes"] else "\n" * (len(lines) - last - 1))
        roles = [ROLES[STATES[s][0]] for s in path if STATES[s][1]]
        row = _row(group.column("conv")[0].as_py(), group.column("segment")[0].as_py(), turns, states, path, len(roles), roles, "".join(parts))
        return pa.Table.from_pylist([row], _TYPES)

    return run


def recover(conversations: DataFrame, model: Model | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render each conversation raw, parse it, render it canonically: conv_id, segment, n_turns, found_turns, right_lines, lines, held_out, roles, text."""
    model = model or train(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    rows = _columns(conversations, conv_col, turn_col, role_col, text_col)

    def short(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_whole(_turns(group), group.column("conv")[0].as_py(), group.column("segment")[0].as_py(), model)], _TYPES)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_whole([(r or "user", t or "")], None, n, model) for r, t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(made, _TYPES)

    named = rows.filter("conv IS NOT NULL")
    spans = named.groupBy("conv").agg(F.min("segment").alias("first"), F.max("segment").alias("last")).filter("first < last").select("conv", "first")
    long = named.join(spans.hint("merge"), "conv")
    ends = long.groupBy("conv", "segment").applyInArrow(_summarised(model), "conv long, segment long, tail boolean, head array<long>, between array<double>").groupBy("conv").applyInArrow(_joined(model), "conv long, segment long, a int, b int, closes boolean")
    parsed = long.groupBy("conv", "segment").cogroup(ends.groupBy("conv", "segment")).applyInArrow(_decoded(model), _OUT)
    few = named.join(spans.hint("merge"), "conv", "left_anti").groupBy("conv", "segment").applyInArrow(short, _OUT)
    single = rows.filter("conv IS NULL").select("role", "text", "segment").mapInArrow(alone, _OUT)
    out = few.union(parsed).union(single)
    held = F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("conv").alias(conv_col), "segment", held.alias("held_out"), "n_turns", "found_turns", "lines", "right_lines", "roles", "text")


def parse_table(transcripts: DataFrame, model: Model, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Turns of a table of raw transcripts: id, turn, role, text."""
    id_type = transcripts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, r, t) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (r, t) in enumerate(parse(x, model))]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.string(), pa.string()), strict=True)], ["id", "turn", "role", "text"])

    rows = transcripts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, turn int, role string, text string").withColumnRenamed("id", id_col)
