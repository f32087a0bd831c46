"""Scoring texts by the marginal probability of a subword lattice.

A text is a run of words that ends with an end mark. A word's probability is the
sum over all ways to write it in pieces of the existing vocabulary; a forward
recursion in log space sums over the segmentations. The vocabulary's own scores
are the first weights of the pieces (rank r weighs 1/(r+1)); EM_ROUNDS of
expectation maximisation over the words of all training documents then fit them,
every segmentation counting by its probability and every word as often as it
occurs. No piece crosses a word's start, so a word is weighed once for all texts
that have it. `score` is this probability; the end mark's is its share of the
training tokens, and the pieces share the rest.

`word_score` is that of another model beside it: a word is one whole-word arc,
if the training documents have it (its count less a discount D, by N training
tokens), or any segmentation, which share what the discounts leave (D times the
T known words, by N). D is n1 / (n1 + 2 n2), from the numbers of words seen once
and twice.

What a document needs from the corpus - the training count and weight of each of
its words - is gathered by chunks of about CHUNK_BYTES of text: a chunk asks
once for each distinct word, counts are added up with partial sums, and each
word's answer is joined to the chunks that asked. A word has at most one request
a chunk. The corpus is never on the driver; only the weights (one per piece) are.

Results in special cases: null and empty texts consist of the end mark; null
ids count as training documents; repeated rows count as often as they occur;
without training documents the weights are the vocabulary's, nothing is known
and the end mark is free; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .lattice import Lattice, vocabulary_pieces

CHUNK_BYTES, EM_ROUNDS, FOLDS, HELD_OUT = 16 << 20, 3, 7, 2
#: Words that a task weighs at a time.
GATHER = 150_000
#: What a piece counts besides its expected count.
PRIOR = 0.01

_made: dict[str, Lattice] = {}


def _lattice(model_file: str) -> Lattice:
    if model_file not in _made:
        _made[model_file] = Lattice(vocabulary_pieces(model_file)[0])
    return _made[model_file]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHER) -> Iterator[pa.RecordBatch]:
    """Larger batches: words of one length are handled together, and the more the better."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _requests():
    def run(chunk: pa.Table) -> pa.Table:
        train, asked = Counter(), set()
        for text, held in zip(chunk.column("text"), chunk.column("held_out").to_pylist(), strict=True):
            if held:
                asked.update(words_of(text.as_py()))
            else:
                train.update(words_of(text.as_py()))
        words = sorted(asked.union(train))
        number = chunk.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([number] * len(words), pa.int32()), "word": pa.array(words, pa.binary()), "n": pa.array([train[w] for w in words], pa.int64())})

    return run


def _expect(model_file: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, out = _lattice(model_file), np.zeros(len(logp))
        for b in _gathered(batches):
            words, times = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for at, rows in lattice.by_length(words):
                lattice.expected(rows, times[at], logp, out)
        k = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(out[k])], ["piece", "n"])

    return run


def fit(words: DataFrame, model_file: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """log p of each piece, from the different words and how often they occur (word, c)."""
    pieces, scores = vocabulary_pieces(model_file)
    rank = np.empty(len(pieces))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
    logp = np.log(1 / (rank + 1) / (1 / (rank + 1)).sum())
    for _ in range(rounds):
        found = words.mapInArrow(_expect(model_file, logp), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most one row a piece
        counts = np.full(len(pieces), PRIOR)
        for r in found:
            counts[r["piece"]] += r["n"]
        logp = np.log(counts / counts.sum())
    return logp


def _weigh(model_file: str, logp: np.ndarray):
    """log p of each word over all its segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model_file)
        for b in _gathered(batches):
            words = b.column(0).to_pylist()
            spelt = np.zeros(len(words))
            for at, rows in lattice.by_length(words):
                spelt[at] = lattice.forward(rows, logp)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spelt)], ["word", "c", "lp"])

    return run


def _judge(total: int, distinct: int, ends: int, known: int, discount: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        place = {w: k for k, w in enumerate(answers.column("word").to_pylist())}
        c, lp = answers.column("c").to_numpy(), answers.column("lp").to_numpy()
        base = np.log10((c + 1) / (total + distinct + 1))
        base_end = np.log10((ends + 1) / (total + distinct + 1))
        # the end mark's share, and what is left to the words
        end, go_on = (np.log(ends / total), np.log(max(total - ends, 1) / total)) if ends else (0.0, 0.0)
        both = lp + (np.log(discount * known / total) if known else go_on)
        if total:
            with np.errstate(divide="ignore"):
                both = np.logaddexp(both, np.log(np.maximum(c - discount, 0) / total))
        out: list[list] = [[], [], [], [], []]
        for text in docs.column("text"):
            at = list(map(place.__getitem__, words_of(text.as_py())))
            marginal, word = (float((x[at].sum() + y * len(at) + end) / np.log(10)) for x, y in ((lp, go_on), (both, 0.0)))
            for col, v in zip(out, (len(at) + 1, int((c[at] > 0).sum()) + (ends > 0), float(base[at].sum() + base_end), marginal, word), strict=True):
                col.append(v)
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(out[0], pa.int64()), "n_known": pa.array(out[1], pa.int64()), "base_score": pa.array(out[2], pa.float64()), "score": pa.array(out[3], pa.float64()), "word_score": pa.array(out[4], pa.float64())})

    return run


def score(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = EM_ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score."""
    key, id_type = F.col(f"`{id_col}`"), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = rows.withColumn("held_out", held)
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum((~held).cast("long")).alias("ends")).first()
    ends, chunks = size["ends"] or 0, max(1, -(-(size["bytes"] or 0) // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.length("text")), F.lit(chunks)).cast("int"))

    asked = rows.groupBy("chunk").applyInArrow(_requests(), "chunk int, word binary, n long")
    asked = materialize(asked)
    words = materialize(asked.groupBy("word").agg(F.sum("n").alias("c")))
    seen = words.filter("c > 0")
    known = seen.agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    total, distinct = (known["n"] or 0) + ends, known["v"] + (ends > 0)
    discount = (known["n1"] + 0.5) / (known["n1"] + 2 * known["n2"] + 1)
    logp = fit(seen, model_file, rounds if known["v"] else 0)
    weighed = words.mapInArrow(_weigh(model_file, logp), "word binary, c long, lp double")
    # merged whatever the sizes: the words grow with the corpus
    answers = asked.select("chunk", "word").join(weighed.hint("merge"), "word")
    judged = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_judge(total, distinct, ends, known["v"], discount), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, word_score double")
    return judged.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "word_score")
