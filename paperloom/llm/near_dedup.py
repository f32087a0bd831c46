"""MinHash near-duplicates by an LSH forest.

Rows with the same words, in order, are one class, merged first and skew-safe;
everything else works on class representatives (the smallest id).

* A representative has VALUES MinHash values over its word shingles. Each of
  TREES orders sorts the representatives by a label of DEPTH values (its own
  SHALLOW ones first, then those of the next order) - the leaves of a prefix
  tree, which are range-partitioned and sorted by Spark.
* Neighbours in an order whose longest common prefix has SHALLOW values or more
  are candidates. The depth adapts to the region: a region of at most SMALL
  members pairs all of them; a larger one is split by the next value, and its
  parts are linked along the order; what is still large at full depth (the
  labels are equal) is linked along the order and to its first member. So each
  member makes a bounded number of candidates in each order. Members of larger
  regions are noted, as are those of a partition's first and last region, which
  may go on in the next partition.
* A bit of each value travels along as a sketch; pairs whose sketches agree on
  less than MIN_AGREE of the bits (about four deviations below what the
  threshold gives) are not candidates.
* Links are confirmed on the full shingle sets, in rounds: first two
  good candidates of each representative; then all candidates whose ends are still in
  different components, and for the noted members also their NEAREST members of
  other components by sketch, in each region of up to WIDE members (wider ones
  by the next value, or along the order). These rounds only save work for the
  last one, which has no such bounds: the noted members that share a region with
  another component are joined by their rarest shingles, with the bounds of
  prefix and place that a similarity join has (`rest_of`), whatever the size of
  the region. Texts that are alike in what many share and differ in what is rare
  never meet there, so a family of unlinked texts doesn't make all its pairs. A
  candidate inside a component would add no reachability.
* Components by parents of parents on tables (`components`).

With a similarity of 0.75 two texts share a prefix of SHALLOW values in a given
order with probability 0.32, and in none of 32 with 0.000005.

Results in special cases: null, empty and blank texts have no shingles and link
with nothing (also not with each other); fewer words than a shingle are one
shingle; repeated rows and repeated ids are members of their text's class; rows
with a null id belong to their class, whose id is the smallest that isn't null;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, told_apart
from .components import components
from .shingles import N, common, normalised, shingle_hashes

TREES, SHALLOW, DEPTH = 32, 4, 8
VALUES = TREES * SHALLOW
SMALL, WIDE, NEAREST = 6, 2048, 8
#: Members on either side of a cell in the last round.
CELL = 1024
MIN_AGREE = 93  # of 128 sketch bits; expected are 112 at 0.75, 64 for unlike texts
#: Shingles hashed at a time, so that they stay in a core's cache.
BLOCK = 1 << 14

_rng = np.random.Generator(np.random.PCG64(20))
MULTIPLY = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
LABEL_VALUES = [[(SHALLOW * t + k) % VALUES for k in range(DEPTH)] for t in range(TREES)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of VALUES 32-bit values for each set, none of which is empty."""
    out = np.empty((len(sets), VALUES), np.uint32)
    k = 0
    while k < len(sets):
        first, size = k, 0
        while k < len(sets) and (size == 0 or size + len(sets[k]) <= BLOCK):
            size += len(sets[k])
            k += 1
        h = np.concatenate(sets[first:k])
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : k - 1]], dtype=np.int64))).astype(np.int64)
        work = np.empty_like(h)
        for j in range(VALUES):
            np.multiply(h, MULTIPLY[j], out=work)
            np.add(work, ADD[j], out=work)
            out[first:k, j] = np.minimum.reduceat(work, at) >> np.uint64(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo in range(0, max(1, batch.num_rows), 512):
            keys, sets, n = [], [], []
            for text in texts[lo : lo + 512]:
                norm = normalised(text.as_py())
                s = shingle_hashes(norm)
                keys.append(hashlib.blake2b(norm, digest_size=16).digest() if norm else None)
                n.append(len(s))
                sets.append(s)
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full)) if full else iter(())
            sig = []
            for s in sets:
                if len(s):
                    v = next(signed)
                    # low halves make labels, one bit of the high halves makes the sketch
                    sig.append((v & np.uint32(0xFFFF)).astype(">u2").tobytes() + np.packbits((v >> np.uint32(16)) & np.uint32(1)).tobytes())
                else:
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["id", "key", "n_shingles", "sig"])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        values, sketch = sig[:, : 2 * VALUES].reshape(-1, VALUES, 2), np.ascontiguousarray(sig[:, 2 * VALUES :])
        fixed = lambda x, w: pa.array([x[i * w : i * w + w] for i in range(len(x) // w)], pa.binary())
        sketches = fixed(sketch.tobytes(), sketch.shape[1])
        for t, use in enumerate(LABEL_VALUES):
            label = np.concatenate((np.full((len(values), 1), t, np.uint8), values[:, use, :].reshape(len(values), -1)), axis=1)
            yield pa.RecordBatch.from_arrays([fixed(label.tobytes(), label.shape[1]), batch.column(0), sketches, batch.column(2)], ["label", "id", "sketch", "component"])


def region_pairs(labels: np.ndarray, small: int = SMALL) -> list[tuple[int, int]]:
    """Candidate places (i, j), i < j, in one region: rows of DEPTH values, sorted, that share the first SHALLOW."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(labels), SHALLOW)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= small:
            out += [(i, j) for i in range(lo, hi) for j in range(i + 1, hi)]
        elif depth == DEPTH:
            out += [(i, i + 1) for i in range(lo, hi - 1)] + [(lo, i) for i in range(lo + 2, hi)]
        else:
            for x, y in _parts(labels, lo, hi, depth):
                if y < hi:
                    out.append((y - 1, y))
                if y - x > 1:
                    todo.append((x, y, depth + 1))
    return out


def _parts(labels: np.ndarray, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
    cuts = [lo, *(lo + 1 + np.flatnonzero(labels[lo + 1 : hi, depth] != labels[lo : hi - 1, depth])).tolist(), hi]
    return list(zip(cuts, cuts[1:], strict=False))


def foreign_pairs(labels: np.ndarray, sketch: np.ndarray, component: np.ndarray, nearest: int = NEAREST, wide: int = WIDE) -> list[tuple[int, int]]:
    """For each member of a region outside its commonest component: its nearest members of other components by sketch."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(labels), SHALLOW)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo > wide:
            todo += [(x, y, depth + 1) for x, y in _parts(labels, lo, hi, depth) if y - x > 1] if depth < DEPTH else [(k, min(hi, k + wide), depth) for k in range(lo, hi, wide)]
            continue
        own, count = np.unique(component[lo:hi], return_counts=True)
        if len(own) < 2:
            continue
        few = lo + np.flatnonzero(component[lo:hi] != own[count.argmax()])
        for at in range(0, len(few), 64):
            some = few[at : at + 64]
            agree = 128 - np.bitwise_count(sketch[some, None, :] ^ sketch[None, lo:hi, :]).sum(axis=2, dtype=np.int16)
            agree[component[some, None] == component[None, lo:hi]] = -1
            k = min(nearest, hi - lo)
            best = np.argpartition(-agree, k - 1, axis=1)[:, :k]
            for i, row, a in zip(some.tolist(), best.tolist(), np.take_along_axis(agree, best, axis=1).tolist(), strict=True):
                out += [(min(i, lo + j), max(i, lo + j)) for j, x in zip(row, a, strict=True) if x >= MIN_AGREE]
    return out


def _candidates(foreign: bool):
    """From leaves in order to candidate pairs. A batch's last region is carried over to the next; one that fills several batches is paired as far as it has come and goes on from its last leaves."""

    def pairs(label: np.ndarray, ids: np.ndarray, sketch: np.ndarray, component: np.ndarray, first: bool = False, last: bool = False) -> pa.RecordBatch | None:
        prefix = label[:, : 1 + 2 * SHALLOW]
        new = np.flatnonzero((prefix[1:] != prefix[:-1]).any(axis=1)) + 1
        edges = np.concatenate(([0], new, [len(label)]))
        left: list[int] = []
        right: list[int] = []
        # the regions at a partition's ends may have members in other partitions
        dense: list[int] = [] if foreign else [*range(int(edges[1]) if first else 0), *range(int(edges[-2]) if last else len(label), len(label))]
        for k in np.flatnonzero(np.diff(edges) > 1).tolist():
            lo, hi = int(edges[k]), int(edges[k + 1])
            if hi - lo == 2:
                found = [(0, 1)] if not foreign or component[lo] != component[lo + 1] else []
            else:
                raw = label[lo:hi, 1:].astype(np.uint32)
                values = raw[:, 0::2] << np.uint32(8) | raw[:, 1::2]
                found = foreign_pairs(values, sketch[lo:hi], component[lo:hi]) if foreign else region_pairs(values)
                if hi - lo > SMALL and not foreign:
                    dense += range(lo, hi)
            left += [lo + i for i, _ in found]
            right += [lo + j for _, j in found]
        if not left and not dense:
            return None
        i, j = np.array(left, int), np.array(right, int)
        agree = 128 - np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) if len(i) else np.zeros(0, int)
        good = (agree >= MIN_AGREE) & (ids[i] != ids[j])
        i, j, agree = i[good], j[good], agree[good]
        noted = np.unique(ids[np.array(dense, int)])
        a, b = (np.concatenate((f(ids[i], ids[j]), noted)) for f in (np.minimum, np.maximum))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate((agree, np.zeros(len(noted), int))).astype(np.int32))], ["a", "b", "agree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        first = True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label, sketch = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (0, 2))
            ids, component = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3))
            now = (label, ids, sketch, component)
            if kept is not None:
                now = tuple(np.concatenate(x) for x in zip(kept, now, strict=True))
            prefix = now[0][:, : 1 + 2 * SHALLOW]
            open_at = int(np.argmax((prefix == prefix[-1]).all(axis=1)))
            if open_at == 0 and len(prefix) > 4 * n:
                if (found := pairs(*now, first=first)) is not None:
                    yield found
                kept = tuple(x[-n:] for x in now)
                continue
            if open_at:
                if (found := pairs(*(x[:open_at] for x in now), first=first)) is not None:
                    yield found
                first = False
            kept = tuple(x[open_at:] for x in now)
        if kept is not None and (found := pairs(*kept, first=first, last=True)) is not None:
            yield found

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, component, sketch, text) to the shingles as signed numbers."""
    for batch in batches:
        sets = [shingle_hashes(normalised(t.as_py())).view(np.int64) for t in batch.column(3)]
        ends = np.cumsum([0, *map(len, sets)])
        flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
        for lo in range(0, len(sets), 256):  # small batches: the lists are opened next
            hi = min(lo + 256, len(sets))
            lists = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), flat[ends[lo] : ends[hi]])
            yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:3]), lists], ["id", "component", "sketch", "shingles"])


def _cells(percent: int):
    """The pairs of a left and a right member of different components in each cell that may still reach the similarity; rows come cell by cell.

    `rest` is how many shingles a member has from the shared one on: two members
    that first meet there share no more than the smaller rest.
    """

    def pairs(left: np.ndarray, ids: np.ndarray, sketch: np.ndarray, component: np.ndarray, few: np.ndarray, n: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        for lo in range(0, len(x), 256):
            for at in range(0, len(y), CELL):
                i, j = x[lo : lo + 256, None], y[None, at : at + CELL]
                can = (100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (n[i] + n[j])
                # two members outside the commonest component meet in both roles
                r, c = np.nonzero(can & (component[i] != component[j]) & ((ids[i] < ids[j]) | (~few[j] & (ids[i] != ids[j]))))
                if len(r):
                    i, j = i[r, 0], j[0, c]
                    alike = 128 - np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) >= MIN_AGREE
                    a, b = ids[i[alike]], ids[j[alike]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2)], axis=1).astype(np.int64)
            left, few = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (3, 7))
            sketch = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            ids, component, n, rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 6, 8, 9))
            now = (cell, left, ids, sketch, component, few, n, rest)
            if kept is not None:
                now = tuple(np.concatenate(x) for x in zip(kept, now, strict=True))
            edges = [0, *(1 + np.flatnonzero((now[0][1:] != now[0][:-1]).any(axis=1))).tolist()]
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield from pairs(*(x[lo:hi] for x in now[1:]))
            kept = tuple(x[edges[-1] :] for x in now)
        if kept is not None:
            yield from pairs(*kept[1:])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def of(key: int, text: str | None) -> np.ndarray:
            nonlocal held
            if key in sets:
                sets.move_to_end(key)
                return sets[key]
            s = sets[key] = shingle_hashes(normalised(text))
            held += len(s)
            while held > 4_000_000 and len(sets) > 2:
                held -= len(sets.popitem(last=False)[1])
            return s

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k in range(batch.num_rows):
                x, y = of(a[k], batch.column(2)[k].as_py()), of(b[k], batch.column(3)[k].as_py())
                both = common(x, y)
                good.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = materialize(rows.mapInArrow(_sign, "id long, key binary, n_shingles long, sig binary"))
    classes = materialize(signed.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")).filter("rep IS NOT NULL"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def candidates(members: DataFrame, foreign: bool) -> DataFrame:
        leaves = members.mapInArrow(_leaves, "label binary, id long, sketch binary, component long")
        ordered = leaves.repartitionByRange(parts, "label").sortWithinPartitions("label", "id")
        return ordered.mapInArrow(_candidates(foreign), "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))

    def rest_of(members: DataFrame) -> DataFrame:
        """Pairs of members of different components that may reach the similarity, by their rarest shingles.

        Only members that share a region with another component count. Their
        shingles are put in one order, rare ones first. Two sets of the
        similarity have a common shingle among the first of each, and from the
        first common one on each has as many as they must share; so members meet
        at each shingle that isn't too late in their order. At a shingle, each
        member outside its commonest component meets all others, in cells of
        about CELL by CELL members, so that no shingle is one task's work.
        """
        leaves = members.mapInArrow(_leaves, "label binary, id long, sketch binary, component long")
        leaves = leaves.select(F.substring("label", 1, 1 + 2 * SHALLOW).alias("region"), "id", "component")
        sizes = leaves.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        mixed = leaves.join(sizes.filter("least <> most").select("region").hint("merge"), "region", "left_semi").select("id").distinct()
        some = members.join(mixed.withColumnRenamed("id", "rep").hint("merge"), "rep", "left_semi").select(F.col("rep").alias("id"), "component", F.expr(f"substring(sig, {2 * VALUES + 1}, 16)").alias("sketch"))
        listed = some.join(texts.hint("merge"), "id").select("id", "component", "sketch", "text").mapInArrow(_listed, "id long, component long, sketch binary, shingles array<long>")
        listed = materialize(listed.withColumn("n", F.size("shingles").cast("long")))
        each = listed.select("id", "n", F.explode("shingles").alias("shingle"))
        shared = listed.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("f")).filter("f > 1")
        ranked = each.join(shared.hint("merge"), "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("in_order"))  # a member's own shingles
        # a member's other shingles come first: nobody else has them
        alone = F.col("n") - F.size("in_order")
        late = F.floor(F.col("n") * (100 - percent) / 100.0 + 1e-9).cast("long")
        early = ranked.filter(alone <= late).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("in_order", F.lit(1), (late - alone + 1).cast("int"))).alias("k", "s"))
        posted = early.select("id", F.col("s.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("k")).alias("rest"))
        posted = posted.join(listed.select("id", "component", "sketch", "n").hint("merge"), "id")
        most = posted.groupBy("shingle", "component").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("most"))
        mixed = most.filter("m > most.m").select("shingle", F.col("most.component").alias("most"), F.ceil((F.col("m") - F.col("most.m")) / CELL).cast("int").alias("rows"), F.ceil(F.col("m") / CELL).cast("int").alias("cols"))
        x = posted.join(mixed.hint("merge"), "shingle").withColumn("few", F.col("component") != F.col("most"))
        place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        cells = lambda n, at: F.transform(F.sequence(F.lit(0), F.col(n) - 1), at)
        cell = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
        right = cells("rows", lambda i: cell(i, place("cols"), False))
        both = F.concat(right, cells("cols", lambda j: cell(place("rows"), j, True)))
        x = x.select("shingle", F.explode(F.when(F.col("few"), both).otherwise(right)).alias("at"), "id", "sketch", "component", "few", "n", "rest").select("shingle", "at.i", "at.j", "at.left", "id", "sketch", "component", "few", "n", "rest")
        return x.repartition(parts, "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j").mapInArrow(_cells(percent), "a long, b long").distinct()

    found_pairs = materialize(candidates(classes.select("rep", "sig", F.lit(0).cast("long")), False))
    pairs, dense = found_pairs.filter("a < b"), found_pairs.filter("a = b").select(F.col("a").alias("rep"))

    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(dense).distinct()
    # sorted and merged whatever the sizes: what would be broadcast grows with the corpus
    texts = materialize(rows.join(ends.hint("merge"), rows["id"] == ends["rep"], "left_semi").groupBy("id").agg(F.min("text").alias("text")))

    def confirm(some: DataFrame) -> DataFrame:
        x = some.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
        x = x.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")
        return x.mapInArrow(_verify(percent), "a long, b long")

    best = F.struct((-F.col("agree")).alias("w"), F.col("to").alias("to"))
    ways = pairs.select(F.col("a").alias("x"), F.col("b").alias("to"), "agree").union(pairs.select(F.col("b").alias("x"), F.col("a").alias("to"), "agree"))
    # two for each: the best of either half of the others, so that no hub's candidates are joined
    best_two = ways.groupBy("x", F.pmod(F.xxhash64("to"), F.lit(2)).alias("half")).agg(F.min(best).alias("m"))
    chosen = best_two.select(F.least("x", "m.to").alias("a"), F.greatest("x", "m.to").alias("b")).distinct()
    chosen = materialize(chosen)
    links = materialize(confirm(chosen))
    found = materialize(components(links))

    tried, proposed = chosen, pairs.select("a", "b")
    for whole in (False, True):
        known = found.select(F.col("node").alias("rep"), "component")
        members = classes.join(dense, "rep", "left_semi").join(known, "rep", "left").select("rep", "sig", F.coalesce("component", "rep").alias("component"))
        near = rest_of(members) if whole else proposed.union(candidates(members, True).filter("a < b").select("a", "b")).distinct()
        rest = near.join(tried, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(known.select(F.col("rep").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        rest = materialize(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
        more = materialize(confirm(rest))
        if not more.isEmpty():
            stars = found.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
            found = materialize(components(stars.union(more)))
        tried = tried.union(rest)

    of_class = classes.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "key", "n_shingles").join(of_class, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id, all columns as they were.

    Of repeated rows one stays; a row with a null id stays if its component has
    no other; rows without words are copies of nothing, so all of them stay.
    """
    rows, row = told_apart(docs, id_col)
    found = near_dedup(rows, percent, row, text_col)
    if row == id_col:
        kept = found.filter("kept").select(row)
    else:
        key = F.col(f"`{id_col}`")
        ranked = found.join(rows.select(row, F.struct(key.isNull(), key, F.col(row)).alias("rank")), row)
        kept = ranked.groupBy("component_id").agg(F.min("rank").alias("best")).select(F.col(f"best.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
