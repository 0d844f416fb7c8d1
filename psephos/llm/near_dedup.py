"""Near-duplicate classes by ProbMinHash.

A document is its distinct five-word shingles, weighted by 1 + log2 of how often each stands in it.
ProbMinHash lets every shingle arrive at random registers as a Poisson process whose rate is its
weight and keeps in each register the shingle that comes first; shingles whose next arrival is later
than every register stop early.  Two documents agree in a register with the probability Jaccard of
their weighted shingles.  Texts that repeat shingles get a second signature with all weights 1 (for
others the two are the same): there the probability Jaccard is the plain Jaccard similarity.  Two texts
are linked if either similarity, computed exactly, is 0.8 or more.

BANDS bands of ROWS registers of each signature make the buckets (at 0.8, a pair has no common band
once in 100,000).  Texts of equal words (lower-cased, white space apart) are one node: copies are never
paired.  Classes are the connected components of links.  In each round every bucket that still holds
several components has one leader, and its members of other components are compared with that one, so
a round costs no more pairs than members.  Leaders are drawn anew in each bucket and round, from members
that haven't led it while there are any.  Rounds end when no bucket holds two components, when one finds
nothing new, or after ROUNDS.  Then all pairs that are left are compared: of each bucket that still holds
several components, every two members of different ones that haven't led it, in blocks of BLOCK members
(a bucket's blocks meet in many tasks).  So every two texts with a common bucket end in one class or have
been compared.  Texts are read for all pairs with a leader, and for those of the rest that may be linked by an
exact bound of both similarities (most_alike): no pair is left out by an estimate.

A text of fewer than five words is one shingle; null and empty texts have no words and are copies of
each other.  Rows without doc_id belong to no class (null).  Rows that share a doc_id count as one
document.  Long texts are read whole, one at a time.  Ties: a class is named by its least doc_id.  Extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import discard, slices, stored

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 50, 7
#: Rounds of leaders, before what is left is compared in full; one that finds nothing new is the last.
ROUNDS = 3
#: Members of a bucket that are compared with each other, or with as many others, at a time.
BLOCK = 256
#: A text's shingles are counted in so many cells, by frequency and by hash, to bound similarities; SLACK covers rounding.
LEVELS, CELLS, SLACK = 8, 16, 1e-4
#: Up to so many ids are sent to every executor (8 bytes each); beyond, Spark joins by a shuffle.
MOST_BROADCAST_IDS = 500_000

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the shingles in order; fewer words than a shingle are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(h), SHINGLE)))
    for k in range(min(len(h), SHINGLE)):
        out = _mix(out * _C + h[k : k + n])
    return out


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures (docs x registers) of weighted elements, many documents at once; doc ascends.

    Arrivals come in blocks, larger for documents of few elements; a block continues an element's
    process where its last one ended.
    """
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    block = np.maximum(1, -(-registers // np.maximum(1, np.bincount(doc, minlength=docs))))
    clock, count = np.zeros(len(element)), np.zeros(len(element), np.uint64)
    active = np.arange(len(element))
    while len(active):
        times = block[doc[active]]
        ends = np.cumsum(times)
        of = np.repeat(active, times)
        nth = np.arange(len(of)) - np.repeat(ends - times, times)
        draw = _mix(element[of] + (count[of] + nth.astype(np.uint64) + np.uint64(1)) * _C)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[of]
        run = np.cumsum(gap)
        at = run - np.repeat(run[ends - times] - gap[ends - times], times) + clock[of]
        count[active] += times.astype(np.uint64)
        clock[active] = at[ends - 1]
        place = doc[of] * registers + (_mix(draw + _A) % np.uint64(registers)).astype(np.int64)
        earlier = at < first[place]
        place, at, of = place[earlier], at[earlier], of[earlier]
        np.minimum.at(first, place, at)
        won = first[place] == at
        winner[place[won]] = element[of[won]]
        latest = first.reshape(docs, registers).max(axis=1)
        active = active[clock[active] < latest[doc[active]]]
    return winner.reshape(docs, registers)


def weighted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, and their weights."""
    found, counts = np.unique(shingles(words), return_counts=True)
    return found, 1.0 + np.log2(counts)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """One signature for each pair of shingles and weights."""
    doc = np.repeat(np.arange(len(texts)), [len(h) for h, _ in texts])
    flat = np.concatenate([h for h, _ in texts]) if texts else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in texts]) if texts else np.zeros(0)
    return prob_minhash(doc, flat, weight, len(texts), registers)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard similarity and probability Jaccard of two texts' weighted shingles.

    The latter sums 1 / sum_j max(x_j / x_i, y_j / y_i) over the common shingles i.  With the shingles in
    order of x / y, the maximum is the first quotient from i on and the second one before.
    """
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(at):
        return 0.0, 0.0
    plain = len(at) / (len(a[0]) + len(b[0]) - len(at))
    x, y = a[1][at], b[1][bt]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    from_i = np.cumsum(x[::-1])[::-1] + (a[1].sum() - x.sum())
    before_i = np.cumsum(y) - y + (b[1].sum() - y.sum())
    return plain, float((1.0 / (from_i / x + before_i / y)).sum())


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, its number included."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * _C + parts[:, :, r])
    return key.view(np.int64)


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


_LONG_LIST = pa.list_(pa.int64())
_SKETCH = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("bands", _LONG_LIST)])
_SKETCH_DDL = "doc_id long, digest binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, rows=64, chars=1_000_000):
        texts = [split_words(t) for t in part.column(1).to_pylist()]
        digests = [xxhash.xxh3_128_digest(" ".join(w)) for w in texts]
        seen = {d: i for i, d in reversed(list(enumerate(digests)))}  # a batch's copies are sketched once
        own = sorted(i for d, i in seen.items() if texts[i])
        each = {i: weighted(texts[i]) for i in own}
        again = [i for i in own if each[i][1].max() > 1]  # texts that repeat shingles
        signed = signatures([*(each[i] for i in own), *((each[i][0], np.ones(len(each[i][0]))) for i in again)])
        keys = band_keys(signed).tolist()
        plain = {i: len(own) + n for n, i in enumerate(again)}
        bands = {i: sorted({*keys[n], *keys[plain.get(i, n)]}) for n, i in enumerate(own)}
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array([bands.get(seen[d], []) for d in digests], _LONG_LIST)], schema=_SKETCH)
    _words.clear()  # other operators' tasks share the worker


_MEMBER = ("node", "comp", "led")
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_b, own_b = None, None
    for part in slices(batches, rows=64):
        links = []
        for b, comp_a, comp_b, text_a, text_b in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if b != last_b:
                last_b, own_b = b, weighted(split_words(text_b))
            if max(similarities(weighted(split_words(text_a)), own_b)) >= SIMILARITY - 1e-9:
                links.append((comp_a, comp_b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=_PAIR)


_POSTING = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("version", pa.int64()), ("comp", pa.int64()), ("weight", pa.float64())])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct shingle of a text; texts that share a node are versions."""
    for part in slices(batches, rows=64, chars=1_000_000):
        for node, comp, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            words = split_words(text)
            found, weight = weighted(words)
            version = xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
            for at in range(0, len(found), 10_000):
                own = found[at : at + 10_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.full(len(own), x)) for x in (node, version, comp)), pa.array(weight[at : at + 10_000])], schema=_POSTING)
    _words.clear()


_FOLDED = pa.schema([("node", pa.int64()), ("size", pa.float64()), ("total", pa.float64()), ("scale", pa.float64()), ("cells", pa.binary())])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's size, total weight and cells: counts, and where they differ weights and largest weights, in bytes that are rounded up."""
    for part in slices(batches):
        node, lists = part.column(0), part.column(1)
        out = []
        for of in lists.to_pylist():
            sums = np.zeros((3, LEVELS * CELLS + 1))
            sums[:, [x["cell"] for x in of]] = np.array([(x["n"], x["w"], x["m"]) for x in of]).T
            scale = max(1.0, sums[:, :-1].max() / 255)
            cells = np.minimum(255, np.ceil(sums[:, :-1] / scale - 1e-9)).astype(np.uint8)
            out.append((sums[0].sum(), sums[1].sum(), scale, (cells[:1] if (cells[1:] == cells[0]).all() else cells).tobytes()))
        yield pa.RecordBatch.from_arrays([node, *(pa.array([x[i] for x in out], _FOLDED.field(i + 1).type) for i in range(4))], schema=_FOLDED)


def _cells(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, size, total, scale, cells) of the nodes that are open, one row for each text.

    Cells are by how many open texts hold a shingle (LEVELS, of two octaves) and by its hash.  Only shingles
    that stand in several components are in a cell: no two texts of unlike components share others.
    """
    postings = open_.select("node", "comp").distinct().join(texts, "node").select("node", "comp", "text").mapInArrow(_postings, "shingle long, node long, version long, comp long, weight double")
    postings = stored(postings, "postings")
    common = postings.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.max("weight").alias("most")).filter("x < y")
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log2("n") / 2)).cast("int")
    common = stored(common.select("shingle", "most", (level * CELLS + F.pmod("shingle", F.lit(CELLS)).cast("int")).alias("cell")), "common")
    sums = postings.join(common, "shingle", "left").groupBy("node", "version", F.coalesce("cell", F.lit(LEVELS * CELLS)).alias("cell")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.coalesce("most", "weight")).alias("m"))
    lists = sums.groupBy("node", "version").agg(F.collect_list(F.struct("cell", "n", "w", "m")).alias("of"))
    folded = stored(lists.select("node", "of").mapInArrow(_folded, "node long, size double, total double, scale double, cells binary"), "cells")
    discard(postings, common)
    return folded


class _Members:
    """Members of a block, their cells as arrays (members x cells)."""

    def __init__(self, block: pa.StructArray):
        self.node, self.comp, self.size, self.total, scale = (block.field(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "size", "total", "scale"))
        each = [np.frombuffer(c, np.uint8).reshape(-1, LEVELS * CELLS) for c in block.field("cells").to_pylist()]
        self.cells = np.stack([np.broadcast_to(c, (3, LEVELS * CELLS)) for c in each], axis=1) * scale[None, :, None]


def most_alike(x: _Members, y: _Members, cells_x: np.ndarray, cells_y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound of both similarities of the texts i of x and j of y.

    Of a cell, two texts share no more than the smaller of their counts, and of a text's weight no more than
    the other's shingles weigh at most.  So the plain similarity is bounded; the probability Jaccard is at
    most pq / (p + q - pq), where p and q are the shares of the two texts' weights that both hold.
    """
    (n_x, w_x, m_x), (n_y, w_y, m_y) = cells_x, cells_y
    both = np.minimum(n_x[i], n_y[j]).sum(axis=1)
    p = np.minimum(1, np.minimum(w_x[i], m_y[j]).sum(axis=1) / x.total[i])
    q = np.minimum(1, np.minimum(m_x[i], w_y[j]).sum(axis=1) / y.total[j])
    return np.maximum(both / (x.size[i] + y.size[j] - both), p * q / np.maximum(p + q - p * q, 1e-300))


_REST = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("comp_a", pa.int64()), ("comp_b", pa.int64())])


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of different components that may be linked, of two blocks of a bucket."""
    for batch in batches:
        for row in range(batch.num_rows):
            x, y = (_Members(batch.column(at)[row].values) for at in (0, 1))
            i, j = np.nonzero(x.comp[:, None] != y.comp[None, :])
            for cells_x, cells_y in ((x.cells.sum(axis=2, keepdims=True), y.cells.sum(axis=2, keepdims=True)), (x.cells, y.cells)):  # all cells as one first
                keep = [most_alike(x, y, cells_x, cells_y, i[k : k + 2_000], j[k : k + 2_000]) >= SIMILARITY - SLACK for k in range(0, len(i), 2_000)]
                keep = np.concatenate([*keep, np.zeros(0, bool)])
                i, j = i[keep], j[keep]
            a, b, comp_a, comp_b = x.node[i], y.node[j], x.comp[i], y.comp[j]
            turn = a > b
            a, b, comp_a, comp_b = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, comp_b, comp_a), np.where(turn, comp_a, comp_b)
            for part in range(0, len(a), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[part : part + 10_000], pa.int64()) for v in (a, b, comp_a, comp_b)], schema=_REST)


def _rest(state: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b) that no leader showed and that may be linked: members of different components of a bucket that haven't led it."""
    open_ = state.filter("NOT led")
    mixed = stored(open_.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x < y").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    placed = stored(open_.join(mixed, "bucket").select("bucket", "node", "comp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "placed")
    placed = placed.join(_cells(placed, texts), "node")
    blocks = stored(placed.groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct("node", "comp", "size", "total", "scale", "cells")).alias("m")), "blocks")
    one = blocks.select("bucket", F.col("m").alias("one"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    both = one.join(blocks.select("bucket", "block", F.col("m").alias("two")), ["bucket", "block"])
    found = both.select("one", "two").mapInArrow(_near_in_blocks, "a long, b long, comp_a long, comp_b long")
    return found.distinct()


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components (a, b), by the candidate pairs (a, b, comp_a, comp_b)."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("b", "comp_a", "comp_b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each component, for the nodes that edges (a, b) name.

    Large-star and small-star steps in turn; each is written to the shared folder, and the driver
    sees only a count and a checksum.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        spread = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(spread.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))


def _merged(found: DataFrame, comps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(comp, root) of the components that new links merge, and of all that have been merged so far."""
    merged = stored(components(found).select(F.col("node").alias("comp"), F.col("comp").alias("root")), "components")
    discard(found)
    if comps is None:
        return merged, merged
    before = comps.select(F.col("comp").alias("was"), F.col("root").alias("comp")).join(merged, "comp", "left").select(F.col("was").alias("comp"), F.coalesce("root", "comp").alias("root"))
    return merged, stored(before.unionByName(merged.join(before.select("comp"), "comp", "left_anti")), "components")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of (least doc_id of its exact copies), class_id (least doc_id of its class)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(docs.mapInArrow(_sketch, _SKETCH_DDL), "sketch")
    nodes = sketch.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("digest", "node", "bands"), "nodes")

    # Buckets of at least two nodes.  Counting is pre-aggregated; the join is split where a bucket is large.
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    # Joins here are of stored tables: adaptive execution can't split one side that is aggregated on the way.
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    shared = stored(shared.select("bucket"), "shared")
    members = stored(buckets.join(shared, "bucket", "left_semi"), "buckets")
    discard(shared)
    involved = stored(members.select("node").distinct(), "involved")
    few = involved.count() <= MOST_BROADCAST_IDS
    named = F.broadcast(involved) if few else involved
    texts = stored(docs.withColumnRenamed("doc_id", "node").join(named, "node", "left_semi"), "texts").dropDuplicates(["node", "text"])
    table = members
    state = members.select("bucket", "node", F.col("node").alias("comp"), F.lit(False).alias("led"))

    comps = None  # (comp, root): the rounds' components, for those that have been merged
    for step in range(ROUNDS):
        order = F.struct("led", F.xxhash64(F.lit(step), "bucket", "node").alias("o"), "node", "comp")
        leader = state.groupBy("bucket").agg(F.min(order).alias("l"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
        leader = leader.select("bucket", F.col("l.node").alias("b"), F.col("l.comp").alias("comp_b"))
        leader = stored(leader, "leaders")
        met = state.join(leader, "bucket").withColumns({"led": F.col("led") | (F.col("node") == F.col("b")), "unlike": F.col("comp") != F.col("comp_b")})
        last, table = table, stored(met.select("bucket", *_MEMBER, "b", "comp_b", "unlike"), "members")
        state = table
        discard(last, leader)
        pairs = state.filter("unlike").select(F.col("node").alias("a"), "b", F.col("comp").alias("comp_a"), "comp_b").distinct()
        found = stored(_links(pairs, texts), "links")
        state = state.select("bucket", *_MEMBER)
        if not found.limit(1).count():
            break
        merged, comps = _merged(found, comps)
        state = state.join(merged, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).select("bucket", *_MEMBER)
    state = stored(state, "members")
    discard(table)
    found = stored(_links(_rest(state, texts), texts), "links")
    if found.limit(1).count():
        comps = _merged(found, comps)[1]

    classes = nodes.select("digest", "node")
    if comps is not None:
        classes = classes.join(comps.withColumnRenamed("comp", "node"), "node", "left").select("digest", F.col("node").alias("copy_of"), F.coalesce("root", "node").alias("class_id"))
    else:
        classes = classes.select("digest", F.col("node").alias("copy_of"), F.col("node").alias("class_id"))
    return sketch.select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("copy_of")).alias("copy_of"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but the least doc_id of each class; rows without doc_id stay."""
    classes = stored(near_duplicate_classes(docs), "classes")
    gone = classes.filter("doc_id <> class_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST_IDS else gone
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = classes.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not repeated:
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))
