"""MinHash near-duplicates: a chosen-path similarity join over shingle sets.

Equal sets meet first, by a 128-bit digest of the whole set. One document of
each such class goes down `trees` independent trees. At every node a document
follows one branch, chosen by the minwise token that the tree draws for that
depth; two sets of similarity s stay together with probability s a step.
Branching goes on while a node is large. Small nodes are compared exhaustively
on signatures; the candidates of a node are thinned to edge-disjoint maximum
spanning forests and confirmed on the full sets, which are computed from the
texts again. Groups are the connected components of the confirmed links. A
second pass compares the full sets of all candidates that thinning left out and
whose ends are still in different groups, node by node, so that thinning loses
no link that matters.

With similarity 0.85 and two steps before the first comparison, one tree keeps
a pair with probability 0.72, twelve trees with 1 - 2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkloom.llm.words import U, buffers, hash_words, mix, seeds, shingles, slices
from linkloom.operators.components import components
from linkloom.session import Workspace

SIGNATURE = 64
TREES = 12
FIRST_DEPTH = 2
MOST_DEPTH = 10
NODE = 128
FORESTS = 4
#: Documents outside its largest group with which a large node is compared at once, at the first depth already.
OUTSIDE = 512
#: Standard errors of a signature's estimate that a candidate may fall short of the threshold.
SLACK = 4.5
#: Ids (8 bytes each) that may be broadcast: 16 MB.
BROADCAST_IDS = 2_000_000
#: Shingles of all sets of a node (8 bytes each) that one task compares; larger nodes are compared pair by pair.
NODE_SHINGLES = 2_000_000

_MULT = seeds(SIGNATURE, 4242)


def _sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, soffs = shingles(*hash_words(data, offs), n)
    for a, b in zip(soffs[:-1].tolist(), soffs[1:].tolist(), strict=True):
        yield np.unique(flat[a:b])


def signature(tokens: np.ndarray) -> np.ndarray:
    """The least value of the tokens under each of the hash functions, 16 bits of it."""
    out = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=U)
    for at in range(0, len(tokens), 4096):
        np.minimum(out, (tokens[at : at + 4096, None] * _MULT).min(axis=0), out=out)
    # The high bits of a minimum are small numbers; the mixed value spreads over all 16.
    return (mix(out) >> U(48)).astype(np.uint16)


def _digest(tokens: np.ndarray) -> bytes:
    h = mix(tokens)
    return b"%016x%016x" % (int(np.add.reduce(h)), int(np.bitwise_xor.reduce(mix(h + U(7)))))


def signatures(docs: DataFrame, words: int = 3, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (of the whole set; null if it's empty), sig (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, keys, sigs = [], [], []
                for s in _sets(*buffers(part.column(1)), words):
                    sizes.append(len(s))
                    keys.append(_digest(s).decode() if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key string, sig binary")


def _brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures (doc_id, sig) with a byte for each hash function, for comparisons.

    Minima that are equal stay equal, so no candidate falls out; one in 256 others
    looks equal, which confirming on the full sets tells.
    """
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in sig.reshape(-1, SIGNATURE)], pa.binary())], ["doc_id", "sig"])


def _orders(trees: int) -> list[np.ndarray]:
    return [np.argsort(mix(np.arange(SIGNATURE, dtype=U) + U(1000 * (t + 1))), kind="stable") for t in range(trees)]


def _paths(trees: int, depth: int, most: int):
    """Rows (doc_id, tree, node, rest) at a depth from rows (doc_id, sig); rest: the tokens chosen from there to the greatest depth."""
    orders = _orders(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SIGNATURE)
            for t in range(trees):
                node = np.full(len(sig), t + 1, dtype=U)
                for d in range(depth):
                    node = mix(node * U(0x9E3779B97F4A7C15) + sig[:, orders[t][d]].astype(U))
                rest = np.ascontiguousarray(sig[:, orders[t][depth:most]])
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * (most - depth)), len(sig), [None, pa.py_buffer(rest.tobytes())]).cast(pa.binary()) if most > depth else pa.array([b""] * len(sig), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(sig), t, np.int32)), pa.array(node.view(np.int64)), packed], ["doc_id", "tree", "node", "rest"])

    return run


def _thinned(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> list[int]:
    """Indices of edges in FORESTS edge-disjoint spanning forests of greatest weight."""
    left = np.argsort(-weight, kind="stable").tolist()
    ii, jj, out = i.tolist(), j.tolist(), []
    for _ in range(FORESTS):
        parent, rest = list(range(n)), []
        for k in left:
            a, b = ii[k], jj[k]
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a == b:
                rest.append(k)
            else:
                parent[a] = b
                out.append(k)
        if not rest:
            break
        left = rest
    return out


def _edges(m: np.ndarray, least: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j and agreement of the pairs of signatures that agree enough; of different groups only, if given."""
    rows, cols, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(m) - 1):
        later = np.arange(k + 1, len(m)) if group is None else k + 1 + np.flatnonzero(group[k + 1 :] != group[k])
        if len(later):
            eq = np.count_nonzero(m[later] == m[k], axis=1)
            hit = np.flatnonzero(eq >= least)
            rows.append(np.full(len(hit), k))
            cols.append(later[hit])
            weights.append(eq[hit])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(weights)


def _compare(least: float):
    """Thinned candidate pairs of nodes given as node and lists (ids, sigs); nodes that lost some by it, without a pair."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seen: set[tuple[int, int]] = set()
            thinned = []
            for node, ids, sigs in zip(pdf["node"], pdf["ids"], pdf["sigs"], strict=True):
                ids = np.asarray(ids, dtype=np.int64)
                i, j, w = _edges(np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(ids), SIGNATURE), least)
                kept = _thinned(len(ids), i, j, w) if len(i) > FORESTS else range(len(i))
                if len(kept) < len(i):
                    thinned.append(node)
                for k in kept:
                    a, b = int(ids[i[k]]), int(ids[j[k]])
                    if a != b:
                        seen.add((min(a, b), max(a, b)))
            pairs = pd.DataFrame(sorted(seen), columns=["a", "b"], dtype="int64").astype("Int64")
            pairs["node"] = pd.array([pd.NA] * len(pairs), dtype="Int64")
            none = pd.array([pd.NA] * len(thinned), dtype="Int64")
            yield pairs
            yield pd.DataFrame({"a": none, "b": none, "node": pd.array(thinned, dtype="Int64")})

    return run


def _ends(least: float):
    """node, doc_id, grp of the documents of a node that have a candidate in another group, from lists (ids, sigs, groups)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for node, ids, sigs, groups in zip(pdf["node"], pdf["ids"], pdf["sigs"], pdf["groups"], strict=True):
                ids, grp = np.asarray(ids, dtype=np.int64), np.asarray(groups, dtype=np.int64)
                i, j, _ = _edges(np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(ids), SIGNATURE), least, grp)
                at = np.union1d(i, j)
                yield pd.DataFrame({"node": np.full(len(at), node, np.int64), "doc_id": ids[at], "grp": grp[at]})

    return run


def _full(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its set's hashes, sorted (binary), of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in _sets(*buffers(part.column(1)), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets, by products of incidence blocks."""
    n = len(sets)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(n), [len(x) for x in sets])
    place = np.cumsum(times > 1) - 1
    common = times[at] > 1
    own, at = own[common], place[at[common]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    out = np.zeros((n, n), dtype=np.int64)
    step = max(1, (1 << 20) // n)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, b = np.searchsorted(at, [lo, lo + step])
        block = np.zeros((n, step), dtype=np.float32)
        block[own[a:b], at[a:b] - lo] = 1
        out += (block @ block.T).astype(np.int64)
    return out


def _join_sets(percent: int):
    """Links between groups of a node that suffice to join them, from a list of (doc_id, grp, tokens)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for members in pdf["members"]:
                ids = [m["doc_id"] for m in members]
                sets = [np.frombuffer(m["tokens"], dtype=U) for m in members]
                both, n = shared_counts(sets), np.array([len(x) for x in sets])
                good = (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
                parent = {m["grp"]: m["grp"] for m in members}
                rows = []
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(good, 1))), strict=True):
                    a, b = members[i]["grp"], members[j]["grp"]
                    while parent[a] != a:
                        parent[a] = a = parent[parent[a]]
                    while parent[b] != b:
                        parent[b] = b = parent[parent[b]]
                    if a != b:
                        parent[a] = b
                        rows.append((ids[i], ids[j]))
                yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return run


def _pairs_of_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for ids, groups in zip(pdf["ids"], pdf["groups"], strict=True):
            ids, grp = np.asarray(ids, dtype=np.int64), np.asarray(groups, dtype=np.int64)
            for k in range(len(ids) - 1):
                other = ids[k + 1 :][grp[k + 1 :] != grp[k]]
                yield pd.DataFrame({"a": np.minimum(other, ids[k]), "b": np.maximum(other, ids[k])})


def tree_nodes(reps: DataFrame, ws: Workspace, trees: int = TREES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (node, doc_id) of the small nodes, and members (big, node, doc_id, low) of the others; the large nodes of the first depth in the same form.

    reps: doc_id, sig, n (size), one row for each distinct set. Nodes that stay large at
    the greatest depth hold near copies of one another; they are dealt at
    random into parts of node size, in each tree anew (big: the whole node,
    node: the part).
    """
    frontier = ws.cut(reps.select("doc_id", "sig").mapInArrow(_paths(trees, FIRST_DEPTH, MOST_DEPTH), "doc_id long, tree int, node long, rest binary"))
    leaves: list[DataFrame] = []
    dealt = early = frontier.select(F.col("node").alias("big"), "node", "doc_id", F.lit(0).cast("long").alias("low")).where("false")
    for depth in range(FIRST_DEPTH, MOST_DEPTH + 1):
        sizes = ws.cut(frontier.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1"))
        many = sizes.where(F.col("n") > NODE)
        # Large nodes are few, and their members don't go to one task.
        small = frontier.select("node", "doc_id").join(many.select("node"), "node", "left_anti")
        leaves.append(small.join(sizes.where(F.col("n") <= NODE).select("node"), "node").select("node", "doc_id"))
        if not many.head(1):
            break
        large = frontier.join(many, "node")
        parts = F.ceil(F.col("n") / NODE)
        in_parts = large.select(F.col("node").alias("big"), part_of("node", F.pmod(F.xxhash64("doc_id", "tree"), parts)).alias("node"), "doc_id", "low")
        if depth == FIRST_DEPTH:
            early = ws.cut(in_parts)
        if depth == MOST_DEPTH:
            dealt = in_parts
        else:
            # Each member takes its tokens along, so that a step down moves the large nodes' members only.
            token = F.substring("rest", 2 * (depth - FIRST_DEPTH) + 1, 2)
            frontier = ws.cut(large.select("doc_id", "tree", F.xxhash64("node", token).alias("node"), "rest"))
    members = leaves[0]
    for part in leaves[1:]:
        members = members.union(part)
    return members, dealt, early


def part_of(node, part):
    return F.xxhash64(node, part)


def _gathered(members: DataFrame, brief: DataFrame, *more) -> DataFrame:
    lists = [F.collect_list("doc_id").alias("ids"), F.collect_list("sig").alias("sigs"), *more]
    return members.join(brief, "doc_id").groupBy("node").agg(*lists).where(F.size("ids") > 1)


def near_links(reps: DataFrame, docs: DataFrame, words: int, percent: int, ws: Workspace, trees: int = TREES) -> DataFrame:
    """Confirmed links (a, b) whose connected components are those of all links found.

    Candidates share a node of a tree and have near signatures. The first pass
    confirms a few spanning forests of each node. The second takes the nodes
    that lost candidates to thinning, those dealt into parts, and the large ones
    of the first depth that one group all but fills, once more: documents
    outside the largest group of such a node meet all of its parts,
    and all candidates between different groups are compared on their full
    sets, in the node itself, which returns the links that join groups. Nodes
    of very long documents are compared pair by pair instead.
    """
    threshold = percent / 100
    least = (threshold - SLACK * (threshold * (1 - threshold) / SIGNATURE) ** 0.5) * SIGNATURE
    members, dealt, early = tree_nodes(reps, ws, trees)
    brief = ws.cut(reps.select("doc_id", "sig").mapInArrow(_brief, "doc_id long, sig binary"))
    dealt = ws.cut(dealt)
    first = members.union(dealt.select("node", "doc_id").union(dealt.select("node", F.col("low").alias("doc_id"))).distinct())
    found = ws.cut(_gathered(first, brief).select("node", "ids", "sigs").mapInPandas(_compare(least), "a long, b long, node long"))
    tested = ws.cut(found.where("a is not null").select("a", "b").distinct())
    links = ws.cut(confirmed(tested, docs, words, percent, ws))
    groups = ws.cut(components(links, ws))

    def grouped(rows: DataFrame) -> DataFrame:
        joined = rows.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return joined.withColumn("group", F.coalesce("component", "doc_id")).drop("component")

    lost = found.where("node is not null").select("node").distinct()
    small = grouped(members.join(lost, "node")).select("node", "doc_id", "group")
    both = dealt.select("big", "node", "doc_id", F.lit(False).alias("early")).union(early.select("big", "node", "doc_id", F.lit(True)))
    labelled = ws.cut(grouped(both).select("big", "node", "doc_id", "group", "early"))
    counts = labelled.groupBy("big", "early", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("big", "early").agg(F.max_by("group", F.struct("n", "group")).alias("largest"), (F.sum("n") - F.max("n")).alias("n")).where("n > 0")
    # Large nodes that one group all but fills are settled where branching hasn't parted border pairs yet.
    largest = largest.where(~F.col("early") | (F.col("n") <= OUTSIDE))
    chunks = largest.select("big", "largest", F.ceil(F.col("n") * 2 / NODE).alias("chunks"))
    inside = labelled.join(chunks, "big")
    # Chunks of the documents outside the largest group meet all parts of their node.
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    held = inside.withColumn("c", each).select(part_of("node", F.col("c")).alias("node"), "doc_id", "group")
    outside = inside.where(F.col("group") != F.col("largest")).select("big", "doc_id", "group", F.pmod(F.xxhash64("doc_id", "big"), F.col("chunks")).alias("c"))
    parts = inside.select("big", F.col("node").alias("part")).distinct()
    spread = outside.join(parts, "big").select(part_of("part", F.col("c")).alias("node"), "doc_id", "group")
    again = ws.cut(small.union(held.union(spread).distinct()))
    mixed = again.groupBy("node").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("node")
    rest = _gathered(again.join(mixed, "node"), brief, F.collect_list("group").alias("groups")).select("node", "ids", "sigs", "groups")
    ends = ws.cut(rest.mapInPandas(_ends(least), "node long, doc_id long, grp long").join(reps.select("doc_id", "n"), "doc_id"))
    weights = ends.groupBy("node").agg(F.sum("n").alias("weight"))
    light = ends.join(weights.where(F.col("weight") <= NODE_SHINGLES).select("node"), "node", "left_semi")
    heavy = ends.join(weights.where(F.col("weight") > NODE_SHINGLES).select("node"), "node", "left_semi")
    sets = ws.cut(_full(texts_of(docs, ws.cut(light.select("doc_id").distinct())), words))
    gathered = light.join(sets, "doc_id").groupBy("node").agg(F.collect_list(F.struct("doc_id", "grp", "tokens")).alias("members"))
    joined = gathered.select("members").mapInPandas(_join_sets(percent), "a long, b long")
    lists = heavy.groupBy("node").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("grp").alias("groups"))
    pairs = lists.select("ids", "groups").mapInPandas(_pairs_of_groups, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
    return links.union(joined).union(confirmed(pairs, docs, words, percent, ws))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text, once each, of the documents whose doc_id is in ids (distinct).

    Up to BROADCAST_IDS ids go to every task, so that other texts aren't moved;
    more are joined by a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, ws: Workspace) -> DataFrame:
    """The pairs whose full sets satisfy 100 * intersection >= percent * union."""
    pairs = ws.cut(pairs)
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = ws.cut(texts_of(docs, ws.cut(ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, sets = [batch.column(k).to_pylist() for k in (0, 2)], {}
            for side, col in ((0, 1), (1, 3)):
                need, at = [], []
                for k, d in enumerate(ids[side]):
                    if d not in kept and d not in sets:
                        sets[d] = None
                        need.append(d)
                        at.append(k)
                part = batch.column(col).take(pa.array(at, pa.int64()))
                for d, s in zip(need, _sets(*buffers(part), words), strict=True):
                    sets[d] = s
            good = []
            for a, b in zip(*ids, strict=True):
                x, y = kept.get(a, sets.get(a)), kept.get(b, sets.get(b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            kept = {ids[0][-1]: kept.get(ids[0][-1], sets.get(ids[0][-1]))} if ids[0] else {}
            keep = pa.array(np.flatnonzero(good), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(2).take(keep)], ["a", "b"])

    left = pairs.join(texts.toDF("a", "ta"), "a")
    full = left.join(texts.toDF("b", "tb"), "b").select("a", "ta", "b", "tb")
    return full.mapInArrow(_limited(run), "a long, b long")


def _limited(run, most: int = 4 << 20):
    """Feed `run` parts of batches that hold about `most` bytes of text."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                step = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)

        return run(parts())

    return inner


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = TREES, ws: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    A document's set holds its distinct shingles of `words` words; with fewer
    words, the whole sequence. Null texts and texts without words have the empty
    set and link with nothing. doc_id identifies a document; repeated rows with
    it are expected to be equal and all are returned. A row without doc_id is a
    group of its own (component_id null, kept). An empty table gives an empty
    result; other columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "near")
    sigs = ws.cut(signatures(docs, words))
    classes = sigs.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = ws.cut(classes)
    reps = classes.select(F.col("rep").alias("doc_id"), "sig", "n")
    # Written first: the next step would hold a second Python worker for each task.
    links = ws.cut(near_links(reps, docs, words, percent, ws, trees))
    comp = components(links, ws)
    labelled = classes.join(comp, classes["rep"] == comp["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.join(labelled, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
