"""Jaccard join of word shingles by a MinHash LSH forest (operator 9).

Texts with one set of shingles form a class, so copies never meet. Each class has TREES signatures of DEPTH MinHash
values, kept as byte strings; the sorted strings of a tree are a trie, and the classes below a node share a prefix.
The join starts from the longest prefixes that find a pair at the threshold with the recall START. Classes below one
node of any tree are candidates and are verified exactly. Then prefixes are shortened where there were matches: for
each class, the links found at depth d say how many were missed, since a link of similarity s is found with the chance
p = 1 - (1 - s ** d) ** trees and so stands for 1 / p links (a Horvitz-Thompson estimate). While the share missed is
above 1 - RECALL, the class looks below its nodes of depth d - 1, for partners that it has not met yet.

A candidate pair is verified once, in tasks, and no list of pairs is ever made or cut. Nodes of the same members count
once. Connected candidates that are few, or so dense that their nodes hold all pairs several times, are compared as one
group; otherwise node by node, each pair in the first tree that it shares, so long chains of candidates do not make
one large group. A group of very many classes is split into blocks, each pair of blocks is one task's work, and only
counts and one edge for each class leave it.

Words are parted by ASCII white space and compared as they are; a text of one to four words has one shingle, all its
words. Defined results: null, empty and blank texts have no shingles; they form one class and link to nothing else;
rows that repeat are members of one class; rows are told apart by numbers of their own, so null and repeated doc_ids
change nothing but the names of classes (least doc_id, null if there is none); other columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, cut, free_name, text_or_empty

K, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 6
#: Of pairs at the threshold, the share that the first prefixes find; of a class's links, the share that is found at the end.
START, RECALL = 0.999, 0.9999
#: Nodes that are broadcast to find their members, 8 bytes each; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Classes of a group that one task compares with as many others; larger groups are split.
BLOCK = 512
#: Matrix columns that are held at a time.
STRIPE = 4096


def shingles(text: str, k: int = K) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of k words."""
    words = re.findall(WORD, text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(len(words) - k + 1, 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


@functools.lru_cache(maxsize=2)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, dtype=np.uint32)


def min_hashes(found: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of a set, over blocks of it."""
    a, b = permutations(n)
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        best = np.minimum(best, (low[at : at + 2048, None] * a + b).min(axis=0))
    return best


def chance(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The chance that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, trees: int = TREES, deepest: int = DEPTH, recall: float = START) -> int:
    """The longest prefix that finds pairs at the threshold with the recall."""
    return next((d for d in range(deepest, 1, -1) if chance(threshold, d, trees) >= recall), 1)


def signed(rows: DataFrame, trees: int, k: int) -> DataFrame:
    """row, doc_id, set (the digest of the shingles) and signature (one byte string for each tree, two bytes of each value)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, signatures = [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, k)
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                values = min_hashes(found, trees * DEPTH).astype(">u2").reshape(trees, DEPTH) if len(found) else []
                signatures.append([x.tobytes() for x in values])
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(signatures, pa.list_(pa.binary()))]
            yield pa.record_batch(columns, names=["row", "doc_id", "set", "signature"])

    given = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return cut(given.mapInArrow(sign, "row long, doc_id long, set binary, signature array<binary>"), "signatures")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the least node of its component) for edges (a, b) of any comparable type.

    Each round every node hooks to its least smaller neighbour, hooks are followed to their ends, and edges are drawn
    between the ends, so only edges between different ends go on: a large star is gone after one round. What a
    round makes is written, so lineage and recovery stay short.
    """

    def between(a: Column, b: Column, rows: DataFrame) -> DataFrame:
        return cut(rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), f"{name}-edges")

    work, labels = between(F.col("a"), F.col("b"), edges), None
    while labels is None or work.limit(1).count():
        hooks = cut(work.groupBy("a").agg(F.min("b").alias("root")), f"{name}-hooks")
        while True:
            ends = hooks.select(F.col("a").alias("root"), F.col("root").alias("end"))
            moved = cut(hooks.join(ends, "root", "left").select("a", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), f"{name}-hooks")
            hooks = moved.select("a", "root")
            if not moved.where("moved").limit(1).count():
                break
        if labels is None:
            labels = hooks
        else:  # former ends are nodes now
            ends = hooks.select(F.col("a").alias("root"), F.col("root").alias("end"))
            labels = cut(labels.join(ends, "root", "left").select("a", F.coalesce("end", "root").alias("root")).union(hooks), f"{name}-labels")
        own, other = hooks.select("a", F.col("root").alias("end_a")), hooks.select(F.col("a").alias("b"), F.col("root").alias("end_b"))
        work = between(F.col("end_a"), F.coalesce("end_b", "b"), work.join(own, "a").join(other, "b", "left"))
    return labels.select(F.col("a").alias("node"), "root").union(labels.select("root", "root").distinct())


def below(classes: DataFrame, depth: int) -> DataFrame:
    """set, tree, node of each class and tree: the node of that depth, by a hash of the tree and the prefix."""
    spread = classes.select("set", F.posexplode("signature").alias("tree", "path"))
    return spread.select("set", "tree", F.xxhash64("tree", F.expr(f"substring(path, 1, {2 * depth})")).alias("node"))


def candidates(classes: DataFrame, depth: int, active: DataFrame | None) -> DataFrame:
    """node, tree, hub, n, set: the members of nodes with several, of those with an active class where active is given.

    Nodes with the same members, as copies with few changes have in most trees, are taken once, in the first tree.
    """
    spread = below(classes, depth)
    if active is not None:
        wanted = cut(below(classes.join(active, "set", "left_semi"), depth).select("node").distinct(), "forest-wanted")
        spread = spread.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "node", "left_semi")
    a, b = F.xxhash64("set"), F.xxhash64("set", F.lit(1))
    nodes = spread.groupBy("node").agg(F.min("tree").alias("tree"), F.min("set").alias("hub"), F.count("*").alias("n"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b")).where("n > 1")
    nodes = nodes.groupBy("hub", "n", "a", "b").agg(F.min(F.struct("tree", "node")).alias("first"))
    nodes = cut(nodes.select("first.node", "hub", "n"), "forest-nodes")
    return cut(spread.join(F.broadcast(nodes) if nodes.count() <= BROADCAST else nodes, "node").select("node", "tree", "hub", "n", "set"), "forest-members")


def units(members: DataFrame) -> DataFrame:
    """unit, tree, n, set: the groups in which candidates are compared. tree is -1 where a unit is a whole connected
    group, else the unit is a node of that tree."""
    groups = components(members.where("set <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b")), "forest")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    work = members.select("node", "hub", "n").distinct().join(groups, F.col("hub") == groups["node"]).groupBy("root").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    whole = (F.col("size") <= BLOCK) | (F.col("size") * F.col("size") <= F.col("work"))
    plan = cut(sizes.join(work, "root").select("root", "size", whole.alias("whole")), "forest-plan")
    dealt = cut(groups.join(plan, "root").select("node", "root", "size", "whole"), "forest-groups")
    own = dealt.where("whole").select(F.xxhash64("root").alias("unit"), F.lit(-1).alias("tree"), F.col("size").alias("n"), F.col("node").alias("set"))
    rest = members.join(dealt.where("NOT whole").select(F.col("node").alias("set")), "set", "left_semi")
    return own.unionByName(rest.select(F.col("node").alias("unit"), "tree", "n", "set"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each pair of sets, as products of 0/1 stripes over the elements of both sides."""
    everything = np.concatenate([*left, *right])
    values, counts = np.unique(everything, return_counts=True)
    values = values[counts > 1]
    out = np.zeros((len(left), len(right)), dtype=np.float64)

    def sides(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(values, flat)
        held = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == flat) if len(values) else np.zeros(len(flat), bool)
        return rows[held], at[held]

    (lr, lc), (rr, rc) = sides(left), sides(right)
    for at in range(0, len(values), STRIPE):
        width = min(STRIPE, len(values) - at)
        a, b = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        own, other = (lc >= at) & (lc < at + width), (rc >= at) & (rc < at + width)
        a[lr[own], lc[own] - at] = 1
        b[rr[other], rc[other] - at] = 1
        out += a @ b.T
    return out


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of each pair."""
    common = shared_counts(left, right)
    sizes = np.array([len(s) for s in left], dtype=np.float64)[:, None] + np.array([len(s) for s in right], dtype=np.float64)[None, :]
    return np.where(common > 0, common / np.maximum(sizes - common, 1), 0.0)


def paths(signatures: list[list[bytes]], depth: int) -> np.ndarray:
    """A 64-bit number for each class and tree that is equal where prefixes of this depth are."""
    values = np.frombuffer(b"".join(b"".join(s) for s in signatures), dtype=">u2").reshape(len(signatures), -1, DEPTH).astype(np.uint64)
    out = np.zeros(values.shape[:2], dtype=np.uint64)
    for d in range(depth):
        out = (out ^ values[:, :, d]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d + 1)
        out ^= out >> np.uint64(31)
    return out


def meets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share a prefix in some tree."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    for t in range(left.shape[1]):
        out |= left[:, t, None] == right[None, :, t]
    return out


def local_roots(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row that links lead to."""
    root = np.arange(len(hit))
    while True:
        near = np.minimum(root, np.where(hit, root[None, :], len(hit)).min(axis=1, initial=len(hit)))
        near = near[near]
        if (near == root).all():
            return root
        root = near


def verify(members: DataFrame, depth: int, first: bool, threshold: float, k: int, trees: int) -> DataFrame:
    """a, b, links, found, missed: for each class and pair of blocks, the least class that the links of these blocks lead
    to, the number of documents in the classes linked to it, the number of those classes, and for each depth from 1 on
    the links that an equal share of misses would have left out.

    members has unit, tree, n, set, weight, active, signature, text. Units of up to BLOCK classes are bundled, so a task
    sees about four blocks; a larger one is dealt into blocks by a hash, and each class goes to the pairs of blocks that
    hold its own. Verified are the pairs that meet at this depth, with an active class, not in an earlier tree than the
    unit's, and, unless this is the first depth, not at the depth before: those are known.
    """
    total = members.count()
    bundles = max(1, -(-total // (4 * BLOCK)))
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    bundle = F.pmod(F.xxhash64("unit"), F.lit(bundles))
    dealt = dealt.select(
        F.when(one, bundle).otherwise(F.col("unit")).alias("part"), F.when(one, F.lit(-1)).otherwise(F.least("own", "other")).alias("i"),
        F.when(one, F.lit(-1)).otherwise(F.greatest("own", "other")).alias("j"), "own", "unit", "tree", "set", "weight", "active", "signature", "text",
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, rows in frame.groupby(["unit", "tree"], sort=False):
            rows = rows.sort_values("set")
            names, weights, own, active = rows["set"].tolist(), rows["weight"].to_numpy(), rows["own"].to_numpy(), rows["active"].to_numpy(dtype=bool)
            i, j, tree = int(rows["i"].iloc[0]), int(rows["j"].iloc[0]), int(rows["tree"].iloc[0])
            signatures = [list(x) for x in rows["signature"]]
            at, deeper = paths(signatures, depth), None if first else paths(signatures, depth + 1)
            sets = [shingles(x, k) for x in rows["text"]]
            like = np.zeros((len(sets), len(sets)))
            left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(sets)),) * 2
            for start in range(0, len(left), BLOCK):
                some = left[start : start + BLOCK]
                wanted = (meets(at[some], at[right]) if tree < 0 else at[some][:, tree, None] == at[right][None, :, tree]) & (active[some][:, None] | active[right][None, :])
                if tree > 0:
                    wanted &= ~meets(at[some][:, :tree], at[right][:, :tree])
                if deeper is not None:
                    wanted &= ~meets(deeper[some], deeper[right])
                if wanted.any():
                    like[np.ix_(some, right)] = similarities([sets[x] for x in some], [sets[x] for x in right]) * wanted
            like = np.maximum(like, like.T)
            np.fill_diagonal(like, 0.0)
            hit = like >= threshold - 1e-9
            least = local_roots(hit)
            for x in np.flatnonzero(hit.any(axis=1)):
                found = like[x][hit[x]]
                missed = [float((1 / chance(found, d, trees) - 1).sum()) for d in range(1, DEPTH + 1)]
                out.append((names[x], names[least[x]], int(weights[hit[x]].sum()), len(found), missed))
        columns = list(zip(*out)) or [()] * 5
        kinds = ("int64", "int64", "int64", "int64", object)
        return pd.DataFrame({c: pd.Series(list(v), dtype=t) for c, v, t in zip(("a", "b", "links", "found", "missed"), columns, kinds)})

    return dealt.groupBy("part", "i", "j").applyInPandas(compare, "a long, b long, links long, found long, missed array<double>")


def linked_classes(rows: DataFrame, threshold: float, k: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """row, doc_id, set, weight of the numbered rows, and a, b, links for each class and group of partners that was verified.

    Classes are numbered by their first row from here on, in the column `set`.
    """
    signatures = signed(rows, trees, k)
    classes = signatures.groupBy("set").agg(F.min("row").alias("row"), F.count("*").alias("weight"), F.any_value("signature").alias("signature"))
    classes = cut(classes.select(F.col("set").alias("digest"), F.col("row").alias("set"), "weight", "signature"), "classes")
    depth = first = depth_for(threshold, trees, recall=START)
    active, found = None, None
    while True:
        dealt = units(candidates(classes, depth, active))
        own = classes.withColumn("active", F.lit(True)) if active is None else classes.join(active.withColumn("active", F.lit(True)), "set", "left").na.fill(False, ["active"])
        members = dealt.join(own.drop("digest"), "set").join(rows.select(F.col("row").alias("set"), text_or_empty().alias("text")), "set")
        links = cut(verify(cut(members, "members"), depth, depth == first, threshold, k, trees), "links")
        found = links if found is None else found.unionByName(links)
        if depth == 1:
            break
        missed = F.sum(F.get("missed", F.lit(depth - 1)))
        active = found.groupBy(F.col("a").alias("set")).agg(missed.alias("missed"), F.sum("found").alias("found"))
        active = cut(active.where(F.col("missed") > (1 - RECALL) * (F.col("missed") + F.col("found"))).select("set"), "forest-active")
        if not active.limit(1).count():
            break
        depth -= 1
    numbered = signatures.select("row", "doc_id", F.col("set").alias("digest")).join(classes.select("digest", "set", "weight"), "digest")
    return numbered.select("row", "doc_id", "set", "weight"), found.select("a", "b", "links")


def named_classes(rows: DataFrame, threshold: float, k: int, trees: int) -> DataFrame:
    """row, doc_id, root (the least class that links lead to), n_links of each numbered row."""
    numbered, found = linked_classes(rows, threshold, k, trees)
    joined = components(found, "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    linked = joined.join(links, F.col("node") == F.col("a")).select(F.col("node").alias("set"), "root", "links")
    named = numbered.join(linked, "set", "left")
    named = named.select("row", "doc_id", F.coalesce("root", "set").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return cut(named, "near-classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, trees: int = TREES) -> DataFrame:
    """doc_id, class_id and n_links of each document.

    class_id is the least doc_id of the documents that links join, directly or through others; n_links is the number
    of other documents whose shingles are similar to its own, copies included.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "near-rows")
    found = named_classes(rows, threshold, k, trees)
    least = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "root").select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, trees: int = TREES) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the least doc_id (null ids last; of equal ones, the
    first row). Rows without a word all stay."""
    row = free_name(docs, "row")
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = named_classes(docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, k, trees)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias(row))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return docs.where(~blank).join(kept, row, "left_semi").unionByName(docs.where(blank)).drop(row)
