"""Near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets become one node first. Independent trees then
branch all nodes by selected minwise tokens: at a root by one or two minima of its own hash functions, below it by positions
of a minwise sketch that are drawn anew for each tree node, one or two of them, so that a pair at the threshold goes on
together in one branch or more on average. A tree node with few members is a leaf and is compared exhaustively by sketches
there; a larger one is branched again, however deep, as long as that leaves SHRINK of its members or fewer. Near copies that
stay together are dealt to random blocks with common pivots, anew in each tree, so no group is ever held whole. A leaf gives a forest of
the links that the sketches leave possible, not all pairs. The forests of all trees join into clusters; what the blocks left apart then
meets every other member of its tree node, block against block. Within a cluster all links are decided on the full sets,
and again only a forest of the confirmed links goes on. A large cluster is decided in the leaves that its members share,
then against the members with the most links, and what is still apart from its largest component meets every other member,
block against block. Components are labels spread over those forests.

A pair at the threshold t meets at a root with probability 1 - (1 - t)^ROOTS; its sketch estimate may fall five standard
errors below t.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; repeated rows and equal texts are one component; a null doc_id takes part in links but names no
component unless all others of it are null too; an empty table gives an empty result; further columns are ignored (the
pipeline's stage keeps those of ``documents``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, fresh, mapped, partitions_of, prepare, slices, stored, table
from lodestar.llm.shingles import mix, shingles

#: Minima that the roots of all trees branch by, trees, sketch positions, members of a leaf.
ROOTS, TREES, SKETCH, LEAF = 12, 10, 128, 2048
#: Of a hundred tree nodes below a root, those that are branched by two positions; the share of a node below which its child is
#: branched again (as TWICE and it make less than one, rows get fewer from level to level); members that every block of near
#: copies gets.
TWICE, SHRINK, PIVOTS = 30, 0.7, 32
#: Shingles of a cluster that one task compares.
LARGE = 6_000_000


def sketch(hashes: np.ndarray) -> bytes:
    """One byte of the least hash in each of SKETCH ranges; an empty range borrows from ranges in an order of its own."""
    edges = (np.arange(SKETCH, dtype=np.uint64) << np.uint64(57)) if SKETCH == 128 else (np.arange(SKETCH, dtype=np.uint64) * np.uint64((1 << 64) // SKETCH))
    at = np.searchsorted(hashes, edges)
    until = np.append(at[1:], len(hashes))
    full = at < until
    value = np.where(full, hashes[np.minimum(at, len(hashes) - 1)], 0)
    if not full.all():
        empty, turn = np.nonzero(~full)[0], 0
        while len(empty):
            turn += 1
            take = (mix(empty.astype(np.uint64) * np.uint64(65_537) + np.uint64(turn), 7) % np.uint64(SKETCH)).astype(np.int64)
            ok = full[take]
            value[empty[ok]] = value[take[ok]]
            empty = empty[~ok]
    return (mix(value, 3) & np.uint64(255)).astype(np.uint8).tobytes()


def root_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the keys of the tree nodes below the roots: its least value under each root's hash functions."""
    sizes = np.array([len(s) for s in sets])
    flat, begins = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = np.empty((len(sets), ROOTS), dtype=np.uint64)
    for k in range(ROOTS):
        out[:, k] = mix(np.minimum.reduceat(mix(flat, 100 + k), begins), 1000 + 16 * (k % TREES) + k // TREES)
    return out.view(np.int64)


def nodes(docs: DataFrame, size: int) -> DataFrame:
    """Of each document (its columns but the text, longs): the number of its shingles, the node of its set (null if empty), its sketch and root keys."""
    rest = [c for c in docs.columns if c != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in rest), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])
        for batch in slices(batches):
            sets = shingles([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], size)
            full = [i for i, s in enumerate(sets) if len(s)]
            node, marks, keys = ([None] * len(sets) for _ in range(3))
            found = root_keys([sets[i] for i in full]).tolist() if full else []
            for i, k in zip(full, found, strict=True):
                node[i], marks[i], keys[i] = name(sets[i]), sketch(sets[i]), k
            yield batch_of(schema, *(batch.column(c) for c in rest), [len(s) for s in sets], node, marks, keys)

    return mapped(docs, each, "".join(f"{c} long, " for c in rest) + "n_shingles long, node long, sketch binary, keys array<long>")


def name(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups from batches that are sorted by a key, several at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))  # ascending
        if last or held and held[0].column(key)[-1] != batch.column(key)[0]:
            if last:
                held.append(batch.slice(0, last))
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join what was apart."""
    parent, out = list(range(n)), []
    for a, b in links:
        x, y = root(parent, a), root(parent, b)
        if x != y:
            parent[y] = x
            out.append((a, b))
    return out


def possible(marks: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a leaf whose sizes and sketches allow the similarity."""
    t = percent / 100
    step = max(1, (32 << 20) // max(1, marks.size))
    for i in range(0, len(marks), step):
        alike = (marks[i : i + step, None, :] == marks[None, :, :]).sum(axis=2, dtype=np.int32) / marks.shape[1]
        low, high = np.minimum(sizes[i : i + step, None], sizes[None, :]), np.maximum(sizes[i : i + step, None], sizes[None, :])
        least = t - 5 * np.sqrt(t * (1 - t) / np.minimum(low, marks.shape[1]))
        a, b = np.nonzero(((alike * 256 - 1) / 255 >= least) & (low * 100 >= percent * high))
        a = a + i
        yield from zip(a[a < b].tolist(), b[a < b].tolist(), strict=True)


def candidate_forest(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for group in grouped(batches, "key"):
            keys, ids = group.column("key").to_numpy(), group.column("part" if "part" in group.column_names else "node").to_numpy()
            sizes = group.column("n_shingles").to_numpy()
            marks = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), SKETCH)
            edges = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
            out: list[tuple[int, int]] = []
            many = np.diff(edges)
            # Leaves of two, by far the most, at once.
            at = edges[:-1][many == 2]
            if len(at):
                low, high = np.minimum(sizes[at], sizes[at + 1]), np.maximum(sizes[at], sizes[at + 1])
                t = percent / 100
                alike = ((marks[at] == marks[at + 1]).mean(axis=1) * 256 - 1) / 255
                good = at[(alike >= t - 5 * np.sqrt(t * (1 - t) / np.minimum(low, SKETCH))) & (low * 100 >= percent * high)]
                out += zip(ids[good].tolist(), ids[good + 1].tolist(), strict=True)
            for a, b in zip(edges[:-1][many > 2].tolist(), edges[1:][many > 2].tolist(), strict=True):
                out += ((int(ids[a + x]), int(ids[a + y])) for x, y in forest(b - a, possible(marks[a:b], sizes[a:b], percent)))
            if found := {(min(p), max(p)) for p in out if p[0] != p[1]}:
                yield batch_of(schema, *zip(*sorted(found), strict=True))

    return compare


def leaves(reps: DataFrame, what: str = "") -> tuple[list[DataFrame], DataFrame | None]:
    """Members of all leaves of the trees (key, node, n_shingles, sketch), by depth; nodes alone in a tree node are in none.

    Also the members of the tree nodes that were dealt to blocks, if there may be any."""
    level = reps.select(F.explode("keys").alias("key"), "node", "n_shingles", "sketch", F.lit(None).cast("long").alias("was"), F.lit(False).alias("dealt"))
    out, crowded = [], None
    while True:
        # Written first, and merged even where small: only a merge join of two plain exchanges has a hot key's rows dealt to several tasks.
        counts = stored(level.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), f"counts{what}")
        level = stored(level.join(counts.hint("merge"), "key"), f"tree{what}")
        leaf = F.col("dealt") | (F.col("members") <= LEAF)
        out.append(level.where(leaf).select("key", "node", "n_shingles", "sketch"))
        large = level.where(~leaf)
        if large.isEmpty():
            return out, crowded
        # Branch again, by sketch positions that are drawn for each tree node.
        to = []
        for k in range(2):
            position = F.pmod(F.xxhash64("key", F.lit(k)), F.lit(SKETCH)).cast("int")
            to.append(F.xxhash64("key", F.lit(k), F.substring(F.col("sketch"), position + 1, F.lit(1))))
        twice = F.pmod(F.xxhash64("key", F.lit("twice")), F.lit(100)) < TWICE
        stuck = F.coalesce(F.col("members") > SHRINK * F.col("was"), F.lit(False))
        branched = F.when(twice, F.array(*to)).otherwise(F.array(to[0]))
        # What agrees in so many tokens and still is large are near copies throughout: random blocks, each with the same few
        # pivots, which tie the blocks together. Each root's tree deals its blocks anew.
        blocks = F.ceil(F.col("members") / (LEAF - 2 * PIVOTS)).cast("int")
        pivot = F.pmod(F.xxhash64("node", "key", F.lit("pivot")), F.col("members")) < PIVOTS
        one = F.pmod(F.xxhash64("key", "node"), blocks).cast("int")
        dealt = F.transform(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(one)), lambda n: F.xxhash64("key", n))
        some = large.where(stuck).select("key", "node", "n_shingles", "sketch")
        crowded = some if crowded is None else crowded.unionAll(some)
        level = large.select(F.explode(F.when(stuck, dealt).otherwise(branched)).alias("key"), "node", "n_shingles", "sketch", F.col("members").alias("was"), stuck.alias("dealt"))


def across(members: DataFrame, what: str) -> DataFrame:
    """Bounded units (unit, then the members' columns) in which each pair of a group meets unless both are of its largest part.

    Members are key (of the group), part, node and n_shingles, and what else they have. Those outside the largest part are
    dealt to blocks, all members to others, and each block of the former is a unit with each of the latter."""
    columns = [c for c in members.columns if c != "key"]
    parts = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    parts = stored(parts, f"parts{what}")
    groups = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.max_by("w", F.struct("n", "part")).alias("top_w"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / F.lit(LEAF / 2), w / F.lit(LARGE / 2))).cast("int")
    groups = groups.where("n > top.n").select("key", F.col("top.part").alias("top"), blocks(F.col("n"), F.col("w")).alias("all_blocks"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top_w")).alias("apart_blocks"))
    dealt = members.join(stored(groups, f"groups{what}").hint("merge"), "key")
    one = F.pmod(F.xxhash64("node", F.lit("all")), "all_blocks").cast("int")
    other = F.pmod(F.xxhash64("node", F.lit("apart")), "apart_blocks").cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("apart_blocks") - 1), lambda i: F.xxhash64("key", i, one))
    more = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda j: F.xxhash64("key", other, j))
    to = F.when(F.col("part") != F.col("top"), F.array_union(to, more)).otherwise(to)
    return dealt.select(F.explode(to).alias("unit"), *columns)


def beside_hubs(large: DataFrame, sure: DataFrame) -> DataFrame:
    """Units of the members of large clusters (label, node, rep, n_shingles, members, weight), each with members that have many links."""
    degree = sure.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    linked = large.join(degree.hint("merge"), "node")
    hubs = linked.groupBy("label", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("bucket")).agg(F.max(F.struct("degree", "node", "rep")).alias("hub"))
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(LEAF / 2), F.col("weight") / F.lit(LARGE / 2))).cast("int")
    unit = F.xxhash64(F.lit("hubs"), "label", F.pmod(F.xxhash64("node", F.lit("all")), blocks).cast("int"))
    sums = large.select("label", blocks.alias("blocks")).distinct()
    again = hubs.join(sums, "label").select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hub.node", "hub.rep")
    again = again.select(F.xxhash64(F.lit("hubs"), "label", "block").alias("unit"), "node", "rep")
    return large.select(unit.alias("unit"), "node", "rep").unionAll(again)


def components(edges: DataFrame, what: str) -> DataFrame:
    """node, label: the least node that can be reached. Labels spread along edges, then along labels, until none changes."""
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a")).distinct(), f"{what}-edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), f"{what}-labels")
    while True:
        near = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.v).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = spread.alias("s").join(labels.select(F.col("node").alias("at"), F.col("label").alias("far")), F.col("s.label") == F.col("at"))
        new = stored(jump.select("s.node", F.least("s.label", "far").alias("label"), (F.least("s.label", "far") != F.col("s.was")).alias("moved")), f"{what}-labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after further links between labels, or nodes that had none."""
    moved = components(links, "joined")
    alone = moved.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    least = moved.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return labels.unionAll(alone).join(least, "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links of some sets, decided on the full sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) <= 24:
        parent, out = list(range(len(sets))), []
        for a, b in combinations(range(len(sets)), 2):
            if min(sizes[a], sizes[b]) * 100 >= percent * max(sizes[a], sizes[b]) and root(parent, a) != root(parent, b):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (sizes[a] + sizes[b] - both):
                    parent[root(parent, b)] = root(parent, a)
                    out.append((a, b))
        return out
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        some = np.zeros((len(sets), width), dtype=np.float32)
        some[row[a:b], column[a:b] - first] = 1
        both += some @ some.T
    both = both.astype(np.int64)
    x, y = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    return forest(len(sets), zip(x.tolist(), y.tolist(), strict=True))


def confirmed(members: DataFrame, size: int, percent: int) -> DataFrame:
    """A forest of the links within each unit; members are unit, node and a text of that node, and its part if only links of parts are asked for."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def close(names: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if found := {(min(names[x], names[y]), max(names[x], names[y])) for x, y in linked(sets, percent) if names[x] != names[y]}:
                yield batch_of(schema, *zip(*sorted(found), strict=True))

        unit, ids, names, sets = None, [], [], []
        for batch in slices(batches):
            hashed = shingles([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], size)
            parts = batch.column("part" if "part" in batch.schema.names else "node").to_pylist()
            for u, node, part, s in zip(batch.column("unit").to_pylist(), batch.column("node").to_pylist(), parts, hashed, strict=True):
                if u != unit:
                    yield from close(names, sets)
                    unit, ids, names, sets = u, [], [], []
                if name(s) == node and (not ids or ids[-1] != node):
                    ids.append(node)
                    names.append(part)
                    sets.append(s)
        yield from close(names, sets)

    dealt = members.repartition(partitions_of(members.sparkSession), "unit").sortWithinPartitions("unit", "node")
    return mapped(dealt, compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (whether that is its own)."""
    out = grouped_rows(docs.select("doc_id", "text"), size, percent)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def grouped_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """All columns of each row but its text, n_shingles, cluster (the node that names its group, null without words) and component_id."""
    found = stored(nodes(docs, size), "sets")
    rest = [c for c in docs.columns if c != "text"]
    docs = docs.select("doc_id", "text")
    reps = found.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    reps = stored(reps, "nodes")
    levels, crowded = leaves(reps)

    def possible_links(leaf: DataFrame) -> DataFrame:
        dealt = leaf.repartition(partitions_of(docs.sparkSession), "key").sortWithinPartitions("key")
        return mapped(dealt, candidate_forest(percent), "a long, b long").distinct()

    links = possible_links(levels[0])
    for leaf in levels[1:]:
        links = links.unionAll(possible_links(leaf))
    clusters = components(links, "clusters")
    if crowded is not None:
        parted = crowded.join(clusters.hint("merge"), "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label")
        again = stored(possible_links(across(stored(parted, "crowded"), "-crowded").withColumnRenamed("unit", "key")), "possible")
        if not again.isEmpty():
            clusters = stored(joined(clusters, again), "clusters")
    sized = clusters.join(reps.select("node", "rep", "n_shingles"), "node")
    sums = sized.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"))
    sized = stored(sized.join(sums, "label").withColumn("whole", (F.col("members") <= LEAF) & (F.col("weight") <= LARGE)), "clusters")
    # A cluster is one unit; members of a large one meet in the leaves they share instead, and then across those.
    units = sized.where("whole").select(F.col("label").alias("unit"), "node", "rep")
    large = sized.where("NOT whole")
    split = not large.isEmpty()
    if split:
        shared = [leaf.join(large.select("node", "rep", "label"), "node").select(F.xxhash64("key", "label").alias("unit"), "node", "rep", "n_shingles") for leaf in levels]
        shared = stored(reduce(DataFrame.unionAll, shared), "shared")
        # A leaf of long texts is cut to what a task may hold; what that parts meets across the cluster below.
        heavy = stored(shared.groupBy("unit").agg(F.sum("n_shingles").alias("weight")).where(F.col("weight") > LARGE), "heavy")
        if not heavy.isEmpty():
            cut = F.coalesce(F.pmod(F.xxhash64("node", F.lit("cut")), F.ceil(F.col("weight") / LARGE)).cast("int"), F.lit(0))
            shared = shared.join(heavy.hint("merge"), "unit", "left").withColumn("unit", F.xxhash64("unit", cut))
        units = units.unionAll(shared.select("unit", "node", "rep"))

    def sure_links(units: DataFrame) -> DataFrame:
        # Merged at every size: the plan of a small input is that of a large one.
        texts = docs.join(units.hint("merge"), docs.doc_id.eqNullSafe(units.rep)).select("unit", "node", *(c for c in units.columns if c == "part"), "text")
        return confirmed(texts, size, percent)

    sure = sure_links(units)
    if split:
        sure = stored(sure, "sure")
        sure = sure.unionAll(stored(sure_links(beside_hubs(large, sure)), "sure"))
    labels = components(sure, "links")
    if split:
        parted = large.select(F.col("label").alias("key"), "node", "rep", "n_shingles").join(labels.hint("merge"), "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label")
        again = stored(sure_links(across(stored(parted, "parted"), "-parted").select("unit", "node", "rep", "part")), "sure")
        if not again.isEmpty():
            labels = stored(joined(labels, again), "links")
    first = labels.join(reps.select("node", "rep"), "node")
    named = first.groupBy("label").agg(F.min("rep").alias("least"))
    classes = first.join(named, "label").select("node", "least", "label")
    mapping = reps.select("node", "rep").join(classes, "node", "left").select("node", F.coalesce("least", "rep").alias("component"), F.coalesce("label", "node").alias("cluster"))
    out = found.select(*rest, "n_shingles", "node").join(mapping, "node", "left")
    return out.select(*rest, "n_shingles", "cluster", F.coalesce("component", "doc_id").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=3, percent=85)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8) stays: that with the least doc_id.

    Rows without an id stay too. Rows that share an id are told apart by their texts: equal ones are one document, others stay
    or go each by its own group, and the text with the least hash stays where a group's least id has several.
    """
    prepare(spark)
    uid = fresh(docs, "uid")
    keyed = docs.withColumn(uid, F.xxhash64("text"))
    rows = stored(grouped_rows(keyed.select("doc_id", "text", F.col(uid).alias("uid"))).where("doc_id IS NOT NULL").select("doc_id", "uid", "cluster"), "rows")
    first = rows.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct("doc_id", "uid")).alias("one")).select("one.*")
    keep = first.unionAll(rows.where("cluster IS NULL").select("doc_id", "uid").distinct()).withColumnRenamed("uid", uid)
    one = keyed.where("doc_id IS NOT NULL").join(keep, ["doc_id", uid], "left_semi").dropDuplicates(["doc_id", uid]).select(docs.columns)
    return one.unionAll(docs.where("doc_id IS NULL"))
