"""Near-duplicate vectors by NN-descent.

Equal vectors are one vertex. Every vertex keeps a list of its best neighbours so far. The first lists come from
blocks: a few random-hyperplane partitions, in each of which the vertices of a block are compared. Then, round by
round, the neighbours and reverse neighbours of a vertex meet and are compared with each other, and better ones enter
the lists. Pairs at the threshold are links; links give components.

A list whose last member is still a link is saturated: it is made twice as long, and its vertex meets the neighbours of its
neighbours again, until no list is saturated or LONGEST is reached. A group of more near copies than that is not written out as
lists, whose number would grow with its square: every block and every meeting also ties together what its links connect, by at
most one row per member, before anything is cut. Lists and ties give the components; within a component all pairs are
compared, block against block, and only counts leave a task. So no link that was ever computed is lost, and the number of
links is complete as far as the components are.

The recall is audited: vectors chosen by hash are compared with all vectors, until enough of them have links; where links are
too rare for that, vectors with links that were found are asked as well, and every try is made. The recall is the mean over
these vertices of the share of their distinct partners that was found, whatever the copies. While it is too low, further
partitions and rounds follow. At most EXACT_VERTICES vertices that fall short after MOST_TRIES, or whose recall can't be told, are
also compared block against block, which misses nothing; more get further tries, and that comparison only after LAST_TRY of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.graph import components
from txrisk.session import discard, reliable

THRESHOLD = 0.9
NEIGHBOURS = 8
#: Neighbours that a saturated list grows to at most.
LONGEST = 32
PARTITIONS = 8
LEAF = 256
#: Vertices that are compared with each other in one task at most.
BLOCK = 1024
ROUNDS = 2
MOST_TRIES = 3
LAST_TRY = 12
#: Vertices up to which all are compared with all if the audit fails after MOST_TRIES or cannot tell (some seconds).
EXACT_VERTICES = 10_000
#: Vectors that the audit asks first and at most, and how many of them shall have links.
AUDIT = 500
MOST_AUDITED = 16_384
LEAST_LINKED = 100
#: Vertices of a block when all are compared with all.
EXACT_BLOCK = 4096
RECALL = 0.99
SEED = 5


def vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of unit length, in double precision."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Whether a vector has a direction: there, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(tree: int, width: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, width]).normal(size=(width, bits))


def leaves(vertices: DataFrame, trees: range, bits: int, seed: int) -> DataFrame:
    """(id, vec) -> (tree, width, code, id, vec) for every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("vec").value_lengths())
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                x = vectors(part.column("vec"))
                for tree in trees:
                    code = ((x @ planes(tree, width, max(1, bits), seed) > 0) @ (1 << np.arange(max(1, bits)))) if bits else np.zeros(len(x), int)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), tree, np.int32)), pa.array(np.full(len(x), width, np.int32)), pa.array(code.astype(np.int64)),
                         part.column("id"), part.column("vec")], names=["tree", "width", "code", "id", "vec"])

    return vertices.mapInArrow(run, f"tree int, width int, code bigint, id bigint, vec {vertices.schema['vec'].dataType.simpleString()}")


def tied(count: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b of ``count`` members -> (member, smallest member that it is connected to), where they differ."""
    root = np.arange(count)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            member = np.flatnonzero(root != np.arange(count))
            return member, root[member]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def best_in_block(table: pa.Table, most: int, threshold: float) -> pa.Table:
    """The best neighbours of every vertex of a block: (u, v, s); and what its links tie together, without s."""
    ids = table["id"].to_numpy()
    x = vectors(table["vec"].combine_chunks())
    out, links = [], []
    for i in range(0, len(x), BLOCK):
        s = x[i:i + BLOCK] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        a, b = np.nonzero(s >= threshold)
        links.append((a + i, b))
        k = min(most, len(x) - 1)
        if k > 0:
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append((np.repeat(ids[i:i + BLOCK], k), ids[at].ravel(), np.take_along_axis(s, at, 1).ravel()))
    u, v, s = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    a, b = tied(len(x), *(np.concatenate(c) for c in zip(*links))) if links else (np.empty(0, np.int64), np.empty(0, np.int64))
    return pa.table({"u": pa.array(np.concatenate((u, ids[a])), pa.int64()), "v": pa.array(np.concatenate((v, ids[b])), pa.int64()),
                     "s": pa.concat_arrays([pa.array(s, pa.float64()), pa.nulls(len(a), pa.float64())])})


def first_pairs(vertices: DataFrame, count: int, trees: range, most: int, threshold: float, seed: int) -> DataFrame:
    """Pairs (u, v, s) of the partitions; without s, a tie."""
    bits = max(0, math.ceil(math.log2(max(1, count) / LEAF)))
    spread = leaves(vertices, trees, bits, seed)
    key = ["tree", "width", "code"]
    crowd = spread.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")).filter("chunks > 1")
    # A crowded block is cut by a hash that differs from partition to partition.
    chunk = F.pmod(F.xxhash64("tree", "id"), F.coalesce("chunks", F.lit(1))).cast("int")
    cut = spread.join(crowd, key, "left").withColumn("chunk", chunk).drop("chunks")
    # Dealt out by chunk too: else the chunks of a block would share a task.
    return (cut.repartition(*key, "chunk").groupBy(*key, "chunk")
            .applyInArrow(lambda t: best_in_block(t, most, threshold), "u bigint, v bigint, s double"))


def lists(pairs: DataFrame, most: int) -> DataFrame:
    """(u, v, s) -> (u, list): the best neighbours, a pair once."""
    once = pairs.groupBy("u", "v").agg(F.max("s").alias("s"))
    return once.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "v")), asc=False), 1, most).alias("list"))


def meetings(rows: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (p, m, least, vec), sorted by p: all members of a pivot are compared; (u, v, s) where s is better than what
    u has last, and what the links tie together, without s. Pivots with equally many members of one width are computed together."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> pa.RecordBatch | None:
        p, m, least = (t[c].to_numpy() for c in ("p", "m", "least"))
        vec = t["vec"].combine_chunks()
        widths = np.asarray(vec.value_lengths())
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        sizes = np.diff(np.append(starts, len(p)))
        out, ties = [], []
        for width in np.unique(widths[starts]).tolist():
            for size in np.unique(sizes).tolist():
                at = starts[(sizes == size) & (widths[starts] == width)]
                for lo in range(0, len(at) if size > 1 else 0, 512):
                    own = at[lo:lo + 512, None] + np.arange(size)
                    x = vectors(vec.take(pa.array(own.ravel()))).reshape(len(own), size, width)
                    s = x @ x.transpose(0, 2, 1)
                    other = ~np.eye(size, dtype=bool)
                    g, a, b = np.nonzero((s > least[own][:, :, None]) & other)
                    out.append((m[own[g, a]], m[own[g, b]], s[g, a, b]))
                    g, a, b = np.nonzero((s >= threshold) & other)
                    a, b = tied(own.size, g * size + a, g * size + b)
                    ties.append((m[own.ravel()[a]], m[own.ravel()[b]]))
        if not out:
            return None
        u, v, s = (np.concatenate(c) for c in zip(*out))
        # A pair that meets at several pivots of the batch is sent once.
        by = np.lexsort((v, u))
        u, v, s = u[by], v[by], s[by]
        new = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))[:len(u)]
        a, b = np.unique(np.stack([np.concatenate(c) for c in zip(*ties)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((u[new], a))), pa.array(np.concatenate((v[new], b))),
                                           pa.concat_arrays([pa.array(s[new]), pa.nulls(len(a), pa.float64())])], names=["u", "v", "s"])

    for batch in rows:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        p = t["p"].to_numpy()
        other = np.flatnonzero(p != p[-1])
        if not len(other):
            continue
        cut = int(other[-1]) + 1
        made = work(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
        if made is not None:
            yield made
    if held and (made := work(pa.Table.from_batches(held))) is not None:
        yield made


def kept(pairs: DataFrame, known: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs, and those known before -> (u, list) and the ties (a, b); both stored."""
    pairs = reliable(pairs)
    scored = pairs.filter("s IS NOT NULL")
    graph = reliable(lists(scored if known is None else scored.unionByName(known), most))
    ties = reliable(pairs.filter("s IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
    discard(pairs)
    return graph, ties


def descended(vertices: DataFrame, graph: DataFrame, most: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One round: (u, list) -> better (u, list), and what the links of the round tie together."""
    edges = graph.select("u", F.explode("list").alias("e")).select("u", "e.v", "e.s")
    reverse = lists(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), most)
    members = edges.select("u", "v").unionByName(
        reverse.select("u", F.explode("list").alias("e")).select("u", "e.v")).unionByName(
        graph.select("u", F.col("u").alias("v"))).distinct()
    # What a list has last is the bar for a new neighbour; a list with room takes any.
    bar = graph.select(F.col("u").alias("id"), F.when(F.size("list") >= most, F.element_at("list", -1)["s"]).otherwise(-2.0).alias("least"))
    known = vertices.join(bar, "id", "left").select(F.col("id").alias("m"), F.coalesce("least", F.lit(-2.0)).alias("least"), "vec")
    rows = members.select(F.col("u").alias("p"), F.col("v").alias("m")).join(known, "m").select("p", "m", "least", "vec")
    met = rows.repartition("p").sortWithinPartitions("p").mapInArrow(lambda t: meetings(t, threshold), "u bigint, v bigint, s double")
    return kept(met, edges, most)


def enlarged(vertices: DataFrame, graph: DataFrame, most: int, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Lists of up to 2 * most neighbours for the vertices whose list ends with a link, and the ties; none if there are none.

    They and their neighbours are the pivots; only pairs that link a saturated vertex come out.
    """
    full = reliable(graph.filter((F.size("list") >= most) & (F.element_at("list", -1)["s"] >= threshold)).select("u"))
    if full.isEmpty():
        discard(full)
        return None
    edges = graph.select("u", F.explode("list").alias("e")).select("u", "e.v", "e.s")
    pivots = full.unionByName(edges.join(full, "u", "left_semi").select(F.col("v").alias("u"))).distinct()
    reverse = lists(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), 2 * most)
    members = edges.select("u", "v").unionByName(reverse.select("u", F.explode("list").alias("e")).select("u", "e.v")).unionByName(
        graph.select("u", F.col("u").alias("v"))).distinct().join(pivots, "u", "left_semi")
    # Above every similarity for those that want no more neighbours.
    bar = full.select(F.col("u").alias("id"), F.lit(threshold - 1e-12).alias("least"))
    known = vertices.join(bar, "id", "left").select(F.col("id").alias("m"), F.coalesce("least", F.lit(2.0)).alias("least"), "vec")
    rows = members.select(F.col("u").alias("p"), F.col("v").alias("m")).join(known, "m").select("p", "m", "least", "vec")
    met = rows.repartition("p").sortWithinPartitions("p").mapInArrow(lambda t: meetings(t, threshold), "u bigint, v bigint, s double")
    made = kept(met, edges, 2 * most)
    discard(full)
    return made


def counted(table: pa.Table, threshold: float) -> pa.Table:
    """Block i against block j of a component: how many vertices of j each vertex of i is linked to, and their weight."""
    left = table["left"].to_numpy(zero_copy_only=False).astype(bool)
    ids, weight = table["id"].to_numpy(), table["n"].to_numpy()
    x = vectors(table["vec"].combine_chunks())
    s = x[left] @ x[~left].T >= threshold
    s &= ids[left][:, None] != ids[~left][None, :]
    return pa.table({"id": pa.array(ids[left]), "links": pa.array(s @ weight[~left], pa.int64()),
                     "partners": pa.array(s.sum(axis=1), pa.int64())})


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(root, size, id, vec, n) -> (id, links, partners): other vertices of the component linked to, with and without their copies."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    sides = F.concat(F.transform(other, lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(True).alias("left"))),
                     F.transform(other, lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"))))
    rows = rows.select("root", "id", "vec", "n", F.explode(sides).alias("side")).select("root", "id", "vec", "n", "side.*")
    parts = rows.groupBy("root", "i", "j").applyInArrow(lambda t: counted(t, threshold), "id bigint, links bigint, partners bigint")
    return parts.groupBy("id").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))


def real_partners(vertices: DataFrame, threshold: float, most: int, of: DataFrame | None = None) -> DataFrame:
    """(id, real) of a sample of ``most`` vertices (of those in ``of``), compared with all: those that have partners, and how many."""
    drawn_from = vertices if of is None else vertices.join(of, "id", "left_semi")
    sample = drawn_from.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vec").toArrow()
    if not sample.num_rows:
        return vertices.select("id", F.lit(0).cast("long").alias("real")).limit(0)
    widths = np.asarray(sample["vec"].combine_chunks().value_lengths())
    asked = {w: (sample["id"].to_numpy()[widths == w], vectors(sample["vec"].combine_chunks().filter(pa.array(widths == w))))
             for w in np.unique(widths).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {w: np.zeros(len(ids), np.int64) for w, (ids, _) in asked.items()}
        for batch in batches:
            lengths = np.asarray(batch.column("vec").value_lengths())
            for w, (ids, x) in asked.items():
                part = batch.filter(pa.array(lengths == w))
                own, y = part.column("id").to_numpy(), vectors(part.column("vec")) if part.num_rows else None
                for lo in range(0, part.num_rows, BLOCK):
                    s = y[lo:lo + BLOCK] @ x.T >= threshold
                    s &= own[lo:lo + BLOCK, None] != ids[None, :]
                    totals[w] += s.sum(axis=0)
        for w, (ids, _) in asked.items():
            some = totals[w] > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(totals[w][some])], names=["id", "real"])

    return vertices.select("id", "vec").mapInArrow(run, "id bigint, real bigint").groupBy("id").agg(F.sum("real").alias("real"))


def drawn(vertices: DataFrame, count: int, threshold: float, first: int) -> tuple[DataFrame, bool]:
    """(id, real) of a sample that grows until enough vertices have partners, and whether it can tell the recall: there
    are enough, or all vertices were asked."""
    size = first
    while True:
        real = reliable(real_partners(vertices, threshold, size))
        if real.count() >= LEAST_LINKED or size >= count:
            return real, True
        if size >= MOST_AUDITED:
            return real, False
        discard(real)
        size = min(4 * size, MOST_AUDITED)


def audited(real: DataFrame, found: DataFrame) -> float:
    """The mean over the vertices with partners of the share of partners found; a copy does not count again."""
    share = F.least("real", F.coalesce("partners", F.lit(0))) / F.col("real")
    got = real.join(found, "id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if got is None else got


def met_all(table: pa.Table, threshold: float) -> pa.Table:
    """Two blocks, or one, compared: what their links tie together."""
    ids, block = table["id"].to_numpy(), table["block"].to_numpy()
    by = np.argsort(block, kind="stable")
    x = vectors(table["vec"].combine_chunks().take(pa.array(by)))
    split = int((block == block.min()).sum())
    rest = split % len(ids)  # one block is compared with itself
    out = []
    for lo in range(0, split, BLOCK):
        a, b = np.nonzero(x[lo:min(lo + BLOCK, split)] @ x[rest:].T >= threshold)
        out.append(tied(len(ids), a + lo, b + rest))
    a, b = tied(len(ids), *(np.concatenate(c) for c in zip(*out)))
    return pa.table({"a": pa.array(ids[by][a], pa.int64()), "b": pa.array(ids[by][b], pa.int64())})


def exact_ties(vertices: DataFrame, count: int, threshold: float) -> DataFrame:
    """(id, vec) -> ties (a, b) of all links there are: every block against every other of its width. A vertex is sent once
    for every block."""
    blocks = max(1, math.ceil(count / EXACT_BLOCK))
    rows = vertices.select("id", "vec", F.size("vec").alias("width"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    sent = rows.select("id", "vec", "width", "block", F.explode(others).alias("other")).select(
        "id", "vec", "width", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return sent.groupBy("width", "i", "j").applyInArrow(lambda t: met_all(t, threshold), "a bigint, b bigint").distinct()


def joined(vertices: DataFrame, ties: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Ties -> components (node, root) and links (id, links, partners); both stored."""
    labels = reliable(components(ties))
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = labels.join(sizes, "root").join(vertices, F.col("node") == F.col("id")).select("root", "size", "id", "vec", "n")
    return labels, reliable(link_counts(members, threshold))


def linked(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS,
           partitions: int = PARTITIONS, rounds: int = ROUNDS, recall: float = RECALL, tries: int = MOST_TRIES, audit: int = AUDIT,
           seed: int = SEED) -> DataFrame:
    """One row per row of ``rows``: key, n_links, component_id (the smallest key reachable), kept.

    Vectors that are missing, zero or hold missing or infinite components have no links and are components of their own;
    so do vectors without a partner of their length. Equal vectors are linked, also when rows repeat each other; n_links
    counts the other rows. Rows without a key take part, but are never named; alone, their component is missing and
    they are kept. No rows give no rows. Other columns may have any name.
    """
    # Whatever is wider than float is kept as double: sizes that floats do not have still have a direction.
    kind = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    all_rows = reliable(rows.select(F.col(key).alias("key"), F.col(vector).cast(f"array<{kind}>").alias("vec")).withColumn("ok", usable("vec")))
    grouped = (all_rows.filter("ok").groupBy("vec").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
               .withColumn("id", F.xxhash64("vec")))
    # The hash of a vector is its vertex; should two vectors share one, the second takes its next.
    turn = F.row_number().over(Window.partitionBy("id").orderBy("vec"))
    vertices = reliable(grouped.withColumn("id", F.when(turn > 1, F.xxhash64("vec", turn)).otherwise(F.col("id"))))
    count = vertices.count()
    graph, ties, reached, attempt = None, None, 0.0, 0
    real, telling = drawn(vertices, count, threshold, audit)
    last = tries if count <= EXACT_VERTICES else max(tries, LAST_TRY)
    small = count <= EXACT_VERTICES
    while attempt < last and (reached < recall or not (telling or small) and attempt < tries):
        trees = range(attempt * partitions, (attempt + 1) * partitions)
        pairs = first_pairs(vertices.select("id", "vec"), count, trees, neighbours, threshold, seed)
        known = None if graph is None else graph.select("u", F.explode("list").alias("e")).select("u", "e.v", "e.s")
        most = neighbours
        graph, more = kept(pairs, known, most)
        ties = more if ties is None else ties.unionByName(more)
        for _ in range(rounds):
            graph, more = descended(vertices.select("id", "vec"), graph, most, threshold)
            ties = ties.unionByName(more)
        while most < LONGEST and (made := enlarged(vertices.select("id", "vec"), graph, most, threshold)):
            graph, more = made
            ties, most = ties.unionByName(more), 2 * most
        links = graph.select("u", F.explode("list").alias("e")).filter(F.col("e.s") >= threshold).select(F.col("u").alias("a"), F.col("e.v").alias("b"))
        labels, found = joined(vertices, links.unionByName(ties), threshold)
        asked = real if telling else reliable(real.unionByName(
            real_partners(vertices, threshold, audit, found.filter("partners > 0"))).dropDuplicates(["id"]))
        reached = audited(asked, found)
        attempt += 1
    if reached < recall or small and not telling:
        labels, found = joined(vertices, exact_ties(vertices, count, threshold), threshold)
    rooted = vertices.join(labels, vertices["id"] == labels["node"], "left").select(
        "id", "vec", "least", "n", F.coalesce("root", "id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_vector = rooted.join(named, "root").join(found, "id", "left").select(
        "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    good = all_rows.filter("ok").join(by_vector, "vec").select("key", "n_links", "component_id")
    bad = all_rows.filter("NOT ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return good.unionByName(bad).select(F.col("key").alias(key), "n_links", "component_id",
                                        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))

