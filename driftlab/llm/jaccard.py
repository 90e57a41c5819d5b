"""Operator 2: n-gram Jaccard join by chosen paths.

A document is the set of its shingles, runs of five words (of a text of one to four words, that run). Documents with
equal sets form a copy class and are handled as one set. In each of ``RUNS`` runs a set of n shingles chooses those
whose hash for the run is below 1 / (threshold * n), 1.25 of them on average for 0.8, and joins their buckets: two
sets that are similar enough meet in one or more buckets on average. Buckets of over ``LIMIT`` sets are split again in
the same way, by hashes of their own, up to ``DEPTH`` levels. A pair at the threshold stays together through three
levels with a probability of 0.37 a run, so 15 runs find it with 0.999; closer pairs more surely.

Buckets of the same sets are kept once. In a bucket all pairs are compared exactly (brute force): the sizes of all
intersections come from one product of incidence matrices. Buckets beyond a tile's bounds are cut into tiles, pairs of
blocks, each a task's work of its own, so no bucket needs a single task's memory. A pair is counted in the first of
its common buckets only. No pair leaves its tile: what goes on is, for each set, how many links it has and the first
set that it is connected with in the tile; classes are the connected components of these.

Intersections compare 32 bits of each shingle's hash: two different shingles of a pair look alike with a probability
of about 1e-6 a pair.

Defined results: a null text and one without words belong to no other: a class of their own, 0 links; null ids are the
last of their class (class_id is null only if no id is known); repeated ids and rows are documents of their own; extra
columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, in_arrow, mix64, only, shingle_hashes, table, text_chunks, word_hashes, words_of

K, THRESHOLD = 5, 0.8
DEPTH, RECALL, LIMIT = 3, 0.999, 256
TILE_SETS, TILE_TOKENS = 2048, 3_000_000
_LAST = (1 << 63) - 1


def survival(threshold: float, depth: int) -> float:
    """The probability that a pair at the threshold shares a bucket of the given level: a branching process of mean 1."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def _seed(*x: int) -> np.uint64:
    return mix64(np.array([hash_of(x)], np.uint64))[0]


def hash_of(x: tuple[int, ...]) -> int:
    out = 0x2545F4914F6CDD1D
    for v in x:
        out = (out ^ (v & (1 << 64) - 1)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        out ^= out >> 29
    return out


def choose(tokens: np.ndarray, node: np.uint64, threshold: float) -> np.ndarray:
    """The child nodes of a set in a node: for each shingle whose hash there is small enough."""
    with np.errstate(over="ignore"):
        h = mix64(tokens ^ node)
    below = min(1.0, 1 / (threshold * len(tokens)))
    chosen = tokens[h < np.uint64(min((1 << 64) - 1, int(below * (1 << 64))))]
    with np.errstate(over="ignore"):
        return mix64(chosen * np.uint64(0x9E3779B97F4A7C15) ^ (node + np.uint64(1)))


def set_of(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(words, K))


def set_key(tokens: np.ndarray) -> int:
    """64 bits that equal sets share."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _sets(batches):
    """(rows, sets) of Arrow batches whose column text holds the texts."""
    for rows, data, offsets in text_chunks(batches, lower=True):
        starts, _, h = words_of(data, offsets)
        at = np.searchsorted(starts, offsets)
        yield rows, [set_of(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _documents(docs: DataFrame, runs: int, threshold: float) -> DataFrame:
    """(did, set_id, n, nodes): the set of each document and its buckets in all runs."""
    seeds = [_seed(r, 1) for r in range(runs)]

    def run(batches):
        import pyarrow as pa

        for rows, sets in _sets(batches):
            nodes = [np.concatenate([choose(s, seed, threshold) for seed in seeds]).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in nodes])]), pa.int32()), pa.array(np.concatenate(nodes)))],
                ["did", "set_id", "n", "nodes"],
            )

    return in_arrow(docs, run, "did long, set_id long, n long, nodes array<long>")


def _with_tokens(docs: DataFrame) -> DataFrame:
    """(set_id, tokens): 32 bits of each shingle, sorted."""

    def run(batches):
        import pyarrow as pa

        for rows, sets in _sets(batches):
            tokens = [(s >> np.uint64(32)).astype(np.uint32) for s in sets]  # sets are sorted, so these are too
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["set_id", "tokens"])

    return in_arrow(docs, run, "set_id long, tokens binary")


def _children(members: DataFrame, threshold: float) -> DataFrame:
    """The next level's (node, set_id, n) of rows (node, set_id, n, tokens)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            node, set_id, n, out = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), []
            for k in range(b.num_rows):
                tokens = np.frombuffer(b.column(3)[k].as_buffer(), np.uint32).astype(np.uint64)
                out.append(choose(tokens, node[k : k + 1].view(np.uint64)[0], threshold).view(np.int64))
            many = [len(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(set_id, many)), pa.array(np.repeat(n, many))], ["node", "set_id", "n"])

    return in_arrow(members, run, "node long, set_id long, n long").distinct()


def _measured(members: DataFrame) -> DataFrame:
    """members (node, set_id, n) of nodes with two sets or more, with the node's sets, shingles and a sum that tells its sets."""
    stats = members.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.sum(F.shiftright(F.xxhash64("set_id"), 20)).alias("sum")).filter("m > 1")
    return members.join(stats, "node")


def _incidence(tokens: list[np.ndarray], counts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set index and column of each token that is in known."""
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
    at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
    ok = known[at] == flat if len(known) else np.zeros(len(flat), bool)
    return np.repeat(np.arange(len(tokens)), counts)[ok], at[ok]


def _products(a: list[np.ndarray], b: list[np.ndarray] | None, width: int = 1024) -> np.ndarray:
    """Sizes of the intersections of all a with all b (or with a), from blocks of columns."""
    u, c = np.unique(np.concatenate(a if b is None else [*a, *b]), return_counts=True)
    known = u[c > 1]  # what one set alone has can't be shared
    sides = [_incidence(x, np.array([len(t) for t in x]), known) for x in ([a] if b is None else [a, b])]
    out = np.zeros((len(a), len(a if b is None else b)), np.float32)
    for at in range(0, len(known), width):
        m = []
        for (row, col), x in zip(sides, ([a] if b is None else [a, b])):
            ok = (col >= at) & (col < at + width)
            dense = np.zeros((len(x), min(width, len(known) - at)), np.float32)
            dense[row[ok], col[ok] - at] = 1
            m.append(dense)
        out += m[0] @ m[-1].T
    return out


def _tile(node: int, sets: dict[int, tuple[int, np.ndarray, np.ndarray]], left: list[int], right: list[int] | None, threshold: float) -> dict[int, tuple[int, int]]:
    """set -> (links counted here, first set that it is connected with); sets: (n, tokens, nodes)."""
    other = left if right is None else right
    size = lambda x: np.array([sets[i][0] for i in x], np.float64)
    inter = _products([sets[i][1] for i in left], None if right is None else [sets[i][1] for i in right])
    rows = [slice(r, r + 256) for r in range(0, len(left), 256)]  # a few rows of the matrix at a time
    n_left, n_other, share = size(left), size(other), threshold / (1 + threshold)
    linked = np.zeros(inter.shape, bool)
    for r in rows:
        linked[r] = inter[r] >= share * (n_left[r, None] + n_other[None, :]) - 1e-6
    del inter
    if right is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return {}
    before = lambda i: sets[i][2][: np.searchsorted(sets[i][2], node)]
    earlier = [before(i) for i in left]
    earlier_other = earlier if right is None else [before(i) for i in right]
    counted = linked
    if sum(map(len, earlier)) and sum(map(len, earlier_other)):
        counted = linked & (_products(earlier, None if right is None else earlier_other) == 0)
    links = [counted.sum(1), counted.sum(0)]
    del counted
    # labels go along links until they are still: ranks of the sets' ids
    ids = np.array([*left, *([] if right is None else right)], np.int64)
    order = np.argsort(ids)
    by_rank = ids[order]
    root = np.searchsorted(by_rank, ids)
    while True:
        ends = [root[: len(left)], root if right is None else root[len(left) :]]
        a, b = ends[0].copy(), ends[1].copy()
        for r in rows:
            a[r] = np.minimum(a[r], np.where(linked[r], ends[1][None, :], len(ids)).min(1))
            np.minimum(b, np.where(linked[r], ends[0][r, None], len(ids)).min(0), out=b)
        new = np.minimum(a, b) if right is None else np.concatenate([a, b])
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    touched = linked.any(1) if right is None else np.concatenate([linked.any(1), linked.any(0)])
    many = links[0] if right is None else np.concatenate(links)
    return {int(ids[k]): (int(many[k]), int(by_rank[root[k]])) for k in np.flatnonzero(touched).tolist()}


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(set_id, links, root) of rows sorted by tile: (node, i, j, block, set_id, n, tokens, nodes)."""

    def run(batches):
        import pyarrow as pa

        tile, sets, blocks, out = None, {}, {}, []

        def done():
            if tile is not None and len(sets) > 1:
                node, i, j = tile
                got = _tile(node, sets, blocks.get(i, []), None if i == j else blocks.get(j, []), threshold) if blocks.get(i) and blocks.get(j) else {}
                out.extend((k, *v) for k, v in got.items())

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["set_id", "links", "root"])

        for b in batches:
            node, i, j, block, set_id, n = (b.column(k).to_pylist() for k in range(6))
            for k in range(b.num_rows):
                if tile != (node[k], i[k], j[k]):
                    done()
                    tile, sets, blocks = (node[k], i[k], j[k]), {}, {}
                    if len(out) > 5_000:
                        yield batch()
                        out.clear()
                if set_id[k] not in sets:  # a row that is there twice counts once
                    sets[set_id[k]] = (n[k], np.frombuffer(b.column(6)[k].as_py(), np.uint32), np.array(b.column(7)[k].as_py(), np.int64))
                    blocks.setdefault(block[k], []).append(set_id[k])
        done()
        yield batch()

    return in_arrow(rows, run, "set_id long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the ends of edges (a, b): the least id that each is connected with. Labels and then labels of labels, until none changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("root")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("of_b")), "b").groupBy(F.col("a").alias("id")).agg(F.min("of_b").alias("of_b"))
        new = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "of_b").alias("via"))
        new = new.join(labels.select(F.col("id").alias("via"), F.col("root").alias("up")), "via").select("id", "old", F.least("via", "up").alias("root"))
        new = cut(new, "join-labels")
        if new.filter("root <> old").isEmpty():
            return new.select("id", "root")
        labels = new.select("id", "root")


def _classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """(did, set_id, class, n_copies, n_links); set_id is null for documents without words."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), F.col(text_col).alias("text"))
    every = cut(_documents(source, runs_for(recall, threshold), threshold), "join-sets")
    level = cut(_measured(every.select(F.explode("nodes").alias("node"), "set_id", "n").distinct()), "join-nodes")

    owners = every.join(level.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.min("did").alias("did"))
    tokens = cut(_with_tokens(only(source, cut(owners.select("did").distinct(), "join-owners"), "did", "left_semi")), "join-tokens")

    found = None
    for depth in range(DEPTH):
        big = level.filter(F.col("m") > LIMIT)
        last = depth == DEPTH - 1 or big.isEmpty()
        here = level if last else level.filter(F.col("m") <= LIMIT)
        found = here if found is None else found.unionByName(here)
        if last:
            break
        level = cut(_measured(_children(big.select("node", "set_id", "n").join(tokens.dropDuplicates(["set_id"]), "set_id").select("node", "set_id", "n", "tokens"), threshold)), "join-nodes")
    first = found.select("node", "m", "total", "sum").distinct().groupBy("m", "total", "sum").agg(F.min("node").alias("node")).select("node")
    members = cut(found.join(first, "node", "left_semi"), "join-members")

    lists = members.groupBy("set_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # at most some dozens: runs times choices
    blocks = F.ceil(F.greatest(F.col("m") / TILE_SETS, F.col("total") / TILE_TOKENS))
    placed = members.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "n")
    full = placed.join(tokens, "set_id").join(lists, "set_id").select("node", "i", "j", "block", "set_id", "n", "tokens", "nodes")
    tiles = full.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    results = cut(_compare(tiles, threshold), "join-links")

    links = results.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    roots = components(results.filter("set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    labelled = links.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", "n_links", F.coalesce("root", "set_id").alias("root"))
    per_set = every.filter("n > 0").groupBy("set_id").agg(F.min("did").alias("least"), (F.count(F.lit(1)) - 1).alias("n_copies")).join(labelled, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    per_root = per_set.groupBy("root").agg(F.min("least").alias("class"))
    classes = per_set.join(per_root, "root").select("set_id", F.col("class"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return every.select("did", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(classes, "set_id", "left")


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for every document.

    class_id: the least id of the documents it is connected with by links; n_links: the sets other than its own that
    are similar to it; n_copies: other documents of the same set.
    """
    out = _classes(docs, threshold, recall, id_col, text_col)
    known = lambda c: F.when(c != _LAST, c)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(known(F.col("did")).alias("doc_id"), known(F.coalesce("class", "did")).alias("class_id"), zero("n_links"), zero("n_copies"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that with the least id; of repeated rows one stays. Documents without words all stay."""
    classes = cut(_classes(docs, threshold, recall, id_col, text_col), "join-classes")
    key, mark, rank = fresh(docs, "_did", "_set", "_rank")
    twice = cut(classes.groupBy("did").count().filter("count > 1").select(F.col("did").alias(key)), "join-twice")
    dropped = cut(classes.filter("class IS NOT NULL AND did <> class").select(F.col("did").alias(key)).distinct().join(twice, key, "left_anti"), "join-dropped")
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    kept = only(keyed, dropped, key, "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    # ids that occur again don't name a document: their rows, and no others, are told apart by their sets
    set_ids = F.pandas_udf(lambda texts: texts.map(lambda t: set_key(set_of(word_hashes(t)))), "long")
    again = only(keyed, twice, key, "left_semi").withColumn(mark, set_ids(F.coalesce(F.col(text_col), F.lit(""))))
    winners = classes.filter("class IS NULL OR did = class").groupBy("did", "class").agg(F.min("set_id").alias("set_id"), F.first("class").isNull().alias("all"))
    lone = again.join(classes.filter("class IS NULL").select(F.col("did").alias(key)).distinct(), key, "left_semi").filter(F.col(mark) == 0)
    picked = again.filter(F.col(mark) != 0).join(winners.filter("NOT all").select(F.col("did").alias(key), F.col("set_id").alias(mark)).distinct(), [key, mark], "left_semi")
    picked = picked.withColumn(rank, F.row_number().over(Window.partitionBy(key, mark).orderBy(F.col(text_col)))).filter(F.col(rank) == 1)
    return only(kept, twice, key, "left_anti").select(*docs.columns).unionByName(lone.select(*docs.columns)).unionByName(picked.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))
