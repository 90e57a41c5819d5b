"""An instrumented trainer of linear heads: local steps in every partition, parameters averaged after each epoch.

An epoch is a chain of Spark jobs, one for each segment of its rows. They are dealt anew to a fixed number of workers by a seeded hash, sorted by another
one, and each worker takes AdamW steps over minibatches of what comes; it never holds more than a batch, and goes on in the next segment with what it held. Workers tell the loss of every
step and, every so many steps, their parameters; Spark averages the workers' last parameters (by their rows) for the next
epoch, and scores the validation rows with the averaged ones in between. Results depend on the number of workers and the
seed, and on Spark's partitions but for the rounding of sums. With one worker it is plain minibatch training.

Rows without a vector or a label, or with a vector of another length or with components that are no numbers, raise: a
trainer that skips rows in silence is worse than one that stops.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlab.operators import frames, scoring
from driftlab.sources.files import checkpoint_folder

BETAS, EPSILON = (0.9, 0.999), 1e-8
TRAILING = 100
SEGMENT_MB = 96  # of rows that a worker's task reads and sorts
BLOCK_MB, TILES = 256, 4  # of a view's validation rows that a task holds, and the tasks that share its heads
_TOLD = "kind string, epoch int, worker int, k long, n long, loss double, params array<double>"


def scaler(rows: DataFrame, vector: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each place, 1 where it is 0."""
    if rows.select(vector).first() is None:
        raise ValueError("a head can't be trained without rows")
    r = rows.select(array_to_vector(vector).alias("v")).agg(Summarizer.mean(F.col("v")).alias("m"), Summarizer.variance(F.col("v")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    std = np.sqrt(r["v"].toArray() * (r["n"] - 1) / r["n"])
    std[std == 0] = 1.0
    return r["m"].toArray(), std


class AdamW:
    """Parameters (weights, then the bias) with their moments, as one array that can be averaged."""

    def __init__(self, state: np.ndarray, steps: int, rate: float, decay: float):
        self.p, self.m, self.v = (x.copy() for x in state.reshape(3, -1))
        self.t, self.rate, self.decay = steps, rate, decay

    def step(self, x: np.ndarray, y: np.ndarray, positive: float) -> float:
        """The batch's weighted cross-entropy before the step."""
        z = x @ self.p[:-1] + self.p[-1]
        soft = np.logaddexp(0.0, -z)  # -log sigmoid(z)
        loss = float(np.mean(positive * y * soft + (1 - y) * (soft + z)))
        s = 1.0 / (1.0 + np.exp(-z))
        d = (positive * y * (s - 1) + (1 - y) * s) / len(y)
        g = np.append(d @ x, d.sum())
        self.t += 1
        self.p *= 1 - self.rate * self.decay
        self.m = BETAS[0] * self.m + (1 - BETAS[0]) * g
        self.v = BETAS[1] * self.v + (1 - BETAS[1]) * g * g
        self.p -= self.rate * (self.m / (1 - BETAS[0] ** self.t)) / (np.sqrt(self.v / (1 - BETAS[1] ** self.t)) + EPSILON)
        return loss

    def state(self) -> list[float]:
        return np.concatenate([self.p, self.m, self.v]).tolist()


def _drawn(rows: DataFrame, key: str, epoch: int, workers: int, seed: int) -> DataFrame:
    """rows with _w, the worker, and _o, the order in which it takes them."""
    draw = lambda k: F.xxhash64(F.lit(f"{seed}:{epoch}:{k}"), F.col(key))
    return rows.withColumns({"_w": F.pmod(draw("worker"), F.lit(workers)).cast("int"), "_o": draw("order")})


def _ordered(rows: DataFrame, key: str, workers: int) -> DataFrame:
    return rows.repartitionById(workers, "_w").sortWithinPartitions("_w", "_o", key)  # a task a worker


def dealt(rows: DataFrame, key: str, epoch: int, workers: int, seed: int) -> DataFrame:
    """rows with _w, the worker, in the order in which it takes them."""
    return _ordered(_drawn(rows, key, epoch, workers, seed), key, workers)


def _segments(rows: DataFrame, key: str, epoch: int, o: dict) -> list[DataFrame]:
    """The epoch's rows in pieces that follow each other in every worker's order; more than one are written first, each apart."""
    drawn, n = _drawn(rows, key, epoch, o["workers"], o["seed"]), o.get("segments", 1)
    if n == 1:
        return [drawn]
    spark, path, schema = rows.sparkSession, checkpoint_folder(rows.sparkSession, f"dealt-{epoch}"), drawn.schema
    drawn = drawn.withColumn("_seg", F.least(F.floor((F.col("_o") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int"))
    drawn.withColumn("_id", F.col("_seg") * o["workers"] + F.col("_w")).repartitionById(n * o["workers"], "_id").drop("_id").sortWithinPartitions("_seg").write.partitionBy("_seg").parquet(path)
    every = spark.read.schema(schema.add("_seg", "integer")).parquet(path)
    return [every.filter(F.col("_seg") == i).drop("_seg") for i in range(n)]


def _vectors(b, at: int, scale) -> np.ndarray:
    """The standardized vectors of a batch whose columns from ``at`` are x, y and, where views are to be made of x, view and seed."""
    (mean, std), x = scale, b.column(at)
    if x.null_count or b.column(at + 1).null_count or (x.value_lengths().to_numpy(zero_copy_only=False) != len(mean)).any():
        raise ValueError("a row without a whole vector or without a label")
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
    if not np.isfinite(x).all():
        raise ValueError("a row without a whole vector or without a label")
    if b.num_columns > at + 2:
        if b.column(at + 3).null_count:
            raise ValueError("a row without a path")
        names, seeds = b.column(at + 2).dictionary_encode(), b.column(at + 3).to_numpy(zero_copy_only=False)
        which, made = names.indices.to_numpy(zero_copy_only=False), np.empty(x.shape)
        for i, name in enumerate(names.dictionary.to_pylist()):
            own = which == i
            made[own] = scoring.view_matrix(x[own], name, seeds[own])
        x = made
    return (x - mean) / std


class Worker:
    """A worker on its way through an epoch: its parameters, and the rows of a batch that is not whole yet. What it tells are rows of _TOLD."""

    def __init__(self, name: int, epoch: int, steps: int, o: dict, state: np.ndarray, k: int = 0, seen: int = 0, held: np.ndarray | None = None):
        self.name, self.epoch, self.steps, self.o, self.k, self.seen = name, epoch, steps, o, k, seen
        self.head = AdamW(state, steps + k, o["rate"], o["decay"])
        held = np.empty((0, len(self.head.p))) if held is None else held  # vectors, then the label
        self.x, self.y = held[:, :-1], held[:, -1]

    def _step(self, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        loss = self.head.step(x, y, self.o["positive"])
        self.k, self.seen = self.k + 1, self.seen + len(y)
        out = [("loss", self.epoch, self.name, self.k, len(y), loss, None)]
        if (self.steps + self.k) % self.o["eval_every"] == 0 or self.steps + self.k == 1:
            out.append(("snap", self.epoch, self.name, self.k, self.seen, None, self.head.p.tolist()))
        return out

    def take(self, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        x, y, batch = np.concatenate([self.x, x]), np.concatenate([self.y, y]), self.o["batch"]
        whole = len(y) // batch * batch
        self.x, self.y = x[whole:], y[whole:]
        return [r for i in range(0, whole, batch) for r in self._step(x[i : i + batch], y[i : i + batch])]

    def pause(self) -> list[tuple]:
        """All that the worker needs to go on: its state, then less than a batch of rows."""
        return [("pause", self.epoch, self.name, self.k, self.seen, None, self.head.state() + np.column_stack([self.x, self.y]).ravel().tolist())]

    def end(self) -> list[tuple]:
        out = self._step(self.x, self.y) if len(self.y) else []
        return [*out, ("end", self.epoch, self.name, self.k, self.seen, None, self.head.state())]


def _epoch(rows: DataFrame, key: str, epoch: int, state: np.ndarray, steps: int, scale, o: dict) -> DataFrame:
    """What the workers tell of an epoch. Its segments are jobs of their own, so that a task reads and sorts one of a bounded size; a worker goes on where it paused."""
    spark, paths, paused = rows.sparkSession, [], {}
    made = [c for c in ("view", "seed") if "seed" in rows.columns]
    resumed = lambda w, paused: Worker(w, epoch, steps, o, *paused.get(w, (state,)))

    def job(paused, last):
        def run(batches):
            import pyarrow as pa

            def told(out):
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["kind", "epoch", "worker", "k", "n", "loss", "params"])

            now = None
            for b in batches:
                w = b.column(0).to_numpy()
                x, y = _vectors(b, 1, scale), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                cuts = [0, *(np.flatnonzero(np.diff(w)) + 1), len(w)]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    if now is None or w[i] != now.name:
                        if now is not None:
                            yield told(now.end() if last else now.pause())
                        now = resumed(int(w[i]), paused)
                    if out := now.take(x[i:j], y[i:j]):
                        yield told(out)
            if now is not None:
                yield told(now.end() if last else now.pause())

        return run

    segments = _segments(rows, key, epoch, o)
    for i, part in enumerate(segments):
        last = i == len(segments) - 1
        paths.append(checkpoint_folder(spark, f"sgd-{epoch}-{i}"))
        _ordered(part, key, o["workers"]).select("_w", "x", "y", *made).mapInArrow(job(paused, last), _TOLD).write.parquet(paths[-1])
        if len(segments) > 1:
            size = 3 * (len(scale[0]) + 1)
            for r in spark.read.schema(_TOLD).parquet(paths[-1]).filter("kind IN ('pause', 'end')").collect():  # a row a worker
                paused.pop(r["worker"], None)
                if r["kind"] == "pause":
                    p = np.array(r["params"])
                    paused[r["worker"]] = p[:size], r["k"], r["n"], p[size:].reshape(-1, size // 3)
    out = spark.read.schema(_TOLD).parquet(*paths).filter("kind <> 'pause'")
    late = [r for w in sorted(paused) for r in resumed(w, paused).end()]  # workers without a row in the last segment
    return out.unionByName(spark.createDataFrame(late, _TOLD)) if late else out


def _averaged(told: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """k -> the workers' parameters averaged by their rows so far: as many numbers as parameters for each k, whatever the workers."""
    rows = told.filter(F.col("kind") == kind).select(F.lit(0).alias("k") if kind == "end" else F.col("k"), "worker", "n", F.posexplode("params").alias("i", "v"))
    each = rows.groupBy("k", "i").agg(F.array_sort(F.collect_list(F.struct("worker", "n", "v"))).alias("l"))  # a number a worker, in a fixed order
    total = lambda f: F.aggregate("l", F.lit(0.0), lambda a, x: a + f(x))
    out: dict[int, dict[int, float]] = {}
    for r in each.select("k", "i", (total(lambda x: x["n"] * x["v"]) / total(lambda x: x["n"].cast("double"))).alias("v")).collect():
        out.setdefault(r["k"], {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _validated(val: DataFrame, heads: dict[int, np.ndarray], scale) -> DataFrame:
    """(k, auc_clean, auc_robust): of each head, over the clean view and the mean over the others. val: view, y, x, and seed where views are to be made.

    An AUC counts pairs, so a view's rows go in blocks and a tile counts the pairs of one block's positives and another's negatives, for a share of the
    heads. Rows travel to tiles, and neither scores nor vectors of views do; a tile holds at most BLOCK_MB of each. A view in one block goes to TILES
    tiles whatever the number of heads; one of more blocks to as many as it has pairs of blocks. The scores themselves are heads times rows.
    """
    val = val.withColumn("y", F.col("y").cast("int")).filter("y IN (0, 1)")
    per = val.groupBy("view").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    per = val.sparkSession.createDataFrame(per.collect(), per.schema)  # a row a view
    sizes = {r["view"]: r["n_pos"] + r["n_neg"] for r in per.collect()}
    ks, names, d = sorted(heads), sorted(sizes), len(scale[0])
    p = np.array([heads[k] for k in ks])
    blocks = max(1, -(-max(sizes.values(), default=0) * 8 * d // int(BLOCK_MB * 1e6)))
    shares = max(1, min(len(ks), -(-TILES // blocks**2)))

    def run(batches):
        import pyarrow as pa

        tiles: dict[int, tuple[list, list]] = {}
        for b in batches:
            tile, z, y = b.column(0).to_numpy(), _vectors(b, 1, scale), b.column(2).to_numpy()
            for t in np.unique(tile).tolist():
                held = tiles.setdefault(t, ([], []))
                for c in (0, 1):
                    held[c].append(z[(tile == t) & (y == c)])
        for t in sorted(tiles):
            z = [np.concatenate(part) for part in tiles.pop(t)]
            share, out = t // blocks**2 % shares, []
            for i in range(share, len(ks), shares):
                # nine digits of a score, as a whole number
                neg, pos = (np.sort(np.rint(np.round(1.0 / (1.0 + np.exp(-(x @ p[i, :-1] + p[i, -1]))), 9) * 1e9).astype(np.int32)) for x in z)
                out.append(int(np.searchsorted(neg, pos, "left").sum() + np.searchsorted(neg, pos, "right").sum()))
            own = ks[share::shares]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([names[t // (shares * blocks**2)]] * len(own)), pa.array(out, pa.int64())], ["k", "view", "s"])

    place = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("view")) if names else F.lit(0)
    made = [c for c in ("view", "seed") if "seed" in val.columns]
    dealt = val.withColumns({"_block": F.pmod(F.monotonically_increasing_id(), F.lit(blocks)), "_v": place})
    dealt = dealt.withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(shares * blocks - 1))))
    other = F.col("_e") % blocks
    pair = F.when(F.col("y") == 1, F.col("_block") * blocks + other).otherwise(other * blocks + F.col("_block"))
    tile = (F.col("_v") * shares + F.floor(F.col("_e") / blocks)) * blocks**2 + pair
    dealt = dealt.withColumn("_tile", tile.cast("int")).repartitionById(max(1, len(names) * shares * blocks**2), "_tile")
    path, kinds = checkpoint_folder(val.sparkSession, "validated"), "k long, view string, s long"
    dealt.select("_tile", "x", "y", *made).mapInArrow(run, kinds).write.parquet(path)
    each = val.sparkSession.read.schema(kinds).parquet(path).groupBy("k", "view").agg(F.sum("s").alias("s")).join(F.broadcast(per), "view")
    each = each.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("s") / (2.0 * F.col("n_pos") * F.col("n_neg"))))
    return each.groupBy("k").agg(F.avg(F.when(F.col("view") == "clean", F.col("auc"))).alias("auc_clean"), F.avg(F.when(F.col("view") != "clean", F.col("auc"))).alias("auc_robust"))


@dataclass
class Run:
    steps: DataFrame  # step, epoch, n, batch_loss, running_mean, trailing_mean
    curve: DataFrame | None  # step, epoch, auc_clean, auc_robust, score
    head: dict  # mean, std, weights, bias
    meta: dict


def train(rows: DataFrame, key: str, val: DataFrame | None = None, clean: DataFrame | None = None, workers: int = 4, batch: int = 128, epochs: int = 2, rate: float = 1e-3, weight_decay: float = 0.0, seed: int = 0, eval_every: int = 50) -> Run:
    """Trains on rows (key, x, y), whose scaler comes from ``clean`` (rows if None); key tells rows apart. val: view, y, x.

    Rows and val that have seed too, as from views.named_views, hold the clean vector: their views are made where they are needed.
    eval_every counts the steps of all workers together.
    """
    spark = rows.sparkSession
    scale = scaler(rows if clean is None else clean)
    c = rows.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"), F.count(F.lit(1)).alias("all")).first()
    o = {"workers": workers, "batch": batch, "rate": rate, "decay": weight_decay, "seed": seed, "eval_every": max(1, eval_every // workers), "positive": c["n"] / max(1, c["p"])}
    wide = len(scale[0]) * (4 if dict(rows.dtypes)["x"] == "array<float>" else 8) + 64
    o["segments"] = max(1, math.ceil(c["all"] * wide / (workers * SEGMENT_MB * 1e6)))
    state, steps, told, points = np.zeros(3 * (len(scale[0]) + 1)), 0, None, None
    for epoch in range(1, epochs + 1):
        part = _epoch(rows, key, epoch, state, steps, scale, o)
        state = _averaged(part, "end")[0]
        last = part.filter("kind = 'end'").agg(F.max("k").alias("k")).first()["k"]  # of the worker with most steps
        steps += last
        if val is not None:
            heads = _averaged(part, "snap") | {last + 1: state.reshape(3, -1)[0]}
            own = _validated(val, heads, scale).withColumn("epoch", F.lit(epoch))
            points = own if points is None else points.unionByName(own)
        told = part if told is None else told.unionByName(part)
    losses = frames.numbered(told.filter("kind = 'loss'"), [], ["epoch", "k", "worker"], "step").select((F.col("step") + 1).alias("step"), "epoch", "k", "n", F.col("loss").alias("batch_loss"))
    path, schema = checkpoint_folder(spark, "losses"), losses.schema
    losses.write.parquet(path)
    losses = spark.read.schema(schema).parquet(path)
    out = frames.cumulative(losses, ["epoch"], ["step"], {"_sum": F.col("batch_loss") * F.col("n"), "_seen": F.col("n")})
    out = frames.trailing(out, [], ["step"], {"trailing_mean": F.avg("batch_loss")}, TRAILING)
    digits = lambda c: F.round(c, 6)
    out = out.select("step", "epoch", "n", digits(F.col("batch_loss")).alias("batch_loss"), digits(F.col("_sum") / F.col("_seen")).alias("running_mean"), digits(F.col("trailing_mean")).alias("trailing_mean"))
    curve = None
    if points is not None:
        ends = losses.groupBy("epoch").agg(F.max("step").alias("_last"))
        at = losses.groupBy("epoch", "k").agg(F.max("step").alias("step"))
        curve = points.join(at, ["epoch", "k"], "left").join(F.broadcast(ends), "epoch")  # a row an epoch
        curve = curve.select(F.coalesce("step", "_last").alias("step"), "epoch", digits(F.col("auc_clean")).alias("auc_clean"), digits(F.col("auc_robust")).alias("auc_robust"), digits(F.col("auc_clean") / 2 + F.col("auc_robust") / 2).alias("score"))
    meta = {"head": "linear", "epochs": epochs, "lr": rate, "batch_size": batch, "weight_decay": weight_decay, "seed": seed, "workers": workers, "eval_every": eval_every, "balance_pos_weight": round(o["positive"], 6), "n_rows": c["all"], "n_real_rows": c["n"], "n_fake_rows": c["p"]}
    p = state.reshape(3, -1)[0]
    return Run(out, curve, {"mean": scale[0].tolist(), "std": scale[1].tolist(), "weights": p[:-1].tolist(), "bias": float(p[-1])}, meta)
