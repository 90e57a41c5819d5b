"""Streams whose triggers are steps over versioned tables: quotas with stop rules, a table of changes with retries, online scores.

Each class has a ``step(batch, batch_id)`` for foreachBatch. What it knows is kept as Parquet below its folder, a version a
batch: a batch reads the version before its own and overwrites its own, so a batch that Spark replays, after a failure at any
place, gives the same rows and the same state. Rows that a batch gives out go to out/batch=<id>. A few numbers of the whole
stream (a stop, counts) are the only thing that the driver sees; everything of groups and keys stays in tables.
Nothing depends on the order of rows within a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from driftlab.streaming.scores import running


class _Steps:
    """Versions of named tables by batch: at(name, batch_id) is the newest one before a batch."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.folder}/{name}/batch={batch_id}"

    def write(self, name: str, df: DataFrame, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name, batch_id))
        return self.spark.read.schema(df.schema).parquet(self._path(name, batch_id))

    def versions(self, name: str) -> list[int]:
        """Versions that were written to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [p.getPath() for p in fs.listStatus(path)]
        return sorted(int(p.getName()[6:]) for p in found if p.getName().startswith("batch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def before(self, name: str, batch_id: int) -> DataFrame:
        old = [v for v in self.versions(name) if v < batch_id]
        if not old:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(self._path(name, old[-1]))

    def rows(self, name: str = "out") -> DataFrame:
        """All rows given out so far; a batch counts once it was written to its end."""
        paths = [self._path(name, v) for v in self.versions(name)]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])


class QuotaReader(_Steps):
    """A reader that keeps rows until their group has its quota, and stops or aborts by rules over all groups.

    Two levels of state: a group has its count; the stream has how many groups are open, how many rows were seen and how many
    of them were bad, and where it ended. The groups of a batch report what they opened and filled; running sums of these, by
    position, say at which kept row no group is open any more. ``stop="filled"``: there, from min_scan on, the reader stops.
    ``stop="overflow"``: it keeps rows of ``classes`` alone, and stops at their next row after that. A bad row is not kept;
    one that makes over most_bad of at least min_seen rows bad aborts, and what was kept before stays.

    Batches come in the order of their positions; within one, rows come in any order. A group is open from its first kept row
    on, ``classes`` are from the start. Rows up to the position
    ``skip``, and rows without a position or a group, are not seen.
    """

    GLOBAL = "open long, seen long, bad long, stopped long, aborted long"

    def __init__(self, spark: SparkSession, folder: str, position: str, group: str, default: int, quota: dict[str, int] | None = None, classes: tuple[str, ...] = (), stop: str = "filled", bad: Column | None = None, skip: int | None = None, min_scan: int = 0, min_seen: int = 200, most_bad: float = 0.5):
        super().__init__(spark, folder, {"out": f"{position} long, {group} string", "groups": "g string, kept long", "global": self.GLOBAL})
        self.position, self.group, self.default, self.quota, self.classes, self.stop = position, group, default, quota or {}, list(classes), stop
        self.bad, self.skip, self.min_scan, self.min_seen, self.most_bad = F.lit(False) if bad is None else bad, skip, min_scan, min_seen, most_bad

    def state(self, batch_id: int | None = None) -> Row:
        """The stream's own state before a batch, or after the last one."""
        at = max(self.versions("global"), default=-1) + 1 if batch_id is None else batch_id
        return self.before("global", at).first() or Row(open=len(self.classes), seen=0, bad=0, stopped=None, aborted=None)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        now, groups = self.state(batch_id), self.before("groups", batch_id)
        if now["stopped"] is not None or now["aborted"] is not None:
            return  # nothing is read any more
        rows = batch.select(F.col(self.position).cast("long").alias("at"), F.col(self.group).cast("string").alias("g"), F.coalesce(self.bad, F.lit(False)).alias("bad"))
        rows = self.write("rows", rows.filter(F.col("at").isNotNull() & F.col("g").isNotNull() & (F.lit(self.skip is None) | (F.col("at") > F.lit(self.skip)))), batch_id)
        seen = running(rows, "at", {"seen": F.lit(1), "bads": F.col("bad")})
        n, m = F.col("seen") + now["seen"], F.col("bads") + now["bad"]
        aborted = seen.agg(F.min(F.when(F.col("bad") & (n >= self.min_seen) & (m / n > self.most_bad), F.col("at"))).alias("a")).first()["a"]
        kept = self.write("kept", self._kept(rows, groups), batch_id)
        opened, filled = (F.col("nth") == 1) & ~F.col("g").isin(self.classes), F.col("nth") == F.col("quota")
        marked = self.write("marked", running(kept, "at", {"opened": opened, "filled": filled}), batch_id)
        closed = marked.filter(F.col("opened") - F.col("filled") + now["open"] == 0)
        if self.stop == "filled":
            stopped = closed.filter(F.col("at") >= self.min_scan).agg(F.min("at").alias("s")).first()["s"]
        else:
            since = -(2**63) if now["open"] == 0 else closed.agg(F.min("at").alias("s")).first()["s"]
            stopped = None if since is None else rows.filter(~F.col("bad") & F.col("g").isin(self.classes) & (F.col("at") > since)).agg(F.min("at").alias("s")).first()["s"]
        if aborted is not None and stopped is not None:
            aborted, stopped = (None, stopped) if stopped < aborted else (aborted, None)
        end = F.lit(True) if stopped is None and aborted is None else F.col("at") <= (aborted if stopped is None else stopped)
        out = marked.filter(end)
        self.write("out", out.select(F.col("at").alias(self.position), F.col("g").alias(self.group)), batch_id)
        counts = out.groupBy("g").agg(F.max("nth").alias("n"))
        self.write("groups", groups.join(counts, "g", "full").select("g", F.coalesce("n", "kept").alias("kept")), batch_id)
        c = rows.filter(end).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b")).first()
        d = out.agg(F.coalesce(F.max("opened"), F.lit(0)).alias("o"), F.coalesce(F.max("filled"), F.lit(0)).alias("f")).first()
        self.write("global", self.spark.createDataFrame([(now["open"] + d["o"] - d["f"], now["seen"] + c["n"], now["bad"] + c["b"], stopped, aborted)], self.GLOBAL), batch_id)

    def _kept(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        quota = F.lit(self.default)
        for g, q in self.quota.items():
            quota = F.when(F.col("g") == g, F.lit(q)).otherwise(quota)
        good = rows.filter(~F.col("bad"))
        if self.stop == "overflow":
            good = good.filter(F.col("g").isin(self.classes))
        nth = F.row_number().over(Window.partitionBy("g").orderBy("at"))
        first = good.withColumn("nth", nth).filter(F.col("nth") <= max([self.default, *self.quota.values()]))  # goes below the shuffle: a group costs its quota a task
        first = first.join(groups, "g", "left").select("at", "g", (F.col("nth") + F.coalesce("kept", F.lit(0))).alias("nth"), quota.cast("long").alias("quota"))
        return first.filter("nth <= quota")


class ChangeTable(_Steps):
    """A table that changes are merged into by versions: upserts are scored in requests, deletes leave tombstones.

    A change is (key, version, op, value); of a key's changes the one with the highest version counts (ties: the greater op,
    then value), whatever batch it comes in, so late ones change nothing. Upserts go in requests of ``size`` rows, by key; a
    request with a row that ``fails`` is put back as a whole for the next batch, and after ``attempts`` tries its rows enter the
    table with an error. Changes without a key or a version are not merged.
    """

    TABLE = "key string, version long, op string, value double, error string"
    PENDING = "key string, version long, op string, value double, tries int"

    def __init__(self, spark: SparkSession, folder: str, fails: Callable[[int], Column] = lambda _: F.lit(False), size: int = 6, attempts: int = 3):
        super().__init__(spark, folder, {"table": self.TABLE, "pending": self.PENDING})
        self.fails, self.size, self.attempts = fails, size, attempts

    def step(self, batch: DataFrame, batch_id: int) -> None:
        from driftlab.operators import frames

        new = batch.select(F.col("key").cast("string").alias("key"), F.col("version").cast("long").alias("version"), "op", F.col("value").cast("double").alias("value"), F.lit(0).alias("tries"))
        todo = new.filter(F.col("key").isNotNull() & F.col("version").isNotNull()).unionByName(self.before("pending", batch_id))
        change = F.max(F.struct("version", F.coalesce("op", F.lit("upsert")).alias("op"), "value", "tries")).alias("c")  # partial: a hot key costs a row a task
        todo = todo.groupBy("key").agg(change).select("key", "c.*")
        old = self.before("table", batch_id).select("key", F.col("version").alias("_v"), F.col("op").alias("_op"), F.col("value").alias("_value"), F.col("error").alias("_error"))
        todo = todo.join(old.select("key", "_v"), "key", "left").filter(F.col("_v").isNull() | (F.col("version") > F.col("_v"))).drop("_v")
        sent = frames.numbered(todo.filter("op <> 'delete'"), [], ["key"]).withColumn("request", F.floor(F.col("n") / self.size))
        sent = self.write("sent", sent.withColumn("failed", F.coalesce(self.fails(batch_id), F.lit(False))), batch_id)
        bad = sent.groupBy("request").agg(F.max("failed").alias("bad"))
        sent = sent.drop("n", "failed").join(bad, "request").drop("request")
        back = sent.filter(F.col("bad") & (F.col("tries") + 1 < self.attempts)).withColumn("tries", F.col("tries") + 1).drop("bad")
        self.write("pending", back.select("key", "version", "op", "value", F.col("tries").cast("int").alias("tries")), batch_id)
        gone = todo.filter("op = 'delete'").select("key", "version", "op", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("error"))
        lost = F.col("bad")
        done = sent.filter(~lost | (F.col("tries") + 1 >= self.attempts)).select("key", "version", "op", F.when(~lost, F.col("value")).alias("value"), F.when(lost, F.lit("unreachable")).alias("error"))
        merged = old.join(done.unionByName(gone), "key", "full")
        newer = F.col("version").isNotNull()
        pick = lambda c, o: F.when(newer, F.col(c)).otherwise(F.col(o)).alias(c)
        self.write("table", merged.select("key", pick("version", "_v"), pick("op", "_op"), pick("value", "_value"), pick("error", "_error")), batch_id)

    def current(self) -> DataFrame:
        """Keys that were not deleted, after the last batch."""
        return self.before("table", max(self.versions("table"), default=-1) + 1).filter("op <> 'delete'")


class OnlineScorer(_Steps):
    """Scores of a stream of vectors by the newest head that a trigger finds; heads may be exchanged while the stream runs.

    A batch notes the version that it used before it scores, so a replay uses the same one. Rows whose vector is null, of
    another length than the head's, or holds null or non-finite components get an error; errors come first, then scores, each by id.
    """

    OUT = "id long, place long, pred double, error string, head long, batch long"
    HEAD = "version long, mean array<double>, std array<double>, weights array<double>, bias double"

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, {"out": self.OUT, "heads": self.HEAD, "used": self.HEAD})

    def publish(self, head: dict, version: int) -> None:
        row = (version, *[list(map(float, head[k])) for k in ("mean", "std", "weights")], float(head["bias"]))
        self.write("heads", self.spark.createDataFrame([row], self.HEAD).coalesce(1), version)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        from driftlab.functions import vectors as V
        from driftlab.operators import frames

        if batch_id not in self.versions("used"):
            newest = self.before("heads", max(self.versions("heads"), default=-1) + 1)
            self.write("used", newest.coalesce(1), batch_id)
        head = self.before("used", batch_id + 1).first() if batch_id in self.versions("used") else None
        rows = batch.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
        error = F.lit("no head")
        p = F.lit(None).cast("double")
        if head is not None:
            part = {k: F.array(*[F.lit(v) for v in head[k]]) for k in ("mean", "std", "weights")}
            whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
            error = F.when(F.col("x").isNull(), "unreadable").when(F.size("x") != len(head["weights"]), "another length").when(~F.coalesce(whole, F.lit(False)), "not finite")
            p = F.round(V.sigmoid(V.dot(V.standardize(F.col("x"), part["mean"], part["std"]), part["weights"]) + F.lit(head["bias"])), 9)
        rows = rows.withColumn("error", error)
        rows = rows.select("id", F.when(F.col("error").isNull(), p).alias("pred"), "error", F.col("error").isNull().alias("ok"), F.xxhash64("x").alias("_h"))
        rows = frames.numbered(rows, [], ["ok", "id", "_h"], "place")
        self.write("out", rows.select("id", (F.col("place") + 1).alias("place"), "pred", "error", F.lit(head["version"] if head else None).cast("long").alias("head"), F.lit(batch_id).cast("long").alias("batch")), batch_id)


class VersionedScores(_Steps):
    """Smoothed scores of keys that are loaded in versions, removed, and forgotten when they idle.

    Rows are (key, t, seq, kind, version, value), in the order of t and seq. A load starts a version afresh, a remove ends the
    key, a row that comes more than ``idle`` after the key's last one finds it forgotten. A result counts if its version is the
    one that the key has then; results of older versions, of removed or of forgotten keys are dropped. Batches come in the order
    of t; within one, rows come in any order and a key may have any number of them (ema_batch, frames). The state has a row a
    key, and none of keys that have idled for longer than ``idle`` at the latest t seen.
    """

    def __init__(self, spark: SparkSession, folder: str, idle: int, alpha: float = 0.6):
        super().__init__(spark, folder, {"out": "key string, t long, seq long, ema double", "state": "key string, t long, version long, ema double"})
        self.idle, self.alpha = idle, alpha

    def step(self, batch: DataFrame, batch_id: int) -> None:
        from driftlab.operators import frames
        from driftlab.streaming.scores import ema_batch

        rows = batch.select(F.col("key").cast("string").alias("key"), F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"), "kind", F.col("version").cast("long").alias("version"), F.col("value").cast("double").alias("value"))
        rows = rows.filter(F.col("key").isNotNull() & F.col("t").isNotNull())
        carried = self.before("state", batch_id).select("key", "t", F.lit(-(2**63)).cast("long").alias("seq"), F.lit("carry").alias("kind"), "version", F.col("ema").alias("value"))
        rows = frames.trailing(rows.unionByName(carried), ["key"], ["t", "seq"], {"_prev": F.first("t")}, 2)  # the row before, or the first itself
        control = F.when(F.col("kind").isin("load", "carry"), F.col("version")).when((F.col("kind") == "remove") | (F.col("t") - F.col("_prev") > self.idle), F.lit(-1))
        rows = frames.filled(rows.withColumn("_control", control.cast("long")), ["key"], ["t", "seq"], "_control", "_now")
        counts = (F.col("kind") == "result") & (F.col("version") == F.col("_now")) & F.col("value").isNotNull()
        rows = self.write("rows", rows.withColumn("_counts", F.coalesce(counts | ((F.col("kind") == "carry") & F.col("value").isNotNull()), F.lit(False))), batch_id)
        ema = ema_batch(rows.filter(F.col("_counts") | F.col("_control").isNotNull()), "key", ["t", "seq"], "value", ~F.col("_counts"), self.alpha)
        ema = self.write("ema", ema, batch_id)
        self.write("out", ema.filter(F.col("ema").isNotNull() & (F.col("seq") > -(2**63))), batch_id)
        at = F.struct("t", "seq")
        last = rows.groupBy("key").agg(F.max("t").alias("t"), F.max_by("_now", at).alias("version"))
        smoothed = ema.groupBy("key").agg(F.max_by(F.struct("ema"), at).alias("e")).select("key", "e.ema")  # the last counted or control row
        newest = rows.agg(F.max("t").alias("m"))  # one row
        state = last.join(smoothed, "key", "left").crossJoin(F.broadcast(newest)).filter((F.col("m") - F.col("t") <= self.idle) & (F.coalesce("version", F.lit(-1)) != -1))
        self.write("state", state.select("key", "t", "version", "ema"), batch_id)


def drained(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream through step until it has read all there is."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
