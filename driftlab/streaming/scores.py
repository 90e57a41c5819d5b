"""Score streams: quotas, gates, deduplication and smoothing, as batch queries and as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALPHA = 0.6
FRAME_ROWS = 10_000


def running(df: DataFrame, order: str, columns: dict[str, Column], chunk: int = 100_000) -> DataFrame:
    """df with running counts of conditions, by a numeric order column: sums over ranges of it, then within each range."""
    df = df.withColumn("_r", F.floor(F.col(order) / chunk)).withColumns({f"_c{i}": c.cast("long") for i, c in enumerate(columns.values())})
    per = df.groupBy("_r").agg(*[F.sum(f"_c{i}").alias(f"_s{i}") for i in range(len(columns))])
    over = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a range
    per = per.select("_r", *[(F.sum(f"_s{i}").over(over) - F.col(f"_s{i}")).alias(f"_s{i}") for i in range(len(columns))])
    inside = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.join(per, "_r").withColumns({name: F.col(f"_s{i}") + F.sum(f"_c{i}").over(inside) for i, name in enumerate(columns)})
    return out.drop("_r", *[f"_{k}{i}" for k in "cs" for i in range(len(columns))])


def quota_slice(df: DataFrame, position: str, group: str, reals: list[str], per_group: int, real_cap: int, skip: int = 0, min_scan: int = 0, max_scan: int | None = None) -> DataFrame:
    """Rows of an ordered stream that a quota'd reader keeps.

    It skips the first rows, keeps rows until their group has its quota (real groups share one cap), and stops at the
    first kept row from min_scan on at which the reals and every group seen so far are full.
    """
    real = F.col(group).isin(reals)
    df = df.withColumn("_g", F.when(real, F.lit("real")).otherwise(F.col(group))).filter(F.col(position) > skip)
    if max_scan is not None:
        df = df.filter(F.col(position) <= max_scan)
    quota = F.when(F.col("_g") == "real", F.lit(real_cap)).otherwise(F.lit(per_group))
    # the rank filter goes below the shuffle, so a group costs at most its quota a task
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(position))
    kept = df.withColumn("nth", nth).filter(F.col("nth") <= F.greatest(F.lit(per_group), F.lit(real_cap))).filter(F.col("nth") <= quota)
    # a group is open from its first row until the row that fills it; the reals are open from the start
    spans = kept.groupBy("_g").agg(F.min(position).alias("first"), F.max(F.when(F.col("nth") == quota, F.col(position))).alias("full"))
    spans = spans.select(F.array_sort(F.collect_list(F.struct("_g", "first", "full")).over(Window.partitionBy())).alias("all")).limit(1)  # one row a group
    at = F.col(position)
    blocked = F.exists("all", lambda s: ((s["first"] <= at) | (s["_g"] == "real")) & (s["full"].isNull() | (s["full"] > at)))
    has_real = F.exists("all", lambda s: s["_g"] == "real")
    marked = kept.crossJoin(F.broadcast(spans)).withColumn("_open", blocked | ~has_real)
    stop = marked.filter(~F.col("_open") & (at >= min_scan)).agg(F.min(position).alias("stop"))
    return kept.crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (at <= F.col("stop"))).drop("_g", "nth", "stop")


def gated_abort(df: DataFrame, position: str, bad: Column, min_seen: int = 200, most: float = 0.5) -> DataFrame:
    """One row: the first position at which a bad row makes over ``most`` of at least ``min_seen`` rows bad (null: the source passes), and the counts there or at the end."""
    r = running(df.select(position, bad.alias("bad")), position, {"seen": F.lit(1), "bad_seen": F.col("bad")})
    fails = F.when(F.col("bad") & (F.col("seen") >= min_seen) & (F.col("bad_seen") / F.col("seen") > most), F.col(position))
    out = r.agg(F.min(fails).alias("abort_at"), F.max("seen").alias("seen"), F.max("bad_seen").alias("bad_seen"))
    return out


def ema_batch(df: DataFrame, key: str, order: list[str], value: str, reset: Column, alpha: float = ALPHA) -> DataFrame:
    """(key, order, ema): exponential smoothing of each key's values in order; a reset row clears it and has none itself.

    Rows are dealt by ranges of key and order and smoothed in one pass over each. What a key brings along from the ranges
    before is still open then: a row's value is ``base + decay * carry``, or ``fresh`` if nothing is brought along. The
    last rows of a key's ranges give the carries, so a key of any length is spread over tasks.
    """
    from driftlab.sources.files import checkpoint_folder

    kinds = dict(df.dtypes)
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(F.col(key).alias("_k"), *[F.col(c).alias(n) for c, n in zip(order, names)], F.col(value).cast("double").alias("_v"), F.coalesce(reset, F.lit(False)).alias("_reset"))
    rows = rows.repartitionByRange("_k", *names).sortWithinPartitions("_k", *names)

    def smooth(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, now, fresh, base, decay = TaskContext.get().partitionId(), 0, None, None, None, None
        for b in batches:
            out: list[list] = [[], [], []]
            for k, v, r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_k", "_v", "_reset"))):
                if at == 0 or k != now:
                    now, fresh, base, decay = k, None, 0.0, 1.0
                if r or v is None:
                    fresh = base = decay = None
                else:
                    fresh = v if fresh is None else alpha * v + (1 - alpha) * fresh
                    if decay is not None:
                        base, decay = alpha * v + (1 - alpha) * base, (1 - alpha) * decay
                at += 1
                for x, y in zip(out, (fresh, base, decay)):
                    x.append(y)
            n = b.num_rows
            kept = [b.column(b.schema.get_field_index(c)) for c in ("_k", *names)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * n, pa.int32()), pa.array(range(at - n, at), pa.int64()), *(pa.array(x, pa.float64()) for x in out)], ["_k", *names, "_part", "_at", "fresh", "base", "decay"])

    schema = ", ".join([f"_k {kinds[key]}", *[f"{n} {kinds[c]}" for c, n in zip(order, names)], "_part int, _at long, fresh double, base double, decay double"])
    path = checkpoint_folder(df.sparkSession, f"ema-{uuid.uuid4().hex}")
    rows.mapInArrow(smooth, schema).write.parquet(path)
    rows = df.sparkSession.read.schema(schema).parquet(path)
    last = rows.groupBy("_k", "_part").agg(F.max_by(F.struct("fresh", "base", "decay"), "_at").alias("l"))
    # one row a key and range, and of these only keys in two ranges or more: fewer than twice the ranges
    lists = last.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_part", "l"))).alias("ls")).filter(F.size("ls") > 1)
    ended = lambda l, c: F.when(c.isNull() | l["decay"].isNull(), l["fresh"]).otherwise(l["base"] + l["decay"] * c)
    carry = lambda p: F.aggregate(F.filter("ls", lambda x: x["_part"] < p), F.lit(None).cast("double"), lambda c, x: ended(x["l"], c))
    carries = lists.select("_k", F.explode(F.transform("ls", lambda x: F.struct(x["_part"].alias("_part"), carry(x["_part"]).alias("_carry")))).alias("c")).select(F.col("_k").alias("_k2"), F.col("c._part").alias("_part2"), "c._carry")
    out = rows.join(F.broadcast(carries), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_part") == F.col("_part2")), "left")
    return out.select(F.col("_k").alias(key), *[F.col(n).alias(c) for c, n in zip(order, names)], ended({c: F.col(c) for c in ("fresh", "base", "decay")}, F.col("_carry")).alias("ema"))


def ema_stream(stream: DataFrame, key: str, value: str, order: str, reset: str, alpha: float = ALPHA) -> DataFrame:
    """Structured Streaming: (key, order, ema) for each row; the state of a key is one number, cleared by a reset row.

    A key's rows of one trigger come in any order and in frames of any size: they are held (in Arrow) and sorted together
    before they are smoothed. Triggers follow each other; bound them (maxFilesPerTrigger) where a key has very many rows.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        e = state.get[0] if state.exists else None
        held = [pa.Table.from_pandas(f, preserve_index=False) for f in frames]
        rows = pa.concat_tables(held, promote_options="permissive").sort_by(order) if held else None
        del held
        for b in rows.to_batches(max_chunksize=FRAME_ROWS) if rows is not None else ():
            f = b.to_pandas()
            out = []
            for v, r in zip(f[value], f[reset]):
                e = None if r else (v if e is None or pd.isna(e) else alpha * v + (1 - alpha) * e)
                out.append(e)
            yield pd.DataFrame({key: f[key].to_numpy(), order: f[order].to_numpy(), "ema": pd.array(out, "Float64").astype(float) if any(x is not None for x in out) else [float("nan")] * len(out)})
        if e is None:
            if state.exists:
                state.remove()
        else:
            state.update((e,))

    kinds = dict(stream.dtypes)
    rows = stream.select(key, order, value, reset)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, ema double", "ema double", "append", GroupStateTimeout.NoTimeout)


def quota_stream(stream: DataFrame, group: str, position: str, quota: int) -> DataFrame:
    """Structured Streaming: rows that are among the first ``quota`` of their group by position, of all seen so far.

    The state of a group is these positions. All frames of a trigger are seen before rows are given out; a later trigger
    may still bring earlier positions, so the reader of the sink takes the first of what was written (first_of_group).
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pd.DataFrame({position: list(state.get[0]) if state.exists else [], "_old": True})
        best = before
        for f in frames:
            best = pd.concat([x for x in (best, f.assign(_old=False)) if len(x)] or [f.assign(_old=False)]).sort_values(position, kind="stable").head(quota)
        state.update(([int(x) for x in best[position].dropna()],))
        new = best[~best["_old"].astype(bool)]
        if len(new):
            yield new[[group, position]]

    rows = stream.select(group, position)
    return rows.groupBy(group).applyInPandasWithState(step, rows.schema.simpleString()[7:-1].replace(":", " "), "first array<long>", "append", GroupStateTimeout.NoTimeout)


def first_of_group(rows: DataFrame, group: str, position: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each group by position; the rank filter goes below the shuffle."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(position))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= quota).drop("_nth")


def first_per_url(stream: DataFrame, url: str, time: str, late: str = "1 hour") -> DataFrame:
    """Structured Streaming: one row for each URL within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([url])


def sampled(df: DataFrame, key: str, time: str, order: str, every: str = "3 seconds") -> DataFrame:
    """The first row of each key in each window of time; partial aggregates, so that a hot key costs a row a task and window."""
    w = F.window(F.col(time).cast("timestamp"), every)
    return df.groupBy(key, w.alias("w")).agg(F.min_by(F.struct(*df.columns), F.struct(time, order)).alias("r")).select("r.*", F.col("w.start").alias("window_start"))
