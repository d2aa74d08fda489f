"""N: Structured Streaming forms of the stateful operators.

Sources are file streams (``readStream`` over Parquet, ``maxFilesPerTrigger``);
sinks are Parquet folders under the session's shared checkpoint folder, so a
restarted query resumes from its checkpoint.  Runs drain their source with
``availableNow`` and end by themselves: no result depends on a clock.

Keyed state uses ``applyInPandasWithState``.  A key's rows of one micro-batch
are gathered and ordered before they are used (Arrow hands them over in
batches), and state is kept until the stream's owner drops it.  Work that needs
joins against tables uses ``foreachBatch``; every epoch writes its own folder, so
an epoch that runs again replaces what it wrote.
"""

from __future__ import annotations

from itertools import accumulate, chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from vocable.session import scratch

EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Files ``events*.parquet`` of a folder; a table kept as a folder of that name counts with all its files."""
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(f"{sf_dir.rstrip('/')}/events*.parquet"))


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append") -> str:
    """Drain the source into a Parquet folder and return its path."""
    out, chk = scratch(df.sparkSession, name + "-out"), scratch(df.sparkSession, name + "-chk")
    run_foreach(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
                .outputMode(output_mode))
    return out


def run_foreach(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _in_order(batches, order: list[str]) -> pd.DataFrame:
    """All rows of a key in this micro-batch, in order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


# ---------------------------------------------------------------- N1s
CHUNK_OUT = "user_id long, chunk_idx long, n long, chunk array<double>"
CHUNK_STATE = "emitted long, buf array<double>"


def _chunker(n: int):
    def fn(key, batches, state):
        emitted, buf = state.get if state.exists else (0, [])
        x = np.concatenate([np.asarray(buf, float), _in_order(batches, ["ts", "event_id"])["value"].to_numpy(float)])
        pieces = [x[i:i + n] for i in range(0, len(x), n)]
        full = len(x) // n
        state.update((emitted + full, x[full * n:].tolist()))
        if pieces:
            yield pd.DataFrame({"user_id": key[0], "chunk_idx": np.arange(emitted, emitted + len(pieces)),
                                "n": [len(c) for c in pieces], "chunk": [c.tolist() for c in pieces]})
    return fn


def chunk_every_n(stream: DataFrame, n: int) -> DataFrame:
    """N1s: per key, a row for every ``n`` values, and for the unfinished last
    chunk one row with what it holds so far; :func:`latest_chunks` keeps the
    longest row of each chunk, so the tail needs no end-of-input signal."""
    return stream.groupBy("user_id").applyInPandasWithState(
        _chunker(n), CHUNK_OUT, CHUNK_STATE, "append", GroupStateTimeout.NoTimeout)


def latest_chunks(emitted: DataFrame) -> DataFrame:
    """The chunks of :func:`chunk_every_n`'s sink: the longest row of each."""
    g = emitted.groupBy("user_id", "chunk_idx").agg(F.max_by(F.struct("n", "chunk"), "n").alias("c"))
    return g.select("user_id", "chunk_idx", "c.n", "c.chunk")


def chunk_every_n_batch(events: DataFrame, n: int) -> DataFrame:
    """Batch form of N1s (the S check compares the two)."""
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.withColumn("_i", F.row_number().over(w) - 1).withColumn("chunk_idx", F.expr(f"_i div {n}"))
    g = e.groupBy("user_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("_i", "value"))).alias("_v"))
    return g.select("user_id", "chunk_idx", F.size("_v").cast("long").alias("n"),
                    F.transform("_v", lambda r: r["value"]).alias("chunk"))


# ---------------------------------------------------------------- N2s
FADE_OUT = "user_id long, chunk_idx long, chunk array<double>"
FADE_STATE = "tail array<double>"


def crossfaded(chunks: list[np.ndarray], tail: np.ndarray | None, overlap: int) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Emit each chunk without its last ``overlap`` samples, which are held back
    and reach the output only as the fading part of the next chunk's head.  A
    chunk too short for that is passed on whole and ends the held-back tail."""
    up = np.linspace(0.0, 1.0, overlap)
    out = []
    for c in chunks:
        body = c[:-overlap].copy()
        if tail is not None and len(body) < overlap:
            out.append(c)
            tail = None
            continue
        if tail is not None:
            body[:overlap] = tail * (1.0 - up) + body[:overlap] * up
        out.append(body)
        tail = c[-overlap:] if len(c) >= overlap else None
    return out, tail


def _crossfader(overlap: int):
    def fn(key, batches, state):
        tail = np.asarray(state.get[0], float) if state.exists and state.get[0] is not None else None
        rows = _in_order(batches, ["chunk_idx"])
        out, tail = crossfaded([np.asarray(c, float) for c in rows["chunk"]], tail, overlap)
        state.update((None if tail is None else tail.tolist(),))
        if out:
            yield pd.DataFrame({"user_id": key[0], "chunk_idx": rows["chunk_idx"].to_numpy(),
                                "chunk": [c.tolist() for c in out]})
    return fn


def crossfade_chunks(chunks: DataFrame, overlap: int) -> DataFrame:
    """N2s: linear cross-fade of each chunk's head with the tail held back from the one before."""
    return chunks.groupBy("user_id").applyInPandasWithState(
        _crossfader(overlap), FADE_OUT, FADE_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- N3s
RUN_OUT = "user_id long, event_id long, running_mean double, ema double"
RUN_STATE = "n long, total double, ema double"


def decayed(x: np.ndarray, start: float | None, decay: float) -> np.ndarray:
    """y[0] = start (or x[0]), y[i] = decay·y[i-1] + (1-decay)·x[i], added up in order."""
    rest = x.tolist()
    if start is None:
        y = accumulate(rest, lambda a, v: a * decay + v * (1.0 - decay))
    else:
        y = islice(accumulate(chain([start], rest), lambda a, v: a * decay + v * (1.0 - decay)), 1, None)
    return np.fromiter(y, float, len(rest))


def _runner(decay: float):
    def fn(key, batches, state):
        n, total, ema = state.get if state.exists else (0, 0.0, None)
        rows = _in_order(batches, ["ts", "event_id"])
        x = rows["value"].to_numpy(float)
        sums, counts = total + np.cumsum(x), n + np.arange(1, len(x) + 1)
        emas = decayed(x, ema, decay)
        if len(x):
            state.update((int(counts[-1]), float(sums[-1]), float(emas[-1])))
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "running_mean": sums / counts,
                                "ema": emas})
    return fn


def running_stats(stream: DataFrame, decay: float = 0.99) -> DataFrame:
    """N3s: running mean and EMA per key, one output row per input row."""
    return stream.groupBy("user_id").applyInPandasWithState(
        _runner(decay), RUN_OUT, RUN_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- N8s
EVERY_OUT = "user_id long, step long, mean double"
EVERY_STATE = "n long, acc double"


def _every_k(k: int):
    def fn(key, batches, state):
        n, acc = state.get if state.exists else (0, 0.0)
        x = _in_order(batches, ["ts", "event_id"])["value"].to_numpy(float)
        window = (n + np.arange(len(x))) // k - n // k           # 0 is the window that the state belongs to
        sums = np.bincount(window, weights=x, minlength=1)
        sums[0] += acc
        done = (n + len(x)) // k - n // k
        state.update((n + len(x), float(sums[done]) if done < len(sums) else 0.0))
        if done:
            yield pd.DataFrame({"user_id": key[0], "step": (n // k + 1 + np.arange(done)) * k, "mean": sums[:done] / k})
    return fn


def log_every_k(stream: DataFrame, k: int) -> DataFrame:
    """N8s: per key, one log row every ``k`` steps with the mean of those steps
    (no row for an unfinished window, as a step logger does)."""
    return stream.groupBy("user_id").applyInPandasWithState(
        _every_k(k), EVERY_OUT, EVERY_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- N4s / N7s (foreachBatch, versioned tables)

def _version(spark: SparkSession, root: str, epoch: int) -> DataFrame:
    """What the epoch before wrote; if that can't be read, the epoch fails."""
    return spark.read.parquet(f"{root}/v={epoch - 1}")


def ring_histogram_sink(stream: DataFrame, ring_root: str, chk: str, capacity: int, code: Column,
                        order: list[str]):
    """N4s: keep the last ``capacity`` codes (arrival order ``order``) in a
    bounded table; each micro-batch writes a new version = newest
    ``capacity`` rows of (previous version ∪ batch).  The table never holds
    more than ``capacity`` rows, so the top-k is bounded."""
    def process(batch: DataFrame, epoch: int) -> None:
        new = batch.select(*order, code.alias("code"))
        if epoch:
            new = _version(batch.sparkSession, ring_root, epoch).unionByName(new)
        top = new.orderBy(*[F.col(c).desc() for c in order]).limit(capacity)
        top.write.mode("overwrite").parquet(f"{ring_root}/v={epoch}")

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", chk)


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version, found through the store's own listing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    epoch = max(int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found)
    return spark.read.parquet(f"{root}/v={epoch}")


def online_codebook_sink(stream: DataFrame, book_root: str, chk: str, vec_col: str, initial: DataFrame):
    """N7s: per micro-batch, assign codes with the current codebook version
    (K5) and write the EMA-updated version (K7) with its cluster sizes."""
    from vocable.operators.vectors import ema_update, nearest_code

    def process(batch: DataFrame, epoch: int) -> None:
        if epoch:
            cur = _version(batch.sparkSession, book_root, epoch)
            book = cur.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_c"),
                                           F.first("cluster_size").alias("cluster_size"))
            book = book.select("code", F.transform("_c", lambda r: r["v"]).alias("centroid"), "cluster_size")
        else:
            book = initial.withColumn("cluster_size", F.lit(0.0))
        cb = book.select("code", "centroid")
        sizes = book.select("code", "cluster_size")
        assigned = nearest_code(batch.select(vec_col), vec_col, cb)
        upd = ema_update(assigned, vec_col, cb, sizes)
        upd.write.mode("overwrite").parquet(f"{book_root}/v={epoch}")

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", chk)


# ---------------------------------------------------------------- N5s / N6s (foreachBatch)

def _before(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """Rows that earlier epochs wrote below ``folder``."""
    return spark.read.parquet(folder).where(F.col("epoch") < epoch).drop("epoch")


def quarantine_sink(stream: DataFrame, kept_dir: str, rejected_dir: str, quarantine_dir: str, chk: str,
                    bad: str = "event_type = 'error'"):
    """N5s: a key becomes bad at its first bad row and every later row of it is
    rejected, in this and all later micro-batches.  Each micro-batch:
    ``left_anti`` against the quarantine table, split by the first bad row,
    write kept rows, rejected rows and newly bad keys to this epoch's folders."""
    def process(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = _before(spark, quarantine_dir, epoch) if epoch else spark.createDataFrame(
            [], "user_id long, q_ts timestamp_ntz, q_event long")
        b = batch.join(known.select("user_id"), "user_id", "left_anti")
        rejected_known = batch.join(known.select("user_id"), "user_id", "left_semi")
        first_bad = (b.where(F.expr(bad)).groupBy("user_id")
                     .agg(F.min(F.struct("ts", "event_id")).alias("_fb")))
        j = b.join(first_bad, "user_id", "left")
        after = F.col("_fb").isNotNull() & (F.struct("ts", "event_id") >= F.col("_fb"))
        cols = batch.columns

        def put(df: DataFrame, folder: str) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

        put(j.where(~after).select(*cols), kept_dir)
        put(j.where(after).select(*cols).unionByName(rejected_known.select(*cols)), rejected_dir)
        put(first_bad.select("user_id", F.col("_fb.ts").alias("q_ts"), F.col("_fb.event_id").alias("q_event")), quarantine_dir)

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", chk)


def feature_cache_sink(stream: DataFrame, store_dir: str, chk: str, key: str, compute):
    """N6s: compute features only for keys not yet in the store
    (``dropDuplicates`` inside the batch, ``left_anti`` against earlier epochs)."""
    def process(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([key])
        if epoch:
            fresh = fresh.join(_before(batch.sparkSession, store_dir, epoch).select(key), key, "left_anti")
        compute(fresh).write.mode("overwrite").parquet(f"{store_dir}/epoch={epoch}")

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", chk)
