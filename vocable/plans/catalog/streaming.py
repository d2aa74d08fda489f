"""N: streaming runs over a file stream of ``events``; each query drains the
stream into a Parquet sink under the shared checkpoint folder and returns the
sink read back, so the oracle compares the streamed answer with SQL."""

from pyspark.sql import functions as F

from vocable.plans.catalog import vectors as _vectors  # noqa: F401  (registers the K7 oracle used below)
from vocable.plans.registry import ORACLE, register
from vocable.streaming import stateful as N

CHUNK = 8


@register("n1s_chunk_every_n", f"""
WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id),
c AS (SELECT user_id, x, unnest(range((len(x) + {CHUNK} - 1) // {CHUNK})) AS chunk_idx FROM s)
SELECT user_id, chunk_idx, CAST(len(x[chunk_idx * {CHUNK} + 1: chunk_idx * {CHUNK} + {CHUNK}]) AS BIGINT) AS n,
       x[chunk_idx * {CHUNK} + 1: chunk_idx * {CHUNK} + {CHUNK}] AS chunk FROM c
""")
def n1s(spark, sf):
    out = N.run_to_parquet(N.chunk_every_n(N.event_stream(spark, sf), CHUNK), "n1s")
    return N.latest_chunks(spark.read.schema(N.CHUNK_OUT).parquet(out))


def _split_chunks(spark, sf, name: str, n: int):
    from vocable.streaming import split as S
    state = S.ChunkState(spark, N.scratch(spark, name))
    N.run_foreach(S.chunk_sink(N.event_stream(spark, sf), state, N.scratch(spark, name + "-chk"), "user_id", ["ts", "event_id"], "value", n))
    return S.longest(state.chunks()).withColumnRenamed("key", "user_id")


@register("n1s_chunks_of_hot_keys", ORACLE["n1s_chunk_every_n"])
def n1s_split(spark, sf):
    """The chunks of N1s by steps that spread a key over all tasks."""
    return _split_chunks(spark, sf, "n1s-split", CHUNK).select("user_id", "chunk_idx", "n", "chunk")


OVERLAP = 2


@register("n2s_crossfade_chunks", f"""
WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id),
c0 AS (SELECT user_id, x, unnest(range((len(x) + {CHUNK} - 1) // {CHUNK})) AS chunk_idx FROM s),
c AS (SELECT user_id, chunk_idx, x[chunk_idx * {CHUNK} + 1: chunk_idx * {CHUNK} + {CHUNK}] AS c,
             x[chunk_idx * {CHUNK} - {OVERLAP} + 1: chunk_idx * {CHUNK}] AS tail FROM c0)
SELECT user_id, chunk_idx,
       CASE WHEN chunk_idx = 0 THEN c[1: len(c) - {OVERLAP}]
            WHEN len(c) < 2 * {OVERLAP} THEN c
            ELSE list_concat(list_transform(range({OVERLAP}), lambda i: tail[i + 1] * (1.0::DOUBLE - i / {OVERLAP - 1}.0::DOUBLE)
                                                                        + c[i + 1] * (i / {OVERLAP - 1}.0::DOUBLE)),
                             c[{OVERLAP} + 1: len(c) - {OVERLAP}]) END AS chunk
FROM c
""")
def n2s(spark, sf):
    """The chunks of N1s, read as a file stream, cross-faded over two samples."""
    first = N.scratch(spark, "n2s-in")
    n1s(spark, sf).write.parquet(first)
    chunks = spark.readStream.schema(N.CHUNK_OUT).parquet(first)
    out = N.run_to_parquet(N.crossfade_chunks(chunks, OVERLAP), "n2s")
    return spark.read.schema(N.FADE_OUT).parquet(out)


@register("n3s_running_stats", """
WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
                  list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre
           FROM events)
SELECT user_id, event_id, round(list_sum(pre) / k, 6) AS running_mean,
       round(list_reduce(pre, lambda a, x: a * 0.99::DOUBLE + x * (1.0::DOUBLE - 0.99::DOUBLE)), 6) AS ema
FROM s
""")
def n3s(spark, sf):
    out = N.run_to_parquet(N.running_stats(N.event_stream(spark, sf)), "n3s")
    r = spark.read.parquet(out)
    return r.select("user_id", "event_id", F.round("running_mean", 6).alias("running_mean"),
                    F.round("ema", 6).alias("ema"))


RING = 4000


@register("n4s_last_n_code_histogram", f"""
SELECT CAST(event_id % 16 AS BIGINT) AS code, count(*) AS n FROM (
  SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT {RING}) GROUP BY 1
""")
def n4s(spark, sf):
    """Histogram of the last 4000 codes (code = event_id mod 16), kept as a bounded ring table."""
    root = N.scratch(spark, "n4s-ring")
    N.run_foreach(N.ring_histogram_sink(N.event_stream(spark, sf), root, N.scratch(spark, "n4s-chk"), RING,
                                        F.pmod("event_id", F.lit(16)), ["ts", "event_id"]))
    ring = N.latest_version(spark, root)
    return ring.groupBy(F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _embedding_stream(spark, sf):
    """The embeddings, one file or a folder of them, as one micro-batch.  The pattern names either; a plain path to
    a file would not do, as a stream takes its path for a folder."""
    return spark.readStream.schema("vec_id long, embedding array<float>, label int").parquet(f"{sf.rstrip('/')}/embeddings.parque[t]")


@register("n7s_online_codebook", ORACLE["k7_ema_codebook_update"])
def n7s(spark, sf):
    """One micro-batch of embeddings → K5 assignment + K7 update of the codebook
    (the batch form is k7_ema_codebook_update)."""
    from vocable.plans.catalog.vectors import codebook
    root = N.scratch(spark, "n7s-book")
    N.run_foreach(N.online_codebook_sink(_embedding_stream(spark, sf), root, N.scratch(spark, "n7s-chk"), "embedding", codebook(spark, sf)))
    book = N.latest_version(spark, root)
    return book.select(F.col("code").cast("bigint").alias("code"), F.col("pos").cast("long").alias("pos"),
                       F.round("cluster_size", 6).alias("cluster_size"), F.round("v", 4).alias("v"))


@register("k8_online_codebook", ORACLE["k7_ema_codebook_update"])
def k8_online(spark, sf):
    """One step of the versioned codebook over a stream of the embeddings; no window is full yet, so no code is reset."""
    from vocable.plans.catalog.vectors import codebook
    from vocable.streaming import codebook as CB
    state = CB.CodebookState(spark, N.scratch(spark, "k8-state"), codebook(spark, sf))
    N.run_foreach(CB.online_codebook(_embedding_stream(spark, sf), state, N.scratch(spark, "k8-chk"), "vec_id", "embedding"))
    book = state.at(state.last())[0]
    v = book.select("code", F.col("size").alias("s"), F.posexplode("centroid").alias("pos", "v"))
    return v.select(F.col("code").cast("bigint").alias("code"), F.col("pos").cast("long").alias("pos"), F.round("s", 6).alias("cluster_size"),
                    F.round("v", 4).alias("v"))


@register("n8s_log_every_k", """
WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT user_id, ((k - 1) // 10 + 1) * 10 AS step, sum(value) AS s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, step, round(s / 10.0, 6) AS mean FROM c WHERE n = 10
""")
def n8s(spark, sf):
    out = N.run_to_parquet(N.log_every_k(N.event_stream(spark, sf), 10), "n8s")
    r = spark.read.parquet(out)
    return r.select("user_id", "step", F.round("mean", 6).alias("mean"))


@register("n8s_means_of_hot_keys", ORACLE["n8s_log_every_k"])
def n8s_split(spark, sf):
    """The means of N8s from the full chunks of the same steps."""
    c = _split_chunks(spark, sf, "n8s-split", 10).where("n = 10")
    mean = F.aggregate("chunk", F.lit(0.0), lambda a, x: a + x) / 10.0
    return c.select("user_id", ((F.col("chunk_idx") + 1) * 10).alias("step"), F.round(mean, 6).alias("mean"))


@register("n5s_quarantine", """
WITH fb AS (SELECT user_id, min((ts, event_id)) AS fb FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.event_id, e.user_id FROM events e LEFT JOIN fb ON e.user_id = fb.user_id
WHERE fb.fb IS NULL OR (e.ts, e.event_id) < fb.fb
""")
def n5s(spark, sf):
    kept, rej, quar = (N.scratch(spark, "n5s-kept"), N.scratch(spark, "n5s-rej"), N.scratch(spark, "n5s-q"))
    N.run_foreach(N.quarantine_sink(N.event_stream(spark, sf), kept, rej, quar, N.scratch(spark, "n5s-chk")))
    return spark.read.parquet(kept).select("event_id", "user_id")


@register("n6s_feature_cache", """
SELECT DISTINCT user_id, md5(CAST(user_id AS VARCHAR)) AS feature FROM events
""")
def n6s(spark, sf):
    store = N.scratch(spark, "n6s-store")
    N.run_foreach(N.feature_cache_sink(N.event_stream(spark, sf), store, N.scratch(spark, "n6s-chk"), "user_id",
                                       lambda fresh: fresh.select("user_id", F.md5(F.col("user_id").cast("string"))
                                                                  .alias("feature"))))
    return spark.read.parquet(store).drop("epoch")
