"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Two documents link when ``DEN * |A & B| >= NUM * |A | B|``.  If they do, their
overlap is at least ``ceil(NUM/DEN * size)`` for either size, so in any common
order of shingles the first ``size - overlap + l`` of both share at least ``l``.

1. *One pass* over whole texts: the set size and a 64-bit key of every set, and
   per task a Misra-Gries summary of frequent shingles over all documents
   (bounded counters; whatever occurs more often than shingles/counters is in).
2. *Classes*: documents with equal (key, size) are copies of one set and go on
   as one; the smallest id stands for the class.
3. *Prefixes*: shingles in the order rare → frequent.  A document whose shortest
   prefix reaches into frequent shingles has many candidates; it takes the
   ``l`` that costs least, counting the postings of its prefix and the
   candidates it may have to verify, and asks for ``min(l, l')`` shared shingles.
   Postings of one class only are dropped; long posting lists are shuffled in
   several parts.
4. *Stars*: the first and last class of each posting list are its pivots; every
   class is compared with two pivots at most, the one it shares most lists with
   and the smallest, so a family of near copies is found without its pairs.
5. *The rest*: pairs of classes that share enough prefix shingles, lie in
   different components after step 4 and were not compared yet are compared,
   all of them; long lists are paired in blocks of bounded size.  Classes that
   were compared with the same smaller pivot form a family; what two of them
   differ in shows in their differences from the pivot, not in what they share.
   If two link and their differences have nothing in common, both link with the
   pivot; else the first common entry is among the first ``D + 1`` of either,
   ``D`` being the most that a linking pair may differ in.  So a family is paired
   by those entries only, which few of its members share.
6. Components of all links; copies take their class's.

Verification routes whole texts to one of the two documents and compares exact
shingle sets; a document with many partners is spread over several groups.

Edge cases: null text counts as empty; a text without words links with nothing,
not even with another empty text; fewer than ``n`` words make one shingle of
the whole sequence; rows that repeat an id take part each with its own text; a row
without id takes the component of a row with an equal set, else none (null): it
joins no two others, and ``keep_one`` keeps it; an empty table gives an empty
result; other columns are not read, or carried along whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocable.llm.components import components
from vocable.llm.store import scratch, written
from vocable.llm.textbytes import U64, Texts, chunks, mix, shingle_hashes

#: Counters of the frequent-shingle summary per task, and entries that are broadcast.
COUNTERS, MAX_FREQUENT = 1 << 16, 1 << 17
#: A shingle counts as frequent from here on; most matches asked for; cost of a
#: verification in postings; share of candidates that has one match more; rows of
#: one part of a posting list; partners of one document in one group.
FREQUENT, MAX_MATCHES, VERIFY_COST, FURTHER, LIST_PART, STAR_PART = 4, 32, 20, 0.7, 2048, 256


class Sets:
    """Distinct shingles of the rows of a chunk: ``token[ptr[i]:ptr[i+1]]``, sorted per row."""

    def __init__(self, texts: pa.Array, n: int):
        t = Texts(texts, lower=True)
        row, s, e = t.words()
        word = t.hash_ranges(s, e)
        at, h = shingle_hashes(row, word, n)
        rows = row[at]
        count = np.bincount(row, minlength=t.n)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            first = np.searchsorted(row, short)
            hs = np.zeros(len(short), U64)
            for j in range(n - 1):
                more = count[short] > j
                hs[more] = mix(hs[more] * U64(31) + word[first[more] + j] + U64(99 + j))
            rows, h = np.concatenate([rows, short]), np.concatenate([h, hs])
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        self.row, self.token = rows[keep], h[keep]
        self.size = np.bincount(self.row, minlength=t.n)
        self.ptr = np.r_[0, np.cumsum(self.size)]

    def keys(self) -> np.ndarray:
        """64-bit key of every row's set."""
        a = np.zeros(len(self.token) + 1, U64)
        np.cumsum(mix(self.token ^ U64(0x5851F42D4C957F2D)), out=a[1:])
        return mix((a[self.ptr[1:]] - a[self.ptr[:-1]]) + self.size.astype(U64)).view(np.int64)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.token[self.ptr[i]:self.ptr[i + 1]]


def _merge_counts(keys, counts, more_keys, more_counts):
    """Misra-Gries: add, then take off the largest count that does not fit."""
    k, inv = np.unique(np.concatenate([keys, more_keys]), return_inverse=True)
    c = np.bincount(inv, weights=np.concatenate([counts, more_counts])).astype(np.int64)
    if len(k) > COUNTERS:
        c -= np.partition(c, len(c) - COUNTERS - 1)[len(c) - COUNTERS - 1]
        k, c = k[c > 0], c[c > 0]
    return k, c


def _heads(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(part.column(part.schema.get_field_index("text")), n)
                k, c = np.unique(sets.token, return_counts=True)
                keys, counts = _merge_counts(keys, counts, k[c > 1], c[c > 1])
                # one count is taken off every shingle of the chunk; the summary stays within its bound
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(part.num_rows, np.int32)), part.column(part.schema.get_field_index("doc_id")),
                     pa.array(sets.keys()), pa.array(sets.size.astype(np.int64))], names=["kind", "doc_id", "key", "n"])
        big = counts >= 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(int(big.sum()), np.int32)), pa.nulls(int(big.sum()), pa.int64()),
             pa.array(keys[big].view(np.int64)), pa.array(counts[big])], names=["kind", "doc_id", "key", "n"])
    return run


def matches(df: np.ndarray, base: int) -> int:
    """The number of shared shingles to ask for: ``df`` are estimated document
    counts in prefix order, ``base`` the length of the shortest prefix.

    The cost is the postings of the prefix plus the documents to verify.  Every
    other posting of the shortest prefix is a possible candidate; documents that
    share one shingle tend to share more (a common passage), so each further
    match is taken to leave the share ``FURTHER`` of them.
    """
    most = min(MAX_MATCHES, len(df) - base + 1)
    postings = np.cumsum(df[:base + most - 1])[base - 1:]
    candidates = float(postings[0] - base) * FURTHER ** np.arange(most)
    return 1 + int(np.argmin(postings + VERIFY_COST * candidates))


def _prefixes(shared, n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fkeys, fdf = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(part.column(part.schema.get_field_index("text")), n)
                key, size = sets.keys(), sets.size
                base = size - (size * num + den - 1) // den + 1
                rows = []
                # base 1: only a set that holds all of this one and more can link with it
                for i in np.flatnonzero((size > 0) & ((base > 1) | (den * size >= num * (size + 1)))).tolist():
                    k = (int(key[i]), int(size[i]))
                    if k not in seen:
                        seen.add(k)
                        rows.append(i)
                if len(seen) > 1 << 18:
                    seen.clear()
                df = np.full(len(sets.token), 2, np.int64)     # not frequent: shared with one other, say
                if len(fkeys):
                    at = np.minimum(np.searchsorted(fkeys, sets.token), len(fkeys) - 1)
                    hit = fkeys[at] == sets.token
                    df[hit] = fdf[at[hit]]
                order = np.lexsort((sets.token, df, sets.row))
                token, df = sets.token[order], df[order]
                pick, ell = [], np.ones(len(size), np.int64)
                for i in rows:
                    a, b = int(sets.ptr[i]), int(base[i])
                    stop = min(int(size[i]), b + MAX_MATCHES - 1)
                    ell[i] = matches(df[a:a + stop], b)
                    pick.append(np.arange(a, a + min(stop, b + int(ell[i]) - 1)))
                pick = np.concatenate(pick) if pick else np.zeros(0, np.int64)
                r = sets.row[pick]             # rows keep their place under a sort by row
                parts = np.maximum(1, df[pick] // LIST_PART)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[pick].view(np.int64)),
                     pa.array(np.where(parts > 1, 1 + (key[r].view(U64) % parts.astype(U64)).astype(np.int64), 0).astype(np.int32)),
                     pa.array(key[r]), pa.array(size[r].astype(np.int32)), pa.array(ell[r].astype(np.int32)),
                     pa.array((pick - sets.ptr[r]).astype(np.int32))],
                    names=["token", "part", "key", "n", "ell", "pos"])
    return run


def _shared_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct postings of (sorted) lists of at least two classes; parts of split lists stay whole."""
    rest = None
    names = ["token", "part", "key", "n", "ell", "pos"]

    def emit(cols):
        t, p, k, n, e, i = cols
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        t, p, k, n, e, i = (c[new] for c in (t, p, k, n, e, i))
        edge = np.ones(len(t) + 1, bool)
        edge[1:-1] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        start = np.flatnonzero(edge)
        length = np.repeat(np.diff(start), np.diff(start))
        keep = (length > 1) | (p > 0)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (t, p, k, n, e, i)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        t, p = cols[0], cols[1]
        last = int(np.flatnonzero((t != t[-1]) | (p != p[-1]))[-1]) + 1 if ((t != t[-1]) | (p != p[-1])).any() else 0
        rest = [c[last:] for c in cols]
        if last:
            yield emit([c[:last] for c in cols])
    if rest is not None and len(rest[0]):
        yield emit(rest)


def _verifier(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(part.column(part.schema.get_field_index("text")), n)
                key = sets.keys().tolist()
                names = part.schema.names
                dest, part_no, role, member, want, fam = (part.column(names.index(c)).to_pylist()
                                                          for c in ("dest", "part", "role", "member", "key", "fam"))
                a, b, lead, who, size, mark, place = [], [], [], [], [], [], []
                for i in range(part.num_rows):
                    if key[i] != want[i]:        # another row with this id
                        continue
                    if role[i] == 0:
                        group, pivot = (dest[i], part_no[i]), sets[i].copy()
                    elif group == (dest[i], part_no[i]):
                        x = sets[i]
                        inter = len(pivot) + len(x) - len(np.union1d(pivot, x))
                        if den * inter >= num * (len(pivot) + len(x) - inter):
                            a.append(dest[i])
                            b.append(member[i])
                        if fam[i]:
                            own, lost = np.setdiff1d(x, pivot, True), np.setdiff1d(pivot, x, True)
                            d = np.concatenate([mix(own + U64(1)), mix(mix(lost) + U64(2))])[:len(x) * (den - num) // num + 1]
                            lead += [dest[i]] * len(d)
                            who += [member[i]] * len(d)
                            size += [len(x)] * len(d)
                            place += range(len(d))
                            mark.append(mix(d ^ mix(np.full(len(d), dest[i], np.int64).view(U64))).view(np.int64))
                k = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a + lead, pa.int64()), pa.array(b + who, pa.int64()), pa.array([0] * k + size, pa.int32()),
                     pa.array(np.concatenate([np.zeros(k, np.int64), *mark])), pa.array([0] * k + place, pa.int32())],
                    names=["u", "v", "n", "mark", "pos"])
    return run


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Compares the pairs (u, v, fam) of class ids exactly, by their whole texts.

    Rows with n = 0 are the links (u, v).  For pairs with ``fam``, v's difference
    from u is given too: its first entries, one row each (u, v, size of v, mark, place),
    in an order that all differences from u share.
    """
    degree = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    salted = pairs.join(degree, "u").select(
        F.col("u").alias("dest"), F.col("v").alias("member"),
        F.pmod(F.xxhash64("v"), F.ceil(F.col("d") / STAR_PART)).cast("int").alias("part"), F.col("fam").cast("int").alias("fam"))
    routes = salted.withColumn("role", F.lit(1)).unionByName(
        salted.select("dest", "part").distinct().withColumn("member", F.col("dest")).withColumn("fam", F.lit(0))
        .withColumn("role", F.lit(0)))
    routes = routes.join(classes.select(F.col("rep").alias("member"), "key"), "member")
    sent = routes.join(docs, routes.member == docs.doc_id).select("dest", "part", "role", "member", "key", "fam", "text")
    sent = sent.repartition("dest", "part").sortWithinPartitions("dest", "part", "role", "member")
    return sent.mapInArrow(_verifier(n, num, den), "u long, v long, n int, mark long, pos int").distinct()


def _blocked_pairs(num: int, den: int):
    """All pairs of each (token, block, block) group whose components differ and
    whose sizes allow a link.  Rows arrive sorted by group; a group holds at most
    two blocks of a list.
    """
    def pairs(g: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, b1, b2, mine, rep, size, ell, pos, own, lead, comp = g
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
        start = np.flatnonzero(new)
        left = np.repeat(np.r_[start[1:], len(token)], np.diff(np.r_[start, len(token)])) - np.arange(len(token)) - 1
        i = np.flatnonzero(left > 0)
        out, held, step = [[] for _ in range(6)], 0, 1
        while len(i):                      # partners at distance 1, 2, ... in all groups at once
            j = i + step
            lo, both = np.minimum(size[i], size[j]).astype(np.int64), size[i].astype(np.int64) + size[j]
            ok = (comp[i] != comp[j]) & (den * lo >= num * np.maximum(size[i], size[j]))
            ok &= (b1[i] == b2[i]) | (mine[i] != mine[j])
            ok &= (lead[i] != lead[j]) | (lead[i] < 0)     # of one family: their differences are paired instead
            # shingles that come before this one and belong to one of the two only
            ok &= np.maximum(own[i] + own[j], np.abs(pos[i] - pos[j])) <= both - 2 * -(-num * both // (num + den))
            a, b = i[ok], j[ok]
            a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
            for col, x in zip(out, (rep[a], rep[b], np.minimum(ell[a], ell[b]), pos[a], pos[b], both[ok])):
                col.append(x)
            held += len(a)
            step += 1
            i = i[left[i] >= step]
            if held > 1 << 18 or (held and not len(i)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out],
                                                 names=["u", "v", "need", "pos_u", "pos_v", "both"])
                out, held = [[] for _ in range(6)], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            other = np.flatnonzero(np.any([c != c[-1] for c in cols[:3]], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from pairs([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
        if rest is not None:
            yield from pairs(rest)
    return run


def _enough(pairs: DataFrame, u: str, v: str, num: int, den: int) -> DataFrame:
    """Pairs that can still link, with the number of prefix shingles they share.

    They share as many as the less demanding of the two asks for; and up to the
    last shared one, the shingles that only one of them has are no more than a
    linking pair may differ in: a shingle that comes before it in both orders and
    is in both sets would have been counted.
    """
    both = F.max("both")
    differ = both - 2 * F.ceil(num * both / (num + den))
    apart = F.max("pos_u") + F.max("pos_v") + 2 - 2 * F.count(F.lit(1))
    return pairs.groupBy(u, v).agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need"),
                                   (apart <= differ).alias("close")).where("close and shared >= need")


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_id.

    ``class_id`` is the smallest id with the same shingle set (null where empty).
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    path = scratch(spark, "jaccard-heads")
    d.mapInArrow(_heads(n), "kind int, doc_id long, key long, n long").write.partitionBy("kind").parquet(path)
    back = spark.read.schema("doc_id long, key long, n long, kind int").parquet(path)
    heads = back.where("kind = 0").drop("kind")
    frequent = (back.where("kind = 1").groupBy("key").agg(F.sum("n").alias("df")).where(F.col("df") >= FREQUENT)
                .orderBy(F.desc("df"), "key").limit(MAX_FREQUENT).toPandas())
    fkeys = frequent.key.to_numpy(np.int64).view(U64)
    order = np.argsort(fkeys)
    classes = written(heads.where("n > 0 and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("rep")),
                      "jaccard-classes")
    shared = spark.sparkContext.broadcast((fkeys[order], frequent.df.to_numpy(np.int64)[order]))

    posting = "token long, part int, key long, n int, ell int, pos int"
    postings = d.mapInArrow(_prefixes(shared, n, num, den), posting)
    postings = postings.repartition("token", "part").sortWithinPartitions("token", "part", "key", "n")
    postings = postings.mapInArrow(_shared_postings, posting)
    lists = postings.join(classes, ["key", "n"]).select("token", "rep", "n", "ell", "pos")
    # prefix shingles before this one that no other class has; a class has no more postings than its prefix
    before = F.row_number().over(Window.partitionBy("rep", "n").orderBy("pos")) - 1
    lists = written(lists.withColumn("own", F.col("pos") - before), "jaccard-lists")

    # stars: every class against the first and last class of its lists
    end = F.struct("rep", "n", "ell", "pos")
    ends = lists.groupBy("token").agg(F.min(end).alias("a"), F.max(end).alias("b")).where("a.rep <> b.rep")
    star = lists.join(ends, "token").select("token", "rep", "n", "ell", "pos", F.explode(F.array("a", "b")).alias("p"))
    star = star.where(F.col("rep") != F.col("p.rep")).where(
        den * F.least("n", "p.n") >= num * F.greatest("n", "p.n"))
    star = star.select(F.col("rep").alias("u"), F.col("p.rep").alias("v"), F.least("ell", "p.ell").alias("need"),
                       F.col("pos").alias("pos_u"), F.col("p.pos").alias("pos_v"), (F.col("n") + F.col("p.n")).alias("both"))
    # a pivot of some lists only: what it shares elsewhere is not seen here, so only the count is asked for
    star = star.groupBy(F.col("u").alias("member"), F.col("v").alias("pivot")).agg(
        F.count(F.lit(1)).alias("shared"), F.max("need").alias("need")).where("shared >= need")
    # of a class's pivots, the one it shares most with and the smallest
    best = star.groupBy("member").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("a"), F.min("pivot").alias("b"))
    best = best.select("member", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("pivot"))
    tried = best.groupBy(F.least("member", "pivot").alias("u"), F.greatest("member", "pivot").alias("v")).agg(
        F.max((F.col("pivot") == F.col("b")) & (F.col("pivot") < F.col("member"))).alias("fam"))
    tried = written(tried, "jaccard-stars")
    checked = written(_verify(d, classes, tried, n, num, den), "jaccard-links")
    links, differences = checked.where("n = 0").select("u", "v"), checked.where("n > 0")
    comp = components(links)

    # the rest: pairs across components that share enough of their prefixes
    family = differences.select(F.col("v").alias("rep"), F.col("u").alias("lead")).distinct()
    alone = F.lit(-1).cast("long")
    listed = lists.join(family, "rep", "left").withColumn("lead", F.coalesce("lead", alone))
    marks = differences.select(F.col("v").alias("rep"), F.col("mark").alias("token"), "n", F.lit(1).alias("ell"),
                               "pos", F.lit(0).alias("own"), alone.alias("lead"))
    placed = listed.unionByName(marks).join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                        F.count(F.lit(1)).alias("k")).where("lo <> hi")
    blocks = F.ceil(F.col("k") / LIST_PART).cast("int")
    rows = placed.join(mixed, "token").withColumn("blocks", blocks).withColumn(
        "mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine", "rep", "n", "ell",
        "pos", "own", "lead", "component")
    rows = rows.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2")
    pairs = rows.mapInArrow(_blocked_pairs(num, den), "u long, v long, need int, pos_u int, pos_v int, both long")
    rest = written(_enough(pairs, "u", "v", num, den).select("u", "v").join(tried, ["u", "v"], "left_anti"), "jaccard-rest")
    more = _verify(d, classes, rest.withColumn("fam", F.lit(0)), n, num, den).select("u", "v")
    links = links.unionByName(written(more, "jaccard-links"))
    comp = written(components(links), "jaccard-components")

    per_class = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "n", "rep", F.coalesce("component", "rep").alias("component"))
    out = heads.join(per_class, ["key", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("component", "doc_id").alias("component_id"), F.col("rep").alias("class_id"))


def keep_one(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``docs`` without the documents whose component holds a smaller id."""
    gone = jaccard_components(docs, n, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone.distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")
