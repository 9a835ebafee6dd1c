"""Operator 1: benchmark decontamination by rare n-gram seeds and local alignment.

Test items are cut into passages of at most ``passage`` words, and those into stretches
of ``STRETCH`` n-grams. One reading of the corpus cuts documents into windows of a fixed
length that overlap by half and gathers the benchmark's n-grams of each; their counts
follow from it. Seeds are the rare n-grams of each stretch: those that occur in the
corpus, at most ``RARE`` times as often as the second rarest of their stretch; of the
stretches, those whose rarest seed is at most ``COMMON`` times as frequent as that of
the rarest stretches that a match needs. (The rarest alone would not do: next to an exact copy,
the n-grams that an edit broke are rarer than those that it left.) An equi-join on
the seeds gives (window, passage) candidates with two different seeds (or the only one
of a passage that has no more) in enough stretches; passages that lack so many in the
whole corpus meet nothing. A second reading fetches the words of windows with a
candidate, each once, and Smith-Waterman aligns: 2 for a match, -1 for a mismatch or gap,
over 2 times the passage's length. Copies with replaced, dropped or inserted words keep a
high score; ``least`` is the share that must be left.

The readings use a bitmap of hashes as a first filter. Its size follows the benchmark
and is bounded (``common.MAP_BITS``); the joins that follow are exact, so a benchmark
of any size gives the same result, only less filtered.

Cases: null and empty texts match nothing, nor do items without words; an item of fewer
than ``n`` words has no n-gram and matches the documents that consist of just its words
(anywhere inside, so short a phrase would be chance); equal items each match; rows of a null ``doc_id`` are matched and dropped
like others; repeated rows give one row per (doc_id, item_id); extra columns are passed
through by ``decontaminate``; empty tables on either side mean no matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bitmap, durable, free_name, grams, lean, mix, prepare, table, word_chunks

_U = np.uint64
#: n-grams of a stretch, and how much more frequent than the rarest seeds of a stretch or passage may be
STRETCH, RARE, COMMON = 8, 8, 64
#: rows that the passages of a window are dealt over
PARTS = 16


def _passages(n: int, passage: int):
    """Of (item_id, text), the passages: their words, their n-grams in order, and what a candidate needs: different seeds, and stretches with one."""

    def run(batches):
        for batch in batches:
            items, parts, words, seeds, need, spread = [], [], [], [], [], []
            for first, starts, hashes in word_chunks(batch.column(1)):
                for k in range(len(starts) - 1):
                    own = hashes[starts[k] : starts[k + 1]]
                    step = passage // 2
                    for p, a in enumerate(range(0, max(1, len(own) - step), step)):
                        some = own[a : a + passage]
                        if not len(some) or len(some) < n <= len(own):
                            continue
                        items.append(batch.column(0)[first + k].as_py())
                        parts.append(p)
                        g = grams(some, n)
                        tiny = len(own) < n  # no n-gram: found by its key alone
                        words.append([] if tiny else some.view(np.int64).tolist())
                        seeds.append(g.view(np.int64).tolist())
                        need.append(0 if tiny else min(2, len(np.unique(g))))
                        stretches = -(-len(g) // STRETCH)
                        spread.append((stretches + 1) // 2 if stretches > 2 else 1)  # what a passage copied to 0.6 reaches
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(parts, pa.int32()), pa.array(words, longs), pa.array(seeds, longs), pa.array(need, pa.int32()), pa.array(spread, pa.int32())], ["item_id", "part", "words", "grams", "need", "spread"])

    return run


def _spread(starts: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of every position of a chunk and whether they lie within one text."""
    g = grams(hashes, n) if len(hashes) >= n else np.zeros(0, np.uint64)
    whole = np.ones(len(g), dtype=bool)
    for d in range(1, n):
        cut = starts[1:-1] - d
        whole[cut[(cut >= 0) & (cut < len(g))]] = False
    return g, whole


def _windows(n: int, passage: int, wanted: Bitmap, words: bool):
    """Of (doc_id, fp, text), the windows of 4 passages' length, at every second passage's length: those that hold wanted n-grams, with these; or the wanted ones, with their words."""
    stride, longs = 2 * passage, pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            rows, begins, held = [], [], []
            ids = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], dtype=np.int64)
            own = mix(ids.view(np.uint64)) + mix(batch.column(1).to_numpy().view(np.uint64)) * _U(3)
            for first, starts, hashes in word_chunks(batch.column(2)):
                if words:
                    count = np.maximum(1, -(-np.diff(starts) // stride) - 1)  # the last window reaches the end
                    doc = np.repeat(np.arange(len(count)), count)
                    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                    some = np.flatnonzero(wanted.has(mix(own[first + doc] + (k * stride).astype(np.uint64))))
                    for d, at in zip(doc[some].tolist(), (k[some] * stride).tolist()):
                        rows.append(first + d)
                        begins.append(at)
                        lo = int(starts[d]) + at
                        held.append(hashes[lo : min(lo + 2 * stride, int(starts[d + 1]))].view(np.int64))
                    continue
                g, whole = _spread(starts, hashes, n)
                at = np.flatnonzero(whole)
                at = at[wanted.has(g[at])]
                if not len(at):
                    continue
                doc = np.searchsorted(starts, at, side="right") - 1
                place = at - starts[doc]
                last = np.maximum(0, -(-np.diff(starts) // stride) - 2)[doc]  # of a text's windows
                k = place // stride
                two = np.flatnonzero((k > 0) & (k <= last) & (place + n <= (k + 1) * stride))
                k = np.minimum(k, last)
                doc, k, key = np.append(doc, doc[two]), np.append(k, k[two] - 1), np.append(g[at], g[at[two]])
                order = np.lexsort((key, k, doc))
                doc, k, key = doc[order], k[order], key[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])
                keep = new.copy()
                keep[1:] |= key[1:] != key[:-1]
                edge = np.flatnonzero(new)
                rows += (first + doc[edge]).tolist()
                begins += (k[edge] * stride).tolist()
                held += [x[y].view(np.int64) for x, y in zip(np.split(key, edge[1:]), np.split(keep, edge[1:]))]
            at = np.array(begins, dtype=np.int64)
            row = np.array(rows, dtype=np.int64)
            wid = mix(own[row] + at.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(wid), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at), pa.array(held, longs)], ["wid", "doc_id", "fp", "at", "held"])

    return run


def choose_seeds(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, part, need, spread, stretch, gram): the rare n-grams of each stretch of passages, given the corpus's (gram, n)."""
    every = parts.select("item_id", "part", "need", "spread", F.posexplode("grams").alias("pos", "gram")).withColumn("stretch", F.floor(F.col("pos") / STRETCH)).drop("pos").distinct()
    met = every.join(counts, "gram")
    whole, stretch = ["item_id", "part"], ["item_id", "part", "stretch"]  # of a passage's n-grams at most
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy(*stretch).orderBy("n", "gram")))
    bar = F.max(F.when(F.col("r") <= 2, F.col("n"))).over(Window.partitionBy(*stretch))
    rare = ranked.withColumn("bar", bar).where(F.col("n") <= RARE * F.col("bar"))
    least = rare.groupBy(*stretch, "spread").agg(F.min("n").alias("least"))
    least = least.withColumn("s", F.row_number().over(Window.partitionBy(*whole).orderBy("least", "stretch")))
    level = F.max(F.when(F.col("s") <= F.col("spread"), F.col("least"))).over(Window.partitionBy(*whole))
    enough = F.count("*").over(Window.partitionBy(*whole)) >= F.col("spread")
    some = least.withColumn("level", level).withColumn("enough", enough).where(F.col("enough") & (F.col("least") <= COMMON * F.col("level")))
    return rare.join(some.select(*stretch), stretch).select(*whole, "need", "spread", "stretch", "gram")


def _whole(n: int):
    """The keys of texts of fewer than ``n`` words."""

    def run(batches):
        for batch in batches:
            rows, keys, sizes = [], [], []
            for first, starts, hashes in word_chunks(batch.column(2)):
                size = np.diff(starts)
                for k in np.flatnonzero((size > 0) & (size < n)).tolist():
                    rows.append(first + k)
                    keys.append(grams(hashes[starts[k] : starts[k + 1]], n))
                    sizes.append(int(size[k]))
            at = pa.array(rows, pa.int64())
            found = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found.view(np.int64)), pa.array(sizes, pa.int64())], ["doc_id", "fp", "gram", "end_word"])

    return run


def smith_waterman(seqs: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores (2, -1, -1) of pairs of word sequences, and where in the windows they end."""
    n, rows, width = len(seqs), max(map(len, seqs), default=0), max(map(len, windows), default=0)
    if not n or not width:
        return np.zeros(n, np.int32), np.zeros(n, np.int64)
    s, w = np.zeros((n, rows), np.int64), np.ones((n, width), np.int64)
    for k in range(n):
        s[k, : len(seqs[k])], w[k, : len(windows[k])] = seqs[k], windows[k]
    inside = np.arange(rows) < np.array([len(x) for x in seqs])[:, None]
    real = np.arange(width) < np.array([len(x) for x in windows])[:, None]
    h, slope = np.zeros((n, width + 1), np.int32), np.arange(width + 1, dtype=np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        step = np.where((s[:, i : i + 1] == w) & real & inside[:, i : i + 1], 2, -1).astype(np.int32)
        g = np.zeros_like(h)
        np.maximum(h[:, :-1] + step, h[:, 1:] - 1, out=g[:, 1:])
        np.maximum(g, 0, out=g)
        h = np.maximum.accumulate(g + slope, axis=1) - slope
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def _align(least: float, cells: int):
    """Of windows (doc_id, fp, at, held) with ``passages`` (item_id, words), the pairs that align."""

    def run(batches):
        for batch in batches:
            row = batch.column(4).value_parent_indices().to_numpy()
            item, words = batch.column(4).flatten().flatten()
            seqs, windows = [x.values.to_numpy() for x in words], [x.values.to_numpy() for x in batch.column(3)]
            score, end = np.zeros(len(row)), np.zeros(len(row), np.int64)
            order = np.argsort([len(windows[x]) for x in row], kind="stable")
            k = 0
            while k < len(order):  # like lengths together, so many rows that a matrix has about `cells` cells
                take = max(1, cells // max(1, len(windows[row[order[min(k + 255, len(order) - 1)]]])))
                some = order[k : k + min(256, take)]
                best, stop = smith_waterman([seqs[x] for x in some], [windows[row[x]] for x in some])
                score[some] = best / (2 * np.array([len(seqs[x]) for x in some]))
                end[some] = stop
                k += len(some)
            ok = np.flatnonzero(score >= least)
            at = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), item.take(pa.array(ok)), pa.array(score[ok]), pa.array(batch.column(2).to_numpy()[row[ok]] + end[ok])], ["doc_id", "fp", "item_id", "score", "end_word"])

    return run


def candidates(docs: DataFrame, parts: DataFrame, n: int, passage: int) -> DataFrame:
    """(wid, item_id, part): windows of (doc_id, fp, text) and the passages that enough of their seeds are of."""
    every = durable(parts.select(F.explode("grams").alias("gram")).distinct())
    met = durable(docs.mapInArrow(lean(_windows(n, passage, Bitmap(every, "gram", every.count()), False)), "wid long, doc_id long, fp long, at long, held array<long>").select("wid", "held"))
    found = met.select("wid", F.explode("held").alias("gram"))
    seeds = durable(choose_seeds(parts, found.groupBy("gram").agg(F.count("*").alias("n"))))
    both = found.join(seeds, "gram").groupBy("wid", "item_id", "part").agg(F.collect_set("gram").alias("g"), F.collect_set("stretch").alias("s"), F.max("need").alias("need"), F.max("spread").alias("spread"))  # sets of a passage's own n-grams
    return durable(both.where((F.size("g") >= F.col("need")) & (F.size("s") >= F.col("spread"))).select("wid", "item_id", "part"))


def matches(docs: DataFrame, items: DataFrame, *, n: int = 3, passage: int = 64, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, fp, item_id, score, end_word) of each document row and item that align; ``fp`` is xxhash64 of the text."""
    prepare(docs.sparkSession)
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    every = durable(tests.mapInArrow(lean(_passages(n, passage)), "item_id long, part int, words array<long>, grams array<long>, need int, spread int").distinct())
    parts, tiny = every.where("need > 0"), every.where("need = 0")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    keyed = rows.select("doc_id", F.xxhash64("text").alias("fp"), "text")

    pairs = candidates(keyed, parts, n, passage)
    wanted = Bitmap(pairs, "wid", pairs.count())
    windows = keyed.mapInArrow(lean(_windows(n, passage, wanted, True)), "wid long, doc_id long, fp long, at long, held array<long>")
    # a window's words stand once beside each share of its passages, whose number the benchmark bounds
    told = pairs.join(parts.select("item_id", "part", "words"), ["item_id", "part"]).groupBy("wid", F.pmod(F.xxhash64("item_id", "part"), F.lit(PARTS)).alias("share")).agg(F.collect_list(F.struct("item_id", "words")).alias("passages"))
    ready = durable(windows.join(told, "wid").select("doc_id", "fp", "at", "held", "passages"))  # a task then feeds one Python worker, not two
    aligned = ready.mapInArrow(lean(_align(least, 1 << 16)), "doc_id long, fp long, item_id long, score double, end_word long")
    if not tiny.isEmpty():
        small = keyed.mapInArrow(lean(_whole(n)), "doc_id long, fp long, gram long, end_word long").join(tiny.select("item_id", F.col("grams")[0].alias("gram")), "gram")
        aligned = aligned.unionAll(small.select("doc_id", "fp", "item_id", F.lit(1.0).alias("score"), "end_word"))
    return aligned.groupBy("doc_id", "fp", "item_id").agg(F.max(F.struct("score", "end_word")).alias("top")).select("doc_id", "fp", "item_id", "top.score", "top.end_word")


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that align with no item."""
    bad = matches(docs, items, text_col=text_col, **options).select(F.col("fp").alias("__bad_fp")).distinct()
    fp = free_name(docs, "fp")
    return docs.withColumn(fp, F.xxhash64(F.col(text_col).cast("string"))).join(bad, F.col(fp) == F.col("__bad_fp"), "left_anti").drop(fp)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max_by("end_word", "score").alias("end_word"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE_SQL: dict[str, str] = {}
