"""Operator 6: n-gram Jaccard join by parity sketches.

Every document is the set of its distinct n-word shingles. Shingles are XOR-hashed
into a bit sketch: each flips one bit, so the Hamming distance of two sketches is
at most the symmetric difference of the sets. Two sets with a Jaccard similarity
of at least ``t`` whose smaller one has ``a`` elements differ in at most
``(1 - t) / t * a`` elements. A sketch is therefore cut into more pieces than that,
and by the pigeonhole principle two similar sets agree in a piece.

* Sizes fall into bands of ratio 1.6. A set is sketched for its own band and, if
  it can be the larger partner of a smaller band, for that band as well.
* A band has ``d + 1 + e`` pieces for a bound of ``d`` differences. A set with at
  most ``e`` empty pieces doesn't publish them: ``e + 1`` pieces of a similar pair
  agree, so an agreeing piece that isn't empty is left.
  A piece holds the XOR of its shingles' hashes, 32 bits wide, so pieces of one
  shingle each agree only where they share it, however many sets there are.
* Of the ``e + 1`` agreeing pieces only those that are empty in a set which doesn't
  publish them go unseen. A set with fewer shared pieces than its own empty ones
  leave is dropped at once, and so is a pair that agrees less often.
* Published pieces are ranged over by (piece, set), so no single piece is ever
  one task's work, and runs of one set are dropped while they stream by.
* Copies of a set are one set from the start: each task publishes a set once.

Links are then found without pairing all sets of a piece. First, each piece's most
central set (the one in the most and largest pieces) is compared with the others:
linear in the published pieces. Then sets of one piece whose components still
differ are compared: a wide bit sketch bounds the difference in the join condition
(it is full for sets of some thousand shingles), the number of agreeing pieces
decides next, and only what passes both is verified on the texts. A link between sets that are
connected already can't change a component, so the components are exact.

Cases: null text, no words: ``n_shingles`` 0, linked with nothing, own component;
fewer than ``n`` words: the whole sequence is one shingle; equal sets are linked;
rows of a null ``doc_id`` keep a row with a null component; repeated ``doc_id`` rows
each keep a row and share what they link to; extra columns are ignored; empty
tables give no rows. Set ids are 64-bit hashes of the shingle set.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, components, durable, lean, mix, overlap, prepare, shingle_sets, slices, stored, table, temporary, written

_U = np.uint64
WIDE = 16  # 64-bit words of the wide sketch
_SEEN = 100_000
_RUN = 50_000


class Bands:
    """Size bands, the differences allowed in each and its number of pieces, for a similarity of ``num / den``."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        least = 1  # a smaller set than this has only equal partners
        while (den - num) * least // num < 1:
            least += 1
        self.least, edges = least, [least]
        while edges[-1] < most:
            edges.append(max(edges[-1] + 1, edges[-1] * 8 // 5))
        self.edges = np.array(edges)
        self.allowed = [(den - num) * (hi - 1) // num for hi in edges[1:]]
        self.spare = [2 + d // 8 for d in self.allowed]
        self.pieces = [d + 1 + e for d, e in zip(self.allowed, self.spare, strict=True)]

    def of(self, n: int) -> list[int]:
        if n < self.least:
            return []
        b = int(np.searchsorted(self.edges, n, side="right")) - 1
        # the larger of a pair whose smaller set is in the band below
        return [b] if b == 0 or n * self.num > self.den * (int(self.edges[b]) - 1) else [b - 1, b]

    def places(self, s: np.ndarray, b: int) -> np.ndarray:
        return ((s >> _U(32)) % _U(self.pieces[b])).astype(np.int64)

    def needs(self, s: np.ndarray) -> tuple[int, int]:
        """(sure, both): published pieces that a similar set shares at least, whichever it is, and if it publishes its empty pieces wherever this one does.

        Two similar sets agree in ``sure`` of either one and in the smaller ``both``.
        """
        sure = both = self.pieces[-1]
        bands = self.of(len(s))
        for b in bands:
            all_agree = self.spare[b] + 1
            empty = self.pieces[b] - int(np.count_nonzero(np.bincount(self.places(s, b), minlength=self.pieces[b])))
            hidden = empty <= self.spare[b]
            sure = min(sure, all_agree - empty if hidden else 1)
            both = min(both, all_agree - empty if hidden else all_agree)
        return (sure, both) if bands else (1, 1)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The published pieces of a set of distinct hashes."""
        out = []
        for b in self.of(len(s)):
            p, at = self.pieces[b], self.places(s, b)
            order = np.argsort(at, kind="stable")
            counts = np.bincount(at, minlength=p)
            bits = mix((s[order] & _U(0xFFFFFFFF)) + _U(1))
            filled = np.flatnonzero(counts)
            content = np.zeros(p, dtype=np.uint64)
            content[filled] = np.bitwise_xor.reduceat(bits, (np.cumsum(counts) - counts)[filled])
            if p - len(filled) <= self.spare[b]:
                content, place = content[filled], filled
            else:
                place = np.arange(p)
            out.append(mix(content ^ mix(place.astype(np.uint64) + _U((b + 1) << 32))))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    if not len(s):
        return 0
    x = mix(np.array([np.bitwise_xor.reduce(mix(s + _U(7))), np.sum(mix(s ^ _U(0xABCDEF)), dtype=np.uint64), len(s)], dtype=np.uint64))
    return int(mix(x[:1] + x[1:2] * _U(3) + x[2:] * _U(5)).view(np.int64)[0])


def _members(n: int, bands: Bands):
    def run(batches):
        for batch in batches:
            ids, sizes, needs = [], [], []
            for _, s in shingle_sets(batch.column(1), n):
                ids.append(set_id(s))
                sizes.append(len(s))
                needs.append(bands.needs(s))
            sure, both = np.array(needs, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sure), pa.array(both)], ["doc_id", "sid", "n_shingles", "sure", "both"])

    return run


def _publish(n: int, bands: Bands):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, sids, held = [], [], 0
            for _, s in shingle_sets(batch.column(0), n):
                if len(s) < bands.least:
                    continue
                sid = set_id(s)
                if sid in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(sid)
                k = bands.keys(s)
                keys.append(k)
                sids.append(np.full(len(k), sid, dtype=np.int64))
                held += len(k)
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sids))], ["key", "sid"])
                    keys, sids, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sids))], ["key", "sid"])

    return run


def _shared(batches):
    """From rows sorted by (key, sid): the distinct ones whose key another set has too, with the number of sets met so far for the key at least 2; rows of a partition's first and last key are kept, as the key may go on next door."""
    ends = [None, None]
    held_key = held = None
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is not None:
            key, sid = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([held, sid])
        else:
            ends[0] = key[0]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid = key[new], sid[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        # the last run waits for its end; a long one is passed on but for its last row
        last = start[-1]
        total = size.copy()
        if held is not None and key[0] == held_key:
            total[0] += n_held
        keep = np.repeat((total > 1) | (key[start] == ends[0]), size)
        if size[-1] > _RUN:
            n_held, cut = int(total[-1]) - 1, len(key) - 1
            keep[last:] = True
        else:
            n_held, cut = int(total[-1]) - int(size[-1]), int(last)
        held_key, held = key[-1], sid[cut:]
        if cut:
            counts = np.repeat(total, size)
            yield pa.RecordBatch.from_arrays([pa.array(key[:cut][keep[:cut]]), pa.array(sid[:cut][keep[:cut]]), pa.array(counts[:cut][keep[:cut]])], ["key", "sid", "n_sets"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), held_key)), pa.array(held), pa.array(np.full(len(held), n_held + len(held)))], ["key", "sid", "n_sets"])


def _widen(n: int, wanted: Bitmap):
    """Of (doc_id, text), the rows that may be wanted, with the id, the size and the wide sketch of their set."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column(0).to_numpy())))
            ids, sizes, words = [], [], np.zeros((batch.num_rows, WIDE), dtype=np.int64)
            for k, s in shingle_sets(batch.column(1), n):
                odd = np.bincount((s & _U(WIDE * 64 - 1)).astype(np.int64), minlength=WIDE * 64) & 1
                words[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                ids.append(set_id(s))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(words[:, k]) for k in range(WIDE))], ["doc_id", "text", "sid", "n", *(f"w{k}" for k in range(WIDE))])

    return run


def _verify(n: int, num: int, den: int):
    def run(batches):
        for batch in (part for whole in batches for half in slices(whole, "text_a") for part in slices(half, "text_b")):
            a = [s for _, s in shingle_sets(batch.column(1), n)]
            b = [s for _, s in shingle_sets(batch.column(3), n)]
            common = np.array([overlap(x, y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.int64) - common
            ok = pa.array(den * common >= num * union)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok)], ["a", "b"])

    return run


def _similar(x: str, y: str, num: int, den: int):
    """Whether sizes and wide sketches of two rows leave room for the similarity."""
    bits = (F.bit_count(F.col(f"{x}.w{k}").bitwiseXOR(F.col(f"{y}.w{k}"))) for k in range(WIDE))
    hamming = reduce(lambda p, q: p + q, bits)
    sizes = den * F.least(f"{x}.n", f"{y}.n") >= num * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & ((den + num) * hamming <= (den - num) * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def _only(wanted: Bitmap):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted.has(batch.column(0).to_numpy())))

    return run


def _links(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, da, b, db) of sets and their documents that are similar; only their texts are shuffled."""
    pairs = durable(pairs)
    ends = pairs.select(F.col("da").alias("doc_id")).unionAll(pairs.select("db")).distinct()
    texts = texts.mapInArrow(lean(_only(Bitmap(ends, "doc_id", ends.count()))), "doc_id long, sid long, text string")
    left, right = texts.toDF("da", "a", "text_a"), texts.toDF("db", "b", "text_b")
    both = pairs.hint("merge").join(left, ["a", "da"]).join(right, ["b", "db"]).select("da", "text_a", "db", "text_b")
    return both.mapInArrow(lean(_verify(n, num, den)), "a long, b long")


def jaccard_components(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when ``den * intersection >= num * union``."""
    prepare(docs.sparkSession)
    with temporary(docs.sparkSession) as staying:
        bands = Bands(num, den)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        members, at = written(rows.mapInArrow(lean(_members(n, bands)), "doc_id long, sid long, n_shingles long, sure long, both long"), "gram-members")
        published = rows.select("text").where("length(text) > 0").mapInArrow(lean(_publish(n, bands)), "key long, sid long")
        runs = published.repartitionByRange("key", "sid").sortWithinPartitions("key", "sid").mapInArrow(lean(_shared), "key long, sid long, n_sets long")
        # a row per set that shares as many pieces as a similar set needs: these, bounded by its own size, and one of its documents
        firsts = members.where("n_shingles > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("sure").alias("sure"), F.min("both").alias("both"))
        sets = runs.groupBy("sid").agg(F.sum("n_sets").alias("weight"), F.max_by("key", "n_sets").alias("common"), F.min_by("key", "n_sets").alias("rare"), F.collect_list("key").alias("keys"))
        sets = durable(sets.join(firsts, "sid").where(F.size("keys") >= F.col("sure")))

        # their texts
        chosen = sets.select("sid", "doc_id")
        fields = ", ".join(["doc_id long, text string, sid long, n long", *(f"w{k} long" for k in range(WIDE))])
        found = rows.where("doc_id is not null").mapInArrow(lean(_widen(n, Bitmap(chosen, "doc_id", chosen.count()))), fields)
        wanted = stored(found, "gram-texts")  # some others too, which no join below meets
        texts = wanted.select("doc_id", "sid", "text")
        sketches = durable(wanted.drop("text").join(chosen, ["doc_id", "sid"], "left_semi").dropDuplicates(["sid"]))

        # the most central set of each set's commonest and rarest piece against it
        pieces = sets.select(F.explode("keys").alias("key"), "sid", "weight")
        centre = pieces.groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("top")).select("key", F.col("top.sid").alias("a"))
        own = sets.select(F.explode(F.array_distinct(F.array("common", "rare"))).alias("key"), F.col("sid").alias("b"))
        stars = own.join(centre, "key").where("a <> b").select("a", "b").distinct()
        x, y = sketches.alias("x"), sketches.alias("y")
        stars = stars.join(x, F.col("a") == F.col("x.sid")).join(y, (F.col("b") == F.col("y.sid")) & _similar("x", "y", num, den))
        links = durable(_links(stars.select("a", F.col("x.doc_id").alias("da"), "b", F.col("y.doc_id").alias("db")), texts, n, num, den))
        label = components(links, "a", "b").withColumnRenamed("node", "doc_id")

        # sets of one piece that are still in different components
        known = chosen.join(label, "doc_id", "left").select("sid", F.coalesce("component", "doc_id").alias("comp"))
        marked = sets.join(known, "sid").select(F.explode("keys").alias("key"), "sid", "comp", "sure", "both")
        still = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        still = durable(marked.join(still, "key").join(sketches, "sid"))
        x, y = still.alias("x"), still.alias("y")
        near = (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.comp") != F.col("y.comp"))
        need = F.greatest(F.least("x.both", "y.both"), "x.sure", "y.sure").alias("need")
        pairs = x.join(y, near & _similar("x", "y", num, den)).groupBy(F.col("x.sid").alias("a"), F.col("x.doc_id").alias("da"), F.col("y.sid").alias("b"), F.col("y.doc_id").alias("db"), need).agg(F.count("*").alias("agree"))
        pairs = pairs.where("agree >= need").select("a", "da", "b", "db")
        final = components(links.unionAll(_links(pairs, texts, n, num, den)), "a", "b").withColumnRenamed("node", "doc_id")

        # a row per set, written: the join below is then one of plain shuffles, whose hot sets AQE splits
        named, named_at = written(firsts.join(final, "doc_id", "left").select("sid", F.coalesce("component", "doc_id").alias("component_id")), "step")
        staying |= {at, named_at}  # all that the result reads
    full = members.where("n_shingles > 0").join(named, "sid", "left")
    full = full.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionAll(alone)


def op6_gram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


QUERIES = {"op6_gram_join": op6_gram_join}
ORACLE_SQL = {
    "op6_gram_join": """
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [hash(array_to_string(words, ' '))] ELSE list_transform(range(1, len(words) - 2), lambda k: hash(array_to_string(words[k:k + 3], ' '))) END) AS gram FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT x.doc_id, y.doc_id AS other, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
JOIN n a ON a.doc_id = p.doc_id JOIN n b ON b.doc_id = p.other WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""
}
