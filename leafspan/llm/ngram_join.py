"""N-gram Jaccard join on group-count vectors.

A document's set holds the hashes of its distinct word shingles; equal sets form a class. For a size band, shingles
are hashed into more groups than the largest symmetric difference two linked sets can have, so linked sets agree
wholly in at least one group. The content hash of a group is thus an exact blocking key (two bands per set, so that
sets of neighbouring sizes meet). Keys travel as packed arrays, and blocks with one class vanish where they are read.

Within blocks, the counts of shingles by groups are points in an R-tree (packed by sorting, bounding boxes, several
levels): the sum of coordinate minima bounds the overlap, of a box as of a point. What may link by that bound is a
family. A family's sets are brought together once (in slices of bounded bytes, every two of which meet), searched by
R-tree again, and each possible pair between components is verified on the full sets until it joins them. Neither step
emits pairs: both yield forests. Verified links are joined to components.

Sets are compared by 64-bit shingle hashes and classes named by a 64-bit hash of the set: a false match of two
different sets needs a collision (about rows squared / 2**65).

Very long texts are hashed whole, in batches of bounded bytes; a class's rows, and blocks, families and roots that very
many rows share, are never dealt to one task. Nulls, empty texts and texts without words have an empty set and link with nothing. A text with fewer words than a
shingle is one shingle. Repeated rows are one class; a null id is never a component's name unless all its ids are null.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, components, id_filter, join_facts, materialise, partitions, sift, table, tidy
from leafspan.llm.texthash import mix, sequence_hashes, word_hashes

DIMENSIONS = 64
GROUP_SIZE = 6
LEAF = 16
BLOCK_ROWS = 1000
VERIFY_ROWS = 256
FAMILY_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20

_U = np.uint64


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are hashed together in chunks."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < CHUNK_BYTES):
            size += len(texts[end] or b"")
            end += 1
        part = [(t or b"").lower() for t in texts[at:end]]
        starts, hashes = word_hashes(b"\n".join(part))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        for i in range(len(part)):
            yield np.unique(sequence_hashes(hashes[bounds[i] : bounds[i + 1]], k))
        at = end


def class_of(s: np.ndarray) -> int:
    return int(mix(np.array([int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)) ^ len(s)], _U)).view(np.int64)[0])


class Bands:
    """Size bands for a similarity of percent/100: sets that link lie in one band or in neighbouring ones."""

    def __init__(self, percent: int) -> None:
        self.percent, self.lows, self.groups = percent, [1], [0]

    def of(self, n: int) -> int:
        p, lows = self.percent, self.lows
        while lows[-1] <= n:
            low = lows[-1]
            lows.append(max(low + 1, (low - 1) * 100 // p + 1))
        return int(np.searchsorted(lows, n, "right")) - 1

    def scheme(self, s: int) -> tuple[int, int]:
        """(groups, empty groups that a set may have without keys for them) of the scheme where bands s-1 and s meet."""
        while len(self.groups) <= s + 1:
            self.groups.append(0)
        if not self.groups[s]:
            while len(self.lows) <= s + 1:
                self.of(self.lows[-1])
            low, high = self.lows[max(s - 1, 0)], self.lows[s + 1] - 1
            differ = 2 * high * (100 - self.percent) // (100 + self.percent)
            spare = 2 + math.ceil(2 * (differ + 1) * math.exp(-low / (differ + 1))) if differ else 0
            self.groups[s] = (differ + 1 + spare, spare)
        return self.groups[s]

    def keys(self, s: np.ndarray) -> np.ndarray:
        band, out = self.of(len(s)), []
        content = mix(s ^ _U(0x27D4EB2F165667C5))
        for scheme in (band, band + 1):
            groups, spare = self.scheme(scheme)
            g = (mix(s ^ _U(scheme * 2 + 1)) % _U(groups)).astype(np.int64)
            sums = np.zeros(groups, _U)
            np.add.at(sums, g, content)
            counts = np.bincount(g, minlength=groups)
            use = np.arange(groups) if (counts == 0).sum() > spare else np.flatnonzero(counts)
            out.append(mix(sums[use] + _U(0x9FB21C651E98DF25) * use.astype(_U) + _U(scheme * 0xD6E8FEB86659FD93 % (1 << 64))))
        return np.concatenate(out)

    def least_overlap(self, a, b):
        """The smallest overlap of two linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts by the hashes' leading bits: DIMENSIONS groups, or more for sets over GROUP_SIZE times as large."""
    bits = max(DIMENSIONS, len(s) // GROUP_SIZE).bit_length() - 1
    return np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """A count vector with neighbouring groups joined until only groups are left."""
    return points.astype(np.int32) if len(points) == groups else points.reshape(groups, -1).sum(1, dtype=np.int32)


class CountRTree:
    """Packed R-tree over count vectors. Boxes of a level bound LEAF children each."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.levels = []
        if len(points) <= LEAF:
            self.order = np.arange(len(points))
            return
        total = points.sum(1)
        spread = np.argsort(-points.var(0))[:2]
        runs = max(1, math.isqrt(-(-len(points) // LEAF)))
        slab = np.argsort(np.argsort(total, kind="stable"), kind="stable") * runs // max(len(points), 1)
        self.order = np.lexsort((points[:, spread[0]], slab))
        # upper corners (they bound overlap from above), leaves first
        top = points[self.order]
        while len(top) > 1:
            cuts = np.arange(0, len(top), LEAF)
            top = np.maximum.reduceat(top, cuts, axis=0)
            self.levels.append(top)

    def partners(self, q: np.ndarray, need: int) -> np.ndarray:
        """Rows whose summed coordinate minima with q reach need."""
        live = np.arange(len(self.levels[-1])) if self.levels else np.arange(len(self.order))
        for depth in range(len(self.levels) - 1, -1, -1):
            live = live[np.minimum(self.levels[depth][live], q).sum(1) >= need]
            below = len(self.levels[depth - 1]) if depth else len(self.order)
            live = (live[:, None] * LEAF + np.arange(LEAF)).ravel()
            live = live[live < below]
        rows = self.order[live]
        return rows[np.minimum(self.points[rows], q).sum(1) >= need]


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def shingle_classes(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (set size), class and points (both null for an empty set)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            rows = [(len(s), class_of(s), count_vector(s).tobytes()) if len(s) else (0, None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["id", "n", "class", "points"])

    return _columns(docs, id_col, text_col).mapInArrow(tidy(run), f"id {kind}, n long, class long, points binary")


def _blocks(docs: DataFrame, k: int, percent: int, n_parts: int) -> DataFrame:
    """(block, class): the classes of every key that two classes or more share; blocks of equal classes are one."""
    n_packs = 2 * n_parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for b in byte_slices(batches, 0, 16 << 20):
            keys, owners, seen = [], [], set()
            for s in shingle_sets(b.column(0).to_pylist(), k):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    keys.append(own := bands.keys(s))
                    owners.append(np.full(len(own), c, np.int64))
            if not keys:
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            part = (key % _U(n_packs)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, owner = key[order], owner[order]
            cuts = np.searchsorted(part[order], np.arange(n_packs + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([key[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()), pa.array([owner[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "keys", "owners"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners = [], []
        for b in batches:
            keys += [np.frombuffer(x, _U) for x in b.column(1).to_pylist()]
            owners += [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(owners)
        keys = owners = None
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        name = np.add.reduceat(mix(owner.view(_U)), first)
        _, one = np.unique(name[size > 1], return_index=True)
        chosen = np.flatnonzero(size > 1)[one]
        rows = np.repeat(first[chosen] - np.concatenate(([0], np.cumsum(size[chosen])[:-1])), size[chosen]) + np.arange(size[chosen].sum())
        for lo in range(0, len(rows), 50_000):
            r = rows[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name[chosen], size[chosen])[lo : lo + 50_000].view(np.int64)), pa.array(owner[r])], names=["block", "class"])

    packs = docs.select("text").mapInArrow(tidy(pack), "part int, keys binary, owners binary").repartition(n_parts, "part")
    return packs.mapInArrow(tidy(unpack), "block long, class long").distinct()


def _sets_of(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(class, hashes) of the chosen (id, class): texts pass a fixed-size filter before they are shuffled.

    A row that only shares the id is told by its own class and left out. Classes whose ids are all null have no id to be
    fetched by: rows with a null id are all measured, then picked by class.
    """
    context = docs.sparkSession.sparkContext
    named, unnamed = chosen.filter("id is not null"), chosen.filter("id is null").select("class")
    bits, classes = context.broadcast(id_filter(named, "id")), context.broadcast(id_filter(unnamed, "class"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            found = [(c, s) for c, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), k), strict=True) if len(s) and class_of(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["class", "hashes"])

    def measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 0):
            found = [s for s in shingle_sets(b.column(0).to_pylist(), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["class", "hashes"])

    near = sift(docs.select("id", "text"), bits, "id", True)
    near = near.join(named, "id").select("class", "text").mapInArrow(tidy(measure), "class long, hashes binary")
    if not unnamed.limit(1).count():
        return near
    rest = sift(docs.filter("id is null").select("text").mapInArrow(tidy(measure_all), "class long, hashes binary"), classes, "class", True)
    return near.unionByName(rest.join(unnamed, "class", "left_semi").dropDuplicates(["class"]))


def _by_slices(rows: DataFrame, key: str, slices, columns: list[str], task) -> DataFrame:
    """Rows of one key in slices; every two slices of a key (and each by itself) meet in one call of task."""
    cut = rows.select("*", slices.cast("int").alias("slices")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cut = cut.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, found = [], None, set()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != last:
                    found.update(task(rows))
                    rows, last = [], row[:3]
                    if len(found) > 50_000:
                        yield _pair_batch(found)
                rows.append(row)
        found.update(task(rows))
        yield _pair_batch(found)

    cut = cut.repartition(partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")
    return cut.mapInArrow(tidy(run), "a long, b long").distinct()


def _pair_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    pairs = list(found)
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _join_rows(rows: list[tuple], percent: int, verify: bool) -> Iterator[tuple[int, int]]:
    """rows: (key, i, j, own, class, n, points[, hashes]) of two slices. Searches each row's possible partners in
    other components (at first each class is one) and joins components on the way, so what it yields is a forest: pairs
    of classes that may link, or, with verify, that do."""
    if len(rows) < 2:
        return
    i, j = rows[0][1:3]
    raw = [np.frombuffer(r[6], np.uint16) for r in rows]
    groups = min(map(len, raw))
    points = np.array([fold(p, groups) for p in raw])
    own, comp, n = (np.array([r[c] for r in rows]) for c in (3, 4, 5))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if not len(left) or not len(right):
        return
    root, apart = comp.copy(), len(set(comp.tolist()))
    tree = CountRTree(points[right])
    for a in left:
        low = -(-percent * int(n[a]) // 100)
        hit = right[tree.partners(points[a], -(-percent * (int(n[a]) + low) // (100 + percent)))]
        hit = hit[root[hit] != root[a]]
        over = np.minimum(points[hit], points[a]).sum(1)
        fit = over * (100 + percent) >= percent * (n[hit] + n[a])
        for h in hit[fit][np.argsort(-over[fit], kind="stable")]:
            if root[h] == root[a]:
                continue
            need, d = percent * int(n[a] + n[h]), min(len(raw[a]), len(raw[h]))
            if d > groups and int(np.minimum(fold(raw[a], d), fold(raw[h], d)).sum()) * (100 + percent) < need:
                continue
            if verify and _overlap(rows[a][7], rows[h][7]) * (100 + percent) < need:
                continue
            yield rows[a][4], rows[h][4]
            root[root == root[h]] = root[a]
            apart -= 1
            if apart == 1:
                return


def _overlap(x: bytes, y: bytes) -> int:
    s, t = np.frombuffer(x, _U), np.frombuffer(y, _U)
    return int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_shingles and component_id, the smallest id that links of percent/100 or more reach."""
    spark = docs.sparkSession
    src = _columns(docs, id_col, text_col)
    rows = materialise(shingle_classes(docs, k, id_col, text_col))
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = materialise(_blocks(src, k, percent, partitions(spark, total * 4 * (100 - percent) / (100 + percent), 4e6)))
    of_class = materialise(rows.filter("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("points").alias("points"), F.count("*").alias("held")))
    classes = of_class.drop("held").join(blocks.select("class").distinct(), "class", "left_semi")
    classes = materialise(classes)
    n_blocked = blocks.count()
    size = blocks.groupBy("block").agg(F.count("*").alias("size"))
    placed = join_facts(blocks, size.withColumn("held", F.col("size")), "block", "held", n_blocked).join(classes.select("class", "n", "points"), "class")
    maybe = materialise(_by_slices(placed, "block", F.ceil(F.col("size") / BLOCK_ROWS), ["class", "n", "points"], lambda r: _join_rows(r, percent, False)))
    own = maybe.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    member = materialise(own.join(components(maybe, "a", "b").withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("family")).join(classes, "class"))
    weight = member.groupBy("family").agg((F.sum("n") * 8).alias("weight"), F.count("*").alias("held"))
    weighed = materialise(join_facts(member.select("class", "n", "points", "family"), weight, "family", "held", member.count()))
    sets = _sets_of(src, member.select("id", "class"), k)
    whole = sets.join(weighed, "class")
    links = materialise(_by_slices(whole, "family", F.ceil(F.col("weight") / FAMILY_BYTES), ["class", "n", "points", "hashes"], lambda r: _join_rows(r, percent, True)), VERIFY_ROWS)
    comp = components(links, "a", "b")
    named = of_class.join(comp.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "id", "held", F.coalesce("root", "class").alias("root"))
    named = materialise(named)
    name = named.groupBy("root").agg(F.min("id").alias("name"), F.count("*").alias("members"))
    names = materialise(join_facts(named.select("class", "held", "root"), name, "root", "members", named.count()).select("class", "held", "name"))
    out = join_facts(rows.select("id", "n", "class"), names, "class", "held", rows.count(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, percent=90)


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rn, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
sized AS (SELECT rn, doc_id, len(g) AS n, g FROM s),
e AS (SELECT rn, n, unnest(g) AS x FROM sized),
pairs AS (SELECT a.rn AS u, b.rn AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.rn < b.rn AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.rn, b.rn),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 90 * (n + m - c)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (WITH RECURSIVE r AS (SELECT rn AS u, rn AS v FROM sized WHERE n > 0 UNION SELECT r.u, b.v FROM r JOIN both_ways b ON r.v = b.u) SELECT * FROM r)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(min(t.doc_id), s.doc_id) AS component_id
FROM sized s LEFT JOIN reach ON reach.u = s.rn LEFT JOIN sized t ON t.rn = reach.v GROUP BY s.rn, s.doc_id, s.n
"""
