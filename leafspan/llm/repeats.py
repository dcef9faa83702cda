"""Removal of repeated passages with run-length compressed suffix indexes.

A byte is removed if a string of `length` bytes that covers it also starts earlier (in a smaller document, or earlier
in the same one). No index of the whole corpus is needed for that: every window of that length belongs to the smallest
hashed k-mer inside it, so windows are dealt out by minimisers. A run of windows with one minimiser is a piece. Equal
pieces (by hash) are repeats of the first one. Different pieces with one minimiser may still share windows: their
bytes are gathered in blocks, and a block gets a run-compressed Burrows-Wheeler transform with suffix samples at the
run ends. The pieces are streamed through it from right to left (a step per byte, by run; at a mismatch to the nearer
run end, whose sample gives the new match). Where the matching statistic reaches the length, the range of equal windows
knows its earliest start, and all later starts are marked. Repetitive blocks have few runs.

Pieces travel as packed arrays; texts are read again, after a filter of bounded size, for the documents concerned.
Minimisers with more different pieces than a block holds (a line that very many documents share) are dealt out again,
window by window, by the hash of the whole window: the earliest of equal windows stands, the others are repeats. So no
block or list is unbounded, and the work stays in proportion to the windows.

Nulls count as empty texts; texts shorter than the length lose nothing. Very long texts are cut into pieces in parts of
bounded size. Documents are ordered by id, nulls last, and rows that share an id by text; they are documents of their
own, and of rows that are equal in both any one may come first. Equality of pieces is by a 64-bit hash made of two sums
modulo 2**64 and a prime. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import byte_slices, filter_place, id_filter, in_filter, materialise, partitions, sift, table, tidy
from leafspan.llm.texthash import _VALUE, _power, mix, prime_hash, prime_sums

LENGTH = 100
KMER = 40
PIECE_BYTES = 1 << 18
BLOCK_BYTES = 1 << 18
BIG_GROUP = 1000
MOST_WINDOWS = 128
PACK_BYTES = 4 << 20

_U = np.uint64


def pieces_of(text: bytes, length: int = LENGTH, kmer: int = KMER, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, hash, start, windows, may repeat within) of the runs of windows with one minimiser."""
    whole = len(text)
    out = []
    for at in range(0, max(whole - length + 1, 0), PIECE_BYTES):
        b = np.frombuffer(text, np.uint8, min(PIECE_BYTES + length - 1, whole - at), at)
        n, span = len(b), length - kmer + 1
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[b] * power[:n], out=total[1:])
        h = mix((total[kmer:] - total[: n - kmer + 1]) * inverse[: n - kmer + 1] + _U(seed))
        low, w = h, 1
        while 2 * w <= span:
            low, w = np.minimum(low[:-w], low[w:]), 2 * w
        if w < span:
            low = np.minimum(low[: len(low) - (span - w)], low[span - w :])
        start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        runs = np.diff(np.append(start, len(low)))
        if runs.max() > MOST_WINDOWS:  # periodic text: bounded pieces
            parts = -(-runs // MOST_WINDOWS)
            at_part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(start, parts) + at_part * MOST_WINDOWS
            runs = np.minimum(np.repeat(runs, parts) - at_part * MOST_WINDOWS, MOST_WINDOWS)
        end = start + runs - 1 + length
        other = mix(prime_hash(prime_sums(b), start, end))
        own = mix(((total[end] - total[start]) * inverse[start] ^ other) + runs.astype(_U) * _U(0x9FB21C651E98DF25))
        # a piece can only repeat its own windows if its minimiser stands in it more than once
        sizes = runs + span - 1
        flat = np.repeat(start - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        same = np.add.reduceat(h[flat] == np.repeat(low[start], sizes), np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
        out.append((low[start], own, start + at, runs, same > 1))
    if not out:
        return np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def window_hashes(pieces: list[bytes], length: int) -> np.ndarray:
    """Hashes of all windows of the pieces, in order."""
    out, at = [], 0
    while at < len(pieces):
        size, end = 0, at
        while end < len(pieces) and (end == at or size + len(pieces[end]) < PIECE_BYTES):
            size += len(pieces[end])
            end += 1
        sizes = np.array([len(p) for p in pieces[at:end]])
        b = np.frombuffer(b"".join(pieces[at:end]), np.uint8)
        windows = sizes - length + 1
        start = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        power, inverse = _power(len(b) + 1)
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(_VALUE[b] * power[: len(b)], out=total[1:])
        out.append(mix((total[start + length] - total[start]) * inverse[start] ^ mix(prime_hash(prime_sums(b), start, start + length))))
        at = end
    return np.concatenate(out)


def suffix_order(symbols: np.ndarray, last: np.ndarray, text_no: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; a suffix ends with its text (last: end of the text at each position),
    and ends count as smaller than bytes, in the order of texts."""
    n = len(symbols)
    pos = np.arange(n)
    left = last - pos
    key = np.zeros(n, _U)
    for j in range(7):
        key = (key << _U(9)) | np.where(left > j, symbols[np.minimum(pos + j, n - 1)].astype(_U) + _U(1), _U(0))
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    base = int(text_no[-1]) + 1 if n else 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, pos, 0))  # the first place of equal keys
    h = 7
    while not new.all():
        # only positions whose rank is shared are sorted again; shared ranks are runs of order
        shared = np.flatnonzero(~(new & np.append(new[1:], True)))
        p = order[shared]
        second = np.where(left[p] > h, rank[np.minimum(p + h, n - 1)] + base, text_no[p])
        both = rank[p] * (n + base + 1) + second
        again = np.argsort(both)
        order[shared] = p = p[again]
        ordered = both[again]
        split = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        new[shared] |= split
        rank[p] = shared[np.maximum.accumulate(np.where(split, np.arange(len(p)), 0))]
        h *= 2
    return order


class RunIndex:
    """Run-length BWT of several texts, with suffix samples at run ends and the earliest start of every long match.

    Texts are separated by end marks smaller than all bytes. key[p] orders the positions of the joined texts.
    """

    def __init__(self, texts: list[bytes], key: np.ndarray, length: int = LENGTH) -> None:
        self.length = length
        sizes = np.array([len(t) + 1 for t in texts])
        self.ends = np.cumsum(sizes)
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        no = np.repeat(np.arange(len(texts)), sizes)
        last = self.ends[no] - 1  # the end mark's place
        order = suffix_order(joined, last, no)
        n = len(joined)
        symbol = joined.astype(np.int16) + 1
        symbol[self.ends - 1] = 0
        before = np.where(order > 0, symbol[order - 1], 0)
        begins = np.zeros(n, bool)
        begins[self.ends - sizes] = True
        before[begins[order]] = 0
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.n = n
        self.run_start, self.run_char = heads, before[heads]
        run_size = np.diff(np.append(heads, n))
        # LF of a run's first row: rows of smaller symbols, then this symbol's earlier runs
        by_char = np.argsort(self.run_char, kind="stable")
        self.run_to = np.empty(len(heads), np.int64)
        self.run_to[by_char] = np.cumsum(np.concatenate(([0], run_size[by_char][:-1])))
        self.sample_first, self.sample_last = order[heads], order[heads + run_size - 1]
        self.run_last = heads + run_size - 1
        self.char_runs = by_char
        self.char_from = np.searchsorted(self.run_char[by_char], np.arange(258))
        power, inverse = _power(n + 1)
        self.total = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[joined] * power[:n], out=self.total[1:])
        self.inverse, self.last = inverse, last
        # ranges of rows that agree on `length` bytes, and the earliest start of each
        long = last[order] - order >= length
        window = np.where(long, (self.total[np.minimum(order + length, n)] - self.total[order]) * inverse[order], 0)
        new = np.concatenate(([True], (window[1:] != window[:-1]) | ~long[1:] | ~long[:-1]))
        self.class_start = np.flatnonzero(new)
        self.class_first = np.minimum.reduceat(key[order], self.class_start)

    def _run(self, rows: np.ndarray) -> np.ndarray:
        """The runs that rows of the transform lie in."""
        return np.searchsorted(self.run_start, rows, "right") - 1

    def _agree(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes on which the suffixes at p and q agree, up to length, by halving on hashes."""
        lo = np.zeros(len(p), np.int64)
        hi = np.minimum(np.minimum(self.last[p] - p, self.last[q] - q), self.length)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            a = (self.total[p + mid] - self.total[p]) * self.inverse[p]
            b = (self.total[q + mid] - self.total[q]) * self.inverse[q]
            same = a == b
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def stream(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of texts, right to left, all texts one step at a time.

        Yields for each step (texts still read, their position, length matched from there up to `length`, index row).
        """
        sizes = np.array([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        row = np.zeros(len(texts), np.int64)
        pos = np.full(len(texts), self.ends[0] - 1)
        got = np.zeros(len(texts), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= step)
            c = flat[ends[live] - step]
            r, p, g = row[live], pos[live], got[live]
            run = self._run(r)
            miss = np.flatnonzero(self.run_char[run] != c)
            if len(miss):
                cm = c[miss]
                lo, hi = self.char_from[cm], self.char_from[cm + 1]
                none = lo == hi
                at = np.empty(len(miss), np.int64)
                for ch in np.unique(cm):  # the first run of this symbol after the row
                    own = cm == ch
                    at[own] = np.searchsorted(self.char_runs[self.char_from[ch] : self.char_from[ch + 1]], run[miss][own]) + self.char_from[ch]
                up, down = np.maximum(at - 1, lo), np.minimum(at, np.maximum(hi - 1, 0))
                up, down = self.char_runs[np.minimum(up, len(self.char_runs) - 1)], self.char_runs[np.minimum(down, len(self.char_runs) - 1)]
                up_pos = np.where(up < run[miss], self.sample_last[up], self.sample_first[up])
                down_pos = np.where(down < run[miss], self.sample_last[down], self.sample_first[down])
                up_row = np.where(up < run[miss], self.run_last[up], self.run_start[up])
                down_row = np.where(down < run[miss], self.run_last[down], self.run_start[down])
                a, b = self._agree(p[miss], up_pos), self._agree(p[miss], down_pos)
                use = a >= b
                r[miss] = np.where(none, 0, np.where(use, up_row, down_row))
                p[miss] = np.where(none, self.ends[0], np.where(use, up_pos, down_pos))
                g[miss] = np.where(none, -1, np.minimum(g[miss], np.maximum(a, b)))
                run[miss] = self._run(r[miss])
            r = np.where(g < 0, 0, self.run_to[run] + r - self.run_start[run])
            p = p - 1
            g = np.minimum(g + 1, self.length)
            row[live], pos[live], got[live] = r, p, g
            yield live, sizes[live] - step, g, r

    def earliest(self, rows: np.ndarray) -> np.ndarray:
        return self.class_first[np.searchsorted(self.class_start, rows, "right") - 1]


def later_windows(texts: list[bytes], keys: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Per text, the starts of windows that also occur earlier, texts' first positions being ordered by keys (position
    i of a text has key + i)."""
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    key = np.concatenate([np.arange(k, k + len(t) + 1) for k, t in zip(keys, texts, strict=True)]) if texts else np.empty(0)
    index = RunIndex(texts, key, length)
    marked: list[list[np.ndarray]] = []
    owners = []
    for live, place, got, row in index.stream(texts):
        full = got >= length
        live, place, row = live[full], place[full], row[full]
        late = index.earliest(row) < key[at[live] + place]
        owners.append(live[late])
        marked.append(place[late])
    owner = np.concatenate(owners) if owners else np.empty(0, int)
    place = np.concatenate(marked) if marked else np.empty(0, int)
    order = np.lexsort((place, owner))
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [place[order[cuts[i] : cuts[i + 1]]] for i in range(len(texts))]


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of consecutive numbers."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.concatenate(([True], np.diff(places) != 1)))
    return places[cut], np.diff(np.append(cut, len(places)))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text) with a distinct key per row in document order; the id itself if that will do."""
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    odd = src.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1).count()
    if not odd and kind in ("bigint", "int", "smallint", "tinyint"):
        return src.select(F.col("id").cast("long").alias("key"), "id", "text")
    return materialise(src.orderBy(F.col("id").asc_nulls_last(), "text").select(F.monotonically_increasing_id().alias("key"), "id", "text"))


def _deal(src: DataFrame, length: int, n_parts: int) -> DataFrame:
    """(key, start, windows, grp): runs of repeated windows (grp null) and pieces to be compared (with a group)."""
    n_packs = 2 * n_parts

    def packed(part: np.ndarray, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(n_packs + 1))
        full = np.flatnonzero(np.diff(cuts))
        columns = [c[order] for c in columns]
        data = [b"".join(c[cuts[p] : cuts[p + 1]].tobytes() for c in columns) for p in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), kind), pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, PACK_BYTES):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            low, own, start, runs, multi, key = [], [], [], [], [], []
            for k, t in zip(keys, texts, strict=True):
                if t and len(t) >= length:
                    p = pieces_of(t, length)
                    for c, x in zip((low, own, start, runs, multi), p, strict=True):
                        c.append(x)
                    key.append(np.full(len(p[0]), k, np.int64))
            if not low:
                continue
            low, own, start, runs, multi, key = map(np.concatenate, (low, own, start, runs, multi, key))
            order = np.lexsort((start, key, own))
            first = np.ones(len(order), bool)
            first[1:] = own[order][1:] != own[order][:-1]
            one, more = order[first], order[~first]  # a batch sends one of its equal pieces
            part = (low[one] % _U(n_packs)).astype(np.int32)
            yield packed(part, 0, [own[one], key[one], (low[one] >> _U(32)).astype(np.uint32), start[one].astype(np.uint32), (runs[one].astype(np.uint32) << np.uint32(1)) | multi[one]])
            if len(more):
                more = more[np.lexsort((start[more], key[more]))]
                k, s, r = key[more], start[more], runs[more]
                cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1] + r[:-1]))))
                yield packed((k[cut] % n_packs).astype(np.int32), 1, [k[cut], s[cut].astype(np.uint32), np.add.reduceat(r, cut).astype(np.uint32)])

    def rows(key, start, runs, grp=None) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(key), 50_000):
            s = slice(lo, lo + 50_000)
            k = len(key[s])
            yield pa.RecordBatch.from_arrays([pa.array(key[s], pa.int64()), pa.array(start[s].astype(np.int64)), pa.array(runs[s].astype(np.int32)), pa.nulls(k, pa.int64()) if grp is None else pa.array(grp[s], pa.int64())], names=["key", "start", "windows", "grp"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            for part, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind:
                    n = len(data) // 16
                    yield from rows(np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint32, n, 8 * n), np.frombuffer(data, np.uint32, n, 12 * n))
                else:
                    n = len(data) // 28
                    got.append((np.frombuffer(data, _U, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.uint32, n, 16 * n), np.frombuffer(data, np.uint32, n, 20 * n), np.frombuffer(data, np.uint32, n, 24 * n), np.full(n, part, np.int32)))
        if not got:
            return
        own, key, low, start, runs, part = (np.concatenate(c) for c in zip(*got, strict=True))
        got = None
        order = np.lexsort((start, key, own))
        first = np.ones(len(order), bool)
        first[1:] = own[order][1:] != own[order][:-1]
        more, one = order[~first], order[first]
        yield from rows(key[more], start[more], runs[more] >> 1)
        grp = (part[one].astype(np.int64) << 32) | low[one].astype(np.int64)
        by = np.argsort(grp, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], grp[by][1:] != grp[by][:-1])))
        size = np.diff(np.append(cut, len(by)))
        several = np.repeat(size, size)
        chosen = by[(several > 1) | (runs[one][by] & 1 == 1)]
        big = np.zeros(len(one), bool)
        big[by] = several > BIG_GROUP
        name = grp[chosen]
        yield from rows(key[one][chosen], start[one][chosen], runs[one][chosen] >> 1, np.where(big[chosen], -1 - name, name))

    packs = src.select("key", "text").mapInArrow(tidy(pack), "part int, kind int, data binary").repartition(n_parts, "part")
    return packs.mapInArrow(tidy(unpack), "key long, start long, windows int, grp long")


def _compare(src: DataFrame, asked: DataFrame, bits, length: int, n_parts: int) -> DataFrame:
    """(key, start, windows) of repeated windows among the pieces asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, PACK_BYTES):
            grps, keys, starts, data, many = [], [], [], [], []
            for key, text, asks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a in asks:
                    s, grp = a["start"], a["grp"]
                    piece = text[s : s + a["windows"] + length - 1]
                    if grp >= 0:
                        grps.append(grp), keys.append(key), starts.append(s), data.append(piece)
                    else:
                        many.append((key, s, piece))
            for grp, known, packed in _packed_windows(many, length, 2 * n_parts):
                grps.append(grp), keys.append(0), starts.append(known), data.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(grps, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=["grp", "key", "start", "piece"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, size, last = [], [], 0, None
        for b in batches:
            for grp, key, start, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if grp != last and windows:
                    yield from _repeat_rows(*_later(windows))
                    windows = []
                if grp != last and size >= BLOCK_BYTES:
                    yield done(block)
                    block, size = [], 0
                last = grp
                if grp >= 0:
                    block.append((key, start, piece))
                    size += len(piece)
                elif start:  # known repeats
                    n = len(piece) // 16
                    yield from _repeat_rows(np.frombuffer(piece, np.int64, n), np.frombuffer(piece, np.int64, n, 8 * n))
                else:
                    windows.append(piece)
        if windows:
            yield from _repeat_rows(*_later(windows))
        if block:
            yield done(block)

    def done(block: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        block.sort(key=lambda x: x[:2])
        found = later_windows([p for *_, p in block], _spread(block), length)
        out_key, out_start, out_runs = [], [], []
        for (key, start, _), places in zip(block, found, strict=True):
            s, r = _runs(places)
            out_key += [key] * len(s)
            out_start += (s + start).tolist()
            out_runs += r.tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_start, pa.int64()), pa.array(out_runs, pa.int32())], names=["key", "start", "windows"])

    per_doc = asked.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "grp")).alias("asks"))
    texts = sift(src, bits, "key", True).select("key", "text").join(per_doc, "key").select("key", "text", "asks")
    cuts = texts.mapInArrow(tidy(cut), "grp long, key long, start long, piece binary")
    return cuts.repartition(n_parts, "grp").sortWithinPartitions("grp").mapInArrow(tidy(index), "key long, start long, windows int")


def _packed_windows(pieces: list[tuple[int, int, bytes]], length: int, n_packs: int) -> Iterator[tuple[int, int, bytes]]:
    """(group, known, packed): the earliest of equal windows of the pieces by hash, and the others as known repeats.

    Groups are negative and stand for a share of the hashes; packed are the arrays hash, key, start, or key, start.
    """
    if not pieces:
        return
    own = window_hashes([p for *_, p in pieces], length)
    windows = np.array([len(p) - length + 1 for *_, p in pieces])
    key = np.repeat(np.array([k for k, *_ in pieces], np.int64), windows)
    start = np.repeat(np.array([s for _, s, _ in pieces]) - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    order = np.lexsort((start, key, own))
    first = np.ones(len(order), bool)
    first[1:] = own[order][1:] != own[order][:-1]
    one, more = order[first], order[~first]
    part = (own[one] % _U(n_packs)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(n_packs + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        rows = one[by[cuts[p] : cuts[p + 1]]]
        yield -1 - p, 0, own[rows].tobytes() + key[rows].tobytes() + start[rows].tobytes()
    if len(more):
        yield -1 - int(own[more[0]] % _U(n_packs)), 1, key[more].tobytes() + start[more].tobytes()


def _later(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and starts of windows of which an equal one comes earlier."""
    parts = []
    for piece in packed:
        n = len(piece) // 24
        parts.append((np.frombuffer(piece, _U, n), np.frombuffer(piece, np.int64, n, 8 * n), np.frombuffer(piece, np.int64, n, 16 * n)))
    own, key, start = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((start, key, own))
    later = order[1:][own[order][1:] == own[order][:-1]]
    return key[later], start[later]


def _repeat_rows(key: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, start, windows) of single repeated windows, neighbours joined."""
    order = np.lexsort((start, key))
    k, s = key[order], start[order]
    cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)))) if len(k) else np.empty(0, int)
    size = np.diff(np.append(cut, len(k))).astype(np.int32)
    for lo in range(0, len(cut), 50_000):
        c = cut[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(k[c]), pa.array(s[c]), pa.array(size[lo : lo + 50_000], pa.int32())], names=["key", "start", "windows"])


def _spread(block: list[tuple[int, int, bytes]]) -> list[int]:
    """Order keys of the pieces' first bytes: a document's pieces keep their distances, later documents come after."""
    out, base, last, reach = [], 0, None, 0
    for key, start, piece in block:
        if key != last:
            base, last = reach + 1 - start, key
        out.append(base + start)
        reach = max(reach, base + start + len(piece))
    return out


def _covered(starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by windows."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], starts[order] + windows[order] + length - 1
    reach = np.maximum.accumulate(e)
    new = np.concatenate(([True], s[1:] > reach[:-1]))
    return s[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, spans array<struct<start,end>> removed (bytes), and kept (binary, what is left).

    Python receives texts in batches of about PACK_BYTES until the result, which is lazy; its batches are the session's.
    """
    spark = docs.sparkSession
    src = _ordered(docs, id_col, text_col)
    size = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = partitions(spark, size, 8e6)
    dealt = materialise(_deal(src, length, n_parts), batch_bytes=PACK_BYTES)
    asked = dealt.filter("grp is not null")
    bits = spark.sparkContext.broadcast(id_filter(asked, "key"))
    found = materialise(_compare(src, asked, bits, length, n_parts), batch_bytes=PACK_BYTES)
    runs = dealt.filter("grp is null").select("key", "start", "windows").unionByName(found)
    late = spark.sparkContext.broadcast(id_filter(runs, "key"))
    per_doc = runs.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    kind = dict(src.dtypes)["id"]
    schema = f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, PACK_BYTES):
            spans, kept, n = [], [], []
            runs = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for text, found in zip(b.column(1).to_pylist(), runs, strict=True):
                text = text or b""
                n.append(len(text))
                if not found:
                    spans.append([])
                    kept.append(text)
                    continue
                s, e = _covered(np.array([r["start"] for r in found]), np.array([r["windows"] for r in found]), length)
                spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                cuts = [0, *(v for p in zip(s.tolist(), e.tolist(), strict=True) for v in p), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    def finish_clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return finish(b.filter(pa.array(~in_filter(late.value, b.column(2)))).select([0, 1]) for b in batches)

    hit = sift(src, late, "key", True).join(per_doc, "key", "left").select("id", "text", "runs").mapInArrow(tidy(finish), schema)
    clear = src.select("id", "text", filter_place("key", late.value)).mapInArrow(tidy(finish_clear), schema)
    return hit.unionByName(clear)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    digest = out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return materialise(digest, batch_bytes=PACK_BYTES)
