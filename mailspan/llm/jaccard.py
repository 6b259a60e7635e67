"""Jaccard join of word shingle sets by parity sketches.

Every set is XOR-hashed into a sketch of parity bits, whose Hamming distance never exceeds the symmetric difference of
two sets. For sets of a and b shingles a similarity of 3/4 or more means a symmetric difference of at most (a + b) / 7.
Per band of sizes the sketch is taken in more parts than that bound, so that two linked sets agree in some part
(pigeonhole). What is joined are the parts' XOR fingerprints (a part's parity bits at full width, 64 for each), so that
parts agree by chance almost never; the sketch in parity bits filters the candidates, and the sets verify them.

Shingles that many rows hold would bring all of these together in one part. Parts therefore leave them out, in levels:
level 0 leaves out all common ones; a set of which too little is left then is found by level 1 too, which leaves out only
those that are LEVEL times as common, and so on to the last level with all shingles. Two linked sets agree in a part of
the first level at which one of them has enough left, so no link is lost, and a group of that level is no larger than its
bound on how common a shingle may be.

Sets that are equal are one class from the start, and classes that are already connected are not compared again, so that
groups of copies cost in proportion to their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, table, written
from mailspan.llm._graph import components, joined

SHINGLE = 5
#: Linked: 7 * common >= 3 * (a + b), which is 100 * common >= 75 * union.
#: Shingles whose keys meet in one bucket; shingles whose keys are made at a time; members of a star that are compared at a
#: time; members, and bytes of their sketches, that one task compares.
SHINGLES_A_BUCKET, SHINGLES_AT_ONCE, CHUNK, MEMBERS_A_TASK, SKETCHES_A_TASK = 250_000, 400_000, 2048, 50_000, 32 << 20
#: Shingles that so many rows hold are common, the most common first and no more than MOST_COMMON of them; from one level to
#: the next they may be LEVEL times as common. That decides how fast the join is, never what it finds.
COMMON_ROWS, LEVEL, MOST_COMMON, HELD_SHINGLES = 8, 16, 1_000_000, 4_000_000
#: A key of the last level may have as many rows as the most common shingle; beyond SPLIT_ROWS they are dealt into parts,
#: each pair of which meets under a key of its own.
SPLIT_ROWS = 1_000_000
#: Rounds in which one link for each two connected groups is looked for, before all that may be left are compared.
FOREST_ROUNDS = 2
#: Up to so many ids are broadcast, to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_BLOCK = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_MIX = tuple(_U(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_TABLE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(_P))
_TABLE[65:91] = _TABLE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(m, _U(x)), dtype=np.uint64))) for x in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of `data` and where they begin, a block of whole words at a time."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > _BLOCK:
            cut = max(data.rfind(x, at, at + _BLOCK) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut > at else min((i + 1 for i in (data.find(x, at + _BLOCK) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0), default=end)
        b = np.frombuffer(data, np.uint8, end - at, at)
        full = ~_SPACE[b]
        edge = np.diff(np.concatenate(([False], full, [False])).view(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[b] * up[: len(b)], dtype=np.uint64)))
            hashes.append(_mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(data):
        upto, size = at, 0
        while upto < len(data) and (upto == at or size + len(data[upto]) <= _BLOCK):
            size += len(data[upto]) + 1
            upto += 1
        part = data[at:upto]
        h, starts = _words(b" ".join(part))
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in part]))
        with np.errstate(over="ignore"):
            n = max(0, len(h) - SHINGLE + 1)
            full = _mixed(sum((h[i : i + n] * _MIX[i] for i in range(SHINGLE)), np.zeros(n, np.uint64)))
            lo = 0
            for hi in ends.tolist():
                if hi - lo >= SHINGLE:
                    yield np.unique(full[lo : hi - SHINGLE + 1])
                elif hi > lo:
                    yield _mixed(np.array([sum(int(x) * int(m) for x, m in zip(h[lo:hi], _MIX, strict=False)) + (hi - lo) * _P & _MASK], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
                lo = hi
        at = upto


def set_key(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def band_starts(most: int) -> list[int]:
    """Smallest sizes of the bands: a set's partners of at least its size are in its band or the next."""
    out = [1]
    while out[-1] <= most:
        out.append(-(-4 * out[-1] // 3))
    return out


def bound(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) // 7


def parts_of(low: int, high: int) -> tuple[int, int]:
    """For a band of sizes from `low` to `high`: the number of parts, and how many empty ones a set may have before it needs
    one more key, which all such sets of the band share. Linked sets disagree in at most D parts, so they agree in more than
    parts - 1 - D; those cannot all be empty unless both sets have more empty parts than that."""
    d = bound(high, 4 * high // 3)
    spare = 0
    while spare < 2 * d + 2:
        p = d + 1 + spare
        empty = p * math.exp(-low / p)
        if spare >= empty + 3 * math.sqrt(empty * (1 - empty / p)):
            break
        spare += 1
    return d + 1 + spare, spare


def batch_keys(sets: list[np.ndarray], starts: list[int], common: np.ndarray, drops: np.ndarray | None = None, salts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys under which the sets are found, from their parts' XOR fingerprints; for each key the number of its set, and 1 if
    the set is a guest there.

    Each set has keys in its band and, as a larger partner, a guest, in the one below, if a set there can be large enough.
    Two guests are found in a band of their own, so they need not meet.
    common: hashes of shingles, sorted, that are left out at as many levels as `drops` says (by default, the first).
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left_out = np.zeros(len(flat), np.uint8)
    if len(common):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        left_out = np.where(common[at] == flat, 1 if drops is None else drops[at], 0).astype(np.uint8)
    last = 1 if len(common) and drops is None else int(drops.max()) if len(common) else 0
    bands = np.searchsorted(starts, sizes, "right") - 1
    edges = np.array(starts, np.int64)
    shape = np.array([parts_of(starts[b], starts[b + 1] - 1) for b in range(len(starts) - 1)], np.int64).reshape(-1, 2)
    keys, owners, guests = [], [], []
    own = [bound(starts[b + 1] - 1, 4 * (starts[b + 1] - 1) // 3) > 0 for b in range(len(starts) - 1)]
    for guest, (band, chosen) in enumerate(((bands, np.array(own, bool)[bands]), (bands - 1, (bands > 0) & (3 * sizes <= 4 * (edges[bands] - 1))))):
        with np.errstate(over="ignore"):
            band = np.maximum(band, 0)
            salt = (band + 1).astype(np.uint64) * _U(_P)
            n_parts, spare = shape[band, 0], shape[band, 1]
            here = chosen[of]
            o, h, d = of[here], _mixed(flat[here] ^ salt[of[here]]), left_out[here]
            part = ((h >> _U(32)) * n_parts[o].astype(np.uint64)) >> _U(32)
            order = np.argsort((o.astype(np.uint64) << _U(32)) | part, kind="stable")
            o, part, h, d = o[order], part[order], h[order], d[order]
            todo = chosen.copy()
            for level in range(last + 1):
                keep = (d <= level) & todo[o]
                ko, kp, kh = o[keep], part[keep], h[keep]
                if len(ko):
                    first = np.flatnonzero(np.append(True, (ko[1:] != ko[:-1]) | (kp[1:] != kp[:-1])))
                    ko, kp, prints = ko[first], kp[first], np.bitwise_xor.reduceat(kh, first)
                    key = _mixed(_mixed(prints + salt[ko]) + kp * _MIX[0] + _U(level) * _MIX[2])
                    keys.append(key if level < last else _dealt(key, sets, ko, salts))
                    owners.append(ko if level < last else np.repeat(ko, salts))
                todo &= n_parts - np.bincount(ko, minlength=len(sets)) > spare
                if not todo.any():
                    break
            if todo.any():  # rare: they may agree with a set in nothing but empty parts, and then that has as many
                ko = np.flatnonzero(todo)
                keys.append(_dealt(_mixed(salt[ko] ^ _MIX[1]), sets, ko, salts))
                owners.append(np.repeat(ko, salts))
        guests += [np.full(len(x), guest, np.uint64) for x in owners[len(guests) :]]
    return (np.concatenate(keys), np.concatenate(owners), np.concatenate(guests)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _dealt(keys: np.ndarray, sets: list[np.ndarray], owners: np.ndarray, salts: int) -> np.ndarray:
    """`salts` keys for each: one for each part that the own part of its set is to meet."""
    if salts == 1:
        return keys
    own = np.array([int(_mixed(x[:1])[0] % _U(salts)) if len(x) else 0 for x in sets], np.uint64)[owners][:, None]
    other = np.arange(salts, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        return _mixed(keys[:, None] + (np.minimum(own, other) * _U(salts) + np.maximum(own, other) + _U(1)) * _MIX[3]).reshape(-1)


def keys_of(s: np.ndarray, starts: list[int], common: np.ndarray, drops: np.ndarray | None = None, salts: int = 1) -> np.ndarray:
    """All keys of one set."""
    return batch_keys([s], starts, common, drops, salts)[0]


def sketch(s: np.ndarray) -> bytes:
    """Parity bits: at least two for each shingle, a power of two, so that a larger sketch folds onto a smaller one."""
    bits = max(256, 1 << (2 * len(s) - 1).bit_length())
    parity = np.bincount((_mixed(s + _U(_P)) & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").tobytes()


def _folded(x: bytes, words: int) -> np.ndarray:
    a = np.frombuffer(x, np.uint64)
    return a if len(a) == words else np.bitwise_xor.reduce(a.reshape(-1, words), 0)


def near_pairs(sizes: np.ndarray, sketches: list[bytes], classes: np.ndarray, seed: int | None) -> list[tuple[int, int]]:
    """Pairs of different classes whose sizes and sketches allow a link; with a `seed` only one for each two classes, in an
    order that it decides, and none between classes that earlier ones connect."""
    order = np.argsort(sizes, kind="stable")
    n, by_size, label = len(order), sizes[order], np.unique(classes, return_inverse=True)[1][order]
    fresh = label.copy()
    turns = np.arange(n) if seed is None else np.random.default_rng(seed).permutation(n)
    stacked: dict[int, tuple[int, np.ndarray]] = {}
    words = np.array([len(sketches[i]) // 8 for i in order])  # never falls, as sizes don't
    out: list[tuple[int, int]] = []
    for i in turns.tolist():
        upto = int(np.searchsorted(by_size, 4 * by_size[i] // 3, "right"))
        if upto <= i + 1:
            continue
        w = int(words[i])
        if w not in stacked:  # from the first sketch of this length on, all are at least as long
            base = int(np.searchsorted(words, w))
            stacked[w] = base, np.stack([_folded(sketches[j], w) for j in order[base:]])
        base, rows = stacked[w]
        at = np.arange(i + 1, upto)
        at = at[fresh[at] != fresh[i]] if seed is not None else at[label[at] != label[i]]
        if not len(at):
            continue
        d = np.bitwise_count(rows[i - base] ^ rows[at - base]).sum(1)
        at = at[d <= (by_size[i] + by_size[at]) // 7]
        if seed is None:
            out += [(int(order[i]), int(order[j])) for j in at.tolist()]
            continue
        for other, k in zip(*np.unique(fresh[at], return_index=True), strict=True):
            out.append((int(order[i]), int(order[at[k]])))
            fresh[fresh == other] = fresh[i]
    return out


def node_id(key: bytes) -> int:
    """What stands for a set in candidate groups. Sets whose ids are equal by chance become candidates together."""
    return int.from_bytes(key[:8], "little", signed=True)


def _described(df: DataFrame) -> DataFrame:
    """doc_id, rk, n_shingles, set_key, id, sketch of each row of (doc_id, rk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sketches = [], [], []
            for s in shingle_sets(batch.column(2).to_pylist()):
                n.append(len(s))
                keys.append(set_key(s))
                sketches.append(sketch(s) if len(s) else None)
            ids = pa.array([None if k is None else node_id(k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), ids, pa.array(sketches, pa.binary())], ["doc_id", "rk", "n_shingles", "set_key", "id", "sketch"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, rk long, n_shingles long, set_key binary, id long, sketch binary")


def _common(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the most common shingles of all rows, sorted; at how many levels each is left out; the largest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            # what is in one text of some thousands alone is left out, so that common ones are all that is shuffled
            return pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], ["s", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist()):
                sets.append(s.view(np.int64))
                held += len(s)
                if held > HELD_SHINGLES:
                    yield out()
                    sets, held = [], 0
        if sets:
            yield out()

    counted = df.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_ROWS)
    got = counted.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toPandas()
    if not len(got):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), 0
    s, n = got["s"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order, drops, at = np.argsort(s), np.ones(len(n), np.uint8), n.min() * LEVEL
    while at <= n.max():
        drops, at = drops + (n >= at).astype(np.uint8), at * LEVEL
    return s[order], drops[order], int(n.max())


def _agreeing(df: DataFrame, starts: list[int], common: tuple[np.ndarray, np.ndarray, int], buckets: int) -> DataFrame:
    """Stars of the sets that agree in some part, if not all of them are guests in the band: pairs (src, dst) of the smallest
    id among them and each other one."""
    shared = df.sparkSession.sparkContext.broadcast((starts, *common[:2]))
    salts = max(1, -(-common[2] // SPLIT_ROWS))

    def packed(sets: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        k, o, guest = batch_keys(sets, *shared.value, salts)
        if not len(k):  # sets of one or two shingles have no keys
            return
        k = k & ~_U(1) | guest  # in the lowest bit
        bucket = ((k >> _U(32)) * _U(buckets)) >> _U(32)
        order = np.argsort(bucket * _U(len(sets)) + o.astype(np.uint64), kind="stable")
        k, o, bucket = k[order], o[order], bucket[order]
        run = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (bucket[1:] != bucket[:-1])))  # keys of one set in one bucket
        counts, whose, where = np.diff(np.append(run, len(k))).astype(np.uint32), np.array(names, np.int64)[o[run]], bucket[run]
        ids, first = np.unique(where, return_index=True)
        cells = [(a, b, int(run[a]), int(run[b]) if b < len(run) else len(k)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(run)], strict=True)]
        five = k.view(np.uint8).reshape(-1, 8)[:, :5]  # 40 of 64 bits; the bucket has others
        columns = [[five[lo:hi].tobytes() for _, _, lo, hi in cells], [counts[a:b].tobytes() for a, b, _, _ in cells], [whose[a:b].tobytes() for a, b, _, _ in cells]]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], ["bucket", "keys", "counts", "names"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sets, names, held = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist()):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                sets.append(s)
                names.append(node_id(key))
                held += len(s)
                if held >= SHINGLES_AT_ONCE:
                    yield from packed(sets, names)
                    sets, names, held = [], [], 0
        if sets:
            yield from packed(sets, names)

    entries = df.select("text").mapInArrow(emit, "bucket long, keys binary, counts binary, names binary")
    return entries.groupBy("bucket").applyInArrow(meet, "src long, dst long").distinct()


def meet(cells: pa.Table) -> pa.Table:
    """The stars, as pairs of ids (src, dst), of the keys of one bucket: keys of five bytes, of each set of a cell so many as counts says."""
    end_to_end = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for x in cells[c]), kind)
    ids, code = np.unique(end_to_end("names", np.int64), return_inverse=True)
    c = np.repeat(code.astype(np.int32), end_to_end("counts", np.uint32))
    k = np.zeros((len(c), 8), np.uint8)
    k[:, :5] = end_to_end("keys", np.uint8).reshape(-1, 5)
    src, dst = stars(k.view(np.uint64).reshape(-1), c, len(ids))
    return pa.table({"src": ids[src], "dst": ids[dst]})


def stars(k: np.ndarray, c: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """For the keys `k` (a guest's in the lowest bit) of the codes `c` below `n_ids`: the smallest code of each key that not only
    guests have, and each other one, every pair once."""
    # one that is no guest first, if there is one
    if len(k) and n_ids <= 1 << 24 and not int(k.max()) >> 40:  # both fit into 64 bits, which are sorted in place
        k = k << _U(24) | c.astype(np.uint64)
        k.sort()
        c = (k & _U((1 << 24) - 1)).astype(np.int32)
        k >>= _U(24)
    else:
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] >> _U(1) != k[:-1] >> _U(1))) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(k)))
    smallest = np.minimum.reduceat(c, first) if len(k) else c
    head = np.repeat(np.where(k[first] & _U(1), -1, smallest), n)
    c, head = c[head >= 0], head[head >= 0]
    apart = head != c
    # products of two codes pass 32 bits
    pair = np.unique(head[apart].astype(np.int64) * n_ids + c[apart])
    return pair // max(1, n_ids), pair % max(1, n_ids)


def _few(ids: DataFrame) -> DataFrame:
    """For a join: broadcast if it has been counted to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sides(pairs: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
    one = table.select(F.col(key).alias("src"), *(F.col(c).alias(f"{c}_a") for c in columns))
    two = table.select(F.col(key).alias("dst"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(one, "src").join(two, "dst").select("src", "dst", *(f"{c}_{x}" for x in "ab" for c in columns))


def _close(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """The pairs (src, dst), as set keys, of one pair of ids for each dst, if sizes and sketches allow a link: that with the
    smallest src of a size that fits. Members of one group mostly name the same src so; what this leaves open is found by
    `_remaining`."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, sa, nb, sb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                words = min(len(sa), len(sb)) // 8
                keep.append(int(np.bitwise_count(_folded(sa, words) ^ _folded(sb, words)).sum()) <= bound(na, nb))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    fit = _sides(pairs, active.select("id", "set_key", "n"), "id", "set_key", "n").filter("3 * greatest(n_a, n_b) <= 4 * least(n_a, n_b)")
    one = fit.filter("set_key_a <> set_key_b").groupBy("set_key_b").agg(F.min_by("set_key_a", F.struct("src", "set_key_a")).alias("src"))
    named = one.select("src", F.col("set_key_b").alias("dst"))
    return _sides(named, active, "set_key", "n", "sketch").mapInArrow(close, "src binary, dst binary")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sets are linked. Sets are made again, for these pairs alone, from the text of a row of each class."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [s for s in shingle_sets(batch.column(0).slice(at, 500).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "shingles"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)))
                both.sort()
                keep.append(7 * int(np.count_nonzero(both[1:] == both[:-1])) >= 3 * len(both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    keys = pairs.select(F.col("src").alias("set_key")).union(pairs.select("dst")).distinct()
    sets = texts.join(_few(keys), "set_key", "left_semi").select("text").mapInArrow(whole, "set_key binary, shingles binary")
    return _sides(pairs, written(sets.dropDuplicates(["set_key"]), "sets"), "set_key", "shingles").mapInArrow(linked, "src binary, dst binary")


def _open(members: DataFrame, active: DataFrame, labels: DataFrame) -> DataFrame:
    """g, id of the stars whose members are not all connected. Those that are stay so, and never come back."""
    named = active.select("id", F.col("set_key").alias("node")).join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    told = members.join(named, "id").groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("g")
    return written(members.join(_few(written(told, "stars")), "g", "left_semi"), "open")


def _remaining(members: DataFrame, active: DataFrame, labels: DataFrame, seed: int | None) -> DataFrame:
    """Pairs of the stars' members (g, id) that are not yet connected and whose sketches allow a link."""
    named = active.select("id", "set_key").join(labels.select(F.col("node").alias("set_key"), "component"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    rows = members.join(named, "id")
    sizes = rows.groupBy(F.col("g").alias("star")).agg(F.count("*").alias("size"))
    rows = rows.join(sizes, F.col("g") == F.col("star"))
    # a large star is compared chunk by chunk, each pair of chunks for itself
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("set_key"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("g", "set_key", "component", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
    rows = written(rows.join(active.select("set_key", "n", "sketch"), "set_key"), "members")
    held = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("sketch")), F.lit(0)).alias("b")).first()
    tasks = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.n // MEMBERS_A_TASK), -(-held.b // SKETCHES_A_TASK))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "lo", "hi"])
        new = (pdf[["g", "lo", "hi"]] != pdf[["g", "lo", "hi"]].shift()).any(axis=1).to_numpy()
        edges = np.append(np.flatnonzero(new), len(pdf)).tolist()
        names, codes, sizes, sketches = pdf["set_key"].to_list(), pd.factorize(pdf["component"])[0], pdf["n"].to_numpy(), pdf["sketch"].to_list()
        found = set()
        for a, b in zip(edges, edges[1:], strict=False):
            if (codes[a:b] != codes[a]).any():
                found.update((names[a + i], names[a + j]) for i, j in near_pairs(sizes[a:b], sketches[a:b], codes[a:b], seed))
        return pd.DataFrame({"src": [x for x, _ in found], "dst": [y for _, y in found]}, dtype=object)

    # many stars a task; each star and pair of chunks is compared for itself
    dealt = rows.select(F.pmod(F.xxhash64("g", "lo", "hi"), F.lit(tasks)).alias("task"), "g", "lo", "hi", "set_key", "component", "n", "sketch")
    return dealt.groupBy("task").applyInPandas(compare, "src binary, dst binary")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row doc_id, n_shingles, component_id (the smallest id in its connected group).

    Words and shingles are as above: null texts and texts without words have the empty set and are linked with nothing;
    fewer than five words are one shingle. Rows repeated or of equal sets are one class. A row without an id is linked
    like others but never gives its group a name; if no row of the group has one, component_id is null. Long texts are
    read whole; an empty table gives no rows; other columns are ignored.
    """
    return grouped(df, id_column, text_column).select("doc_id", "n_shingles", "component_id")


def row_key(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> "F.Column":
    return F.xxhash64(df[id_column], df[text_column].cast("string"))


def one_of_each(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`df` with one document of each group: the one with the smallest id, rows without an id after all others, ties by the
    hash of id and text. Rows of equal id and text are one document, of which the row whose columns have the smallest hash
    stays; rows of equal id and different texts are different documents. Documents without words all stay."""
    told = written(grouped(df, id_column, text_column).select("doc_id", "rk", "group"), "told")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "rk")
    first = told.filter("group is not null").groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("group").alias("g"), "first")
    go = written(told.join(first, F.col("group") == F.col("g")).filter(place != F.col("first")).select(F.col("doc_id").alias("_d"), F.col("rk").alias("_k")).distinct(), "go")
    again = written(told.groupBy(F.col("doc_id").alias("_d"), F.col("rk").alias("_k")).count().filter("count > 1").select("_d", "_k"), "again")

    def same(other: DataFrame) -> "F.Column":
        return df[id_column].eqNullSafe(other["_d"]) & (row_key(df, id_column, text_column) == other["_k"])

    left = df.join(_few(go), same(go), "left_anti")
    if again.isEmpty():
        return left
    repeated = left.join(_few(again), same(again), "left_semi")
    one = repeated.groupBy(row_key(repeated, id_column, text_column).alias("_k"), repeated[id_column].alias("_d")).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("_row"))
    return left.join(_few(again), same(again), "left_anti").unionByName(one.select("_row.*"))


def grouped(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same, with rk (the row's key) and group: the set key of one of the component's sets, null for the empty set. It
    names the group even if no row of it has an id."""
    spark = df.sparkSession
    arrow_batches(spark)
    text = df[text_column].cast("string")
    docs = df.select(df[id_column].alias("doc_id"), row_key(df, id_column, text_column).alias("rk"), text.alias("text"))
    told = written(_described(docs), "sets")
    facts = told.agg(F.sum("n_shingles").alias("total"), F.max("n_shingles").alias("most")).first()
    if not facts.most:
        return told.select("doc_id", "rk", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("group"))
    starts = band_starts(facts.most)
    pairs = written(_agreeing(docs, starts, _common(docs), max(1, facts.total // SHINGLES_A_BUCKET)), "pairs")
    # one row for each set, under the smallest id that has it; from here on only sets that are in a star count
    classes = told.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("rk").alias("rk"), F.first("id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    ids = written(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct(), "ids")
    active = written(classes.join(_few(ids), "id", "left_semi"), "active")
    chosen = active.select("rk", "set_key")
    texts = written(docs.join(_few(chosen), "rk").select("set_key", "text"), "texts")
    links = written(_linked(written(_close(pairs, active).distinct(), "near"), texts), "links")
    labels = components(links)
    # a star has its head as a member
    members = pairs.select(F.col("src").alias("g"), F.col("dst").alias("id")).union(pairs.select("src", "src").distinct())
    for seed in (*range(FOREST_ROUNDS), None):
        members = _open(members, active, labels)
        asked = written(_remaining(members, active, labels, seed).distinct(), "asked")
        found = written(_linked(asked, texts), "links")
        n_asked, n_found = asked.count(), found.count()
        if n_found:
            labels = joined(labels, found)
        if n_found == n_asked:  # nothing that was asked for in vain could hide a link
            break
    named = classes.select("set_key", "doc_id").join(labels.select(F.col("node").alias("set_key"), "component"), "set_key", "left").withColumn("group", F.coalesce("component", "set_key"))
    heads = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("head"))
    named = named.join(heads, "component", "left").select("set_key", "group", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("component_id"))
    columns = ["doc_id", "rk", "n_shingles", "component_id", "group"]
    full = told.filter("set_key is not null").select("doc_id", "rk", "n_shingles", "set_key").join(named, "set_key").select(columns)
    empty = told.filter("set_key is null").select("doc_id", "rk", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("group"))
    return full.union(empty)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 7 * c >= 3 * (na.n + nb.n)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLE_SQL = {"op9_jaccard_join": _SQL}
