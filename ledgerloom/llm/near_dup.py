"""Near-duplicate records with small edits (problem 3).

SetSketch: every register holds the minimum of an exponentially distributed hash over the words of a record, stored
as its truncated logarithm to a base near 1. Registers of a union are the maxima of the registers, so
sketches merge; two records agree in a register with a probability close to their Jaccard similarity.

1. One pass sketches each record's word set and gives rows (bucket, set hash, size, one bit of each register). Records with the same words have the same set hash and are one row a
   partition from here on, so a group of copies of any size costs one row in each partition. The pass also gives the
   membership of the record, with its set's registers.
   Buckets of a set of more than ``PREFIX_WORDS`` words are its registers' bands. Smaller sets meet by their rarest words: texts of one sentence pattern share bands without
   being similar enough, and their pairs in bands grow with the square of the table. Of all words put in one order, the rarest first, two sets as similar as the threshold
   t share one of the first n - ceil(2t/(1+t) n) + 1 words of the smaller set and n - ceil(t n) + 1 of the larger, so this misses no pair. Sets of more than t ``PREFIX_WORDS`` words give bands too,
   so that a pair on either side of the bound meets. The order is that of the words' numbers in a sample; any order gives the same pairs, this one small buckets.
2. Rows of one bucket meet in one task; a bucket that many different sets share is split into blocks, of which every two meet in a task of their own. There both set sizes
   and the number of equal register bits rule out most pairs; a pair costs a few array operations on 20 bytes, and only surviving pairs leave the task. The number of tasks follows from the
   number of rows, so that a task holds about ``TASK_BYTES`` at any size of the input.
3. The similarity of a surviving pair is estimated from its registers by maximum likelihood, jointly from how many are greater, less and equal
   and from both set sizes; pairs whose threshold that likelihood rules out are dropped.
4. The rest are verified exactly on the words of the two texts.

Recall: with ``rows`` registers a band and ``bands`` bands a pair of similarity s of which one set is larger than ``PREFIX_WORDS`` is missed with probability
(1 - s**rows)**bands, 1.2 % at 0.7, 0.02 % at 0.8; by the bit test with 0.04 % and by the likelihood test with 0.02 % at 0.7. Two different word sets
with one 64-bit hash would be taken for copies; at 10**9 records the chance of one such pair is 3 %.

Copies: ``similar_pairs`` names every pair of records, also within a group of copies; both ends are dealt to ``BLOCKS`` blocks there, so that no task gets
more than the pairs of two blocks. ``links`` and ``groups`` give the same knowledge without pairs of copies.

Defined cases: a null or blank text and one without a word belongs to no group; repeated rows of an id, which are taken to
have one text, count once; records whose word sets are equal have similarity 1; null ids are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import words as words_of
from ledgerloom.llm.text import WordSets, mix, text_slices
from ledgerloom.session import spread

REGISTERS, BASE, BLOCK = 160, 1.05, 1024
#: The registers that are sent along for the estimate; they are in no band, so that meeting in a band says nothing about them.
SENT = slice(64, 112)
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: A record in a bucket: 22 bits of the bucket's hash (a partition holds few of them) and two of its role, set hash, logarithm of the set size, one bit of each register.
_ROW = np.dtype([("band", "<u2"), ("band_low", "u1"), ("size", "u1"), ("sid", "<i8"), ("bits", "<u4", REGISTERS // 32)])
_SIZE_BASE = 1.05
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Sets whose words are gathered at once, words whose values are held at once, bytes of text in one step, sets a task remembers to have sent.
_STEP, MOST_WORDS, STEP_BYTES, REMEMBERED = 256, 80_000, 1_200_000, 200_000
#: Different sets of one bucket that are compared in one task; larger buckets are split into blocks of about this size.
HOT_ROWS = 16_384
#: Words up to which sets meet by their rarest words; above half of it bands are fewer rows. Rows of the sample that orders the words, at least, and words that are put in order by it.
PREFIX_WORDS, ORDER_ROWS, ORDERED = 96, 20_000, 100_000
#: Roles in a bucket: as the smaller set of a pair, where both ends are so split that it meets larger ones only; as either; as the larger set only.
SMALLER, EITHER, LARGER = 0, 1, 2
_WORD_KEY, _LARGER_KEY = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
#: Bytes of band rows in one task, and those a sketching task packs at once; pairs a task holds before they leave; blocks that the members of a set are dealt to.
TASK_BYTES, PACK_BYTES, PAIRS_HELD, BLOCKS = 6_000_000, 32_000_000, 1_000_000, 64


def _uniform(hashes: np.ndarray) -> np.ndarray:
    """Uniform 32-bit values (words x REGISTERS); the largest belongs to the least exponential."""
    x = hashes[:, None] + _SEEDS[None, :]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def sketch(sets: WordSets) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16)."""
    n = len(sets.sizes)
    top = np.zeros((n, REGISTERS), np.uint32)
    if len(sets.hashes) <= MOST_WORDS:  # words that come again are hashed once
        values = _uniform(sets.hashes)
        for at in range(0, n, _STEP):
            to = min(at + _STEP, n)
            lo = sets.starts[at]
            hi = sets.starts[to] if to < n else len(sets.flat)
            top[at:to] = np.maximum.reduceat(values[sets.flat[lo:hi]], sets.starts[at:to] - lo, axis=0)
    else:  # a very long text: piece by piece, registers of pieces merge
        row = np.repeat(np.arange(n), sets.sizes)
        for lo in range(0, len(sets.flat), MOST_WORDS // 4):
            part = slice(lo, lo + MOST_WORDS // 4)
            first = np.flatnonzero(np.concatenate([[True], np.diff(row[part]) > 0]))
            of = row[part][first]
            top[of] = np.maximum(top[of], np.maximum.reduceat(_uniform(sets.hashes[sets.flat[part]]), first, axis=0))
    least = -np.log((top.astype(np.float32) + np.float32(0.5)) / np.float32(2.0**32))
    np.maximum(least, np.float32(1e-12), out=least)
    return (np.float32(1000) - np.floor(np.log(least) * np.float32(1 / np.log(BASE)))).astype(np.uint16)


def bits_of(registers: np.ndarray) -> np.ndarray:
    """The last bit of every register, packed to 32-bit numbers."""
    return np.packbits((registers & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint32)


def _least_equal(threshold: float, slack: float = 3.3) -> int:
    """Equal bits below which a pair of that similarity is as good as ruled out (slack standard deviations)."""
    p = (1 + threshold) / 2
    return int(np.floor(REGISTERS * p - slack * np.sqrt(REGISTERS * p * (1 - p))))


def size_class(n: np.ndarray) -> np.ndarray:
    """The rounded logarithm of a set's size in one byte."""
    return np.minimum(np.round(np.log(np.maximum(n, 1)) / np.log(_SIZE_BASE)), 255).astype(np.uint8)


def likely(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the threshold can't be ruled out from the number of equal bits and the classes of the set sizes."""
    apart = np.abs(size_a.astype(np.int16) - size_b)
    return (equal >= _least_equal(threshold)) & (apart <= np.ceil(-np.log(threshold) / np.log(_SIZE_BASE)) + 1)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarities j where so many registers of the first set are greater, less and the same; u is the first set's share of both sizes.

    A register of the first is the greater one with probability p(u - v j), p(x) = -log_b(1 - x (b - 1) / b), v = 1 - u; in the same way for the second.
    """
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    v = 1 - u
    up, down = p(u - v * j), p(v - u * j)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """The most likely similarity, by golden section on the likelihood, which has one maximum."""
    u = n_a / (n_a + n_b)
    lo, hi = np.zeros(len(u)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = log_likelihood(x, more, less, same, u) > log_likelihood(y, more, less, same, u)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def not_ruled_out(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, slack: float = 3.5) -> np.ndarray:
    """Whether the likelihood ratio of the threshold against the most likely similarity leaves the threshold possible. Registers are given by their last byte."""
    apart = (regs_a - regs_b).view(np.int8)
    more, less = (apart > 0).sum(axis=1), (apart < 0).sum(axis=1)
    same = apart.shape[1] - more - less
    best, u = estimate(more, less, same, n_a, n_b), n_a / (n_a + n_b)
    at = np.minimum(threshold, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
    gain = log_likelihood(best, more, less, same, u) - log_likelihood(at, more, less, same, u)
    return (best >= at) | (2 * gain <= slack * slack)


def prefixes(sets: WordSets, of: np.ndarray, threshold: float, times: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in of, key, role) of the rarest words of the sets of: EITHER where two sets that share the word there may be a pair whichever is larger,
    LARGER where only with a smaller set. times: how often the more frequent words stand in a sample, by hash."""
    known = np.array(sorted(times), np.uint64)
    often = np.zeros(len(sets.hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, sets.hashes), len(known) - 1)
        often = np.where(known[at] == sets.hashes, np.array([times[k] for k in known.tolist()], np.int64)[at], 0)
    order = np.lexsort((sets.hashes, often))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = sets.sizes[of]
    starts = np.cumsum(sizes) - sizes
    who = np.repeat(np.arange(len(of)), sizes)
    at = np.arange(len(who)) - starts[who]
    ranked = np.sort(who * np.int64(len(order) + 1) + place[sets.flat[sets.starts[of][who] + at]])
    most = lambda share: sizes - np.ceil(share * sizes - 1e-6).astype(np.int64) + 1
    keep = at < most(threshold)[who]
    role = np.where(at < most(2 * threshold / (1 + threshold))[who], EITHER, LARGER)[keep]
    return who[keep], mix(sets.hashes[order[ranked[keep] % (len(order) + 1)]] + _WORD_KEY), role


def _met(batches: Iterator[pa.RecordBatch], bands: int, rows: int, threshold: float, times: dict[int, int]) -> Iterator[tuple]:
    """Of each step: the batch, its word sets, their hashes, which of them the task has not met before, and for these
    the registers and the buckets (place in new, key, role)."""
    seen: set[int] = set()
    for whole in batches:
        for batch in text_slices(whole, "text", STEP_BYTES):
            sets = WordSets(batch.column("text").to_pylist())
            if not len(sets.sizes):
                continue
            sids = sets.set_hashes()
            new = np.array([i for i, s in enumerate(sids.tolist()) if not (s in seen or seen.add(s))], np.int64)
            if len(seen) > REMEMBERED:
                seen.clear()
            registers = sketch(sets)[new]
            small = np.flatnonzero(sets.sizes[new] <= PREFIX_WORDS)
            own, key, role = prefixes(sets, new[small], threshold, times)
            owns, keys, roles = [small[own]], [key], [role]
            large = np.flatnonzero(sets.sizes[new] > threshold * PREFIX_WORDS - 1e-6)
            for k in range(bands):
                h = np.full(len(large), k + 1, np.uint64)
                for j in range(rows):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + registers[large, k * rows + j])
                owns.append(large)
                keys.append(h)
                roles.append(np.full(len(large), EITHER))
            yield batch, sets, sids, new, registers, (np.concatenate(owns), np.concatenate(keys), np.concatenate(roles))


def _larger_key(key: np.ndarray) -> np.ndarray:
    """What the larger sets of a bucket are counted and split under."""
    return mix(key + _LARGER_KEY)


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, "text", STEP_BYTES):
            sets = WordSets(batch.column("text").to_pylist())
            times = np.bincount(sets.flat, minlength=len(sets.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(sets.hashes.view(np.int64)), pa.array(times.astype(np.int64))], names=["word", "times"])


def frequent_words(texts: DataFrame, n: int) -> dict[int, int]:
    """Hashes of the words that stand in several rows of a sample of a thousandth of the n rows, 20,000 at least, with their numbers there.

    They say only in which order words are taken, which the results don't depend on.
    """
    share = min(1.0, max(1e-3, ORDER_ROWS / max(n, 1)))
    sample = texts.sample(share, seed=2) if share < 1 else texts
    found = sample.mapInArrow(_sampled_words, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).where("times > 1")
    found = found.orderBy(F.desc("times"), "word").limit(ORDERED).toArrow()
    return dict(zip(found["word"].to_numpy().view(np.uint64).tolist(), found["times"].to_pylist(), strict=True))


def _sampled_keys(bands: int, rows: int, threshold: float, times: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sids, new, _, (own, key, role) in _met(batches, bands, rows, threshold, times):
            key = np.where(role == LARGER, _larger_key(key), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sids[new][own])], names=["key", "sid"])

    return run


def hot_buckets(texts: DataFrame, n: int, bands: int, rows: int, threshold: float = 0.7, times: dict[int, int] | None = None, most: int = HOT_ROWS) -> dict[int, int]:
    """Keys of buckets that hold more than about so many different sets, with the number of blocks to split each into; larger sets have keys of their own.

    They are looked for in a sample of a thousandth of the n rows, 5,000 at least, and say only where work is split: results don't depend on it. Of more
    than a million the smaller ones stay whole, and are compared block by block in one task.
    """
    times = frequent_words(texts, n) if times is None else times
    share = min(1.0, max(1e-3, 5_000 / max(n, 1)))
    sample = texts.sample(share, seed=1) if share < 1 else texts
    keys = sample.mapInArrow(_sampled_keys(bands, rows, threshold, times), "key long, sid long").groupBy("key").agg(F.countDistinct("sid").alias("k"))
    found = keys.where(F.col("k") >= max(10.0, most * share)).orderBy(F.desc("k")).limit(1_000_000).collect()
    return {r["key"]: int(np.ceil(r["k"] / share / most)) + 1 for r in found}


_SKETCHED = "part int, packed binary, sid long, id string, n int, regs binary"


def _sketcher(bands: int, rows: int, parts: int, hot: dict[int, int], threshold: float, times: dict[int, int]):
    """Rows of each bucket, packed to one row for each step and task, and the members.

    The rows of a hot key are dealt to blocks by set hash, and a block meets every block in a task of its own: rows of blocks i and j are
    sent under the key of (i, j), in the same way blocks of smaller and of larger sets. Members are dealt by the hash of their id, so that a group of copies is spread too.
    """
    hot_keys = np.array(sorted(hot), np.int64).view(np.uint64)
    types = (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _SKETCHED.split(", ")]

    def split(sids: np.ndarray, own: np.ndarray, keys: np.ndarray, roles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(own, key, role) of the rows of hot keys."""
        order = np.argsort(keys, kind="stable")
        for of in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            key = keys[of[:1]]
            large = _larger_key(key)
            some, more = (np.uint64(hot.get(int(k.view(np.int64)[0]), 1)) for k in (key, large))
            small_own, large_own = own[of[roles[of] == EITHER]], own[of[roles[of] == LARGER]]
            i, j = sids[small_own].view(np.uint64) % some, sids[large_own].view(np.uint64) % more
            for k in np.arange(some, dtype=np.uint64):
                yield small_own, mix(key + np.minimum(i, k) * some + np.maximum(i, k) + np.uint64(1)), EITHER
                yield large_own, mix(large + k * more + j + np.uint64(1)), LARGER
            for k in np.arange(more, dtype=np.uint64):
                yield small_own, mix(large + i * more + k + np.uint64(1)), SMALLER

    def bucket_rows(sids: np.ndarray, sizes: np.ndarray, registers: np.ndarray, own: np.ndarray, keys: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, h, role = own, keys, roles
        if len(hot_keys):
            heavy = np.isin(keys, hot_keys) | np.isin(_larger_key(keys), hot_keys)
            at, h, role = own[~heavy], keys[~heavy], roles[~heavy]
            if heavy.any():
                dealt = list(split(sids, own[heavy], keys[heavy], roles[heavy]))
                at, h = (np.concatenate([x, *(d[c] for d in dealt)]) for c, x in enumerate((at, h)))
                role = np.concatenate([role, *(np.full(len(d[0]), d[2]) for d in dealt)])
        out = np.empty(len(at), _ROW)
        out["band"], out["band_low"] = (h >> np.uint64(40)) & np.uint64(0xFFFF), (h >> np.uint64(32)) & np.uint64(0x3F) | role.astype(np.uint64) << np.uint64(6)
        out["sid"], out["size"], out["bits"] = sids[at], size_class(sizes)[at], bits_of(registers)[at]
        return out, ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out, to = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.argsort(to, kind="stable")
        out, to = out[order], to[order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
        ends = np.concatenate([cuts[1:], [len(to)]]).astype(int)
        pieces = [out[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
        none = [None] * len(pieces)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((to[cuts], pieces, none, none, none, none), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch, sets, all_sids, new, registers, buckets in _met(batches, bands, rows, threshold, times):
            held.append(bucket_rows(all_sids[new], sets.sizes[new], registers, *buckets))
            size += held[-1][0].nbytes
            if size > PACK_BYTES:
                yield packed(held)
                held, size = [], 0
            who = batch.column("id").take(pa.array(sets.rows)).to_pylist()
            sent: list[bytes | None] = [None] * len(who)
            for i, x in zip(new.tolist(), registers[:, SENT].astype(np.uint8), strict=True):
                sent[i] = x.tobytes()
            dealt = [xxhash.xxh3_64_intdigest(x) % parts if x is not None else None for x in who]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((dealt, [None] * len(who), all_sids, who, sets.sizes, sent), types, strict=True)], names=names)
        if held:
            yield packed(held)

    return run


def _emit(threshold: float):
    def pairs_of(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        for at in range(0, pairs.shape[1], 100_000):
            part = pairs[:, at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], schema=_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a partition: rows are sorted by bucket and role, and the pairs of each bucket are tested in blocks."""
        held = [np.frombuffer(x.as_buffer(), _ROW) for b in batches for x in b.column("packed").drop_null()]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        band = (rows["band"].astype(np.uint32) << 8) + ((rows["band_low"] & 0x3F) << 2) + (rows["band_low"] >> 6)
        order = np.lexsort((rows["sid"], band))
        rows, band = rows[order], band[order]
        sid = rows["sid"]
        first = np.concatenate([[True], (band[1:] != band[:-1]) | (sid[1:] != sid[:-1])])  # the same set from several tasks
        rows, band = rows[first], band[first]
        sid, size, bits = np.ascontiguousarray(rows["sid"]), np.ascontiguousarray(rows["size"]), np.ascontiguousarray(rows["bits"])
        role, band = (band & 3).astype(np.int8), band >> 2
        starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(band)]]))
        smaller = np.add.reduceat(role != LARGER, starts)

        def tested(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            roles = role[i] + role[j]  # rows are in order of role: either with either or larger, smaller with larger
            meet = (roles >= EITHER + EITHER) & (roles <= EITHER + LARGER) & ((role[j] != LARGER) | (size[i] <= size[j]))
            i, j = i[meet], j[meet]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int32)
            ok = likely(REGISTERS - apart, size[i], size[j], threshold)
            a, b = sid[i[ok]], sid[j[ok]]
            return np.stack([np.minimum(a, b), np.maximum(a, b)])

        out: list[np.ndarray] = []
        held_pairs = 0
        for some in _blocks(starts, sizes, smaller, tested):
            out.append(some)
            held_pairs += some.shape[1]
            if held_pairs > PAIRS_HELD:
                yield from pairs_of(out)
                out, held_pairs = [], 0
        if out:
            yield from pairs_of(out)

    return run


def _blocks(starts: np.ndarray, sizes: np.ndarray, smaller: np.ndarray, tested: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """What tested gives for all pairs of rows of each bucket of which one is among the first, the smaller sets, a bounded number of pairs at a time."""
    some = (sizes > 1) & (smaller > 0)
    starts, sizes, smaller = starts[some], sizes[some], smaller[some]
    for size in np.unique(sizes[sizes <= 64]):  # buckets of one size together
        i, j = np.triu_indices(size, 1)
        of = starts[sizes == size]
        step = max(1, 500_000 // len(i))
        for at in range(0, len(of), step):
            o = of[at : at + step, None]
            yield tested((o + i).ravel(), (o + j).ravel())
    for start, size, few in zip(starts[sizes > 64], sizes[sizes > 64], smaller[sizes > 64], strict=True):
        for lo in range(0, few, BLOCK):
            for lo2 in range(lo, size, BLOCK):
                i, j = (g.ravel() for g in np.meshgrid(np.arange(lo, min(lo + BLOCK, few)), np.arange(lo2, min(lo2 + BLOCK, size)), indexing="ij"))
                up = i < j
                yield tested(start + i[up], start + j[up])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a partition, each (sid, id) once."""
    held = [b.filter(pc.is_valid(b.column("id"))) for b in batches]
    t = pa.Table.from_batches([b for b in held if b.num_rows]) if any(b.num_rows for b in held) else None
    if t is None:
        return
    t = t.group_by(["sid", "id"], use_threads=False).aggregate([("n", "min"), ("regs", "max")])
    for b in t.select(["sid", "id", "n_min", "regs_max"]).rename_columns(["sid", "id", "n", "regs"]).to_batches(20_000):
        yield b


def sketched(texts: DataFrame, bands: int = 16, rows: int = 4, threshold: float = 0.7) -> DataFrame:
    """The one pass over texts(id, text): packed bucket rows and members, dealt to tasks. candidates() of that threshold and members() read it, in one plan by one exchange."""
    if bands * rows > SENT.start:
        raise ValueError(f"bands * rows is more than {SENT.start}")
    some = spread(texts.where("id is not null and text is not null").select("id", "text"))
    n = texts.count()
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * bands * _ROW.itemsize // TASK_BYTES))
    times = frequent_words(some, n)
    hot = hot_buckets(some, n, bands, rows, threshold, times)
    return some.mapInArrow(_sketcher(bands, rows, parts, hot, threshold, times), _SKETCHED).repartitionById(parts, F.col("part"))


def candidates(sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of hashes of different word sets that may be as similar as the threshold."""
    return sketches.mapInArrow(_emit(threshold), "a long, b long").distinct()


def members(sketches: DataFrame) -> DataFrame:
    """(sid, id, n, regs): each record with at least one word with the hash and size of its set; some record of each set has registers."""
    return sketches.mapInArrow(_members, "sid long, id string, n int, regs binary")


def sets_of(who: DataFrame) -> DataFrame:
    """(sid, rep, k, n, regs, blocks): the smallest id of each set and its number of records, its size and registers, and the blocks its records are dealt to."""
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")
    sets = who.where("sid is not null").groupBy("sid").agg(F.min("id").alias("rep"), F.count("*").alias("k"), F.min("n").alias("n"), F.max("regs").alias("regs"), F.collect_set(block).alias("blocks"))
    return sets.where("rep is not null and k > 0 and n > 0 and regs is not null and size(blocks) > 0")  # always so; every use has the same filters and columns, so that one exchange serves them


def _estimated(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ra", "rb")]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            keep = np.flatnonzero(not_ruled_out(*regs, *sizes, threshold))
            yield batch.select(["a", "b", "rep_a", "rep_b"]).take(pa.array(keep))

    return run


def _jaccard_at_least(a: Column, b: Column, threshold: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= F.lit(threshold) * (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both) - F.lit(1e-9)


def similar_sets(texts: DataFrame, sketches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, rep_a, rep_b): different word sets whose Jaccard similarity is at least the threshold, verified on the words of their representatives."""
    sets = sets_of(members(sketches))
    end = lambda k: sets.select(F.col("sid").alias(k), F.col("rep").alias(f"rep_{k}"), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))
    pairs = candidates(sketches, threshold).join(end("a"), "a").join(end("b"), "b").select("a", "b", "rep_a", "rep_b", "na", "nb", "ra", "rb")
    pairs = pairs.mapInArrow(_estimated(threshold), "a long, b long, rep_a string, rep_b string")
    some = texts.where("id is not null and text is not null")
    text = lambda k: some.select(F.col("id").alias(f"rep_{k}"), F.col("text").alias(f"t{k}"))
    both = pairs.join(text("a"), "rep_a").join(text("b"), "rep_b")
    return both.where(_jaccard_at_least(words_of(F.col("ta")), words_of(F.col("tb")), threshold)).select("a", "b", "rep_a", "rep_b").distinct()


def links(texts: DataFrame, threshold: float = 0.7, bands: int = 16, rows: int = 4) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of representatives (the smallest id of records with the same words) at least as similar as the threshold."""
    texts = texts.select("id", "text")
    sets = similar_sets(texts, sketched(texts, bands, rows, threshold), threshold)
    return sets.select(F.least("rep_a", "rep_b").alias("id_a"), F.greatest("rep_a", "rep_b").alias("id_b"))


def groups(texts: DataFrame, threshold: float = 0.7, bands: int = 16, rows: int = 4) -> DataFrame:
    """(id, rep, n_copies, n_links) of every record with a word: its representative, the records with the same words, and the other sets that are similar."""
    texts = texts.select("id", "text")
    sketches = sketched(texts, bands, rows, threshold)
    who = members(sketches)
    n_links = similar_sets(texts, sketches, threshold).select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
    sets = sets_of(who).select("sid", "rep", F.col("k").alias("n_copies")).join(n_links, "sid", "left")
    return who.select("sid", "id").join(sets, "sid").select("id", "rep", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def similar_pairs(texts: DataFrame, threshold: float = 0.7, bands: int = 16, rows: int = 4) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records at least as similar as the threshold, copies included."""
    texts = texts.select("id", "text")
    sketches = sketched(texts, bands, rows, threshold)
    who = members(sketches).select("sid", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int").alias("block"), "id")
    held = sets_of(members(sketches)).select("sid", "blocks", "k")
    sets = similar_sets(texts, sketches, threshold).select("a", "b")
    # every pair of blocks of the two ends, and of each group of copies with itself
    between = sets.join(held.select(F.col("sid").alias("a"), F.col("blocks").alias("in_a")), "a").join(held.select(F.col("sid").alias("b"), F.col("blocks").alias("in_b")), "b")
    within = held.where("k > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b"), F.col("blocks").alias("in_a"), F.col("blocks").alias("in_b"))
    ends = between.select("a", "b", "in_a", "in_b", F.lit(False).alias("own")).unionByName(within.withColumn("own", F.lit(True)))
    ends = ends.select("a", "b", "own", F.explode("in_a").alias("block_a"), "in_b").select("a", "b", "own", "block_a", F.explode("in_b").alias("block_b"))
    ends = ends.where("not own or block_a <= block_b")
    ids = lambda k, name: who.select(F.col("sid").alias(k), F.col("block").alias(f"block_{k}"), F.col("id").alias(name))
    pairs = ends.join(ids("a", "x"), ["a", "block_a"]).join(ids("b", "y"), ["b", "block_b"])
    pairs = pairs.where("x <> y and (not own or block_a < block_b or x < y)")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
