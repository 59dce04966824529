"""Repeated passages by suffix arrays built with two-stage sorting.

A string of ``length`` bytes that two documents share contains an anchor: the
``GRAM`` bytes in it with the smallest hash, which both documents choose alike.
Anchors are dealt to buckets by their hash; those met in one document only are
dropped there, and the others go to the groups of texts that have them. They
travel as arrays, so no row is made for an anchor. The strings of shared anchors
are cut out in pieces and dealt to blocks of bounded size; a block's suffix array
is sorted in two stages, and equal strings are neighbours whose common prefix is
long enough. Groups larger than a block are split, and the strings that are new in
each part are compared by an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Shorter grams are fewer but more of them are shared by chance.
LENGTH, GRAM = 50, 20
#: Bytes of a text whose anchors are sought at a time, string starts in a piece,
#: bytes beyond which a group is split, and of groups that are pooled in a block.
CHUNK, PIECE, BLOCK, POOL = 1 << 18, 1 << 17, 1 << 22, 1 << 20
#: Bytes of text behind a bucket of anchors and in a group of texts, anchors that
#: are sorted at a time, and rows of one anchor among these up to which each goes
#: to its own group (a quarter of the groups, if that is more).
BUCKET, GROUP, FLUSH, FEW = 1 << 24, 1 << 23, 1 << 20, 64
#: What a row without doc_id is ordered as: behind all others.
LAST = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes at each place as a number."""
    data = np.ascontiguousarray(data)
    return np.ndarray(max(0, len(data) - 7), ">u8" if big else "<u8", data, strides=(1,)).astype(np.uint64)


def _slide(x: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """choose over each run of ``width`` values."""
    run = 1
    while 2 * run <= width:
        x, run = choose(x[:-run], x[run:]), 2 * run
    return choose(x[: -(width - run)], x[width - run :]) if run < width else x


def least_hashes(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """For each string of ``length`` bytes the smallest hash of its grams: the
    first string's place, and the hashes of a run of strings."""
    for at in range(0, len(text) - length + 1, CHUNK):
        w = _words(np.frombuffer(text, np.uint8, min(len(text) - at, CHUNK + length - 1), at))
        n = len(w) + 8 - GRAM
        h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (GRAM - 8, 0x165667B19E3779F9)):  # eight bytes at a time, the last ones from the end
            h += w[k : k + n] * np.uint64(odd)
        yield at, _slide(_mix(h), length - GRAM + 1, np.minimum)


def runs(texts: bytes, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of strings of a text that have one anchor, for joined texts: the text's
    number, where the run's strings begin and end, and the anchor."""
    breaks = np.sort(np.concatenate((offsets[:-1], offsets[1:] - length + 1)))  # strings between these are within a text or in none
    for at, least in least_hashes(texts, length):
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, at + len(least))] - at] = True
        begin = np.flatnonzero(new)
        end, anchor = np.append(begin[1:], len(least)) + at, least[begin]
        begin += at
        text = np.searchsorted(offsets, begin, side="right") - 1
        inside = begin + length <= offsets[text + 1]
        yield text[inside], begin[inside], end[inside], anchor[inside]


def anchors(text: bytes, length: int = LENGTH) -> np.ndarray:
    """The distinct smallest hashes of a text's strings."""
    found = [h for *_, h in runs(text, np.array([0, len(text)]), length)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _joined(column: pa.Array) -> Iterator[tuple[slice, bytes, np.ndarray]]:
    """Texts of a column in joined runs of some: their rows, their bytes, and where
    each begins. Long ones come alone, so a text is always chunked alike."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    stripe, long = (offsets[:-1] - offsets[0]) // (CHUNK // 2), np.diff(offsets) > CHUNK // 2
    cuts = np.flatnonzero((np.diff(stripe) > 0) | long[1:] | long[:-1]) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(long)], strict=True):
        if lo < hi:
            yield slice(lo, hi), data[offsets[lo] : offsets[hi]].to_pybytes(), offsets[lo : hi + 1] - offsets[lo]


def _scattered(h: np.ndarray) -> np.ndarray:
    """Another number for each hash: smallest hashes are small, these are anywhere."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15))


def _is_smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    decided = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
    rises = np.append(t[:-1] < t[1:], False)[decided]
    return np.repeat(rises, np.diff(decided, prepend=-1))


def _order(keys: np.ndarray) -> np.ndarray:
    """np.argsort. Keys of few bits are sorted with their places behind them, which
    is faster than sorting the places."""
    bits = np.uint64(len(keys).bit_length())
    if not len(keys) or keys.max() >> (np.uint64(64) - bits):
        return np.argsort(keys)
    placed = np.sort((keys << bits) | np.arange(len(keys), dtype=np.uint64))
    return (placed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _ranks(x: np.ndarray) -> np.ndarray:
    """The dense rank of each value."""
    order = np.argsort(x)
    ordered = x[order]
    ranks = np.empty(len(x), np.uint64)
    ranks[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return ranks


def _sorted(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the ``depth`` bytes there at least. All are
    sorted by eight bytes; only those still equal to another are by the next."""
    keys = words[places]
    order = np.argsort(keys)
    places, keys = places[order], keys[order]
    at = np.arange(len(places))
    group = np.cumsum(np.concatenate((np.zeros(min(1, len(at)), bool), keys[1:] != keys[:-1])))
    for k in range(8, depth, 8):
        # Groups are runs of ``at``; those of one suffix are in place.
        tied = np.concatenate((group[1:] == group[:-1], [False])) if len(at) else np.empty(0, bool)
        tied[1:] |= tied[:-1].copy()
        at, group = at[tied], group[tied]
        if not len(at):
            break
        mine = places[at]
        # Group and rank are below 2**32 each, since a block's bytes are.
        ranks = _ranks(words[mine + k])
        keys = group.astype(np.uint64) * (ranks.max() + np.uint64(1)) + ranks
        order = _order(keys)
        places[at], keys = mine[order], keys[order]
        group = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
    return places


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least.

    First stage: sort the suffixes that are smaller than their successors.
    Second: scan the buckets of first bytes upwards; each suffix puts the one
    before it, if that is larger, at the next free place of its bucket.
    """
    n = len(t)
    smaller = _is_smaller(t)
    padded = np.pad(t, (0, depth + 16))
    words = _words(padded, big=True)
    direct = np.flatnonzero(smaller)
    direct = _sorted(words, direct, depth)
    counts = np.bincount(t, minlength=256)
    end = np.cumsum(counts)
    start = end - counts
    sa = np.empty(n, np.int64)
    split = end - np.bincount(t[direct], minlength=256)
    by_byte = np.searchsorted(t[direct], np.arange(257))
    for c in range(256):
        sa[split[c] : end[c]] = direct[by_byte[c] : by_byte[c + 1]]
    free = start.copy()
    sa[free[t[-1]]] = n - 1
    free[t[-1]] += 1
    for c in np.flatnonzero(counts):
        wave = sa[start[c] : free[c]]
        while len(wave):  # larger suffixes that begin with the same byte again
            wave = wave[wave > 0] - 1
            wave = wave[t[wave] == c]
            sa[free[c] : free[c] + len(wave)] = wave
            free[c] += len(wave)
        before = sa[start[c] : end[c]]
        before = before[before > 0] - 1
        first = t[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            b = t[part[0]]
            sa[free[b] : free[b] + len(part)] = part
            free[b] += len(part)
    return sa


def repeats(pieces: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal strings of a block.

    Returns, for every place of the joined pieces: whether a string starts
    there, whether a piece of a smaller document has it too, whether it is the
    smallest document's; and where each piece begins.
    """
    lengths = np.array([len(p) for p in pieces])
    begin = np.cumsum(lengths) - lengths
    t = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(docs, lengths)
    inside = np.arange(len(t)) - np.repeat(begin, lengths) <= np.repeat(lengths, lengths) - length
    sa = suffix_array(t, length)
    words = _words(np.pad(t, (0, length + 16)))
    # Common prefixes of neighbours, as far as they matter; their ends tell most apart.
    same = np.zeros(len(sa) - 1, bool)
    at = np.arange(len(sa) - 1)
    ends = words[sa + (length - 8)]
    at = at[ends[1:] == ends[:-1]]
    for k in range(0, length - 8, 8):
        at = at[words[sa[at] + k] == words[sa[at + 1] + k]]
    same[at] = True
    sa_inside = inside[sa]
    group = np.concatenate(([0], np.cumsum(~same)))[sa_inside]
    order = sa[sa_inside]
    if not len(order):
        nothing = np.zeros(len(t), bool)
        return inside, nothing, nothing, begin
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    owners = owner[order]
    least = np.repeat(np.minimum.reduceat(owners, heads), np.diff(np.append(heads, len(order))))
    removed, first = np.zeros(len(t), bool), np.zeros(len(t), bool)
    removed[order] = owners > least
    first[order] = owners == least
    return inside, removed, first, begin


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and d, a number in the order of doc_id. Ids that are no whole
    numbers are numbered in ranges, each by a task of its own."""
    rows = docs.select("doc_id", "text")
    if isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        return rows.withColumn("d", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
    ids = rows.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    numbered = materialize(ids.withColumn("d", F.monotonically_increasing_id()), "ids")
    return rows.join(numbered, "doc_id", "left").withColumn("d", F.coalesce("d", F.lit(LAST)))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("d", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))


def _dealt(h: np.ndarray, d: np.ndarray, group: np.ndarray, buckets: int, few: int) -> pa.RecordBatch:
    """Anchors in the order of h, an array for each bucket. Those of more than
    ``few`` rows are for all groups (-1): their first and last document will do."""
    # By 40 bits: anchors alike in these may mix here, which the bucket's own sort undoes.
    order = _order(h >> np.uint64(24))
    h, d, group = h[order], d[order], group[order]
    heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    sizes = np.diff(np.append(heads, len(h)))
    many = sizes > few
    if many.any():
        least, most, one = np.minimum.reduceat(d, heads)[many], np.maximum.reduceat(d, heads)[many], h[heads[many]]
        few = ~np.repeat(many, sizes)
        h, d, group = (np.concatenate(x) for x in ((h[few], one, one), (d[few], least, most), (group[few], np.full(2 * len(one), -1, np.int32))))
        order = np.argsort(h)
        h, d, group = h[order], d[order], group[order]
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True))
    columns = [pa.array([x[lo:hi].tobytes() for lo, hi in spans], pa.binary()) for x in (h, d, group)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *columns], names=["bucket", "h", "d", "group"])


def _anchor_rows(docs: DataFrame, buckets: int, groups: int, length: int) -> DataFrame:
    """A row for each bucket and some anchors: arrays of anchors, their documents
    and the groups of their texts."""
    few = max(FEW, groups // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            d, key = batch.column("d").to_numpy(), batch.column("key").to_numpy()
            group = ((key ^ d) % groups).astype(np.int32)
            for rows, texts, offsets in _joined(batch.column("b")):
                for text, _, _, h in runs(texts, offsets, length):
                    found.append((_scattered(h), d[rows][text], group[rows][text]))
                    n += len(h)
                    if n >= FLUSH:
                        yield _dealt(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets, few)
                        found, n = [], 0
        if n:
            yield _dealt(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets, few)

    return _keyed(docs).where(F.length("b") >= length).mapInArrow(run, "bucket int, h binary, d binary, group binary")


def _array(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _shared(groups: int):  # noqa: ANN202
    """Of a bucket's anchors those that several documents have, for each group of
    texts with their first document, m."""

    def run(table: pa.Table) -> pa.Table:
        h, d, group = _array(table["h"], np.uint64), _array(table["d"], np.int64), _array(table["group"], np.int32)
        order = np.argsort(h)
        h, d, group = h[order], d[order], group[order]
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        least, sizes = np.minimum.reduceat(d, heads), np.diff(np.append(heads, len(h)))
        shared = least < np.maximum.reduceat(d, heads)
        everywhere = shared & (np.minimum.reduceat(group, heads) < 0)
        rows = np.repeat(shared & ~everywhere, sizes)
        # Groups and rows of a bucket are below 2**31.
        order = np.sort((group[rows].astype(np.uint64) << np.uint64(32)) | np.arange(rows.sum(), dtype=np.uint64))
        order = (order & np.uint64(2**32 - 1)).astype(np.int64)
        to_all = h[heads[everywhere]].tobytes(), least[everywhere].tobytes()
        h, m, group = h[rows][order], np.repeat(least, sizes)[rows][order], group[rows][order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
        h, m, group = h[once], m[once], group[once]
        to = np.arange(groups, dtype=np.int32) if to_all[0] else np.unique(group)
        spans = list(zip(np.searchsorted(group, to).tolist(), np.searchsorted(group, to, side="right").tolist(), strict=True))
        hs, ms = ([x[lo:hi].tobytes() + more for lo, hi in spans] for x, more in zip((h, m), to_all, strict=True))
        return pa.table({"group": to, "h": pa.array(hs, pa.binary()), "m": pa.array(ms, pa.binary())})

    return run


def _pieces(length: int):  # noqa: ANN202
    """The bytes of the strings whose anchor is shared, a piece for each run of
    strings whose anchor has the same first document, m.

    Equal strings have the same anchor, so all of them are in pieces of one m.
    """

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        h, m = _array(found["h"], np.uint64), _array(found["m"], np.int64)
        order = np.argsort(h)
        h, m = h[order], m[order]
        out: dict[str, list] = {"d": [], "key": [], "start": [], "m": []}
        pieces: list[bytes] = []
        for batch in texts.to_batches() if len(h) else []:
            d, key = batch.column("d").to_numpy(), batch.column("key").to_numpy()
            for rows, joined, offsets in _joined(batch.column("b")):
                for text, begin, end, anchor in runs(joined, offsets, length):
                    anchor = _scattered(anchor)
                    at = np.minimum(np.searchsorted(h, anchor), len(h) - 1)
                    shared = h[at] == anchor
                    text, begin, end, group = text[shared], begin[shared], end[shared], m[at[shared]]
                    if not len(text):
                        continue
                    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (begin[1:] != end[:-1]) | (group[1:] != group[:-1]))))
                    text, begin, end, group = text[first], begin[first], end[np.append(first[1:], len(end)) - 1], group[first]
                    parts = -(-(end - begin) // PIECE)
                    of = np.repeat(np.arange(len(parts)), parts)
                    begin = begin[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
                    end = np.minimum(begin + PIECE, end[of]) + length - 1
                    text = text[of]
                    for name, value in (("d", d[rows][text]), ("key", key[rows][text]), ("start", begin - offsets[text]), ("m", group[of])):
                        out[name].append(value)
                    pieces += [joined[lo:hi] for lo, hi in zip(begin.tolist(), end.tolist(), strict=True)]
        columns = {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}
        ids = [hashlib.blake2b(piece, digest_size=16).digest() for piece in pieces]
        return pa.table({**columns, "id": pa.array(ids, pa.binary()), "bytes": pa.array(pieces, pa.binary())})

    return run


def _block(length: int):  # noqa: ANN202
    """A block's removed stretches (h1 null) and, for split groups, its new strings."""

    def run(table: pa.Table) -> pa.Table:
        docs, ids, ms, hot = table["first"].to_numpy(), table["id"].to_pylist(), table["m"].to_numpy(), table["hot"].to_numpy(zero_copy_only=False)
        pieces = table["bytes"].to_pylist()
        _, removed, first, begin = repeats(pieces, docs, length)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], removed, [False])).astype(np.int8)))
        lo, hi = edges[::2], edges[1::2] + length - 1
        piece = np.searchsorted(begin, lo, side="right") - 1
        # Starts at the end of one piece never run on into the next: its last ones start no string.
        out = {"piece": piece, "lo": lo - begin[piece], "hi": hi - begin[piece], "h1": np.zeros(len(lo), np.int64), "h2": np.zeros(len(lo), np.int64), "string": np.zeros(len(lo), bool)}
        if hot.any():
            at = np.flatnonzero(first & np.repeat(hot, [len(p) for p in pieces]))
            words = _words(np.pad(np.frombuffer(b"".join(pieces), np.uint8), (0, length + 16)))
            hashes = []
            for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                h = np.full(len(at), seed, np.uint64)
                for k in [*range(0, length - 8, 8), length - 8]:
                    h = _mix((h + words[at + k]) * np.uint64(seed))
                hashes.append(h.view(np.int64))
            own = np.searchsorted(begin, at, side="right") - 1
            new = {"piece": own, "lo": at - begin[own], "hi": at - begin[own] + length, "h1": hashes[0], "h2": hashes[1], "string": np.ones(len(at), bool)}
            out = {k: np.concatenate((out[k], new[k])) for k in out}
        piece = out.pop("piece")
        return pa.table({"m": ms[piece], "id": pa.array([ids[i] for i in piece], pa.binary()), "first": docs[piece], **out})

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of rows with d and text: d, key (which name a row) and spans: the stretches (lo, hi) to remove."""
    total, unnamed = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("d") == LAST, F.lit(1)))).first()
    buckets, groups = (total or 0) // BUCKET + 1, (total or 0) // GROUP + 1
    met = _anchor_rows(docs, buckets, groups, length).groupBy("bucket").applyInArrow(_shared(groups), "group int, h binary, m binary")
    met = materialize(met, "met")
    texts = _keyed(docs).where(F.length("b") >= length).withColumn("group", F.pmod(F.col("key").bitwiseXOR(F.col("d")), F.lit(groups)).cast("int"))
    if unnamed > 1:  # Copies without id are one name, so one group: the first will do for all.
        texts = texts.where(F.col("d") < LAST).unionByName(texts.where(F.col("d") == LAST).dropDuplicates(["d", "key"]))
    pieces = texts.groupBy("group").cogroup(met.groupBy("group")).applyInArrow(_pieces(length), "d bigint, key bigint, start bigint, m bigint, id binary, bytes binary")
    pieces = materialize(pieces, "pieces")

    # Equal pieces are compared once, as their smallest document's.
    distinct = pieces.groupBy("m", "id").agg(F.min("d").alias("first"), F.first("bytes").alias("bytes"))
    distinct = materialize(distinct, "distinct")
    sizes = materialize(distinct.groupBy("m").agg(F.sum(F.length("bytes")).alias("total")), "totals")
    blocks = max(1, (sizes.agg(F.sum("total")).first()[0] or 0) // POOL)
    # Few groups are larger than a block, so the pieces themselves need no shuffle here.
    large = materialize(sizes.where(F.col("total") > BLOCK), "large")
    part: Column = F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / BLOCK) * 2)
    hot = F.col("total").isNotNull()
    block = F.when(hot, F.concat_ws("/", "m", part)).otherwise(F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("string"))
    dealt = distinct.join(large, "m", "left").select("m", "id", "first", "bytes", hot.alias("hot"), block.alias("block"))
    schema = "m bigint, id binary, first bigint, lo bigint, hi bigint, h1 bigint, h2 bigint, string boolean"
    found = materialize(dealt.groupBy("block").applyInArrow(_block(length), schema), "found")

    strings = found.where("string")
    again = materialize(strings.groupBy("h1", "h2").agg(F.min("first").alias("least"), F.max("first").alias("x")).where("least < x").drop("x"), "again")
    late = strings.join(again, ["h1", "h2"]).where("first > least")
    stretches = materialize(found.where("not string").select("m", "id", "lo", "hi").unionByName(late.select("m", "id", "lo", "hi")).groupBy("m", "id").agg(F.collect_list(F.struct("lo", "hi")).alias("s")), "stretches")

    placed = pieces.select("d", "key", "start", "m", "id", F.length("bytes").alias("n")).join(distinct.select("m", "id", "first"), ["m", "id"])
    whole = placed.where("d > first").select("d", "key", F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))).alias("s"))
    moved = F.transform("s", lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), (x["hi"] + F.col("start")).alias("hi")))
    partly = placed.where("d = first").join(stretches, ["m", "id"]).select("d", "key", moved.alias("s"))
    return materialize(whole.unionByName(partly).groupBy("d", "key").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Texts without the strings that a document of smaller doc_id has too.

    Returns one row per row of ``docs``: doc_id, n_bytes, kept (the remaining
    bytes joined) and spans (maximal removed stretches, start and end in bytes).
    A string is judged on the input, and strings never cross documents. A null
    text is empty; rows without doc_id come after all others and not before
    each other; rows of one doc_id don't remove each other's bytes; ids may be
    of any type that has an order; texts of any length are read whole; an empty
    table gives an empty result. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for b, found in zip(batch.column("b"), batch.column("spans"), strict=True):
                text, merged = b.as_py(), []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in found.as_py() or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                ends = [0, *(x for s in merged for x in s), len(text)]
                kept.append(b"".join(text[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True)))
                spans.append([{"start": a, "end": z} for a, z in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    rows = _ordered(docs)
    spans = removed_spans(rows, length)
    keyed = rows.select("doc_id", "d", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    joined = keyed.join(spans, ["d", "key"], "left").select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), "b", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``."""
    found = remove_repeats(docs, length)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
