"""Suffix-array deduplication by threshold-bounded interval expansion.

Which LENGTH-byte strings of a document also start in a document with a smaller id? Strings that are
equal have equal minimisers (the least hash of their K-byte substrings), so the work is dealt out by
minimiser: first the minimisers that occur in two or more documents are found from hashes alone, then
only the stretches of text around those go to buckets. In a bucket the distinct stretches are laid end
to end, ordered as a suffix array to LENGTH symbols, and the boundaries between suffixes that share
fewer than LENGTH symbols are derived on the Burrows-Wheeler transform: starting from single symbols,
intervals are extended backwards breadth first, so common-prefix lengths appear in increasing order, an
interval whose right boundary is known is dropped, and the search stops at LENGTH. What lies between
two boundaries is one repeated string.

Documents equal as a whole are settled before: every string of a copy also starts in the first of them.

Buckets are read as streams. Of minimisers a bucket keeps one document each; of equal stretches it keeps
the one of the least document, since what the others lose is known at once. A bucket whose distinct
stretches outgrow MOST_HELD (a passage with very many different surroundings) hands its stretches on
window by window, and those are grouped by a 128-bit hash of the window, summed before the shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, as_text, blocks, discard, materialise, mix, ragged, small_batches, span_hashes, table, text_view, with_group

LENGTH, K = 50, 16
#: Text bytes whose minimisers go to one bucket of hashes, and bytes of stretches in one bucket of text.
HASH_BUCKET, TEXT_BUCKET = 16 << 20, 3 << 20
#: Bytes of stretches that a bucket takes in before it drops the repeated ones, and of distinct ones that it orders at once.
TAKEN, MOST_HELD = 12 << 20, 24 << 20
#: Entries of a bucket of hashes that are looked at together.
ENTRIES = 2_000_000
_KEEP = (1 << 40) - 1


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, text number, first window, number of windows) of every run of windows with one minimiser.

    A window is a `length`-byte substring that lies in one text; each belongs to exactly one run.
    """
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    padded = np.concatenate((data, np.zeros(k + 8, np.uint8)))
    at = lambda i, m: np.ndarray((m,), "<u8", padded, i, (1,))
    m = len(data) - k + 1
    least = mix(at(0, m) * np.uint64(0x9E3779B97F4A7C15) + (at(k - 8, m) ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F))
    width, have = length - k + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    size = np.diff(offsets)
    windows = np.maximum(0, size - length + 1)
    inside = np.repeat(offsets[:-1], windows) + ragged(windows)
    owner = np.repeat(np.arange(len(size)), windows)
    value = least[inside]
    if not len(value):
        return none.astype(np.uint64), none, none, none
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return value[first], owner[first], inside[first] - offsets[owner[first]], np.diff(np.append(first, len(value)))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `symbols` (0 to 256) in the order of their first `depth` symbols at least."""
    n = len(symbols)
    wide = np.concatenate((symbols, np.zeros(7, symbols.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | wide[j : j + n]
    order = np.argsort(key)
    own = key[order]
    head = np.ones(n, bool)
    head[1:] = own[1:] != own[:-1]
    at, have = np.arange(n), 7  # places whose order isn't known yet, and symbols that they are ordered by
    rank = np.empty(n, np.uint64)  # the place of the first suffix that is equal so far
    while True:
        rank[order[at]] = np.maximum.accumulate(np.where(head, at, 0))
        at = at[~(head & np.append(head[1:], True))]
        if have >= depth or not len(at):
            return order
        these = order[at]
        key = rank[these] << np.uint64(32)
        longer = these + have < n
        key[longer] |= rank[these[longer] + have] + np.uint64(1)
        by = np.argsort(key)
        own = key[by]
        order[at] = these[by]
        head = np.ones(len(at), bool)
        head[1:] = own[1:] != own[:-1]
        have *= 2


def boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix order: whether fewer than `length` symbols are shared with the place before.

    Symbol 0 separates: strings that hold it are not followed, and boundaries among them may be missing.
    """
    n = len(symbols)
    bwt = symbols[order - 1]
    bwt[order == 0] = 0
    by_symbol = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)  # the place that extends this place's suffix by one symbol to the left
    forward[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    ends = np.cumsum(np.bincount(symbols, minlength=257))
    known[0] = known[ends] = True
    left, right = np.concatenate(([0], ends[:-1]))[1:], ends[1:]
    left, right = left[right > left], right[right > left]
    for _ in range(2, length + 1):
        if not len(left):
            break
        sizes = right - left
        at = np.repeat(left, sizes) + ragged(sizes)
        solid = bwt[at] > 0
        lasts = at[solid & (following[at] >= np.repeat(right, sizes))]
        firsts = at[solid & (preceding[at] < np.repeat(left, sizes))]
        right, left = np.sort(forward[lasts]) + 1, np.sort(forward[firsts])
        fresh = ~known[right]
        known[right] = True
        left, right = left[fresh], right[fresh]
    return known[:n]


def first_documents(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of `text` (stretches [start, end) laid end to end, stretch i first seen in docs[i]): the least document in which its `length`-byte string starts, or the greatest int64 where none does."""
    sizes = ends - starts
    top = np.iinfo(np.int64).max
    symbols = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
    place = np.cumsum(sizes + 1) - (sizes + 1)
    into = np.repeat(place, sizes) + ragged(sizes)
    symbols[into] = text[np.repeat(starts, sizes) + ragged(sizes)].astype(np.uint16) + 1
    order = suffix_order(symbols, length)
    cut = boundaries(symbols, order, length)
    whole = np.full(len(symbols), top, np.int64)
    full = np.maximum(0, sizes - length + 1)
    whole[np.repeat(place, full) + ragged(full)] = np.repeat(docs, full)
    groups = np.flatnonzero(cut)
    least = np.minimum.reduceat(whole[order], groups)
    found = np.empty(len(symbols), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(groups, len(symbols))))
    found[whole == top] = top
    out = np.full(len(text), top, np.int64)
    out[np.repeat(starts, sizes) + ragged(sizes)] = found[into]
    return out


def _composite(value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, what is kept of the minimiser in it)."""
    value = mix(value + np.uint64(0x5851F42D4C957F2D))
    return (value % np.uint64(n)).astype(np.int64), (value // np.uint64(n)) & np.uint64(_KEEP)


def _hash_rows(n: int):
    """Per block of text and bucket: the distinct minimisers of each document, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(2))
            doc, tag = (batch.column(k).to_numpy() for k in (0, 1))
            rows: tuple = ([], [], [], [], [], [])
            for i, j in blocks(offsets, 4 << 20):
                value, owner, _, _ = stretches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bucket, kept = _composite(value, n)
                # in the order of bucket, text and what is kept: texts of a block have numbers below 2^24, buckets are sorted by their digits
                order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | kept)
                order = order[np.argsort(bucket[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
                bucket, owner, kept = bucket[order], owner[order], kept[order]
                new = np.ones(len(kept), bool)
                new[1:] = (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
                bucket, owner, kept = bucket[new], owner[new], kept[new]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
                for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
                    own = owner[a:b]
                    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    packed = (int(bucket[a]), doc[i + own[heads]].tobytes(), tag[i + own[heads]].tobytes(), np.diff(np.append(heads, b - a)).astype("<u4").tobytes(), kept[a:b].astype("<u4").tobytes(), (kept[a:b] >> np.uint64(32)).astype(np.uint8).tobytes())
                    for column, x in zip(rows, packed, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["bucket", "docs", "tags", "counts", "low", "high"])

    return run


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _taken(batches: Iterator[pa.RecordBatch], sized: str, most: int) -> Iterator[pa.Table]:
    """The batches united to tables in which the binary column `sized` has about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(sized)))).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _shared_keys(n: int):
    """doc_id, tag, key for each minimiser of each document that another document has too. Holds a document for each distinct minimiser, not the rows."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, first, told = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, bool)
        for rows in _taken(batches, "low", 4 * ENTRIES):
            counts = _joined(rows["counts"], "<u4")
            owner = np.stack((np.repeat(_joined(rows["docs"], "<i8"), counts), np.repeat(_joined(rows["tags"], "<i8"), counts)), 1)
            kept = _joined(rows["low"], "<u4").astype(np.uint64) | (_joined(rows["high"], np.uint8).astype(np.uint64) << np.uint64(32))
            at = np.minimum(np.searchsorted(seen, kept), max(0, len(seen) - 1))
            known = seen[at] == kept if len(seen) else np.zeros(len(kept), bool)
            order = np.argsort(kept, kind="stable")
            own = kept[order]
            again = np.zeros(len(own), bool)
            again[1:] = own[1:] == own[:-1]
            head = ~again
            again[:-1] |= again[1:].copy()
            shared = again | known[order]
            out = [(owner[order[shared]], own[shared])]
            met = np.unique(at[known]) if len(seen) else np.zeros(0, np.int64)
            late = met[~told[met]]  # minimisers whose first document wasn't given yet
            out.append((first[late], seen[late]))
            if len(told):
                told[met] = True
            new = order[head & ~known[order]]
            seen, first, told = np.concatenate((seen, kept[new])), np.concatenate((first, owner[new])), np.concatenate((told, again[head & ~known[order]]))
            by = np.argsort(seen, kind="stable")
            seen, first, told = seen[by], first[by], told[by]
            docs, values = (np.concatenate(x) for x in zip(*out, strict=True))
            values = (values * np.uint64(n) + np.uint64(key[0].as_py())).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0].copy()), pa.array(docs[:, 1].copy()), pa.array(values)], ["doc_id", "tag", "key"])

    return run


def _text_rows(n: int, m: int):
    """Per block of text and bucket: the stretches around shared minimisers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(_unzipped(batch.column(2)))
            doc, tag = (batch.column(k).to_numpy() for k in (0, 1))
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            rows: tuple = ([], [], [], [], [], [])
            for i, j in blocks(offsets, 4 << 20):
                part = data[offsets[i] : offsets[j]]
                value, owner, start, windows = stretches(part, offsets[i : j + 1] - offsets[i])
                bucket, kept = _composite(value, n)
                whole = kept * np.uint64(n) + bucket.astype(np.uint64)
                shared = np.zeros(len(value), bool)
                heads = np.searchsorted(owner, np.arange(j - i + 1))
                for k in range(j - i):
                    shared[heads[k] : heads[k + 1]] = np.isin(whole[heads[k] : heads[k + 1]], flat[ends[i + k] : ends[i + k + 1]])
                at = np.flatnonzero(shared)
                into = (mix(whole[at]) % np.uint64(m)).astype(np.int64)
                at = at[np.argsort(into, kind="stable")]
                into = np.sort(into, kind="stable")
                cuts = np.flatnonzero(np.append(True, into[1:] != into[:-1])) if len(into) else np.zeros(0, np.int64)
                for a, b in zip(cuts, np.append(cuts[1:], len(into)), strict=True):
                    own = at[a:b]
                    size = windows[own] + LENGTH - 1
                    text = part[np.repeat(offsets[i + owner[own]] - offsets[i] + start[own], size) + ragged(size)]
                    for column, x in zip(rows, (int(into[a]), doc[i + owner[own]].tobytes(), tag[i + owner[own]].tobytes(), start[own].astype("<i8").tobytes(), windows[own].astype("<u4").tobytes(), text.tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["bucket", "docs", "tags", "starts", "windows", "text"])

    return run


class _Stretches:
    """Stretches laid end to end: document, tag, first window, number of windows, and the bytes."""

    def __init__(self, docs, tags, first, windows, text):
        self.docs, self.tags, self.first, self.windows, self.text = docs, tags, first, windows, text
        self.size = windows + LENGTH - 1
        self.starts = np.cumsum(self.size) - self.size

    @classmethod
    def of(cls, rows: pa.Table) -> _Stretches:
        return cls(*(_joined(rows[c], "<i8") for c in ("docs", "tags", "starts")), _joined(rows["windows"], "<u4").astype(np.int64), _joined(rows["text"], np.uint8))

    def and_(self, other: _Stretches) -> _Stretches:
        return _Stretches(*(np.concatenate((getattr(self, x), getattr(other, x))) for x in ("docs", "tags", "first", "windows", "text")))

    def at(self, which: np.ndarray) -> _Stretches:
        text = self.text[np.repeat(self.starts[which], self.size[which]) + ragged(self.size[which])]
        return _Stretches(self.docs[which], self.tags[which], self.first[which], self.windows[which], text)


FOUND = "doc_id long, tag long, runs array<long>, starts array<long>, h1 array<long>, h2 array<long>"


def _lists(docs: np.ndarray, tags: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """A row of FOUND for each document with its values; lists that aren't given are null."""
    order = np.lexsort((tags, docs))
    docs, tags = docs[order], tags[order]
    heads = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]))) if len(docs) else np.zeros(0, np.int64)
    none = pa.nulls(len(heads), pa.list_(pa.int64()))
    lists = {}
    for name, x in values.items():
        x = x[order]
        ends = np.append(heads, len(docs)) * (x.shape[1] if x.ndim > 1 else 1)
        lists[name] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(docs[heads]), pa.array(tags[heads]), *(lists.get(c, none) for c in ("runs", "starts", "h1", "h2"))], ["doc_id", "tag", "runs", "starts", "h1", "h2"])


def _runs(held: _Stretches, one: np.ndarray, group: np.ndarray, earliest: np.ndarray) -> pa.RecordBatch:
    """Runs of windows whose string starts in an earlier document's. one: a stretch of each distinct one; group: which of these each is; earliest: the least document of each."""
    later = held.docs > earliest[group]
    mine = np.flatnonzero(~later)
    least = first_documents(held.text, held.starts[one], held.starts[one] + held.size[one], earliest)
    at = np.repeat(held.starts[one[group[mine]]], held.windows[mine]) + ragged(held.windows[mine])
    owner = np.repeat(mine, held.windows[mine])
    hit = least[at] < held.docs[owner]
    place = held.first[owner] + ragged(held.windows[mine])
    edge = np.ones(len(hit), bool)
    edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(edge)
    tails = np.append(heads[1:], len(hit))
    good = hit[heads]
    heads, tails = heads[good], tails[good]
    which = np.concatenate((np.flatnonzero(later), owner[heads]))
    first = np.concatenate((held.first[later], place[heads]))
    end = np.concatenate((held.first[later] + held.windows[later], place[heads] + (tails - heads)))
    return _lists(held.docs[which], held.tags[which], runs=np.stack((first, end), 1))


def _handed_on(held: _Stretches) -> pa.RecordBatch:
    """The windows of these stretches: where they start and a 128-bit hash of each."""
    mine = np.repeat(np.arange(len(held.docs)), held.windows)
    at = held.starts[mine] + ragged(held.windows)
    h1 = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 1 << 16):
        low, high = int(at[i]), int(at[min(len(at), i + (1 << 16)) - 1]) + LENGTH
        own = at[i : i + (1 << 16)] - low
        h1[i : i + (1 << 16)] = span_hashes(held.text[low:high], own, own + LENGTH)
    # the second hash is of the string backwards, so it doesn't follow from the first
    back, h2 = held.text[::-1], np.empty(len(at), np.uint64)
    behind = len(held.text) - at - LENGTH
    for i in range(0, len(at), 1 << 16):
        own = behind[i : i + (1 << 16)]
        low, high = int(own.min()), int(own.max()) + LENGTH
        h2[i : i + (1 << 16)] = span_hashes(back[low:high], own - low, own - low + LENGTH)
    return _lists(held.docs[mine], held.tags[mine], starts=held.first[mine] + ragged(held.windows), h1=h1.view(np.int64), h2=h2.view(np.int64))


def _repeated(taken: int, most_held: int):
    """Rows of FOUND of a bucket: runs [first, end) of windows whose string starts in an earlier document, flattened, or windows to be grouped elsewhere."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, False
        chunks = _taken(batches, "text", taken)
        rows = next(chunks, None)
        while rows is not None:
            more, rows = _Stretches.of(rows), next(chunks, None)
            held = held.and_(more) if held else more
            _, one, group = np.unique(_hashes(held.text, held.starts, held.starts + held.size), return_index=True, return_inverse=True)
            earliest = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(earliest, group, held.docs)
            size = int(held.size[one].sum())
            if rows is None and not large and size <= most_held:
                yield _runs(held, one, group, earliest)
                return
            later = np.flatnonzero(held.docs > earliest[group])
            yield _lists(held.docs[later], held.tags[later], runs=np.stack((held.first[later], held.first[later] + held.windows[later]), 1))
            # other stretches of the same least document stay: what they lose depends on the rest
            held = held.at(np.flatnonzero(held.docs == earliest[group]))
            if size > most_held or rows is None:
                large = True
                yield _handed_on(held)
                held = None

    return run


def _hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches laid end to end, in blocks that keep the sums short."""
    out, edges = np.empty(len(starts), np.uint64), np.append(starts, len(text))
    for i, j in blocks(edges):
        out[i:j] = span_hashes(text[edges[i] : edges[j]], starts[i:j] - edges[i], ends[i:j] - edges[i])
    return out


def _unzipped(column: pa.Array) -> pa.Array:
    import zstandard

    opener = zstandard.ZstdDecompressor()
    return pa.array([opener.decompress(z.as_buffer()) for z in column], pa.binary())


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([packer.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "tag", "z"])


RESULT = "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the windows of each text into removed spans of bytes."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for batch in batches:
        data, offsets = text_view(_unzipped(batch.column(2)))
        out = []
        for i, (doc, tag, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            pairs = np.array(runs.values.to_numpy()).reshape(-1, 2) if runs.is_valid else np.zeros((0, 2), np.int64)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            reach = np.maximum.accumulate(pairs[:, 1] - 1 + LENGTH) if len(pairs) else np.zeros(0, np.int64)
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:, 0] > reach[:-1]
            a, b = pairs[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)] if len(pairs) else reach
            keep = np.ones(len(own), bool)
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                keep[s:e] = False
            out.append((doc, tag, int(len(own) - keep.sum()), len(a), hashlib.sha256(own[keep].tobytes()).hexdigest(), [{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "tag", "n_removed", "n_spans", "kept_sha256", "spans"])


def _grouped(found: DataFrame) -> DataFrame:
    """doc_id, tag, runs from windows that were handed on: those whose hash a smaller doc_id has too."""
    use = F.explode(F.arrays_zip("starts", "h1", "h2")).alias("use")
    windows = found.filter("starts is not null").select("doc_id", "tag", use).select("doc_id", "tag", F.col("use.starts").alias("start"), "use.h1", "use.h2")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    later = windows.join(least, ["h1", "h2"]).filter("doc_id > first")
    return later.select("doc_id", "tag", F.array("start", F.col("start") + 1).alias("runs"))


def remove_repeats(docs: DataFrame, hash_bucket: int = HASH_BUCKET, text_bucket: int = TEXT_BUCKET, taken: int = TAKEN, most_held: int = MOST_HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes, [start, end)) of every row of docs (doc_id, text).

    Bytes covered by a LENGTH-byte string that also starts in a document with a smaller doc_id are
    removed, as judged on the input. Null text counts as empty; texts shorter than LENGTH lose nothing.
    There is one row for each input row: rows that repeat a doc_id are judged each by itself, against
    smaller ids only. Rows with a null doc_id lose nothing and count for no other. Other columns are ignored.

    Sizes: bytes for a bucket of hashes and of text; bytes a bucket of text reads before it drops what
    repeats, and distinct bytes from which it hands its windows on. None of them changes the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text").cast("string")).alias("text")).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    summary = materialise(docs.select("doc_id", F.xxhash64("text").alias("tag"), F.octet_length("text").cast("long").alias("n_bytes"), "hash"), "summary")
    total, n_rows = summary.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    n = max(1, math.ceil((total or 0) / hash_bucket))
    first = summary.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null")
    first = materialise(first, "copies")
    # copies of a text that very many rows have are left out at once; of others they are found below
    hot = F.broadcast(first.filter(F.col("c") * HOT >= n_rows).select("hash", "first"))
    texts = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).join(hot, "hash", "left").filter("first is null or doc_id = first").select("doc_id", F.xxhash64("text").alias("tag"), "text")
    packed = texts.mapInArrow(_hash_rows(n), "bucket int, docs binary, tags binary, counts binary, low binary, high binary")
    keys = packed.groupBy("bucket").applyInArrow(_shared_keys(n), "doc_id long, tag long, key long")
    known = with_group(summary, first, ["hash"], n_rows)
    whole_first = known.filter((F.col("n_bytes") >= LENGTH) & (F.col("first").isNull() | (F.col("doc_id") == F.col("first")))).select("doc_id", "tag")
    by_doc = keys.groupBy("doc_id", "tag").agg(F.collect_list("key").alias("keys")).join(whole_first, ["doc_id", "tag"], "left_semi")
    zipped = texts.mapInArrow(_zipped, "doc_id long, tag long, z binary")
    by_doc = materialise(by_doc, "keys")
    held = materialise(zipped.join(by_doc.hint("shuffle_hash"), ["doc_id", "tag"]), "held")
    discard(by_doc)
    bulk = 2.5 * (held.agg(F.sum(F.octet_length("z"))).first()[0] or 0)
    m = max(1, math.ceil(4 * bulk / text_bucket))
    pieces = held.mapInArrow(_text_rows(n, m), "bucket int, docs binary, tags binary, starts binary, windows binary, text binary")
    found = materialise(pieces.groupBy("bucket").applyInArrow(_repeated(taken, most_held), FOUND), "found")
    runs = found.filter("runs is not null").select("doc_id", "tag", "runs")
    if found.filter("starts is not null").limit(1).count():
        runs = runs.unionByName(_grouped(found))
    by_doc = runs.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    cut = held.select("doc_id", "tag", "z").join(by_doc, ["doc_id", "tag"]).mapInArrow(_cut, RESULT).dropDuplicates(["doc_id", "tag"])
    copy = (F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    all_rows = known.join(cut, ["doc_id", "tag"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return all_rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "hash")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)"))).alias("spans"),
    )


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `documents`; see remove_repeats."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
