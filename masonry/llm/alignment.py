"""Alignment of two tokenizers' tokens by the bytes they cover.

So that what repeats is aligned once, a block of texts is a list of units - stretches that begin where a run of
spaces does and tokens of both sides end - and each text a list of numbers of units. A block's end arrays are
handled whole, by sorted searches, in time in proportion to the tokens:

* groups: the intersection of both end arrays has the offsets where tokens of both end; these cut them into groups.
* links: each end of the merged arrays closes a stretch of bytes that one token of either side covers, so it is one
  overlapping pair. A group of p and q tokens has p + q - 1 links.
* texts: the groups of their units laid end to end, and sums over their units.

Counts over the corpus: each block sends its distinct pairs, sorted and packed, to buckets of B's ids, which sum them,
find the highest of each B id and send the counts back; no link becomes a row. A bucket has a row for each block, and a
B id no more pairs in a block than A has ids. There are as many buckets as shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, blocks, materialise, mix, ragged, small_batches, span_hashes, table, text_view
from .tokens import VOCABULARY, encoder, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Of the former join, which broadcast the pairs with one in HOT links; nothing is broadcast now (a test sets it).
HOT = 100_000
#: Ids of words that a worker keeps before it starts over.
CACHE_IDS = 4_000_000
#: Text bytes that make a block.
BLOCK = 2 << 20
#: Tokens of A from which on a unit is cut again where tokens of both sides end.
UNIT_TOKENS = 64
MARK = "▁"

_WORDS: dict[str, WordEncoder] = {}
_BYTES: dict[str, Spelling] = {}


class WordEncoder:
    """Encodes many texts, each with a space put before it, by encoding each distinct word once.

    No piece has a space after something else, so merges never cross the start of a run of spaces, and the ids of
    the words - runs of spaces with what follows - laid end to end are the ids of the text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id(MARK)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this vocabulary has pieces that go on after a space; texts can't be cut at spaces")
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); the texts have their first space already."""
        cut = data == 32
        cut[1:] &= data[:-1] != 32
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        own, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.flat) > CACHE_IDS:
            self.clear()
        new = np.flatnonzero(~np.isin(own, self.keys, assume_unique=True))
        if len(new):
            raw = data.tobytes()
            # the model puts a space before each word itself; a lone space would be lost
            words = [raw[starts[i] + 1 : ends[i]].decode() for i in first[new]]
            ids = [x or [self.space] for x in self.model.encode(words, num_threads=1)]
            count = np.array([len(x) for x in ids], np.int64)
            begin = len(self.flat) + np.cumsum(count) - count
            self.flat = np.concatenate((self.flat, np.array([x for some in ids for x in some], np.int32)))
            at = np.searchsorted(self.keys, own[new])
            self.keys, self.begin, self.count = (np.insert(a, at, b) for a, b in ((self.keys, own[new]), (self.begin, begin), (self.count, count)))
        at = np.searchsorted(self.keys, own)
        begin, count = self.begin[at][back], self.count[at][back]
        total = np.append(0, np.cumsum(count))
        return self.flat[np.repeat(begin, count) + ragged(count)], np.diff(total[np.searchsorted(starts, offsets)])


class Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def spells(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the bytes of their tokens, joined, are equal to."""
        run = np.append(0, np.cumsum(self.size[ids]))
        total = np.diff(run[np.append(0, np.cumsum(counts))])
        right = total == np.diff(offsets)
        own, size = ids[np.repeat(right, counts)], np.diff(offsets)[right]
        joined = self.flat[np.repeat(self.start[own], self.size[own]) + ragged(self.size[own])]
        wrong = np.flatnonzero(joined != data[np.repeat(right, np.diff(offsets))])
        right[np.flatnonzero(right)[np.searchsorted(np.cumsum(size), wrong, side="right")]] = False
        return right


def byte_level(entry: str) -> bytes:
    """The bytes of a byte-level entry: printable Latin-1 characters are their own bytes, the others were moved to 256 and up in order."""
    return bytes(_BYTE_OF.get(c, 0) for c in entry)


_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_OF = {chr(b): b for b in _OWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _OWN)}


def piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode()


def _loaded(path_a: str, path_b: str):
    a = encoder(path_a)
    if path_b not in _WORDS:
        _WORDS[path_b] = WordEncoder(path_b)
        _BYTES[path_b] = Spelling([piece_bytes(_WORDS[path_b].model, i) for i in range(_WORDS[path_b].model.get_piece_size())])
    if path_a not in _BYTES:
        _BYTES[path_a] = Spelling([byte_level(a.tokenizer.id_to_token(i) or "") for i in range(a.tokenizer.get_vocab_size())])
    return a, _BYTES[path_a], _WORDS[path_b], _BYTES[path_b]


def _sequence_hashes(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ids[start:end], all at once."""
    up, down = _powers(len(ids) + 1)
    sums = np.append(np.uint64(0), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up[: len(ids)], dtype=np.uint64))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(np.int32)))


def units(data: np.ndarray, offsets: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(units of all texts in order, how many each text has, [occurrences, then ids and ends of each side] of every unit).

    sides: ids and ends (offsets in data) of both tokenizers. Units with the same ids on both sides are one.
    """
    start = np.zeros(len(data) + 1, bool)
    start[offsets] = True
    both = start.copy()
    for k, (_, ends) in enumerate(sides):
        seen = np.zeros(len(data) + 1, bool)
        seen[ends] = True
        both = seen if k == 0 else both & seen
    spaces = data == 32
    spaces[1:] &= data[:-1] != 32
    at = np.flatnonzero(start[:-1] | (both[:-1] & spaces))
    # within stretches of many tokens, some other places where tokens of both sides end
    tokens = np.searchsorted(sides[0][1], np.append(at, len(data)), side="right")
    places = np.flatnonzero(both[:-1])
    step = np.searchsorted(sides[0][1], places, side="right") // UNIT_TOKENS
    places = places[np.append(True, step[1:] != step[:-1])] if len(places) else places
    at = np.union1d(at, places[(np.diff(tokens) > UNIT_TOKENS)[np.searchsorted(at, places, side="right") - 1]])
    bounds = [np.append(np.searchsorted(ends, at, side="right"), len(ids)) for ids, ends in sides]
    keys = np.zeros(len(at), np.uint64)
    for (ids, _), b in zip(sides, bounds, strict=True):
        keys = mix(keys + _sequence_hashes(ids, b[:-1], b[1:]))
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    for (ids, _), b in zip(sides, bounds, strict=True):
        size = np.diff(b)
        if (size != size[first][back]).any() or (ids[np.repeat(b[:-1][first][back], size) + ragged(size)] != ids).any():
            first = back = np.arange(len(at))  # two hashes were equal: every unit stands for itself
            break
    columns = [pa.array(np.bincount(back, minlength=len(first)).astype(np.int64))]
    for (ids, ends), b in zip(sides, bounds, strict=True):
        size = np.diff(b)[first]
        own = np.repeat(b[:-1][first], size) + ragged(size)
        columns += [_lists(ids[own], size), _lists(ends[own] - np.repeat(at[first], size), size)]
    return back, np.diff(np.searchsorted(at, offsets)), columns


TOKENS = """docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, words: array<int>>>,
    units array<struct<n: bigint, a_ids: array<int>, a_ends: array<int>, b_ids: array<int>, b_ends: array<int>>>"""


def tokenised(docs: DataFrame, path_a: str, path_b: str, then=lambda block: block, schema: str = TOKENS) -> DataFrame:
    """What then gives, in that schema, of a row for each block of texts: its docs (words: numbers of units; none where the bytes don't agree) and its units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, spell_a, b, spell_b = _loaded(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")))
            data, offsets = text_view(texts)
            for i, j in blocks(offsets, BLOCK):
                own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                encoded = [(*x.encode(own, ends), spelling) for x, spelling in ((a, spell_a), (b, spell_b))]
                good = np.diff(ends) > 0
                for ids, counts, spelling in encoded:
                    good &= spelling.spells(ids, counts, own, ends)
                length = np.where(good, np.diff(ends), 0)
                sides = [ids[np.repeat(good, counts)].astype(np.int64) for ids, counts, _ in encoded]
                sides = [(ids, np.cumsum(spelling.size[ids])) for ids, (_, _, spelling) in zip(sides, encoded, strict=True)]
                words, n, columns = units(own[np.repeat(good, np.diff(ends))], np.append(0, np.cumsum(length)), sides)
                n_a, n_b = (pa.array(np.where(good, counts, 0).astype(np.int64)) for _, counts, _ in encoded)
                texts_in = pa.StructArray.from_arrays([batch.column(0).slice(i, j - i), n_a, n_b, _lists(words, n)], ["doc_id", "n_a", "n_b", "words"])
                units_in = pa.StructArray.from_arrays(columns, ["n", "a_ids", "a_ends", "b_ids", "b_ends"])
                yield then(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (texts_in, units_in)], ["docs", "units"]))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed: small ones take one or two bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _columns(rows: pa.Array, *names: str) -> list[pa.Array]:
    """Fields of the structs in a column of lists of structs."""
    flat = rows.flatten()
    return [pc.struct_field(flat, n) for n in names]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, number of values of each)."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


_DIGITS = Spelling([str(i).encode() for i in range(1 << 16)])


def _group_texts(sides: list[tuple[np.ndarray, np.ndarray]], cuts: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Groups of each unit (which ends at a cut in last) as text, each followed by a semicolon."""
    (a, b), (ga, gb) = [ids for ids, _ in sides], [np.searchsorted(cuts, ends) for _, ends in sides]
    ids, sign = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    for own, other, side, mark in ((ga, gb, "left", "|"), (gb, ga, "right", ";")):
        at = np.arange(len(own)) + np.searchsorted(other, own, side=side)
        ids[at] = a if own is ga else b
        sign[at] = np.where(np.append(own[1:] != own[:-1], True), ord(mark), ord(","))
    size = _DIGITS.size[ids] + 1
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    signs = np.zeros(len(out), bool)
    signs[ends - 1] = True
    out[signs] = sign
    out[~signs] = _DIGITS.flat[np.repeat(_DIGITS.start[ids], size - 1) + ragged(size - 1)]
    tokens = np.searchsorted(ga, np.searchsorted(cuts, last), side="right") + np.searchsorted(gb, np.searchsorted(cuts, last), side="right")
    stop = ends[tokens - 1].tolist()
    raw = out.tobytes()
    return [raw[i:j] for i, j in zip([0, *stop], stop, strict=False)]


def _aligned(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    docs, units_in = (batch.column(k) for k in (0, 1))
    doc_id, n_a, n_b, words = _columns(docs, "doc_id", "n_a", "n_b", "words")
    n, *lists = _columns(units_in, "n", "a_ids", "a_ends", "b_ids", "b_ends")
    n, ((a, na), (a_ends, _), (b, nb), (b_ends, _)) = n.to_numpy(), map(_flat, lists)
    size = a_ends[np.cumsum(na) - 1].astype(np.int64) if len(n) else np.zeros(0, np.int64)
    last = np.cumsum(size)
    a_ends, b_ends = (e + np.repeat(last - size, k) for e, k in ((a_ends, na), (b_ends, nb)))
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    # each end closes a stretch of bytes that one token of either side covers
    ends = np.union1d(a_ends, b_ends)
    pair = b[np.searchsorted(b_ends, ends)].astype(np.int64) << 32 | a[np.searchsorted(a_ends, ends)]
    unit = np.searchsorted(last, ends)
    own, back = np.unique(pair, return_inverse=True)
    times = np.bincount(back, n[unit], len(own)).astype(np.int64)
    bucket = (mix((own >> 32).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    split = np.searchsorted(bucket[order], np.arange(1, buckets))
    asked = [(k, _pack(np.diff(x, prepend=0)), _pack(y)) for k, (x, y) in enumerate(zip(np.split(own[order], split), np.split(times[order], split), strict=True)) if len(x)]
    groups = np.diff(np.append(0, np.searchsorted(cuts, last, side="right")))
    texts, (flat, count) = _group_texts([(a, a_ends), (b, b_ends)], cuts, last), _flat(words)
    stop = np.cumsum(count)
    sums = np.append(0, np.cumsum(groups[flat]))
    flat = flat.tolist()
    text = [b"".join([texts[w] for w in flat[i:j]])[:-1].decode() for i, j in zip((stop - count).tolist(), stop.tolist(), strict=True)]
    out = pa.StructArray.from_arrays([doc_id, n_a, n_b, pa.array(sums[stop] - sums[stop - count]), pa.array(text, pa.string()), words], ["doc_id", "n_a", "n_b", "n_groups", "groups", "words"])
    links = pa.StructArray.from_arrays([pa.array(n), _lists(place[back], np.bincount(unit, minlength=len(n)))], ["n", "links"])
    asks = pa.StructArray.from_arrays([pa.array([x[k] for x in asked], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "pairs", "times"])
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (out, links, asks)]
    return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(one, ["docs", "units", "asks"])], ["found"])


ALIGNED = """found struct<docs: array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, groups: string, words: array<int>>>,
    units: array<struct<n: bigint, links: array<int>>>, asks: array<struct<bucket: int, pairs: binary, times: binary>>>"""


PACKED = """docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, groups: string, n_words: bigint>>,
    words binary, links binary, sizes binary, asks array<struct<bucket: int, pairs: binary, times: binary>>"""


def _packed(aligned_block: pa.RecordBatch) -> pa.RecordBatch:
    """The same with all words in one column, all links, and the number of links of each unit."""
    docs, units_in, asks = (pc.struct_field(aligned_block.column(0), n) for n in ("docs", "units", "asks"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups"]
    *columns, words = _columns(docs, *names, "words")
    (words, n_words), (links, sizes) = _flat(words), _flat(*_columns(units_in, "links"))
    counted = pa.StructArray.from_arrays([*columns, pa.array(n_words)], [*names, "n_words"])
    blobs = [pa.array([_pack(x)], pa.binary()) for x in (words, links, sizes)]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(counted)], pa.int32()), counted), *blobs, asks], ["docs", "words", "links", "sizes", "asks"])


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aligned(tokens: DataFrame) -> DataFrame:
    """Rows of blocks with found: docs (doc_id, n_a, n_b, n_groups, groups, words), units (n, links: places of its overlapping pairs among
    those of the block) and asks (distinct pairs of the block and how often each occurs, packed, by buckets of B's ids)."""
    buckets = _buckets(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _aligned(batch.slice(k, 1), buckets)

    return tokens.mapInArrow(run, ALIGNED)


def _counted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Of a bucket's pairs: what each block asked for, as counts over the corpus times two, and one more where the count is the highest of its B id."""
    asked = [np.cumsum(_unpack(x.as_py())) for x in rows["pairs"]]
    own, back = np.unique(np.concatenate(asked), return_inverse=True)
    count = np.bincount(back, np.concatenate([_unpack(x.as_py()) for x in rows["times"]])).astype(np.int64)
    heads = np.flatnonzero(np.append(True, np.diff(own >> 32) != 0))
    top = np.repeat(np.maximum.reduceat(count, heads), np.diff(np.append(heads, len(own))))
    told = np.split((2 * count + (count == top))[back], np.cumsum([len(x) for x in asked])[:-1])
    return pa.table({"block": rows["block"], "bucket": rows["bucket"], "told": pa.array([_pack(x) for x in told], pa.binary())})


def _summed(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
    """The rows of a block's docs with the sums over their units."""
    values = np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_py()) for x in told.sort_by("bucket")["told"])])
    doc_id, n_a, n_b, n_groups, groups, n_words = _columns(rows["docs"].combine_chunks(), "doc_id", "n_a", "n_b", "n_groups", "groups", "n_words")
    words, links, sizes = (_unpack(rows[c][0].as_py()) for c in ("words", "links", "sizes"))
    sums = []
    for each in (values & 1, values >> 1):
        for flat, count in ((links, sizes), (words, n_words.to_numpy())):
            run, stop = np.append(0, np.cumsum(each[flat])), np.cumsum(count)
            each = run[stop] - run[stop - count]
        sums.append(pa.array(each.astype(np.int64)))
    n_links = pc.subtract(pc.add(n_a, n_b), n_groups)
    return pa.table([doc_id, n_a, n_b, n_groups, n_links, *sums, groups], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text).

    Null and empty texts, and texts that the bytes of one tokenizer's tokens don't spell (those with U+2581, which
    B takes for a space), have no tokens: zeros and an empty groups_sha256. Each row counts, repeated ones and
    those with a null doc_id too. Other columns are ignored. The groups themselves: see aligned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = _buckets(spark)
    blocks_of = tokenised(docs, path_a or vocabulary_path(VOCABULARY), path_b or vocabulary_path(PIECES), lambda block: _packed(_aligned(block, buckets)), PACKED)
    digested = F.transform("docs", lambda d: d.withField("groups", F.when(d["n_a"] == 0, "").otherwise(F.sha2(d["groups"], 256))))
    rows = materialise(blocks_of.select(F.monotonically_increasing_id().alias("block"), digested.alias("docs"), "words", "links", "sizes", "asks"), "aligned")
    asks = rows.select("block", F.explode("asks").alias("a")).select("block", "a.*")
    told = asks.groupBy("bucket").applyInArrow(_counted, "block long, bucket int, told binary")
    met = rows.drop("asks").groupBy("block").cogroup(told.groupBy("block"))
    return met.applyInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of both tokenizers over every row of `documents`; see align."""
    return align(table(spark, sf_dir, "documents"))
