"""Token ids in a content-addressed store.

Texts are encoded by a public byte-level BPE tokenizer. A rolling hash over a window of ids cuts each
id stream into chunks at places that depend on content alone, so shared passages give shared chunks. A
chunk is stored once under the SHA-256 of its bytes; a document is a recipe of chunk keys with a Merkle
root over them. Reading checks every chunk against its key and every recipe against its root.

Store layout (Parquet below one folder):

* ``chunks``: key, ids - a row for each distinct chunk; ids are little-endian, two bytes where the
  vocabulary allows it, else four.
* ``recipes``: doc_id ascending, start, n_tokens, keys, ends, root - a row for each document.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, blocks, materialise, mix, ragged, small_batches, span_hashes, table, text_view, with_group, work_dir

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Chunk lengths in ids: least, mean beyond the least (a power of two), most. Window of the rolling hash.
CHUNK_MIN, CHUNK_MEAN, CHUNK_MAX, ROLL = 128, 512, 4096, 16
#: Text bytes that are encoded at a time.
BLOCK = 2 << 20
#: Ids of pieces that a worker keeps before it starts over.
CACHE_IDS = 12_000_000

_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = ~_LETTER[33:127]


class PieceEncoder:
    """Encodes many texts by encoding each distinct piece once.

    Byte-level BPE never merges across the start of a white-space run, so a text may be cut before any
    single space or line feed that stands between two solid characters; nor does it merge a letter with
    what is no letter, so a text may also be cut between an ASCII letter and an ASCII digit or mark. The
    ids of the pieces, laid end to end, are the ids of the text. Texts with white space outside ASCII
    are encoded whole. With `added` the content of an added token (such as an end-of-text marker) in a text
    gives that token, as the library has it by default, and texts that contain one are encoded whole too;
    without, it is text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.newline = self._ids(["\n"])[0][0]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Adds the ids of new pieces; pieces without inner white space go through the tokenizer joined by line feeds, which stay apart."""
        texts = [p.decode() for p in pieces]
        plain = np.array([self._plain(t) and not any(x in t for x in self.added) for t in texts], bool)
        begin, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, have = [self.flat], len(self.flat)
        one, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        for at in range(0, len(one), 4096):
            part = one[at : at + 4096]
            ids = np.array(self._ids(["\n".join([texts[i] for i in part])])[0], np.uint32)
            cuts = np.flatnonzero(ids == self.newline)
            begin[part] = have + np.append(0, cuts + 1)
            count[part] = np.append(cuts, len(ids)) - np.append(0, cuts + 1)
            parts.append(ids)
            have += len(ids)
        for i, ids in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            begin[i], count[i] = have, len(ids)
            parts.append(np.array(ids, np.uint32))
            have += len(ids)
        self.flat = np.concatenate(parts)
        at = np.searchsorted(self.keys, keys)  # both are in order
        self.keys, self.begin, self.count = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.begin, begin), (self.count, count)))

    @staticmethod
    def _plain(piece: str) -> bool:
        """One word of at most 256 characters with at most a space before it."""
        word = piece.removeprefix(" ")
        return len(piece) <= 256 and word.split() == [word]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        solid = ~SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & solid[:-2] & solid[2:]
        cut[offsets[1:-1][offsets[1:-1] < len(data)]] = False  # a space that begins a text is no cut by this rule
        last = offsets[1:] - 1
        cut[last[last >= 0]] = False
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        odd = np.concatenate((self._odd(data), self._marked(data)))
        if odd.size:
            for i in np.unique(np.searchsorted(offsets, odd, side="right") - 1):
                cut[offsets[i] : offsets[i + 1]] = False
        after = np.zeros(len(data), bool)
        after[1:] = cut[:-1] & (data[:-1] == 10)
        cut |= after
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        own, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != own) if len(self.keys) else np.arange(len(own))
        if len(new):
            if len(self.flat) > CACHE_IDS:
                self.clear()
                new = np.arange(len(own))
            raw = data.tobytes()
            self._learn(own[new], [raw[starts[i] : ends[i]] for i in first[new]])
            at = np.searchsorted(self.keys, own)
        begin, count = self.begin[at][back], self.count[at][back]
        ids = self.flat[np.repeat(begin, count) + ragged(count)]
        piece_of = np.searchsorted(starts, offsets)
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(total[piece_of])

    def _marked(self, data: np.ndarray) -> np.ndarray:
        """Places where the content of an added token begins."""
        raw = data.tobytes() if self.added else b""
        return np.array([m.start() for x in self.added for m in re.finditer(b"(?=" + re.escape(x.encode()) + b")", raw)], np.int64)

    @staticmethod
    def _odd(data: np.ndarray) -> np.ndarray:
        """Places of white space outside ASCII, and of the controls that only some call white space."""
        padded = np.append(data, np.zeros(2, np.uint8))
        a, b, c = padded[:-2], padded[1:-1], padded[2:]
        lead = np.flatnonzero((a == 0xC2) | ((a >= 0xE1) & (a <= 0xE3)) | ((a >= 0x1C) & (a <= 0x1F)))
        a, b, c = a[lead], b[lead], c[lead]
        white = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        white |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        return lead[white]


def encoder(path: str, added: bool = False) -> PieceEncoder:
    """One per Python worker, so pieces that were met before stay known."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = PieceEncoder(path, added)
    return _ENCODERS[path, added]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_ends(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each stream its chunk ends. A chunk ends where the rolling hash of the last ROLL ids has its low bits zero, within the length limits."""
    value = mix(ids.astype(np.uint64) + np.uint64(1))
    rolled, shift = value.copy(), 1
    while shift < ROLL:  # doubles the window: hash(2w) = hash(w) * odd + hash(w) shifted by w
        rolled[shift:] = rolled[shift:] + rolled[:-shift] * np.uint64(2 * shift * 0x9E3779B1 + 1)
        shift *= 2
    hot = np.flatnonzero((mix(rolled) & np.uint64(CHUNK_MEAN - 1)) == 0)
    out = []
    for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
        ends, at = [], 0
        own = hot[np.searchsorted(hot, s + ROLL - 1) : np.searchsorted(hot, s + n)] - s + 1
        for e in own.tolist():
            while e - at > CHUNK_MAX:
                at += CHUNK_MAX
                ends.append(at)
            if e - at >= CHUNK_MIN and e < n:
                ends.append(e)
                at = e
        while n - at > CHUNK_MAX:
            at += CHUNK_MAX
            ends.append(at)
        ends.append(n)
        out.append(np.array(ends, np.int64))
    return out


def merkle_root(keys: list[bytes]) -> bytes:
    level = list(keys)
    while len(level) > 1:
        if len(level) % 2:
            level.append(level[-1])
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
    return hashlib.sha256(b"root" + level[0]).digest() if level else hashlib.sha256(b"root").digest()


ROWS = "doc_id long, tag long, row long, seq int, n long, key binary, ids binary"


def chunk_rows(docs: DataFrame, path: str, end: int = END, added: bool = False) -> DataFrame:
    """A row per chunk of each row of docs (doc_id, text); a task sends the bytes of a chunk it has sent before as null.

    tag is a hash of the text and row a number of the row, so that rows which repeat a doc_id stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sent, count = encoder(path, added), set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_view(batch.column(2))
            doc, tag = (batch.column(k).to_pylist() for k in (0, 1))
            for i, j in blocks(offsets, BLOCK):
                ids, counts = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                whole = counts + 1
                stream = np.full(int(whole.sum()), end, np.uint32)
                starts = np.cumsum(whole) - whole
                stream[np.repeat(starts, counts) + ragged(counts)] = ids
                raw = stream.astype(f"<u{coder.width}")
                rows = ([], [], [], [], [], [], [])
                for k, ends in enumerate(chunk_ends(stream, starts, whole)):
                    at = 0
                    for seq, e in enumerate(ends.tolist()):
                        own = raw[starts[k] + at : starts[k] + e].tobytes()
                        key = hashlib.sha256(own).digest()
                        for column, x in zip(rows, (doc[i + k], tag[i + k], count + i + k, seq, e - at, key, None if key in sent else own), strict=True):
                            column.append(x)
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(key)
                        at = e
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "tag", "row", "seq", "n", "key", "ids"])
            count += batch.num_rows

    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(run, ROWS)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by doc_id, tag, row, seq within a range of doc_id; a document may span batches."""
    part, start, doc, keys, sizes = TaskContext.get().partitionId(), 0, None, [], []
    out: list[tuple] = []

    def close() -> None:
        nonlocal start
        if keys:
            ends = np.cumsum(sizes)
            out.append((doc[0], part, start, int(ends[-1]), list(keys), ends.tolist(), merkle_root(keys)))
            start += int(ends[-1])

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "part", "start", "n_tokens", "keys", "ends", "root"]
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
    for batch in batches:
        for d, row, k, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if (d, row) != doc:
                close()
                doc, keys, sizes = (d, row), [], []
            keys.append(k)
            sizes.append(n)
        if out:
            yield flush()
            out.clear()
    close()
    if out:
        yield flush()


def write_store(docs: DataFrame, store: str, path: str | None = None, end: int = END, added: bool = False) -> None:
    """Write all of `docs` (doc_id, text) into a new store. Null text counts as empty (its ids: the end id).

    added: whether the content of an added token in a text gives that token (see PieceEncoder).

    Every row is a document of the store: rows that repeat a doc_id stand one after the other in the order of
    a hash of their text, and those with a null one first. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = materialise(chunk_rows(docs, path, end, added), "uses")
    # tasks send a chunk once each, and those are reduced to one before the shuffle where they meet
    staged.filter("ids is not null").groupBy("key").agg(F.max("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{store}/chunks")
    ranged = staged.select("doc_id", "tag", "row", "seq", "key", "n").repartitionByRange("doc_id", "tag", "row").sortWithinPartitions("doc_id", "tag", "row", "seq").select("doc_id", "row", "key", "n")
    local = materialise(ranged.mapInArrow(_recipes, "doc_id long, part int, start long, n_tokens long, keys array<binary>, ends array<long>, root binary"), "recipes")
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row per range: as many as shuffle partitions
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    whole = local.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before"))
    whole.select("doc_id", "start", "n_tokens", "keys", "ends", "root").write.option("compression", "zstd").parquet(f"{store}/recipes")


def _checked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if hashlib.sha256(ids).digest() != key:
                raise ValueError(f"the store is damaged: chunk {key.hex()}")
            crc.append(zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], ["key", "crc"])


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, in its reflected bit order."""
    out, b, one = np.zeros_like(a), b.copy(), np.uint64(1)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & one, b, np.uint64(0))
        b = (b >> one) ^ np.where(b & one, _POLY, np.uint64(0))
    return out


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32, followed by `after` bytes, adds (by xor) to the CRC-32 of the whole."""
    crc, left, power = crc.astype(np.uint64), after.astype(np.uint64), np.full(1, 1 << 23, np.uint64)  # x to the power 8
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            crc[odd] = _times(crc[odd], np.broadcast_to(power, odd.sum()).copy())
        power, left = _times(power, power), left >> np.uint64(1)
    return crc


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = crc_shift(batch.column(3).to_numpy(), batch.column(4).to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part.astype(np.int64))], ["doc_id", "start", "n_tokens", "part"])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, keys, root in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if merkle_root(keys) != root:
                raise ValueError(f"the store is damaged: recipe of document {d}")
        yield batch


def read_recipes(spark: SparkSession, store: str) -> DataFrame:
    recipes = spark.read.parquet(f"{store}/recipes").select("doc_id", "start", "n_tokens", "keys", "ends", "root")
    return recipes.mapInArrow(_proved, recipes.schema)


def read_checksums(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Each stored chunk is read once; a document's checksum follows from those of its chunks. Documents are told
    apart by where they start, as each has an end id.
    """
    small_batches(spark)
    crcs = spark.read.parquet(f"{store}/chunks").select("key", "ids").mapInArrow(lambda b: _checked(b, width), "key binary, crc long")
    recipes = read_recipes(spark, store).select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip("keys", "ends")).alias("use"))
    uses = materialise(recipes.select("doc_id", "start", "n_tokens", F.col("use.keys").alias("key"), (4 * (F.col("n_tokens") - F.col("use.ends"))).alias("after")), "references")
    counts = uses.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    known = materialise(counts.join(crcs, "key", "left"), "crcs")
    total = known.agg(F.sum("c"), F.count_if(F.col("crc").isNull())).first()
    if total[1]:
        raise ValueError(f"the store is damaged: {total[1]} chunks are missing")
    parts = with_group(uses, known, ["key"], total[0] or 0).select("doc_id", "start", "n_tokens", "crc", "after").mapInArrow(_shifted, "doc_id long, start long, n_tokens long, part long")
    return parts.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"))


def read_ids(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """doc_id, ids array<int>: the documents themselves, rebuilt from recipes and chunks."""
    stored = spark.read.parquet(f"{store}/chunks")
    uses = read_recipes(spark, store).select("doc_id", "start", F.posexplode("keys").alias("seq", "key")).join(stored, "key")
    whole = uses.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts")).drop("start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), f"<u{width}").astype(np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return whole.mapInArrow(run, "doc_id long, ids array<int>")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of `documents`, read back from the store; see write_store and read_checksums."""
    store = work_dir(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), store, added=True)
    return read_checksums(spark, store)
