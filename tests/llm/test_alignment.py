import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from masonry.llm import alignment
from masonry.llm.tokens import vocabulary_path
from .conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.PIECES))


def spelled(tokenizers, text):
    """(ids, ends) of both tokenizers by their plain calls; None where the bytes differ."""
    a, b = tokenizers
    if not text:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = dict(zip(map(chr, range(256, 512)), [x for x in range(256) if x not in printable], strict=False))
    out = []
    for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(moved.get(c, ord(c)) for c in a.id_to_token(i))), (b.encode(text), lambda i: alignment.piece_bytes(b, i))):
        parts = [spell(i) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        out.append((ids, np.cumsum([len(p) for p in parts]).tolist()))
    return out


def brute(tokenizers, rows):
    links, out = {}, []
    for k, (_, text) in enumerate(rows):
        found, groups, links[k] = spelled(tokenizers, text), [], []
        if found:
            (a, ea), (b, eb) = found
            starts_a, starts_b = [0, *ea[:-1]], [0, *eb[:-1]]
            j = 0
            for i in range(len(a)):
                while eb[j] <= starts_a[i]:
                    j += 1
                n = j
                while n < len(b) and starts_b[n] < ea[i]:
                    links[k].append((a[i], b[n]))
                    n += 1
            sides = [[[]], [[]]]
            for side, (ids, ends), other in zip(sides, found, (set(eb), set(ea)), strict=True):
                for i, e in zip(ids, ends, strict=True):
                    side[-1].append(str(i))
                    if e in other:
                        side.append([])
            groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)][:-1]
        out.append((len(found[0][0]) if found else 0, len(found[1][0]) if found else 0, len(groups), len(links[k]), hashlib.sha256(";".join(groups).encode()).hexdigest() if found else ""))
    counts = Counter(x for some in links.values() for x in some)
    top = {}
    for (_, b), c in counts.items():
        top[b] = max(top.get(b, 0), c)
    return sorted([(d, *out[k][:4], sum(counts[x] == top[x[1]] for x in links[k]), sum(counts[x] for x in links[k]), out[k][4]) for k, (d, _) in enumerate(rows)], key=str)


def got(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, alignment.align(frame).select(names).collect()), key=str)


ODD = [
    " ", "  ", "\n", "a  b   c ", "\u2581", "x \u2581y", "<s> </s> <unk> <0x41>", "<|endoftext|>", "don't  stop   <|endoftext|> it's\r\n\r\n\tfine \x1c odd", "e\u0301 \u00e9 \ufb01 \u00b2 \u3000 \u00a0x",
    "\u6f22\u5b57\u304b\u306a \U0001f600\U0001f469\u200d\U0001f469 \u0645\u0631\u062d\u0628\u0627 \u043f\u0440\u0438\u0432\u0435\u0442", "a\u0000b", "1234567890 12,345.67", "https://example.com/a?b=c&d=%20", "x" * 3000, "\u6f22" * 700, "ab" * 40 + " " * 70 + "end",
]


@pytest.mark.parametrize("hot", [1, 30, 100_000])
def test_like_brute_force(spark, docs, texts, tokenizers, monkeypatch, hot):
    """No pair broadcast but those above all links, some, and all."""
    monkeypatch.setattr(alignment, "HOT", hot)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rows += [(0, "again"), (0, "again"), (None, "no id"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("place", F.lit("clash")).withColumn("A_IDS", F.lit(1)).withColumn("found", F.lit(2))
    assert got(frame) == brute(tokenizers, rows)


def test_random_texts(spark, tokenizers):
    rng = random.Random(8)
    signs = "abcdeß éñ漢字😀 .,;:!?-'\"\n\t 0123<>|_ THEing tion "
    rows = [(k, "".join(rng.choices(signs, k=rng.randint(1, 120)))) for k in range(300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(tokenizers, rows)


def test_long_text_is_linear(spark, tokenizers):
    """A text of more than 1 MB in far less than a minute."""
    import time

    text = prose(random.Random(9), 300_000)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = got(frame)[0]
    assert time.time() - began < 60
    assert row[1] + row[2] - row[3] == row[4] > 500_000


def test_groups_are_given_as_text(spark):
    frame = spark.createDataFrame([(1, "unbelievable tokens, unbelievable")], "doc_id long, text string")
    row = alignment.aligned(alignment.tokenised(frame, vocabulary_path("byte_bpe_50k.json"), vocabulary_path(alignment.PIECES))).first().found
    doc = row.docs[0]
    assert doc.n_groups == doc.groups.count(";") + 1 and doc.n_a + doc.n_b - doc.n_groups == sum(len(row.units[w].links) for w in doc.words)
    assert sum(u.n for u in row.units) == len(doc.words) == 3


def test_equal_hashes_do_no_harm(spark, tokenizers, monkeypatch):
    """Where hashes of units are equal by chance, every unit stands for itself."""
    data = np.frombuffer(b" a b", np.uint8)
    sides = [(np.array([7, 8]), np.array([2, 4])), (np.array([5, 6]), np.array([2, 4]))]
    monkeypatch.setattr(alignment, "_sequence_hashes", lambda ids, starts, ends: np.ones(len(starts), np.uint64))
    words, n, columns = alignment.units(data, np.array([0, 4]), sides)
    assert words.tolist() == [0, 1] and n.tolist() == [2] and columns[1].to_pylist() == [[7], [8]]


def test_no_row_for_a_link(spark):
    """Distinct pairs go packed: rows that are asked for are as many as blocks and buckets at most, not as links."""
    rng = random.Random(12)
    rows = [(k, prose(rng, 500)) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = [r.found for r in alignment.aligned(alignment.tokenised(frame, vocabulary_path("byte_bpe_50k.json"), vocabulary_path(alignment.PIECES))).collect()]
    places = [p for f in found for u in f.units for p in u.links]
    pairs = sum(len(alignment._unpack(x.pairs)) for f in found for x in f.asks)
    assert all(len(f.asks) <= int(spark.conf.get("spark.sql.shuffle.partitions")) for f in found) and max(places) + 1 <= pairs < len(places)
    assert sum(alignment._unpack(x.times).sum() for f in found for x in f.asks) == sum(d.n_a + d.n_b - d.n_groups for f in found for d in f.docs)


def test_packed_numbers_come_back():
    for values in ([], [0], [5, -3, 2**62, 0, 255, 256]):
        assert alignment._unpack(alignment._pack(np.array(values, np.int64))).tolist() == values


def test_empty(spark, empty):
    assert got(empty) == []
    assert got(spark.createDataFrame([(1, None, "en", "s", 0)], SCHEMA)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, docs, texts, tokenizers, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = alignment.op11_token_alignment(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows), key=str) == brute(tokenizers, [(i * 3, t) for i, t in enumerate(texts)])
