import collections
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from masonry.llm import personal, rules
from .conftest import prose


def brute_rules(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times, seen, twice, hit = collections.Counter(windows), set(), 0, set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(hit)


def test_base_counts_and_verdict(docs, texts, empty):
    rows = {r.doc_id: r for r in rules.judge(docs.withColumn("classes", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        r, want = rows[3 * i], brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert rules.judge(empty).count() == 0


def test_divergence(spark):
    row = spark.createDataFrame([([1, 1, 0], [2, 2, 0], [0, 0, 5], [0, 0, 0])], "a array<long>, b array<long>, c array<long>, d array<long>")
    same, apart, none = row.select(*(rules.divergence(F.col("a"), F.col(x)) for x in "bcd")).first()
    assert same == 0 and abs(apart - 1) < 1e-9 and none is None


def luhn(d):
    digits = [int(x) for x in d][::-1]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(digits)) % 10 == 0


def brute_spans(t):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "a@b.c%d@e.f g@h a@b@c.de é😀 x.y@z-z.co.uk. @", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 9.9.9", "call +1 (743) 555-3824, +12 3 or +44 20 7946 0958 0958 0958 1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4316522678525456 0000", "é" * 40 + "jo@x.org" + "é" * 40, "phone (743) 555-3824 now; contact joe [at] mail [dot] example here",
]


def test_spans_like_brute_force(spark, texts, empty):
    everything = TEXTS + texts
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(everything)], "doc_id long, text string, found int")
    spotted = personal.spot(frame, "doc_id").cache()
    for r in spotted.collect():
        assert [(s.start, s.k, s.end) for s in r.found if s.base] == brute_spans(everything[r.doc_id]), everything[r.doc_id]
    loose = {everything[r.doc_id][s.start : s.end] for r in spotted.collect() for s in r.found if not s.base}
    assert {"(743) 555-3824", "joe [at] mail [dot] example"} <= loose
    assert personal.spot(empty, "doc_id").count() == 0 and personal.fit(personal.spot(empty)) == {}


def test_masking(spark):
    frame = spark.createDataFrame([(1, "é jo@x.org or 8.8.8.8!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    out = {r[0]: r[1] for r in frame.select("doc_id", personal.masked(text, personal.decided(personal.candidates(text), {}))).collect()}
    assert out == {1: "é <EMAIL> or <IP>!", 2: "nothing", 3: ""}


def test_labelers_that_agree_are_trusted():
    counts = {"3l-11-": 0, "3l-111": 900, "3s1111": 500, "3l-001": 40, "3l-000": 800, "3l-0--": 300}
    counts = {p: n for p, n in counts.items() if n}
    post, _ = personal.expectation_maximisation(counts)
    weights = personal.train_classifier(counts, post)
    score = lambda p: 1 / (1 + math.exp(-sum(weights[x] for x in personal.pattern_features(p))))
    assert post["3l-111"] > 0.9 > 0.1 > post["3l-000"] and score("3l-111") > score("3l-000")


def test_scores_are_those_of_the_weights(spark):
    """The native expression against the weights, for patterns with every part."""
    patterns = ["3l-11-aa0n", "3l-111ba1n", "2l0-1-cc2y", "0s1111aa0n", "1s1100bb2n"]
    counts = {p: 10 + k for k, p in enumerate(patterns)}
    weights = personal.train_classifier(counts, {p[: personal.VOTES]: 0.9 - 0.2 * k for k, p in enumerate(patterns)})
    frame = spark.createDataFrame([(p,) for p in [*patterns, "2l---1ba1n", "9?"]], "p string")
    for r in frame.select("p", personal.score(F.col("p"), weights).alias("s")).collect():
        want = 1 / (1 + math.exp(-sum(weights.get(x, 0.0) for x in personal.pattern_features(r.p))))
        assert abs(r.s - want) < 1e-9


def test_added_spans(spark):
    """Obfuscated addresses and national phone numbers near words that speak for them are added; part numbers aren't."""
    rng = random.Random(3)
    name = lambda: prose(rng, 1)
    phone = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    good = [f"{prose(rng, 20)} contact {name()} [at] {name()} [dot] com {prose(rng, 9)}" if k % 2 else f"{prose(rng, 20)} call {phone()} {prose(rng, 9)}" for k in range(60)]
    bad = [f"{prose(rng, 20)} part {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}x order {prose(rng, 9)}" for _ in range(60)]
    strict = [f"{prose(rng, 9)} mail {name()}@{name()}.org tel +1 {phone()} host 8.8.4.4" for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(good + bad + strict)), "doc_id long, text string").repartition(3)
    spotted = personal.spot(frame, "doc_id").cache()
    kept = {r.doc_id: r.n for r in spotted.select("doc_id", F.size(F.filter(personal.decided(F.col("found"), personal.fit(spotted)), lambda s: ~s["base"])).alias("n")).collect()}
    assert sum(kept[i] > 0 for i in range(60)) >= 54 and sum(kept[i] > 0 for i in range(60, 120)) <= 3


def slow_distance(p, q):
    p, q = ([x / sum(h) for x in h] for h in (p, q))
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))


def test_verdict_like_brute_force(spark):
    """Common words, references, distances and verdicts of a small corpus computed in Python."""
    rng, rows = random.Random(5), []
    vocabulary = {x: ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(60)] for x in ("aa", "bb", None)}
    for i in range(90):
        lang = ["aa", "bb", None][i % 3]
        own = rng.choices(vocabulary[lang], [1 / (k + 1) for k in range(60)], k=rng.choice([30, 160, 220]))
        rows.append((i, " ".join(own) if i % 10 else " ".join(w.upper() + "#$" for w in own), lang))
    rows.append((90, " ".join(rng.choices(vocabulary["aa"], k=200)), "bb"))
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    ref = lambda x: x or "*"
    words, classes, common = collections.defaultdict(collections.Counter), {}, {}
    for _, t, x in rows:
        words[ref(x)].update(t.lower().split())
    listed = {x: [w for w, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[: rules.N_COMMON]] for x, c in words.items()}
    sums = {}
    for i, t, x in rows:
        kind = [sum(c.islower() for c in t), sum(c.isspace() for c in t), sum(c.isupper() for c in t), 0, sum(c in "#$" for c in t), 0, 0]
        own = collections.Counter(t.lower().split())
        classes[i], common[i] = kind, [sum(n for w, n in own.items() if w not in listed[ref(x)]), *(own[w] for w in listed[ref(x)])]
        common[i] += [0] * (rules.N_COMMON + 1 - len(common[i]))
        if not got[i].base_failed:
            for k, h in enumerate((kind, common[i])):
                sums[ref(x), k] = [a + b for a, b in zip(sums.get((ref(x), k), [0] * len(h)), h, strict=True)]
    for i, t, x in rows:
        far = [slow_distance(h, sums[ref(x), k]) for k, h in enumerate((classes[i], common[i]))]
        judged = [len(t) >= rules.LEAST_CHARS, len(t.split()) >= rules.LEAST_WORDS]
        for d, want, ok in zip((got[i].d_classes, got[i].d_words), far, judged, strict=True):
            assert (d is None) == (not ok) and (d is None or abs(d - want) < 1e-9)
        keep = not got[i].base_failed and (not judged[0] or far[0] <= rules.MOST_CLASSES) and (not judged[1] or far[1] <= rules.MOST_WORDS)
        assert got[i].kept == keep
    assert {got[i].kept for i in got} == {True, False} and not got[90].kept


def test_queries(spark, docs, texts, tmp_path):
    docs.unionByName(docs.limit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    ids = sorted([3 * i for i in range(len(texts))] + [r.doc_id for r in spark.read.parquet(str(tmp_path / "documents.parquet")).groupBy("doc_id").count().filter("count > 1").collect()])
    found = personal.op9_personal_data(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == ids
    for r in found:
        base = brute_spans(texts[r.doc_id // 3])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[1] for x in base) for k in range(4)]
        named = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest() and set(named.split(",")) <= set(r.spans.split(",") + [""])
    judged = rules.op8_distribution_divergence(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in judged) == ids and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(texts[r.doc_id // 3]) for r in judged)


def test_digest_is_of_the_listed_spans(spark):
    frame = spark.createDataFrame([("a@b.cd 8.8.8.8",)], "text string")
    row = frame.select(F.sha2(personal._named(personal.candidates(F.col("text"))), 256)).first()
    assert row[0] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()


def test_long_runs_of_digits_and_labels(spark):
    """Repeated groups must not recurse: the stack of a task is small. Nor may a run be entered at each of its digits."""
    long = {1: "7" * 1_000_000, 2: "1 " * 500_000 + "2", 3: "4-" * 500_000 + "4", 4: "a@b" + ".c" * 200_000, 5: "joe [at] mail" + " [dot] ab" * 20_000}
    rows = [(k, "jo@x.org " + t + " ends. 8.8.8.8") for k, t in long.items()]
    spotted = personal.spot(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id")
    for r in spotted.collect():
        text = dict(rows)[r.doc_id]
        strict = [(s.start, s.k, s.end) for s in r.found if s.base]
        inner = [(9, 0, 9 + len(long[4]))] if r.doc_id == 4 else []
        assert strict == [(0, 0, 8), *inner, (len(text) - 7, 1, len(text))]
        loose = [(s.start, s.end) for s in r.found if not s.base]
        assert loose == ([(9, 9 + len(long[5]))] if r.doc_id == 5 else [])


def test_many_spans_in_one_text(spark):
    """70,000 addresses in a text of 1 MB: found and masked in seconds, since no span walks the whole text."""
    import time

    text = " ".join(f"u{i}@mail{i % 7}.com" for i in range(70_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("found", personal.candidates(F.col("text")))
    began = time.time()
    r = frame.select(F.size("found").alias("n"), F.length(personal.masked(F.col("text"), F.col("found"))).alias("m"), F.get("found", F.lit(69_999))["end"].alias("end")).first()
    assert (r.n, r.m, r.end) == (70_000, 8 * 70_000 - 1, len(text))
    assert time.time() - began < 60


def test_spans_around_the_folds(spark):
    """Offsets, contexts and masks are right on both sides of the places where folds and chunks end."""
    import re

    for n in (1, 255, 256, 257, 1500):
        text = "".join(f"né{i % 3} call +1 (212) 555-{i:04d}, é{i}@m.com;" for i in range(n))
        row = spark.createDataFrame([(1, text)], "doc_id long, text string").select(personal.candidates(F.col("text")).alias("c"), personal.masked(F.col("text"), personal.candidates(F.col("text"))).alias("m")).first()
        want = sorted([(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text)] + [(m.start(), 0, m.end()) for m in re.finditer(r"[0-9]+@m\.com", text)])
        assert [(s.start, s.k, s.end) for s in row.c] == want
        assert row.m == re.sub(r"[0-9]+@m\.com", "<EMAIL>", re.sub(r"\+[0-9][ ().0-9-]+[0-9]", "<PHONE>", text))
