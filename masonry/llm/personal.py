"""Personal data by weak supervision. DataFrame functions only; the driver handles a table of vote patterns.

Strict and loose regular expressions propose spans. On each span four labelers vote yes, no or abstain:
the strict expression, a gazetteer, the words before the span, and the characters around it. Votes are
counted over all documents by pattern, together with features of the span itself (length, share of digits,
separators, repeated digits; a bounded number of patterns); expectation-maximisation over the votes
estimates each labeler's reliability and a posterior, and a logistic classifier over votes and features is
trained on the posteriors. Spans that pass the strict rules always stay; the classifier decides on the loose ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, materialise, table
from .rules import let

KINDS = ["email", "ip", "card", "phone"]
# Expressions of the strict rules (fixed values). A run of address characters is entered at its start
# or where the match before ended, which finds the same spans as without the look-behind, but sooner.
# Groups that repeat are possessive: java.util.regex matches others by recursion, which overflows the stack
# on long runs. Nothing follows them, so they match the same. A run of digits is entered at its start only.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,40} ?[\[(] ?at ?[\])] ?[a-z0-9-]{2,40}(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]{2,20})++",
    "card": r"(?<![0-9-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
MARK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Gazetteers (fixed values): common top-level domains, card issuers' first digits, and country codes.
DOMAINS = "com|org|net|edu|gov|io|info|fr|de|es|uk|eu|us|it|nl|ch|be|at|pt"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
COUNTRIES = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Words shortly before a span that speak for or against personal data (fixed values).
FOR = r"(?i)\b(e-?mail|mail|contact|tel|phone|call|fax|mobile|card|visa|credit|ip|host|server|address|reach|write)\b"
AGAINST = r"(?i)\b(version|isbn|issn|page|section|order|invoice|total|ratio|doi|part|figure|table)\b"
CONTEXT = 32
LABELERS = 4
#: Characters of a pattern: kind, looseness, a vote of each labeler, then features of the span.
VOTES = 2 + LABELERS
#: A loose span is kept from this score on.
LEAST_SCORE = 0.8

#: What folds over spans append at a time: an array that grows is copied for each element, so arrays stay this short and are joined once.
FOLDED = 256
#: Parts that a text is cut into before spans are cut out, since every cut walks from the start of what it cuts.
CHUNKS = 256
#: Matches before a span, each with the text before it, that hold at least CONTEXT characters; both together have two or more.
NEAR = CONTEXT // 2

_SPAN = "array<struct<start:int,end:int,m:string,i:int>>"


def folded(items: Column, state: Column, kind: str, step, finish):
    """A fold whose `step` (state, item) gives a struct of s, the next state, and out; `finish` takes the last state and the outs, an array of `kind`."""
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")

    def some(s: Column, block: Column) -> Column:
        part = F.slice(items, block * FOLDED + 1, FOLDED)
        grown = lambda acc, x: let(step(acc["s"], x), lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["out"], r["out"]).alias("out")))
        return F.aggregate(part, F.struct(s.alias("s"), none(kind).alias("out")), grown)

    whole = lambda acc, block: let(some(acc["s"], block), lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["out"], r["out"]).alias("out")))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int"))
    return F.aggregate(blocks, F.struct(state.alias("s"), none(f"array<{kind}>").alias("out")), whole, lambda acc: finish(acc["s"], F.flatten(acc["out"])))


def laid(pieces: Column, matches: Column) -> Column:
    """array<struct<start, end, m, i>> with code point offsets of matches, each after its piece of the text (i: its number)."""

    def step(at: Column, i: Column) -> Column:
        start = at + F.length(F.get(pieces, i))
        end = start + F.length(F.get(matches, i))
        return F.struct(end.alias("s"), F.struct(start.alias("start"), end.alias("end"), F.get(matches, i).alias("m"), i.alias("i")).alias("out"))

    places = F.sequence(F.lit(0), F.size(matches) - 1)
    spans = let(places, lambda own: folded(own, F.lit(0), "struct<start:int,end:int,m:string,i:int>", step, lambda _, out: out))
    return F.when(F.size(matches) == 0, F.expr(f"cast(array() as {_SPAN})")).otherwise(spans)


def parts(text: Column, pattern: str, then) -> Column:
    """`then` of the matches of a pattern, leftmost and non-overlapping, and of the pieces of text around them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda ms: let(F.when(F.size(ms) > 0, F.split(text, pattern, -1)), lambda ps: then(ps, ms)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The strict rule for a match of the strict expression."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("long") <= 255))
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("1")).when(no, F.lit("0")).otherwise(F.lit("-"))


def gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        known = F.lower(m).rlike(rf"({DOMAINS})$")
        return _vote(known, F.lit(False))
    if kind == "ip":
        low = m.rlike(r"^0*(0|10|127|255)\.|^192\.168\.|^1\.[0-9]\.")
        return _vote(~low, low)
    if kind == "card":
        known = _digits(m).rlike(ISSUERS)
        return _vote(known, ~known)
    known = m.rlike(COUNTRIES)
    return _vote(known, m.startswith("+") & ~known)


def span_features(m: Column) -> Column:
    """Four characters: length (a to c), share of digits (a to c), separators (0, 1, 2 for more kinds), a digit five times in a row (y or n)."""
    n, digits = F.length(m), F.length(_digits(m))
    kinds = sum((F.contains(m, F.lit(c)).cast("int") for c in " -.("), F.lit(0))
    return F.concat(
        F.when(n <= 14, "a").when(n <= 22, "b").otherwise("c"),
        F.when(2 * digits < n, "a").when(5 * digits < 4 * n, "b").otherwise("c"),
        F.least(kinds, F.lit(2)).cast("string"),
        F.when(m.rlike(r"([0-9])\1{4}"), "y").otherwise("n"),
    )


def _labelled(pieces: Column, matches: Column, spans: Column, kind: str, strict: bool) -> Column:
    """The spans with kind, base and pattern; what stands around them is cut from the pieces and matches beside them, not from the whole text."""
    last = lambda c: F.right(c, F.lit(CONTEXT))

    def label(s: Column) -> Column:
        i = s["i"]
        earlier = F.when(i > 0, F.array_join(F.transform(F.sequence(F.greatest(i - NEAR, F.lit(0)), i - 1), lambda j: F.concat(last(F.get(pieces, j)), last(F.get(matches, j)))), "")).otherwise("")
        before = last(F.concat(earlier, last(F.get(pieces, i))))
        after = F.coalesce(F.nullif(F.left(F.get(pieces, i + 1), F.lit(1)), F.lit("")), F.left(F.get(matches, i + 1), F.lit(1)), F.lit(""))

        def voted(b: Column) -> Column:
            around = F.concat(F.right(b, F.lit(1)), F.lit(" "), after)
            return F.concat(
                F.lit("1" if strict else "-"),
                gazetteer(kind, s["m"]),
                _vote(b.rlike(FOR), b.rlike(AGAINST)),
                let(around, lambda a: _vote(~a.rlike(r"[\p{L}\p{N}_]"), a.rlike(r"[\p{L}\p{N}_]"))),
            )

        pattern = F.concat(F.lit(f"{KINDS.index(kind)}{'s' if strict else 'l'}"), let(before, voted), span_features(s["m"]))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), F.lit(strict).alias("base"), pattern.alias("pattern"))

    return F.transform(spans, label)


def overlapped(spans: Column, x: Column) -> Column:
    """Whether x overlaps one of `spans`, which are in order and apart: the last that begins before x ends is found by halving."""
    half = lambda r: F.floor((r["low"] + r["high"]) / 2).cast("int")
    step = lambda r, _: F.when(r["low"] >= r["high"], r).when(F.get(spans, half(r))["start"] < x["end"], F.struct((half(r) + 1).alias("low"), r["high"].alias("high"))).otherwise(F.struct(r["low"].alias("low"), half(r).alias("high")))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step, lambda r: F.coalesce(F.get(spans, r["low"] - 1)["end"] > x["start"], F.lit(False)))
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(found)


def candidates(text: Column) -> Column:
    """array<struct<start, k, end, base, pattern>> in order of start and kind; loose spans that touch a strict one are left out.

    The time is in proportion to the text and its spans, but for a factor that grows with the logarithm of their number.
    """
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,base:boolean,pattern:string>>)")

    def of(kind: str, pattern: str, strict: bool) -> Column:
        def labelled(ps: Column, ms: Column) -> Column:
            kept = let(laid(ps, ms), lambda spans: F.filter(spans, lambda s: valid(kind, s["m"])) if strict else spans)
            return let(kept, lambda own: _labelled(ps, ms, own, kind, strict))

        mark = F.contains(text, F.lit(MARK[kind])) if strict and MARK[kind] else text.rlike("(?i)[\\[(] ?at ?[\\])]") if kind == "email" else text.rlike("[0-9]{3}")
        return F.when(mark, parts(text, pattern, labelled)).otherwise(none)

    strict = F.array(*(of(k, STRICT[k], True) for k in KINDS))
    loose = F.concat(*(of(k, p, False) for k, p in LOOSE.items()))
    # spans of one kind are apart, so each kind is searched by itself
    free = lambda base: F.filter(loose, lambda x: ~F.exists(base, lambda own: overlapped(own, x)))
    return let(strict, lambda base: F.sort_array(F.concat(F.flatten(base), free(base))))


def expectation_maximisation(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], list[dict[str, list[float]]]]:
    """(posterior of each pattern, per labeler P(vote | not personal, personal)): votes are independent given the truth."""
    share = {p[0]: 0.7 for p in counts}
    rates = [{v: [0.2, 0.6] if v == "1" else [0.5, 0.1] if v == "0" else [0.3, 0.3] for v in "10-"} for _ in range(LABELERS)]
    post: dict[str, float] = {}
    for _ in range(rounds):
        for p in counts:
            a, b = math.log(share[p[0]]), math.log(1 - share[p[0]])
            for r, v in zip(rates, p[2:], strict=True):
                a, b = a + math.log(r[v][1]), b + math.log(r[v][0])
            post[p] = 1 / (1 + math.exp(max(-500.0, min(500.0, b - a))))
        for k in share:
            own = [(n, post[p]) for p, n in counts.items() if p[0] == k]
            share[k] = (1.4 + sum(n * q for n, q in own)) / (2 + sum(n for n, _ in own))
        for i, r in enumerate(rates):
            for y in (0, 1):
                seen = {v: prior for v, prior in (("1", (2.0, 6.0)[y]), ("0", (5.0, 1.0)[y]), ("-", 3.0))}
                for p, n in counts.items():
                    seen[p[2 + i]] += n * (post[p] if y else 1 - post[p])
                total = sum(seen.values())
                for v in "10-":
                    r[v][y] = seen[v] / total
    return post, rates


def pattern_features(pattern: str) -> list[str]:
    """Names of what a pattern has; features of the span are taken by kind."""
    return ["bias", pattern[0], pattern[1], *(f"{i}{v}" for i, v in enumerate(pattern[2:VOTES])), *(f"{pattern[0]}f{i}{v}" for i, v in enumerate(pattern[VOTES:]))]


def train_classifier(counts: dict[str, int], post: dict[str, float], steps: int = 600, rate: float = 0.5) -> dict[str, float]:
    """Weights of a logistic regression on kind, looseness, votes and span features, fitted to the posteriors of the votes."""
    own = [pattern_features(p) for p in counts]
    names = sorted({x for f in own for x in f} | {"bias"})
    x = np.array([[name in f for name in names] for f in map(set, own)], float).reshape(-1, len(names))
    n = np.array(list(counts.values()), float)
    y, share = np.array([post[p[:VOTES]] for p in counts]), n / max(1.0, n.sum())
    w = np.zeros(len(names))
    for _ in range(steps):
        w += rate * (x.T @ (share * (y - 1 / (1 + np.exp(-x @ w)))) - 1e-4 * w)
    return dict(zip(names, w.tolist(), strict=True))


def score(pattern: Column, weights: dict[str, float]) -> Column:
    """The classifier's score of a pattern, as an expression."""
    kind = F.substring(pattern, 1, 1)

    def at(place: int, prefix: str, by_kind: bool) -> Column:
        out = None
        for name, w in weights.items():
            own = name[1:] if by_kind and name[:1] in "0123" else name
            if own[:-1] != prefix or name == "bias" or (by_kind != (len(name) == len(prefix) + 2)):
                continue
            here = F.substring(pattern, place + 1, 1) == name[-1]
            here = here & (kind == name[0]) if by_kind else here
            out = F.when(here, w) if out is None else out.when(here, w)
        return F.lit(0.0) if out is None else out.otherwise(0.0)

    parts = [at(0, "", False), at(1, "", False), *(at(2 + i, str(i), False) for i in range(LABELERS)), *(at(VOTES + i, f"f{i}", True) for i in range(4))]
    return 1 / (1 + F.exp(-sum(parts, F.lit(weights.get("bias", 0.0)))))


def fit(spotted: DataFrame) -> dict[str, float]:
    """Weights from a frame with `found` (see candidates) over all documents; none if there are no spans."""
    rows = spotted.select(F.explode("found").alias("s")).groupBy("s.pattern").count().collect()  # at most 8 * 3^LABELERS * 54 rows
    counts = {r[0]: r[1] for r in sorted(rows)}
    votes: dict[str, int] = {}
    for p, n in counts.items():
        votes[p[:VOTES]] = votes.get(p[:VOTES], 0) + n
    return train_classifier(counts, expectation_maximisation(votes)[0]) if counts else {}


def decided(spans: Column, weights: dict[str, float], least: float = LEAST_SCORE) -> Column:
    """The spans that stay: all strict ones, and loose ones that score `least` or more."""
    return F.filter(spans, lambda s: s["base"] | (score(s["pattern"], weights) >= least)) if weights else F.filter(spans, lambda s: s["base"])


def spot(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and `found` for every row. Null and empty texts have no spans."""
    return docs.withColumn("_t", as_text(F.col("text").cast("string"))).select(*keep, candidates(F.col("_t")).alias("found"))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first is replaced and the rest is cut."""
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def replaced(spans: Column, size: Column, chunks: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            def part(c: Column) -> Column:
                low = F.greatest(start - c * size, F.lit(0))
                return F.substring(F.get(chunks, c), low + 1, F.least(end - c * size, size) - low)

            first, last = F.floor(start / size).cast("int"), F.floor((end - 1) / size).cast("int")
            return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

        def step(at: Column, s: Column) -> Column:
            piece = F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.get(kinds, s["k"]))).otherwise("")
            return F.struct(F.greatest(at, s["end"]).alias("s"), piece.alias("out"))

        return folded(spans, F.lit(0), "string", step, lambda at, out: F.concat(F.array_join(out, ""), between(at, F.length(text))))

    cut = lambda size: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda c: F.substring(text, c * size + 1, size))
    size = F.greatest(F.ceil(F.length(text) / CHUNKS), F.lit(1024)).cast("int")
    return let(spans, lambda own: F.when(F.size(own) == 0, text).otherwise(let(size, lambda n: let(cut(n), lambda chunks: replaced(own, n, chunks)))))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of `documents`, repeated ones too; see spot and decided."""
    spotted = materialise(spot(table(spark, sf_dir, "documents"), "doc_id"), "spans")
    kept = spotted.select("doc_id", F.filter("found", lambda s: s["base"]).alias("base"), decided(F.col("found"), fit(spotted)).alias("spans"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), *map(count, KINDS), F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))
