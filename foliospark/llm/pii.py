"""Personal data: four exact kinds, and identifiers found by bootstrapped contextual extraction. DataFrame functions only.

Base kinds (email, ip, card, phone) are regular expressions with a check of the match. Their spans, whole, are the seeds of the
method; the identifier-like tokens outside them are the other instances. Patterns are an instance's neighbouring words, alone
and together with its exact shape (digits and letters as runs, and the length), and its runs alone. Spark scores the graph of
patterns and instances in rounds: a pattern's confidence is the smoothed mean score of its distinct instances, an instance's score
is what its trusted patterns leave open of doubt, 1 - product(1 - weight * confidence), 1 for a seed, and `PRIOR` at least: an unknown
instance isn't a wrong one. One that has the form of a base kind and fails its check is held to be wrong until words around it say
otherwise: its form is no evidence.
So a context is trusted where about half of the identifier-like tokens in it, or more, are seeds or found. A pattern is trusted from
`MIN_CONFIDENCE` and `MIN_SUPPORT` distinct instances that are seeds or already found. Weights are 1 for two neighbouring words or an
exact shape in context, `ONE_WORD` for a single word and `RUNS` for the runs: neither of these vouches alone. Tokens whose
score reaches `MIN_SCORE` become spans of kind `id`, whatever their shape.

Scale: each text is read once, in a narrow map that leaves spans and candidate tokens only; the graph holds distinct
(pattern, instance) edges, so copies of a text weigh nothing more; scores are aggregated map-side; the number of rounds is a
parameter. Possessive expressions keep the search linear in very long runs, and places are running totals by blocks, so that work
grows with a text's length however many spans it holds.

Defined cases: null counts as empty; equal texts have equal spans; rows that repeat stay as they are; with no seed
nothing is induced; an empty table gives an empty result; extra columns are ignored by find_spans and kept by redact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.arrays import bound, running

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The contract's expressions. A match may start where the last one ended or where no character of its first class
#: stands before it: elsewhere none can begin, and a long run is tried once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9]"}
#: Identifier-like tokens: at least 6 characters with at least 2 digits.
TOKEN = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9][A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{6,}+"
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, MIN_SCORE, CONTEXT = 3, 0.7, 3, 0.7, 48
ONE_WORD, RUNS, PRIOR = 0.6, 0.3, 0.4

NO_SPANS = "array<struct<start:int,end:int,low:int,high:int,value:string,before:string,after:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, low, high, value, before, after>> of all matches: in code points and in bytes from 0, ends exclusive, with
    up to CONTEXT characters on either side, taken from the gaps and the neighbouring matches. Linear in the text."""

    def places(sizes: Column, starts: Column, lows: Column) -> Column:
        return F.zip_with(F.zip_with(sizes, starts, lambda s, a: F.struct(s.alias("s"), a.alias("a"))), lows, lambda x, w: F.struct(
            (x.a + x.s.gap).alias("start"), (x.a + x.s.both).alias("end"), (w + x.s.low_gap).alias("low"), (w + x.s.low_both).alias("high"),
            x.s.value.alias("value"), x.s.before.alias("before"), x.s.after.alias("after"),
        ))

    def sized(found: Column, gaps: Column) -> Column:
        near = lambda k: F.coalesce(F.get(found, k), F.lit(""))

        def one(x: Column, k: Column) -> Column:
            gap, after = F.get(gaps, k), F.coalesce(F.get(gaps, k + 1), F.lit(""))
            return F.struct(
                F.char_length(gap).alias("gap"), (F.char_length(gap) + F.char_length(x)).alias("both"),
                F.octet_length(gap).alias("low_gap"), (F.octet_length(gap) + F.octet_length(x)).alias("low_both"), x.alias("value"),
                F.substring(F.concat(near(k - 1), gap), -CONTEXT, CONTEXT).alias("before"), F.substring(F.concat(after, near(k + 1)), 1, CONTEXT).alias("after"),
            )

        return F.transform(found, one)

    def summed(sizes: Column) -> Column:
        add = lambda a, v: a + v
        return places(sizes, running(F.transform(sizes, lambda s: s.both), add, F.lit(0)), running(F.transform(sizes, lambda s: s.low_both), add, F.lit(0)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(found, lambda f: F.when(F.size(f) > 0, bound(F.split(text, pattern, -1), lambda g: bound(sized(f, g), summed))).otherwise(F.array().cast(NO_SPANS)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(turned, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def holds(kind: str, x: Column) -> Column:
    """Whether a match of this kind passes its check."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    size = F.length(_digits(x))
    if kind == "card":
        return F.when(size.between(12, 19), _luhn(_digits(x))).otherwise(False)
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def matched(text: Column, kind: str) -> Column:
    """All matches of a kind's expression, whether or not they pass its check."""
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, located(text, PATTERNS[kind])).otherwise(F.array().cast(NO_SPANS))


def refused(kind: str, x: Column) -> Column:
    """Whether a match has a kind's form and length and yet fails its check: known not to be one."""
    return F.length(_digits(x)).between(12, 19) & ~holds(kind, x) if kind == "card" else ~holds(kind, x)


def _found(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep, _key (digest of a text that has seeds or candidates, else null), base (array of spans), tokens (both): one row a document."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    all_ = docs.select(*keep, text).select(*keep, "_text", *[matched(F.col("_text"), k).alias(f"_{k}") for k in KINDS])
    wrong = F.array_sort(F.concat(*[F.transform(F.filter(f"_{k}", _fails(k)), _span(0, k)) for k in ("ip", "card")]))
    each = all_.select(*keep, "_text", wrong.alias("_wrong"), *[F.filter(f"_{k}", _passes(k)).alias(k) for k in KINDS])
    tagged = [F.transform(k, _span(j, k)) for j, k in enumerate(KINDS)]
    digits = F.col("_text").rlike("[0-9]")
    tokens = F.when(digits, located(F.col("_text"), TOKEN)).otherwise(F.array().cast(NO_SPANS))
    with_tokens = each.select(*keep, "_text", "_wrong", *KINDS, F.array_sort(F.concat(*tagged)).alias("base"), tokens.alias("_t"))

    def instance(t: Column, seed: bool, prior: float) -> Column:
        left = F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), _context_words(t.before)), -2, 2)
        right = F.slice(F.concat(_context_words(t.after), F.array(F.lit("$"))), 1, 1)
        return F.struct(*[t[c].alias(c) for c in ("start", "end", "low", "high", "value")], left[0].alias("l2"), left[1].alias("l1"), right[0].alias("r1"), F.lit(seed).alias("seed"), F.lit(prior).alias("prior"))

    seeds = F.concat(*[F.transform(k, lambda m: instance(m, True, 1.0)) for k in KINDS])
    found = with_tokens.select(*keep, "_text", "_wrong", "base", seeds.alias("_seeds"), outside(F.col("_t"), F.col("base")).alias("_t"))
    others = F.concat(F.transform(outside(F.col("_t"), F.col("_wrong")), lambda t: instance(t, False, PRIOR)), F.transform(outside(F.col("_t"), F.col("_wrong"), False), lambda t: instance(t, False, 0.0)))
    return found.select(
        *keep, "base", F.concat("_seeds", others).alias("tokens"),
        F.when((F.size("_t") > 0) | (F.size("base") > 0), F.sha2("_text", 256)).alias("_key"),
    )


def _span(order: int, kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(m.start.alias("start"), F.lit(order).alias("order"), m.end.alias("end"), m.low.alias("low"), m.high.alias("high"), F.lit(kind).alias("kind"))


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda m: holds(kind, m.value)


def _fails(kind: str) -> Callable[[Column], Column]:
    return lambda m: refused(kind, m.value)


def outside(tokens: Column, base: Column, free: bool = True) -> Column:
    """The tokens (no two overlap) that overlap no span of base (or, unless `free`, some): in the order of spans' starts and tokens' ends, none before a token reaches into it."""
    none = F.lit(None)
    spans = F.transform(base, lambda b: F.struct(b.start.alias("at"), F.lit(1).alias("kind"), b.end.alias("reach"), F.get(tokens, F.lit(-1)).alias("t")))
    ends = F.transform(tokens, lambda t: F.struct(t.end.alias("at"), F.lit(0).alias("kind"), none.cast("int").alias("reach"), t.alias("t")))

    def sifted(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: F.coalesce(x.reach, F.lit(0))), lambda a, v: F.greatest(a, v), F.lit(0))
        kept = F.zip_with(both, reach, lambda x, r: F.when((x["kind"] == 0) & ((r <= x.t.start) if free else (r > x.t.start)), x.t))
        return F.filter(kept, lambda t: t.isNotNull())

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens if free else F.slice(tokens, 1, 0)).otherwise(bound(F.array_sort(F.concat(spans, ends)), sifted))


def _context_words(part: Column) -> Column:
    return F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}=:#]+"), lambda w: w != "")


def runs(value: Column) -> Column:
    """Digits and letters as runs: 9 for digits, a for letters, other characters as they are."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"\p{L}+", "a"), "[0-9]+", "9")


def shape(value: Column) -> Column:
    """The runs and the length."""
    return F.concat(runs(value), F.lit("/"), F.char_length(value))


def _patterns() -> Column:
    """array<struct<pattern, weight>> of an instance. A rim of the text is no context of its own, a refused form no pattern."""
    value, left, right, formed = F.col("t.value"), F.col("t.l1") != "^", F.col("t.r1") != "$", F.col("t.prior") > 0
    each = [
        ("left", ("t.l1", shape(value)), 1.0, formed), ("left2", ("t.l2", "t.l1", shape(value)), 1.0, formed), ("both", ("t.l1", "t.r1", shape(value)), 1.0, formed),
        ("words2", ("t.l2", "t.l1"), 1.0, F.col("t.l2") != "^"), ("around", ("t.l1", "t.r1"), 1.0, left & right),
        ("before", ("t.l1",), ONE_WORD, left), ("after", ("t.r1",), ONE_WORD, right), ("runs", (runs(value),), RUNS, formed),
    ]
    made = [(F.struct(F.concat_ws(" ", F.lit(name), *parts).alias("pattern"), F.lit(weight).alias("weight")), when) for name, parts, weight, when in each]
    return F.filter(F.array(*[p if when is None else F.when(when, p) for p, when in made]), lambda p: p.isNotNull())


def _induced(found: DataFrame, rounds: int) -> DataFrame:
    """(_key, spans: array of start, end): tokens outside the base spans that trusted patterns vouch for."""
    tokens = written(
        found.filter("_key IS NOT NULL").select("_key", F.explode("tokens").alias("t"))
        .select("_key", "t.start", "t.end", "t.low", "t.high", "t.value", "t.seed", "t.prior", _patterns().alias("patterns")).dropDuplicates(["_key", "start", "end"]),
        "tokens",
    )
    edges = written(tokens.select(F.inline("patterns"), "value", "seed", "prior").groupBy("pattern", "weight", "value").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.max("prior").alias("prior")), "edges")
    instances = edges.groupBy("value").agg(F.max("prior").alias("score"))
    for _ in range(rounds):
        scored = edges.join(instances, "value")
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("score") >= MIN_SCORE).alias("support"))
        trusted = patterns.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT))
        doubt = edges.join(trusted, "pattern", "left").groupBy("value").agg(F.max("prior").alias("prior"), F.sum(F.log1p(-F.col("weight") * F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999999)))).alias("doubt"))
        instances = written(doubt.select("value", F.greatest("prior", 1 - F.exp("doubt")).alias("score")), "instances")
    known = instances.filter(F.col("score") >= MIN_SCORE).select("value")
    return (
        tokens.filter("NOT seed").join(known, "value").groupBy("_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("order"), "end", "low", "high", F.lit("id").alias("kind")))).alias("more"))
    )


def find_spans(docs: DataFrame, keep: list[str], text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(keep, base, spans): arrays of struct<start, order, end, low, high, kind> (low and high in bytes), by start, then kind; spans are base
    and induced."""
    found = written(_found(docs, keep, text_col), "found")
    more = _induced(found, rounds)
    plain = found.filter("_key IS NULL").select(*keep, "base", F.col("base").alias("spans"))
    with_tokens = found.filter("_key IS NOT NULL").join(more, "_key", "left")
    joined = with_tokens.select(*keep, "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))
    return plain.unionByName(joined)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The op6 result."""
    spans = find_spans(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs with every span of text_col replaced by [KIND] (overlapping spans by that of the first); null stays null."""
    keyed = docs.withColumn("__fs_sha", F.when(F.col(text_col).rlike("[0-9@]"), F.sha2(text_col, 256)))
    spans = find_spans(keyed.filter("__fs_sha IS NOT NULL"), ["__fs_sha"], text_col, rounds).filter(F.size("spans") > 0).select("__fs_sha", F.col("spans").alias("__fs_spans")).dropDuplicates(["__fs_sha"])
    some = keyed.filter("__fs_sha IS NOT NULL").join(spans, "__fs_sha", "left")
    text = F.col(text_col)

    def cut(raw: Column) -> Column:
        """By bytes: a substring of a binary value is found without reading what stands before it."""
        piece = lambda low, high: F.substring(raw, low + 1, high - low).cast("string")

        def pieces(spans: Column) -> Column:
            at = running(F.transform(spans, lambda s: s.high), lambda a, v: F.greatest(a, v), F.lit(0))
            put = F.zip_with(spans, at, lambda s, a: F.when(s.low >= a, F.concat(piece(a, s.low), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(""))
            return F.concat(F.array_join(put, ""), piece(F.array_max(F.transform(spans, lambda s: s.high)), F.octet_length(raw)))

        return bound(F.col("__fs_spans"), pieces)

    parts = bound(text.cast("binary"), cut)
    done = some.withColumn(text_col, F.when(F.col("__fs_spans").isNull(), text).otherwise(parts)).select(docs.columns)
    return done.unionByName(keyed.filter("__fs_sha IS NULL").select(docs.columns))
