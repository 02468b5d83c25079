"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Everything on the data is a DataFrame expression.  The driver holds parameters only: a few
probabilities per kind, labeler and vote.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

KINDS = ["email", "ip", "card", "phone"]

#: What each kind's base spans match.  They are written for a single pass over long texts:
#: quantifiers are possessive where nothing could be given back, and a match starts where a
#: run of its first class starts, or where the match before it ended (\\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Other ways of writing the same things, which labelers must judge.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9 ().-]{7,18}[0-9]|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4})(?![0-9])",
}
#: Cheap tests that every text with a match passes.
_GATES = {
    "email": r"@|[\[({][aA][tT][\])}]", "ip": r"[0-9]\.[0-9]|:[0-9a-fA-F]{1,4}:", "card": r"[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]|00[1-9]|\([0-9]{3}\)",
}

#: Gazetteers: top-level domains, country calling codes, issuer prefixes of cards.
TLDS = "com org net edu gov mil int info biz io dev app me co ai uk de fr es pt it nl be ch at pl se no fi dk br mx ar cl us ca au nz in cn jp kr ru za eu".split()
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 220 221 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 502 503 504 505 506 507 509 591 593 595 598 852 853 855 880 886 961 962 965 966 971 972 974 977 994 995 998"
).split()
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3[0689]|35|6(?:011|4[4-9]|5)|62)"
#: Words in the 40 characters before a span, back to the match before it, that speak for or against personal data.
FOR = r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|kontakt|phone|tel|call|fax|mobile|telefon|téléphone|teléfono|whatsapp|ip|host|server|address|adresse|dirección|card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)\b"
AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|order|invoice|ticket|total|sum|id|sha|md5|hash|commit|token|serial|model|section|chapter|page|figure|table)\b"

LABELERS = ["pattern", "format", "gazetteer", "context", "edges", "variety"]
ROUNDS = 10
_SPAN = "struct<start:long,no:int,end:long,kind:string,base:boolean,votes:array<int>,features:array<string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` (or lambdas in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each of some values, ``op`` over ``start`` and all values before it.

    In blocks of the square root of their number: totals of blocks, those before each block,
    then those within, so that n values take n times the square root of n steps.
    """
    total = lambda part, first: F.aggregate(part, first, lambda acc, x: op(acc, x))
    cut = lambda v, w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.size(v) / w).cast("int")) - 1), lambda k: F.slice(v, k * w + 1, w))
    ahead = lambda blocks: _let(F.transform(blocks, lambda part: total(part, start)), lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k), start)))
    within = lambda blocks: F.flatten(F.zip_with(blocks, ahead(blocks), lambda part, first: F.transform(part, lambda _, k: total(F.slice(part, F.lit(1), k), first))))
    width = lambda v: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
    return _let(values, lambda v: _let(_let(width(v), lambda w: cut(v, w)), within))


def _spans(found: Column, between: Column) -> Column:
    """``start, end`` (code points), ``value``, and up to 40 characters before and one after, of matches, from the matches and the texts between them.

    What stands before is read from the text between two matches and the match before that,
    so that no span looks through the whole text.
    """

    def spans(f: Column, b: Column) -> Column:
        sizes = F.zip_with(F.slice(b, F.lit(1), F.size(f)), f, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        through = _running(sizes, lambda acc, x: acc + x, F.lit(0).cast("long"))

        def span(value: Column, k: Column, t: Column) -> Column:
            gap, following = F.get(b, k), F.get(b, k + 1)
            start = F.get(t, k) + F.length(gap)
            before = F.right(F.concat(F.when(k == 0, "").otherwise(F.get(f, F.greatest(k - 1, F.lit(0)))), gap), F.lit(40))
            after = F.left(F.when(following == "", F.coalesce(F.get(f, k + 1), F.lit(""))).otherwise(following), F.lit(1))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), before.alias("before"), after.alias("after"))

        return _let(through, lambda t: F.transform(f, lambda value, k: span(value, k, t)))

    none = F.array().cast("array<struct<start:long,end:long,value:string,before:string,after:string>>")
    return F.when(F.size(found) == 0, none).otherwise(_let(found, lambda f: _let(between, lambda b: spans(f, b))))


def _apart(loose: Column, base: Column) -> Column:
    """The loose spans that overlap no base span.

    In order of start, a loose span overlaps one before it if the largest end so far is
    beyond its start, and one after it if the next base span starts before its end.
    """
    far = F.lit(2**62).cast("long")
    none = F.lit(None).cast("struct<start:long,end:long,value:string,before:string,after:string>")
    tagged = lambda spans, mark: F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(mark).alias("loose"), s["end"].alias("to"), (s if mark else none).alias("span")))

    def free(order: Column) -> Column:
        ends = F.transform(order, lambda s: F.when(s["loose"] == 0, s["to"]).otherwise(F.lit(-1).cast("long")))
        starts = F.transform(F.reverse(order), lambda s: F.when(s["loose"] == 0, s["at"]).otherwise(far))
        reach = _running(ends, lambda acc, x: F.greatest(acc, x), F.lit(-1).cast("long"))
        following = F.reverse(_running(starts, lambda acc, x: F.least(acc, x), far))
        alone = lambda s, k, r, f: (s["loose"] == 1) & (F.get(r, k) <= s["at"]) & (F.get(f, k) >= s["to"])
        return _let(reach, lambda r: _let(following, lambda f: F.transform(F.filter(order, lambda s, k: alone(s, k, r, f)), lambda s: s["span"])))

    some = (F.size(base) > 0) & (F.size(loose) > 0)
    return F.when(some, _let(F.array_sort(F.concat(tagged(base, 0), tagged(loose, 1))), free)).otherwise(loose)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """The check that a base match of a kind must pass."""
    n = F.length(_digits(value))
    if kind == "ip":
        # leading zeros don't count, so at most three digits are left of a part of at most 255
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """+1, -1 or, if ``no`` is given and neither holds, 0."""
    vote = F.when(yes, 1)
    return (vote.otherwise(-1) if no is None else vote.when(no, -1).otherwise(0)).cast("int")


def _votes(kind: str, value: Column, base: Column, before: Column, after: Column) -> Column:
    """One vote of each labeler, in the order of LABELERS."""
    digits, lower = _digits(value), F.lower(value)
    if kind == "email":
        form = lower.rlike(r"[.\])}] ?[a-z]{2,12}$")
        known = F.regexp_extract(lower, r"([a-z0-9-]+)$", 1).isin(TLDS)
    elif kind == "ip":
        form = (_holds("ip", value) & ~value.rlike(r"(?:^|\.)0[0-9]")) | value.contains(":")
        known = ~value.rlike(r"^(?:0|24[0-9]|25[0-9])\.")
    elif kind == "card":
        form = F.call_function("luhn_check", digits) & F.length(digits).between(13, 19)
        known = digits.rlike(ISSUERS)
    else:
        form = F.length(digits).between(10, 15)
        known = F.regexp_replace(digits, "^00", "").rlike(f"^(?:{'|'.join(CALLING)})") & value.rlike(r"^(?:\+|00)")
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(lower, "[^0-9a-z]", ""), ""))) >= 4
    glued = before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")
    return F.array(
        _vote(base, F.lit(False)), _vote(form), _vote(known), _vote(before.rlike(FOR) & ~before.rlike(AGAINST), before.rlike(AGAINST)), _vote(~glued), _vote(variety)
    )


def _features(kind: str, value: Column, before: Column, after: Column) -> Column:
    """Names of what the classifier sees of a span; few in all."""
    n = F.length(value)
    share = F.floor(4 * F.length(_digits(value)) / F.greatest(n, F.lit(1)))
    side = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}]"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("sign")
    return F.array(
        F.concat(F.lit(f"{kind} length "), F.floor(F.least(n, F.lit(63)) / 8)),
        F.concat(F.lit(f"{kind} digits "), share),
        F.concat(F.lit(f"{kind} before "), side(F.right(before, F.lit(1)))),
        F.concat(F.lit(f"{kind} after "), side(F.left(after, F.lit(1)))),
    )


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id and ``spans``, the base spans and the loose candidates that overlap none of them."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    for kinds, kept in ((BASE, "b"), (LOOSE, "l")):
        rows = rows.withColumns({f"_{kept}m_{k}": F.when(F.col("_text").rlike(_GATES[k]), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none) for k, p in kinds.items()})
        rows = rows.withColumns({f"_{kept}s_{k}": F.when(F.size(f"_{kept}m_{k}") > 0, F.split("_text", p, -1)).otherwise(none) for k, p in kinds.items()})
    # most texts have none; with the columns above in hand, spans are made for the others only
    rows = rows.drop("_text").withColumns({f"_{kept}_{k}": _spans(F.col(f"_{kept}m_{k}"), F.col(f"_{kept}s_{k}")) for kept in "bl" for k in KINDS})
    passing = lambda k: F.filter(f"_b_{k}", lambda s: _holds(k, s["value"]))
    rows = rows.withColumns({f"_b_{k}": passing(k) for k in KINDS})
    base = F.concat(*[F.transform(f"_b_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    rows = rows.withColumn("_taken", base).withColumns({f"_l_{k}": _apart(F.col(f"_l_{k}"), F.col("_taken")) for k in KINDS})

    def judged(kind: str, base: bool) -> Column:
        def one(s: Column) -> Column:
            return F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                _votes(kind, s["value"], F.lit(base), s["before"], s["after"]).alias("votes"), _features(kind, s["value"], s["before"], s["after"]).alias("features"),
            )

        return F.transform(f"_{'b' if base else 'l'}_{kind}", one)

    found = F.concat(*[judged(k, base) for base in (True, False) for k in KINDS]).cast(f"array<{_SPAN}>")
    return rows.select(F.col("_id").alias(id_col), found.alias("spans"))


def _lookup(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,double>")


def _score(weights: Column, keys: Column, kind: Column) -> Column:
    """Probability from the sum of log odds of a kind and of keys."""
    odds = F.aggregate(keys, F.coalesce(weights[F.concat(kind, F.lit(" prior"))], F.lit(0.0)), lambda acc, k: acc + F.coalesce(weights[k], F.lit(0.0)))
    return 1 / (1 + F.exp(-odds))


def _vote_keys(kind: Column, votes: Column) -> Column:
    return F.transform(votes, lambda v, i: F.concat_ws(" ", kind, F.element_at(F.array(*map(F.lit, LABELERS)), i + 1), v.cast("string")))


def _log_odds(soft: DataFrame) -> dict[str, float]:
    """From rows ``kind, keys, n, p``: log odds of kinds and of keys under soft labels, smoothed.

    Keys name a kind and one of a few values, so the table that comes back is small whatever
    the input.
    """
    each = soft.select("kind", F.explode(F.concat(F.array(F.concat("kind", F.lit(" prior"))), "keys")).alias("key"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
    sums = each.groupBy("kind", "key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    prior = {r["kind"]: (r["yes"] + 1, r["no"] + 1) for r in sums if r["key"].endswith(" prior")}
    out = {}
    for r in sums:
        yes, no = prior[r["kind"]]
        if r["key"].endswith(" prior"):
            out[r["key"]] = math.log(yes / no)
        else:
            out[r["key"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    return out


def estimate(spans: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, float]]:
    """Labelers' log odds by EM, and the classifier's trained on the labels that these give.

    ``spans`` has ``kind, votes, features``.  Equal rows are counted first: votes and
    features have few values, so EM's rounds run over a table of bounded size.  It starts
    from the balance of votes; a labeler's reliability is its chance of each vote given
    personal data or not, by kind.
    """
    counted = materialise(spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "votes")
    patterns = materialise(counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).withColumn("keys", _vote_keys(F.col("kind"), F.col("votes"))), "vote-patterns")
    balance = F.aggregate("votes", F.lit(0), lambda acc, v: acc + v)
    soft = patterns.withColumn("p", 1 / (1 + F.exp(-balance.cast("double"))))
    labelers: dict[str, float] = {}
    for _ in range(rounds):
        labelers = _log_odds(soft)
        if not labelers:
            return {}, {}
        soft = patterns.withColumn("p", _score(_lookup(labelers), F.col("keys"), F.col("kind")))
    taught = counted.withColumn("p", _score(_lookup(labelers), _vote_keys(F.col("kind"), F.col("votes")), F.col("kind")))
    seen = taught.withColumn("keys", F.concat("features", _vote_keys(F.col("kind"), F.col("votes"))))
    return labelers, _log_odds(seen)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: its id and ``spans``, ordered by start, then kind.

    A span has ``start, end`` (code points, end exclusive), ``kind``, ``base`` and ``score``.
    Base spans always stay; loose ones that overlap none are added if the classifier gives
    them ``least`` or more.  Null texts count as empty and have no spans; repeated rows are
    reported each; an empty table gives no rows; other columns are not read.
    """
    found = materialise(_candidates(docs, id_col, text_col), "pii-candidates")
    each = found.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    _, classifier = estimate(each)
    weights = _lookup(classifier)
    keys = lambda s: F.concat(s["features"], _vote_keys(s["kind"], s["votes"]))
    scored = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), _score(weights, keys(s), s["kind"]).alias("score")))
    kept = F.filter(F.array_sort(scored), lambda s: s["base"] | (s["score"] >= least))
    return found.select(id_col, kept.alias("spans"))
