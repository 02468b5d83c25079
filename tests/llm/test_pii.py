"""Base spans against plain regular expressions, row by row."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumbra.llm import pii, registry
from lumbra.llm.pii import KINDS, LABELERS, estimate, find_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), n, m.end()) for n, k in enumerate(KINDS) for m in re.finditer(PATTERNS[k], text or "") if passes(k, m[0]))


def texts():
    rng = random.Random(3)
    out = [None, "", "a@b.co", "x a@b.com_c@d.com é.12@mail.example.com.", "1.2.3.4.5.6.7.8", "0000255.1.1.1 256.1.1.1 1.1.1.0999", "+1 (459) 555-9246 and +1 (459) 555-9246."]
    out += ["4111 1111 1111 1111", "4111-1111-1111-1111-4111-1111", "𝔸𝔹 4111111111111111 é", "9" * 5000, "1 2 " * 4000, "a" * 30000 + "@b.c", "a.b" * 9000, "+1" * 3000, "1." * 9000]
    for n in range(600):
        out.append("".join(rng.choice(["1", "4", "0", "255", ".", "-", " ", "@", "a.b", "+", "(", ")", "é", "𝔸", "\n", "4111111111111111", "_", "%"]) for _ in range(rng.randrange(40))))
    return out


def test_base_spans_equal_brute_force(spark):
    rows = [(n, t, "x") for n, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, spans string").repartition(3)
    got = [(r["doc_id"], [tuple(s[c] for c in ("start", "no", "end")) for s in r["spans"] if s["base"]]) for r in find_personal_data(docs).collect()]
    assert len(got) == len(rows) + 3
    for n, spans in got:
        assert spans == brute(rows[n][1]), rows[n][1]


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: brute(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op7_pii(spark, sf).collect():
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == n for s in want[r["doc_id"]]) for n in range(4)]


def test_labelers_add_what_base_patterns_miss(spark):
    rows = [(n, f"mail me: jo.doe{n}@mail.example.com or call +1 (212) 555-01{n:02d} now") for n in range(40)]
    rows += [(100, "contact: jane.roe (at) example (dot) com please"), (101, "nothing here: 12 of 99")]
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["base"]) for s in got[100]] == [("email", False)]
    assert got[101] == []


def sure(odds):
    return 1 / (1 + math.exp(-odds))


def slow_log_odds(rows):
    """Of rows ``kind, keys, p``: log odds of kinds, and of keys by kind, smoothed."""
    kinds, keys = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for kind, own, p in rows:
        kinds[kind][0] += p
        kinds[kind][1] += 1 - p
        for k in own:
            keys[kind, k][0] += p
            keys[kind, k][1] += 1 - p
    out = {f"{kind} prior": math.log((yes + 1) / (no + 1)) for kind, (yes, no) in kinds.items()}
    for (kind, k), (yes, no) in keys.items():
        out[k] = math.log((yes + 0.5) / (kinds[kind][0] + 2)) - math.log((no + 0.5) / (kinds[kind][1] + 2))
    return out


def test_estimate_equals_plain_em(spark):
    rng = random.Random(6)
    spans = []
    for _ in range(400):
        kind, true = rng.choice(KINDS[:3]), rng.random() < 0.4
        votes = [rng.choices([1 if true else -1, -1 if true else 1, 0], [r, 1 - r, 0.2])[0] for r in (0.9, 0.8, 0.7, 0.6, 0.55, 0.5)]
        spans.append((kind, votes, [f"{kind} length {rng.randrange(3) + 2 * true}", f"{kind} before {rng.choice(['space', 'sign'])}"]))
    labelers, classifier = estimate(spark.createDataFrame(spans, "kind string, votes array<int>, features array<string>"), rounds=4)
    keys = [[f"{kind} {name} {v}" for name, v in zip(LABELERS, votes, strict=True)] for kind, votes, _ in spans]
    p = [sure(sum(votes)) for _, votes, _ in spans]
    for _ in range(4):
        want = slow_log_odds([(kind, own, x) for (kind, _, _), own, x in zip(spans, keys, p, strict=True)])
        p = [sure(want[f"{kind} prior"] + sum(want[k] for k in own)) for (kind, _, _), own in zip(spans, keys, strict=True)]
    assert labelers == pytest.approx(want)
    taught = slow_log_odds([(kind, features + own, x) for (kind, _, features), own, x in zip(spans, keys, p, strict=True)])
    assert classifier == pytest.approx(taught)
    assert taught["email length 4"] > 1 > taught["email length 0"]
    assert estimate(spark.createDataFrame([], "kind string, votes array<int>, features array<string>")) == ({}, {})


def test_running_values(spark):
    rows = [(n, [random.Random(n).randrange(100) for _ in range(n)]) for n in (0, 1, 2, 3, 7, 30, 101)]
    got = spark.createDataFrame(rows, "n int, v array<long>").select("n", "v", pii._running(F.col("v"), lambda a, x: a + x, F.lit(0).cast("long")).alias("sums"), pii._running(F.col("v"), lambda a, x: F.greatest(a, x), F.lit(-1).cast("long")).alias("tops")).collect()
    for r in got:
        assert r["sums"] == [sum(r["v"][:k]) for k in range(r["n"])] and r["tops"] == [max(r["v"][:k], default=-1) for k in range(r["n"])]


def test_loose_spans_apart_from_base_ones(spark):
    rng = random.Random(9)
    span = "array<struct<start:long,end:long,value:string,before:string,after:string>>"
    rows = []
    for n in range(60):
        pick = lambda most: sorted((a, a + rng.randrange(1, 9), "v", "b", "a") for a in {rng.randrange(80) for _ in range(rng.randrange(most))})  # noqa: B023, E731
        rows.append((n, pick(6), pick(6)))
    docs = spark.createDataFrame(rows, f"n int, loose {span}, base {span}")
    for r in docs.select("loose", "base", pii._apart(F.col("loose"), F.col("base")).alias("free")).collect():
        want = [s for s in r["loose"] if not any(t["start"] < s["end"] and s["start"] < t["end"] for t in r["base"])]
        assert sorted(r["free"]) == sorted(want)


def test_many_spans_in_one_text(spark):
    n = 3000
    text = " ".join(f"u{k}@m{k}.example.com 4111.1111.1111.{k:04d}" for k in range(n))
    [row] = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s["start"], s["end"]) for s in row["spans"] if s["base"]] == [(a, b) for a, _, b in brute(text)]


@pytest.mark.parametrize("schema", ["doc_id long, text string", "doc_id string, text string"])
def test_empty_table(spark, schema):
    assert find_personal_data(spark.createDataFrame([], schema)).collect() == []
