"""Licence scan, mixture, line dedup and fingerprints against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumbra.llm import registry
from lumbra.llm.fingerprints import fingerprint_documents
from lumbra.llm.license_rules import BASE, Rule, default_rules
from lumbra.llm.license_scan import Scanner, scan_licenses
from lumbra.llm.line_dedup import drop_common_lines
from lumbra.llm.mixture import draw_mixture, mix_sources, source_targets
from lumbra.llm.words import hash_words, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ODD = [None, "", " ", "\n", "é", "İ K", "Under the MIT License under the mit-license. Apache License, Version 2.0", "CC-BY-NC cc by nc nd", "x" * 100_000, "a\n\n\nb\r\n c \x0b\n", "　a\x85b", "𝔸b 𝔸"]


def odd_docs(spark, extra=()):
    rows = [(n, t, f"s{n % 3}" if n % 4 else None, "clash") for n, t in enumerate([*ODD, *extra])]
    return spark.createDataFrame([*rows, *rows[5:7]], "doc_id long, text string, source string, size string").repartition(3)


def test_licence_base_places(spark):
    assert len(default_rules()) > 200
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text", "source", F.lit("x")).toDF("doc_id", "text", "source", "size"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = 0
    for r in scan_licenses(docs).collect():
        words = WORD.findall(lower(texts[r["doc_id"]]))
        assert r["n_words"] == len(words)
        want = sorted((k, label) for phrase, label in BASE.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p)
        assert sorted((d["first"], d["label"]) for d in r["detections"] if d["base"]) == want
        assert all(d["kept"] for d in r["detections"] if d["base"])
        seen += len(want)
    assert seen > 5


def test_licence_rules_and_suppression(spark):
    rows = [
        (1, "SPDX-License-Identifier: GPL-3.0"),
        (2, "Licensed under the Creative Commons Attribution-NonCommercial 4.0"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (4, "ein Haus mit Lizenz, und the general public version 2"),
        (5, "released under the terms of the GNU Lesser General Public License version 2.1"),
    ]
    got = {r["doc_id"]: {d["label"] for d in r["detections"] if d["kept"]} for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: {"gpl-3"}, 2: {"cc-by-nc"}, 3: {"mit"}, 4: set(), 5: {"lgpl-2.1"}}


def example(rng, tree):
    """A text that a parsed pattern may match."""
    out = ""
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                kind, value = rng.choice(arg)
                out += chr(value if str(kind) == "LITERAL" else rng.randint(*value)) if str(kind) != "CATEGORY" else "w"
            case "SUBPATTERN":
                out += example(rng, arg[3])
            case "BRANCH":
                out += example(rng, rng.choice(arg[1]))
            case "MAX_REPEAT":
                out += "".join(example(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
    return out


def test_licence_keywords_hide_no_match():
    rng, rules = random.Random(3), default_rules()
    scanner, seen = Scanner(rules), 0
    for rule in rules:
        for text in {example(rng, re._parser.parse(rule.pattern)) for _ in range(40)}:
            if re.search(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])", text):
                seen += 1
                assert rule.name in {d["rule"] for d in scanner.scan(text.encode().split())}, (rule.name, text)
    assert seen > 3 * len(rules)


def test_licence_glued_names_and_titles():
    def labels(text):
        return {d["label"] for d in Scanner(default_rules()).scan(lower(text).encode().split()) if d["kept"]}

    glued = {"gpl2": "gpl-2", "gpl3": "gpl-3", "lgpl3": "lgpl-3", "lgplv3": "lgpl-3", "mplv2": "mpl-2", "apache2": "apache-2", "agpl3": "agpl-3", "freebsd": "bsd-2-clause"}
    assert {k: labels(f"licensed under {k}") for k in glued} == {k: {v} for k, v in glued.items()}
    titles = {"Mozilla Public License Version 2 0": "mpl-2", "Eclipse Public License 1 0": "epl-1", "Apache Software License 2 0": "apache-2", "MIT License": "mit"}
    assert {k: labels(k) for k in titles} == {k: {v} for k, v in titles.items()}
    assert labels("the ncsa met apache 2 0 and mit") == set()


def slow_resolved(found):
    """Which of ``(start, end, priority)`` stay, pair by pair."""
    outer = [k for k, x in enumerate(found) if not any(y[0] <= x[0] and x[1] <= y[1] and ((y[0], y[1]) != (x[0], x[1]) or (y[2], j) < (x[2], k)) for j, y in enumerate(found) if j != k)]
    kept = []
    for k in sorted(outer, key=lambda k: found[k][2]):
        if all(found[k][1] <= found[j][0] or found[j][1] <= found[k][0] for j in kept):
            kept.append(k)
    return {found[k] for k in kept}


def test_licence_overlaps_equal_brute_force():
    rng = random.Random(5)
    text = b"w " * 40
    for _ in range(300):
        spans = {(2 * a, 2 * (a + rng.randrange(1, 8)) - 1, p) for p, a in enumerate(rng.choices(range(30), k=rng.randrange(1, 9)))}
        rules = [(a, b, Rule(str(p), str(p), "w", "w", 1.0, p)) for a, b, p in spans]
        got = {(2 * d["first"], 2 * d["last"] + 1, int(d["rule"])) for d in Scanner._resolve(text, rules) if d["kept"]}
        assert got == slow_resolved(sorted(spans))


def test_licence_choices():
    def labels(text):
        return {d["label"] for d in Scanner(default_rules()).scan(lower(text).replace("-", " ").replace(":", " ").replace(".", " ").encode().split()) if d["kept"]}

    assert labels("dual licensed: GPL-2.0 OR MIT") == {"gpl-2", "mit"}
    assert labels("SPDX-License-Identifier: GPL-2.0 OR MIT OR Apache-2.0") == {"gpl-2", "mit", "apache-2"}
    assert labels("Dual-licensed under the MIT and Apache 2.0 licenses") == {"mit", "apache-2"}
    assert labels("wine or mit und cc or apache") == set()


def test_licence_scan_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert scan_licenses(docs).collect() == [] and scan_licenses(docs).columns == ["doc_id", "n_words", "detections"]


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 2 * sizes[s] * (1 + 1e-12) or sizes[s] == 0}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else min(2.0 * sizes[s], level * w[s]) for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{n}": rng.choice([0, 1, 5, rng.randrange(10**6)]) for n in range(rng.randrange(1, 12))} | {None: 7}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(rows, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mixture(spark):
    rng = random.Random(2)
    docs = odd_docs(spark, [" ".join("w" for _ in range(rng.randrange(300))) for _ in range(300)])
    got = mix_sources(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = docs.collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r["doc_id"], size(r["text"])) for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += size(r["text"])
    targets, taken, source_of = brute_targets(by), defaultdict(int), {r["doc_id"]: r["source"] for r in rows}
    for r in got:
        assert r["source_size"] == by[source_of[r["doc_id"]]] and r["target"] == pytest.approx(targets[source_of[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) < 1 for s in by)
    assert sorted(map(tuple, mix_sources(docs).collect())) == sorted(map(tuple, got))
    plain = docs.drop("size")
    drawn = draw_mixture(plain)
    assert drawn.columns == plain.columns
    words = drawn.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    assert all(abs((r["n"] or 0) - targets[r["source"]]) <= 300 for r in words)
    assert mix_sources(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = ["Common Line", " common line\t", "rare", "", "É x", "𝔸", "only"]
    docs = odd_docs(spark, ["\n".join(rng.choice([*lines, str(rng.random())]) for _ in range(rng.randrange(8))) for _ in range(60)])
    rows = docs.collect()
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    found = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            found[key(line)].add(r["doc_id"])
    gone = {k for k, ids in found.items() if k and len(ids) >= 10}
    assert gone
    want = []
    for r in rows:
        own = (r["text"] or "").split("\n")
        kept = [x for x in own if key(x) not in gone]
        want.append((r["doc_id"], len(own), len(own) - len(kept), "\n".join(kept)))
    got = drop_common_lines(docs)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept").collect()) == sorted(want)
    assert got.columns[:4] == docs.columns
    assert drop_common_lines(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    docs = odd_docs(spark, [f"doc {n} " + " ".join(random.Random(n // 2).choices([f"w{k}" for k in range(500)], k=200)) for n in range(40)])
    docs = docs.dropDuplicates(["doc_id"]).repartitionByRange(5, "doc_id")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    got = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for n, (key, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    long = [got[k] for k, t in rows if t.startswith("doc ") and k % 2]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.3 + sum(r["near_next"] for r in long) / len(long)
    assert fingerprint_documents(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert [(r["n_chars"], r["near_next"]) for r in fingerprint_documents(one).collect()] == [(7, 1.0)]


def scrambled(x):
    """Finaliser of splitmix64, by whole numbers."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def slow_print(text, terms):
    """88 hashes: subset 8 r + j keeps a term if bit 0 of byte j of r + 1 random numbers is set."""
    own = {int(h) for h in hash_words(words_of(text)).tolist()} & terms
    out = []
    for rate in range(11):
        for j in range(8):
            kept = [t for t in sorted(own) if all(scrambled((t + (r + 1) * 0x9E3779B97F4A7C15) % 2**64) >> 8 * j & 1 for r in range(rate + 1))]
            digest = scrambled(sum(scrambled(t ^ 0x51ED270B7A3F2C95) for t in kept) % 2**64) >> 48
            out.append(max(digest, 1) if kept else 0)
    return out


def slow_likeness(a, b):
    rates = []
    for r in range(11):
        pairs = [(x, y) for x, y in zip(a[8 * r : 8 * r + 8], b[8 * r : 8 * r + 8], strict=True) if x or y]
        rates.append((sum(x == y for x, y in pairs), len(pairs)))
    counted = [x for x in rates if x[1] >= 4][-2:] or rates
    total = sum(n for _, n in counted)
    return sum(m for m, _ in counted) / total if total else 0.0


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", "!!", "w1", "w1 w1", *(" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(60))]
    rows = [(n // 2, t, "x") for n, t in enumerate(texts)] + [(None, texts[9], None), (None, texts[10], None), (7, texts[14], "x"), (7, texts[14], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    band = (0.08, 0.4)
    df = defaultdict(int)
    for _, t, _ in rows:
        for h in set(hash_words(words_of(t)).tolist()):
            df[int(h)] += 1
    terms = {h for h, n in df.items() if n >= max(2, band[0] * len(rows)) and n <= max(30, band[1] * len(rows))}
    assert 50 < len(terms) < len(df)
    prints = {t: slow_print(t, terms) for t in {t or "" for _, t, _ in rows}}
    hexed = {t: "".join(f"{x:04x}" for x in p) for t, p in prints.items()}
    got = fingerprint_documents(docs, band=band).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    want = defaultdict(list)
    for k, t, _ in rows:
        want[k].append(hexed[t or ""])
    assert {k: sorted(r["fingerprint"] for r in v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    ids = sorted(by, key=lambda k: (k is not None, k or 0))
    text_of = {h: t for t, h in hexed.items()}
    single = [k for k in ids if k is not None and len(by[k]) == 1]
    for k in single:
        r, follow = by[k][0], by[ids[(ids.index(k) + 1) % len(ids)]]
        own = next(t or "" for i, t, _ in rows if i == k)
        cut = len(own) // 4
        edited = [(own[: len(own) - cut] + text[:cut], text) for text in {text_of[f["fingerprint"]] for f in follow}]
        edited = next(x for x in edited if hashlib.sha256(x[0].encode()).hexdigest() == r["edited_sha256"])
        changed = slow_print(edited[0], terms)
        assert r["edited_fingerprint"] == "".join(f"{x:04x}" for x in changed)
        assert r["near_edited"] == pytest.approx(1.0 if edited[0] == own else slow_likeness(prints[own], changed))


def test_queries_give_all_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for f in (registry.op1_license_scan, registry.op2_mix_sources, registry.op3_line_dedup, registry.op5_fingerprints):
        assert f(spark, SF).count() == n
