"""Runs of repeated words against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lumbra.llm import registry
from lumbra.llm.period_runs import branching_squares, common_prefix, common_suffix, find_runs, maximal_runs, suffix_order, word_codes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=12):
    """Every maximal stretch by every period, from how far words and those a period later agree; smaller periods first."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(least, 2 * q):
                found.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def slow_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def random_text(rng):
    kind, size = rng.randrange(4), rng.randrange(60)
    letters = "ab" if kind == 0 else "abc" if kind == 1 else "abcdefghij"
    words = [rng.choice(letters) for _ in range(size)]
    if kind == 3:
        words = words[: rng.randrange(1, 9)] * rng.randrange(2, 9) + words[:7]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_plain_search(seed):
    rng = random.Random(seed)
    texts = [random_text(rng) for _ in range(30)]
    least = rng.choice([1, 2, 3, 5, 7, 12, 13, 20])
    codes, starts = word_codes([[w.encode() for w in t] for t in texts])
    start, length, period = maximal_runs(codes, least)
    want = [(int(starts[k]) + s, n, q) for k, t in enumerate(texts) for s, n, q in slow_runs(t, least)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_suffixes_and_common_parts():
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(8)]
    codes, _ = word_codes([[w.encode() for w in t] for t in texts])
    order, ranks = suffix_order(codes)
    plain = codes.tolist()
    assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    assert ranks[-1][order].tolist() == list(range(len(plain)))
    for _ in range(500):
        x, y = sorted(rng.sample(range(len(plain)), 2))
        ahead = next(k for k in range(len(plain)) if y + k == len(plain) or plain[x + k] != plain[y + k])
        behind = next(k for k in range(len(plain)) if k == x or plain[x - 1 - k] != plain[y - 1 - k])
        assert common_prefix(ranks, np.array([x]), np.array([y]))[0] == ahead and common_suffix(ranks, np.array([x]), np.array([y]))[0] == behind


def test_branching_squares_equal_plain_search():
    rng = random.Random(2)
    codes, _ = word_codes([[w.encode() for w in random_text(rng)] for _ in range(10)])
    i, d, _ = branching_squares(codes)
    plain, n = codes.tolist(), len(codes)
    want = {(x, k) for x in range(n) for k in range(1, (n - x) // 2 + 1) if plain[x : x + k] == plain[x + k : x + 2 * k] and plain[x + k] != plain[x + 2 * k : x + 2 * k + 1]}
    want = {(x, k) for x, k in want if x + 2 * k < n and plain[x + k] != plain[x + 2 * k]}
    assert len(i) == len(want) and set(zip(i.tolist(), d.tolist(), strict=True)) == want


def test_nested_and_long_repeats():
    fib = ["a", "b"]
    for _ in range(18):
        fib.append(fib[-1] + fib[-2])
    for text in (fib[12], "a" * 700, ("ab" * 9 + "c") * 20, "a" * 40 + "b" + "a" * 40):
        codes, _ = word_codes([[c.encode() for c in text]])
        assert list(zip(*(v.tolist() for v in maximal_runs(codes)), strict=True)) == slow_runs(text)
    codes, _ = word_codes([[c.encode() for c in text] for text in (fib[18], "x" * 50_000)])
    start, length, period = maximal_runs(codes)
    assert (start[-1], length[-1], period[-1]) == (len(fib[18]) + 1, 50_000, 1) and len(start) > 100


def test_query_equals_plain_search(spark, tmp_path):
    rng = random.Random(3)
    odd = [None, "", " \t\n", "a", "é é é é é é é é é é é é é", "x " * 30_000, "a b\x0bc\ra b c a\nb\fc a b c", "u\x85v " * 12, "  lead " * 13, "\x00 " * 12, "a　b " * 12]
    rows = [(k, t) for k, t in enumerate(odd)] + [(None, "p q " * 9), (3, "a"), (3, "a")]
    rows += [(100 + k, " ".join(random_text(rng))) for k in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((slow_row(i, t if i != 5 else (t or "")[:0]) for i, t in rows if i != 5), key=repr)
    got = registry.op13_period_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.where("not doc_id <=> 5").collect()), key=repr) == want
    assert tuple(got.where("doc_id = 5").first())[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert sum(r[1] > 0 for r in want) > 30


def test_query_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    small = {i for i, t in rows if len(t or "") < 20_000}
    want = sorted(slow_row(i, t) for i, t in rows if i in small)
    got = [tuple(r) for r in registry.op13_period_runs(spark, SF).collect()]
    assert len(got) == len(rows)
    key = lambda r: r[0]
    assert sorted((r for r in got if r[0] in small), key=key) == sorted(want, key=key)


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go a b c a b c a b c a b c stop"), (2, None)], "id long, t string")
    got = {r["id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in find_runs(docs, id_col="id", text_col="t").collect()}
    assert got == {1: (14, [(1, 12, 3)], "go a b c stop"), 2: (0, [], "")}
    assert find_runs(docs.limit(0), id_col="id", text_col="t").collect() == []
