"""Near-duplicates, quality, packing, token files, top-k and the pipeline against plain Python."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumbra.llm import packing, quality, registry
from lumbra.llm.components import connected_components
from lumbra.llm.near_dedup import REGISTERS, keep_one_of_each, near_duplicates, prob_minhash, similarity, weighted_shingles
from lumbra.llm.packing import Island, _evolved, cut_pieces, least_bins, pack_documents, pack_pieces
from lumbra.llm.quality import cut, keep_good, score_quality, train_quality
from lumbra.llm.storage import shared_dir
from lumbra.llm.token_files import Shard, pack_shard, read_token_shards, write_token_shards
from lumbra.llm.tokens import cut_at_spaces, vocabulary
from lumbra.llm.topk_index import BlockIndex, build_index, postings_of, quantise, search_top_k

SF = "/root/testdata/sf0.001"


def slow_similarity(a, b):
    """Both definitions, written out."""
    x, y = (dict(zip(s[0].tolist(), s[1].tolist(), strict=True)) for s in (a, b))
    both, every = x.keys() & y.keys(), x.keys() | y.keys()
    weighted = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in both)
    return max(weighted, len(both) / len(every) if every else 0)


def copies(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def near_docs():
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    texts = [None, "", "  ", "!!!", "one", "One.", "a b c d", "A, b c d"]
    base = prose(120)
    texts += [base, base.upper(), base + "!"] + [copies(rng, base, 1) for _ in range(40)] + [copies(rng, base, 3) for _ in range(30)] + [copies(rng, base, 8) for _ in range(10)]
    chain = prose(200)
    for _ in range(12):
        chain = copies(rng, chain, 2)
        texts.append(chain)
    passage = prose(60)
    texts += [passage + " " + prose(60) for _ in range(30)] + [prose(80) for _ in range(40)] + ["la " * n for n in (10, 20, 400)] + [prose(30) * 3]
    return texts


def test_similarity():
    rng = random.Random(1)
    for _ in range(60):
        a, b = (weighted_shingles(" ".join(rng.choices("abc", k=rng.randrange(1, 30)))) for _ in range(2))
        assert similarity(a, b) == pytest.approx(slow_similarity(a, b))


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(3)
    x = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = (x[:300], rng.integers(1, 6, 300)), (x[60:], rng.integers(1, 6, 340))
    a, b = (tuple(v[np.argsort(s[0])] for v in s) for s in (a, b))
    registers = 4000
    got = prob_minhash(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]).astype(float), np.repeat([0, 1], [300, 340]), 2, registers)
    common, at, bt = np.intersect1d(a[0], b[0], return_indices=True)
    every = {k: (0, 0) for k in [*a[0].tolist(), *b[0].tolist()]}
    wa, wb = dict(zip(a[0].tolist(), a[1].tolist(), strict=True)), dict(zip(b[0].tolist(), b[1].tolist(), strict=True))
    jp = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in every) for i in common.tolist())
    assert abs((got[0] == got[1]).mean() - jp) < 5 * math.sqrt(jp * (1 - jp) / registers)
    assert REGISTERS == 125


def test_near_duplicates_equal_brute_force(spark):
    texts = near_docs()
    rows = [(n, t, "x") for n, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], rows[9], rows[50]], "doc_id long, text string, tid string").repartition(4)
    sets, parent = [weighted_shingles(t) for t in texts], list(range(len(texts)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            alike = similarity(sets[i], sets[j]) >= 0.8 if len(sets[i][0]) and len(sets[j][0]) else not len(sets[i][0]) and not len(sets[j][0]) and (texts[i] or "") == (texts[j] or "")
            if alike and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [root(n) for n in range(len(texts))]
    got = near_duplicates(docs).collect()
    assert len(got) == len(texts) + 3
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(want))
    counts = Counter(want[r["doc_id"]] for r in got)
    assert all(r["class_size"] == counts[r["class_id"]] for r in got)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one_of_each(docs.limit(0)).count() == 0


def test_near_duplicates_with_repeated_passages(spark):
    rng = random.Random(12)
    prose = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    rows = []
    for n in range(12):
        passage, rest = prose(), prose()
        rows += [(3 * n, f"{passage} {rest}"), (3 * n + 1, f"{passage} " * 10 + rest), (3 * n + 2, prose())]
    assert all(similarity(weighted_shingles(rows[3 * n][1]), weighted_shingles(rows[3 * n + 1][1])) > 0.9 for n in range(12))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {k: k - (k % 3 == 1) for k in range(36)}


def test_near_duplicates_miss_none_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    sets = [weighted_shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for n, (shingles, _) in enumerate(sets):
        for h in shingles.tolist():
            holders[h].append(n)
    near = {(a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k]}
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    links = [(a, b) for a, b in near if similarity(sets[a], sets[b]) >= 0.8]
    links += [(a, b) for b in range(len(rows)) for a in range(b) if not len(sets[a][0]) and not len(sets[b][0]) and rows[a][1] == rows[b][1]]
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    found = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in links)
    assert len(links) > 80 and found >= 0.99 * len(links)
    want = {rows[n][0]: rows[root(n)][0] for n in range(len(rows))}
    assert all(want[k] == want[c] for k, c in got.items())


def test_components(spark):
    rng = random.Random(8)
    links = [(n, n + 1) for n in range(50)] + [(100, n) for n in range(101, 160)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-2, "x" * 50_000, "en", "s", None)], docs.schema)
    held = labels.where("doc_id % 3 = 0")
    model = train_quality(docs, labels.where("doc_id % 3 <> 0"))
    scored = score_quality(docs.unionByName(odd), model)
    rows = scored.join(held, "doc_id").collect()
    good, bad = ([r["accepted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 80 and sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.35
    assert scored.count() == docs.count() + 3 and all(0 <= r["score"] <= 1 for r in scored.collect())
    none = train_quality(docs, labels.limit(0))
    assert score_quality(odd, none).where("accepted").count() == 3 and score_quality(docs.limit(0), none).count() == 0


def test_quality_learns_from_all_unlabelled(spark, monkeypatch):
    rng, seen = random.Random(11), []
    prose = lambda: " ".join(rng.choices(["river", "stone", "garden", "letter", "music", "winter"], k=30))
    junk = lambda: "$$$ " * 12 + "BUY 99 " * 12
    rows = [(n, prose() if n % 2 else junk(), "en", "s", None) for n in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = docs.where("doc_id < 100").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    real = quality.co_train

    def spy(views, y, held, exchange, *bounds):
        ones = quality.Linear(np.zeros(1), np.ones(1), np.zeros(1), 0.0)

        class Sure(quality.Linear):
            def odds(self, x):
                return np.full(len(x), 9.0)

        sure = Sure(ones.mean, ones.scale, ones.weights, 0.0)
        seen.extend(len(told) for _, told in exchange([sure, sure], [1, 10_000]))
        return real(views, y, held, exchange, *bounds)

    monkeypatch.setattr(quality, "co_train", spy)
    train_quality(docs, labels)
    assert seen == [5900, 5900]


def test_quality_is_fitted_without_copies_of_the_features():
    rng = np.random.default_rng(4)
    x, y, weight = rng.random((3000, 600), dtype=np.float32), (rng.random(3000) < 0.5).astype(float), np.ones(3000)
    plain = quality.fit(x.copy(), y, weight, steps=5)
    # every step with whole matrices, written out
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-3)
    w = np.concatenate([rng.random(598), [0.0, 1.0]])
    assert np.allclose(quality._times(z, w), z.astype(float) @ w, rtol=0, atol=1e-9) and np.allclose(quality._summed(z, y), z.T.astype(float) @ y, rtol=0, atol=1e-9)
    size = x.nbytes
    tracemalloc.start()
    spent = quality.fit(x, y, weight, steps=5, spend=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < size / 2 and np.array_equal(plain.weights, spent.weights) and plain.bias == spent.bias


def test_quality_features_are_fetched_in_parts(spark, monkeypatch):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")

    def whole(*_):
        raise AssertionError("fetched as a whole")

    monkeypatch.setattr(type(docs), "toArrow", whole)
    assert len(train_quality(docs, labels, rounds=1).views) == 2


def slow_text_view(text):
    """Features of one text, one after the other."""
    data, words = text.encode(), []
    for piece in cut_at_spaces(pa.array([text]))[0].to_pylist():
        words.append(piece)
    grams = Counter((((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761) % 2**32) >> 22 for k in range(len(data) - 2))
    total = max(1, len(data) - 2)
    out = [math.sqrt(grams[k] / total) for k in range(1024)]
    out.append(-sum(n / total * math.log(n / total) for n in grams.values()) / math.log(1024))
    out.append(max(grams.values(), default=0) / total)
    some = max(1, len(words))
    out += [len(set(words)) / some, max(Counter(words).values(), default=0) / some, sum(a == b for a, b in zip(words, words[1:], strict=False)) / some, min(len(words), 50) / 50]
    lines = text.split("\n")
    out += [math.log1p(len(lines)) / 6, math.log1p(len(data) / len(lines)) / 8, len(set(lines)) / len(lines)]
    kinds = ["\t\n\x0b\x0c\r ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-?", "!#$%&*+/<=>@[\\]^_`{|}~"]
    return out + [sum(chr(b) in k for b in data) / max(1, len(data)) for k in kinds]


def test_quality_features_equal_slow_ones():
    texts = [None, "", "a", "ab", "a b a  a\n\nx x", "É𝔸 ß!", "BUY 99 $$$ " * 40, "the cat. The cat, the\tcat\n" * 9, *(" ".join(random.Random(n).choices(["x", "yy", "é."], k=n)) for n in range(40))]
    got = quality.text_views(pa.array(texts))
    assert got.shape[1] == len(slow_text_view(""))
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(slow_text_view(text or ""), abs=1e-5)
    assert quality.text_views(pa.array(texts).slice(5, 7)) == pytest.approx(got[5:12])
    assert quality.text_views(pa.array([], pa.string())).shape == (0, got.shape[1])


def test_quality_equals_training_in_one_process(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train_quality(docs, labels, rounds=2, exchanged=60, certain=0.8)
    table = docs.withColumn("_h", F.xxhash64(F.lit(6), "doc_id")).toArrow().sort_by("_h")
    ids, hashes = table["doc_id"].to_pylist(), dict(zip(table["doc_id"].to_pylist(), table["_h"].to_pylist(), strict=True))
    text = dict(zip(ids, quality.text_views(table["text"].combine_chunks()), strict=True))
    page = {r["doc_id"]: quality.page_view(r["source"], r["lang"], r["n_chars"]) for r in table.select(["doc_id", "source", "lang", "n_chars"]).to_pylist()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] in text}
    known, taken = [k for k in ids if k in y], (set(), set())

    def exchange(models, many):
        out = []
        for to in (0, 1):
            view, model = (page, models[1]) if to == 0 else (text, models[0])
            p = {k: float(1 / (1 + np.exp(-model.odds(view[k][None, :])[0]))) for k in ids if k not in y}
            told = {}
            for value in (0, 1):
                order = sorted((k for k in p if (p[k] if value else 1 - p[k]) >= 0.8), key=lambda k: (-(p[k] if value else 1 - p[k]), hashes[k]))
                told |= dict.fromkeys([k for k in order if k not in taken[to] and k not in told][: many[value]], value)
            taken[to].update(told)
            rows = sorted(told, key=hashes.get)
            own = (text, page)[to]
            out.append((np.array([own[k] for k in rows]).reshape(-1, len(own[ids[0]])), np.array([told[k] for k in rows], float)))
        return out

    held = np.array([hashes[k] % 10 < 3 for k in known])
    want = quality.co_train([np.stack([v[k] for k in known]) for v in (text, page)], np.array([y[k] for k in known], float), held, exchange, 2, 60)
    assert model.threshold == pytest.approx(want.threshold, abs=0.02) and sum(map(len, taken)) > 20
    scores = want.scores(np.stack([text[k] for k in ids]), np.stack([page[k] for k in ids]))
    got = {r["doc_id"]: r for r in score_quality(docs, model).collect()}
    assert len(got) == len(ids)
    for n, name in enumerate(("text_score", "page_score", "score")):
        assert np.abs(np.array([got[k][name] for k in ids]) - scores[n]).max() < 0.03
    assert all(r["accepted"] == (r["score"] >= model.threshold) for r in got.values())


def test_quality_odd_columns(spark):
    schema = "doc_id long, text string, source int, _h string, _y int, score double"
    rows = [(n, ("good words here now " if n % 2 else "!!! $$$ 99 ") * 5, n % 2, "x", 1, 0.5) for n in range(60)] + [(None, None, None, None, None, None), (1, None, 3, "x", 1, 0.5)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(n, n % 2) for n in range(50)] + [(3, 0), (None, 1), (51, None)], "doc_id long, quality int")
    model = train_quality(docs, labels, max_labelled=45)
    scored = score_quality(docs, model)
    assert scored.columns == ["doc_id", "text_score", "page_score", "score", "accepted"] and scored.count() == 62
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and 20 < kept.count() <= 40
    assert keep_good(docs.limit(0), model).count() == 0


def test_quality_cut_withstands_outliers():
    rng = np.random.default_rng(4)
    good, bad = rng.uniform(0.6, 1, 100), rng.uniform(0, 0.4, 50)
    scores, y = np.concatenate([good, bad, [0.001, 0.999]]), np.concatenate([np.ones(100), np.zeros(50), [1, 0]])
    assert 0.39 <= cut(scores, y) <= 0.61
    assert cut(np.array([0.2, 0.2, 0.2]), np.array([1.0, 0.0, 1.0])) == 0.0


def brute_tokens(texts, name, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


TEXTS = [None, "", " ", "\n\n a\tb  c\r\n", "<|endoftext|> x <|startoftext|>", "It's don't I'LL", "\x1c!\x1c　é ́", "!!! ! ! " * 300, "ab" * 9000, "word " * 9000, "É𝔸 ß"]


def shard_of(docs, base):
    ends = np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    return Shard(pack_shard(np.concatenate(docs), ends, base))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    texts = [*TEXTS, *(" ".join(random.Random(n).choices(["the", "cat", "sat"], k=n * 37 % 3000)) for n in range(120))]
    rows = [(n, t) for n, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = brute_tokens(texts, "word_bpe_49k.json", 1)
    want = Counter((n, k, at, len(tokens[n][at : at + 4096]), crc(tokens[n][at : at + 4096])) for n, _ in rows for k, at in enumerate(range(0, len(tokens[n]), 4096)))
    got = pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_over_many_shards(spark):
    rng = random.Random(6)
    rows = [(n, 0, min(4096, int(rng.lognormvariate(6, 1)) + 1)) for n in range(9000)]
    got = pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 4096, ["doc_id", "piece"]).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    least = -(-sum(r[2] for r in rows) // 4096)
    assert len(got) == 9000 and max(fill.values()) <= 4096 and len(fill) <= least + 2


def test_crossover_keeps_all_items():
    rng = random.Random(7)
    home = Island([rng.randrange(1, 60) for _ in range(200)], 100, 1)
    a, b = home.founder(False), home.pack(list(range(200)))
    for _ in range(20):
        child = home.cross(a, b)
        assert sorted(i for bin_ in child for i in bin_) == list(range(200)) and all(sum(home.lengths[i] for i in bin_) <= 100 for bin_ in child)
        a, b = b, child
    assert home.fitness(home.evolve([a])) >= home.fitness(a)


def triplets(rng, n, capacity=1000):
    """Items that fill ``n`` bins to the last token, three in each; best fit by falling length needs more bins."""
    items = []
    for _ in range(n):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (capacity - a) // 2)
        items += [a, b, capacity - a - b]
    rng.shuffle(items)
    return items


def test_evolution_beats_best_fit(spark):
    rng = random.Random(3)
    lengths = [triplets(rng, 20) for _ in range(3)]
    shards = spark.createDataFrame([(k, [(x, k) for x in row]) for k, row in enumerate(lengths)], "_shard long, _items array<struct<length:int,doc_id:int>>")
    rows = _evolved(shards, 1000, 0).collect()
    assert len(rows) == 3
    for r in rows:
        row = lengths[r["_shard"]]
        home, fill = Island(row, 1000, 0), Counter()
        for b, x in zip(r["_best"], row, strict=True):
            fill[b] += x
        assert max(fill.values()) <= 1000 and sorted(x["length"] for x in r["_items"]) == sorted(row)
        assert len(fill) < len(home.founder(False)) and r["_won"] > 0 and r["_crossed"] > r["_won"]


def test_epochs_of_packing_join_nothing(spark, monkeypatch):
    plans, real = [], packing.materialise

    def spy(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(packing, "materialise", spy)
    pieces = spark.createDataFrame([(k, x) for k, x in enumerate(triplets(random.Random(5), 60))], "doc_id long, length int")
    assert pack_pieces(pieces, 1000, ["doc_id"]).count() == 180
    assert len(plans) > 3 and not any("Join" in p for p in plans)


def slow_least(lengths, capacity):
    """The bound with every threshold tried."""
    best = -(-sum(lengths) // capacity)
    for c in range(1, capacity // 2 + 1):
        alone = [x for x in lengths if x > capacity - c]
        large = [x for x in lengths if capacity / 2 < x <= capacity - c]
        small = [x for x in lengths if c <= x <= capacity / 2]
        best = max(best, len(alone) + len(large) + max(0, -(-(sum(small) - (len(large) * capacity - sum(large))) // capacity)))
    return best


def test_least_bins():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([9, 10, 31, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 25))]
        assert least_bins(lengths, capacity) == slow_least(lengths, capacity)
        assert least_bins(lengths, capacity) <= len(Island(lengths, capacity, 1).founder(False))


def test_half_full_pieces_end(spark):
    rows = [(n, 0, 2100 + n % 7) for n in range(5000)]
    got = pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 4096, ["doc_id", "piece"])
    assert got.count() == 5000 and got.select("sequence_id").distinct().count() == 5000


def test_token_files_round_trip(spark, tmp_path):
    texts = [*TEXTS, *(" ".join(random.Random(n).choices(["alpha", "beta", "gamma"], k=50)) for n in range(200))]
    rows = [(n * 3 % 211, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "shards")
    write_token_shards(docs, path, vocabulary("byte_bpe_50k.json"), 0, 50_257, shard_ids=700)
    tokens, want, start = brute_tokens([t for _, t in sorted(rows)], "byte_bpe_50k.json", 0), [], 0
    for (key, _), ids in zip(sorted(rows, key=lambda r: r[0]), tokens, strict=True):
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, read_token_shards(spark, path).collect())) == sorted(want)
    assert spark.read.parquet(path).count() > 5
    write_token_shards(docs.limit(0), path + "0", vocabulary("byte_bpe_50k.json"), 0, 50_257)
    assert read_token_shards(spark, path + "0").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_shards_decode_at_random(seed):
    rng = np.random.default_rng(seed)
    kinds = [lambda n: rng.integers(0, 4, n), np.zeros, lambda n: np.tile([7, 8, 9], n)[:n], lambda n: rng.choice([0, 1, 2, 60_000], n)]
    docs = [kinds[rng.integers(4)](n).astype("<u4") for n in rng.integers(1, 400, 60)]
    shard = shard_of(docs, 60_001 if seed % 2 else 70_000)
    assert shard.n_tokens == sum(map(len, docs))
    for k in rng.permutation(60):
        assert shard.document(int(k)).tolist() == docs[k].tolist()
    assert len(shard.symbols) < shard.n_tokens
    ids, at = shard.documents()
    assert ids.tolist() == np.concatenate(docs).tolist() and np.diff(at).tolist() == [len(d) for d in docs]


def test_shards_replace_every_pair_that_pays():
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 50_000, 1000)
    docs = [np.concatenate([rng.integers(0, 50_000, 50), passage, rng.integers(0, 50_000, 50)]).astype("<u4") for _ in range(4)] + [np.full(5, 7, "<u4")]
    shard = shard_of(docs, 50_257)
    assert all(shard.document(k).tolist() == d.tolist() for k, d in enumerate(docs))
    assert len(shard.symbols) < 4 * 100 + 30
    places = Counter()
    for a, b in zip(shard.places, shard.places[1:], strict=False):
        row, last = shard.symbols[a:b].tolist(), {}
        for k, pair in enumerate(zip(row, row[1:], strict=False)):
            if last.get(pair, -2) < k - 1:
                last[pair] = k
                places[pair] += 1
    assert max(places.values()) < 3


def test_packing_and_token_files_of_odd_rows(spark, tmp_path):
    rows = [(None, "a b", "x"), (None, "c", "x"), (1, "x y", "x"), (1, "x y", "x"), (2, None, None), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    write_token_shards(docs, str(tmp_path / "odd"), vocabulary("byte_bpe_50k.json"), 0, 50_257, shard_ids=3)
    got = sorted(map(tuple, read_token_shards(spark, str(tmp_path / "odd")).collect()), key=lambda r: r[1])
    ids = [brute_tokens([t], "byte_bpe_50k.json", 0)[0] for t in ("a b", "c", "x y", "x y", None, "")]
    assert [r[0] for r in got] == [None, None, 1, 1, 2, 3] and [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(6)]
    assert Counter((r[2], r[3]) for r in got) == Counter((len(x), crc(x)) for x in ids)
    packed = pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    want = Counter((k, len(x), crc(x)) for (k, t, _) in rows for x in brute_tokens([t], "word_bpe_49k.json", 1))
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed) == want and len({r["sequence_id"] for r in packed}) == 1
    assert sorted(r["offset"] for r in packed) == [sum(sorted_[:k]) for sorted_ in [[r["length"] for r in sorted(packed, key=lambda r: r["offset"])]] for k in range(6)]


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(300)] + [(n, [0.5] * 8) for n in range(300, 420)]
    rows += [(420, None), (421, [None] * 8), (422, [float("nan")] * 8), (423, [float("inf")] * 8), (None, [1.0] * 8), (440, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in search_top_k(table, table.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {n: [math.floor(64 * x) for x in v] for n, v in rows if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [n for n in usable if n % 20 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(usable[q], v, strict=True)), n) for n, v in usable.items() if n != q))[:20]
        assert got[q] == [(n, -s) for s, n in best]
    assert set(got) == {n for n in usable if n % 20 == 0}
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in search_top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 64 * 128)]
    assert search_top_k(few.limit(0), few.limit(0)).count() == 0


def brute_top(matrix, ids, query, key, k):
    scores = matrix @ query
    others = np.flatnonzero(ids != key)
    best = others[np.lexsort((ids[others], -scores[others]))[:k]]
    return ids[best].tolist(), scores[best].tolist()


def test_top_k_stops_on_proof():
    rng = np.random.default_rng(2)
    skewed = np.floor(rng.lognormal(0, 1.6, (1500, 32)) * rng.choice([-4, 4], (1500, 32)))
    sparse = np.where(rng.random((1500, 32)) < 0.2, np.floor(rng.normal(0, 60, (1500, 32))), 0)
    table = pa.parquet.read_table("/root/testdata/sf0.01/embeddings.parquet")
    given = quantise(np.stack([np.array(x, float) for x in table["embedding"].to_pylist() if x is not None]), 64)
    wide = np.floor(rng.normal(0, 1e5, (300, 8)))
    shares = []
    for matrix in (skewed, sparse, given, wide, np.ones((50, 3)), np.zeros((30, 3)), np.array([[5.0, -1]])):
        ids = rng.permutation(len(matrix)).astype(np.int64) * 3
        block = BlockIndex(ids, matrix.shape[1], *postings_of(matrix))
        for key, found, scores in block.search(matrix[::15], ids[::15], 20):
            assert (found.tolist(), scores.tolist()) == brute_top(matrix, ids, matrix[ids == key][0], key, 20)
        shares.append(block.multiplied / max(1, block.scanned))
    assert shares[0] < 0.4 and shares[1] < 0.8 and shares[2] < 1


def test_postings_by_falling_impact():
    rng = np.random.default_rng(6)
    matrix = np.floor(rng.normal(0, 20, (90, 7)))
    dims, levels, vectors, values = postings_of(matrix)
    assert (np.diff(dims.astype(int)) >= 0).all() and all((np.diff(levels[dims == d].astype(int)) <= 0).all() for d in range(7))
    assert (np.abs(values) <= 2.0**levels).all() and (np.abs(values) > 2.0 ** (levels - 1.0))[np.abs(values) > 1].all()
    back = np.zeros_like(matrix)
    back[vectors, dims] = values
    assert (back == matrix).all()


def test_top_k_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (1, [1.0, 2.0], None), (2, None, "x"), (3, [None, 1.0], "x")]
    table = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in search_top_k(table, table.where("vec_id = 0"), k=2).collect())
    assert got == [(0, 1, 1, 64 * 64 * 5), (0, 1, 1, 64 * 64 * 5)]
    index = build_index(table)
    assert sorted(tuple(r) for r in search_top_k(table, table.where("vec_id = 1"), k=2, index=index).collect()) == [(1, 1, 0, 64 * 64 * 5), (1, 2, 0, 64 * 64 * 5)]
    mixed = spark.createDataFrame([(0, [1.0], None), (1, [1.0, 2.0], None)], schema).coalesce(1)
    with pytest.raises(Exception, match="can't be compared"):
        search_top_k(mixed, mixed).collect()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0)], docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mix", "pack"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        rows = after.collect()
        assert rows
        if name != "pack":
            assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        old = {r["doc_id"]: r for r in before.collect()}
        assert {r["doc_id"] for r in rows} <= set(old)
        if name in ("quality", "near_dedup"):
            assert all(r == old[r["doc_id"]] for r in rows) and len(rows) == len({r["doc_id"] for r in rows})
        if name == "near_dedup":
            assert near_duplicates(after).where("class_size > 1").count() == 0
        if name == "mix":
            assert Counter(r["doc_id"] for r in rows).most_common(1)[0][1] <= 2
        if name == "pack":
            assert {r["doc_id"] for r in rows} == set(old)
        before = spark.createDataFrame(rows, after.schema)


CLASHES = "kept string, n_lines int, n_dropped int, row string, _th string, _text string, _key string, size string, taken int, copies int, _id string, tid string, _source string"


def test_pipeline_stages_with_clashing_names_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [c.split()[0] for c in CLASHES.split(", ")]
    more = docs.select("*", *[F.lit(f"{k + 1}").cast(c.split()[1]).alias(c.split()[0]) for k, c in enumerate(CLASHES.split(", "))])
    for name, stage in corpus_pipeline.STAGES:
        got, plain = stage(spark, more, SF), stage(spark, docs, SF)
        if name == "pack":
            assert got.count() == plain.count()
        else:
            assert got.columns == more.columns
            rows = got.collect()
            assert all([str(r[c]) for c in names] == [str(k + 1) for k in range(len(names))] for r in rows)
            assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in plain.collect())
        empty = stage(spark, more.limit(0), SF)
        assert empty.count() == 0 and (name == "pack" or empty.columns == more.columns)


def test_line_stage_keeps_null_texts(spark):
    rows = [(n, "common\nown " + str(n), "en", "s", 12) for n in range(12)] + [(20, None, None, None, None), (21, "", "en", "s", 0), (22, "common", "en", "s", 6), (22, "common", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(n, f"own {n}", len(f"own {n}")) for n in range(12)] + [(20, None, None), (21, "", 0), (22, "", 0), (22, "", 0)], key=str)


def test_shared_folder_is_asked_for_on_clusters():
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(Session())


def test_pieces_of_long_documents(spark):
    docs = spark.createDataFrame([(1, "cat " * 5000)], "doc_id long, text string")
    assert [(r["piece"], r["start"], r["length"]) for r in cut_pieces(docs, vocabulary("word_bpe_49k.json"), 1, 4096).collect()] == [(0, 0, 4096), (1, 4096, 905)]


def test_queries_give_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for f in (registry.op4_near_dedup, registry.op6_quality, registry.op9_token_files):
        assert f(spark, SF).count() == n
    assert registry.op8_best_fit_packing(spark, SF).select("doc_id").distinct().count() == n


def test_an_encoder_remembers_by_its_slots_and_is_forgotten():
    from lumbra.llm import tokens

    path = vocabulary("byte_bpe_50k.json")
    words = pa.array([f"w{k:x} in{k:o}" for k in range(300)])
    few, many = tokens.Encoder(path, 2), tokens.Encoder(path, 1 << 12)
    (a, at), (b, to) = few.encode(words, 0), many.encode(words, 0)
    assert a.tolist() == b.tolist() and at.tolist() == to.tolist()
    asked = []
    for enc in (few, many):
        made, n = enc.make_all, []
        enc.make_all = lambda p, made=made, n=n: (n.append(len(p)), made(p))[1]
        assert enc.encode(words, 0)[0].tolist() == a.tolist()
        asked.append(sum(n))
    assert asked[1] < asked[0] / 4
    assert tokens.encoder(path) is tokens.encoder(path) is not tokens.encoder(path, 1 << 12)
    tokens.forget_encoder()
    assert not tokens._encoders


def test_pairs_of_runs_of_one_id():
    from lumbra.llm.token_files import repair

    # of a run, the first, third and so on places count, also where runs of different ids or documents meet
    for docs in ([[7] * 9, [7] * 4, [7, 7]], [[5, 5, 5, 7, 7, 7, 7], [7, 5, 5, 5]], [[1, 2, 1, 2, 1, 2, 2, 2, 2, 2]]):
        ids, ends = np.array(sum(docs, []), np.uint32), np.zeros(sum(map(len, docs)), bool)
        ends[np.cumsum([len(d) for d in docs]) - 1] = True
        got, starts = Shard(pack_shard(ids, ends, 10)).documents()
        assert got.tolist() == ids.tolist() and np.diff(starts).tolist() == [len(d) for d in docs]
    seq, pairs, _, _ = repair(np.full(8, 7, np.uint32), np.arange(8) == 7, 10)
    assert pairs[0].tolist() == [7, 7] and len(seq) == 4


def test_views_of_many_short_texts_take_little_memory():
    import tracemalloc

    rows = pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array([f"short text {k}" * (1 + k % 9) for k in range(9000)])], ["doc_id", "text"])
    parts = list(quality._portions([rows], "text"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows])) and max(p.num_rows for p in parts) <= quality.ROWS
    tracemalloc.start()
    views = [quality._views(p, "text")[0][:, 0].copy() for p in quality._portions([rows], "text")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and np.array_equal(np.concatenate(views), quality._views(rows, "text")[0][:, 0])
