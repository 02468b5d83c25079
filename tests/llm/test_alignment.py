"""Alignment of two vocabularies against plain Python."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lumbra.llm import alignment, registry
from lumbra.llm.alignment import align_documents, align_ends, byte_level_tokens, score_links, sentence_tokens

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def slow_groups(a, b):
    """Tokens ``(id, bytes)`` of both, cut where ends meet."""
    groups, end_a, end_b, i, j = [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        left, right = [], []
        while not left or not right or end_a != end_b:
            if end_a <= end_b and (not left or end_a < end_b):
                left.append(a[i][0])
                end_a += len(a[i][1])
                i += 1
            else:
                right.append(b[j][0])
                end_b += len(b[j][1])
                j += 1
        groups.append((left, right))
    return groups


def slow_rows(rows):
    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    bytes_a, bytes_b = byte_level_tokens(A), sentence_tokens(second)
    aligned = []
    for i, text in rows:
        whole = f" {text}".encode() if text else b""
        a = [(k, bytes_a[k]) for k in first.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(k, bytes_b[k]) for k in second.encode(text)] if text else []
        good = b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        groups = slow_groups(a, b) if good else []
        aligned.append((i, groups, Counter((x, y) for left, right in groups for x in left for y in right)))
    count = Counter(pair for *_, links in aligned for pair in links)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups, links in aligned:
        spelt = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        best, total = sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items())
        numbers = (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), best, total)
        out.append((i, *numbers, hashlib.sha256(spelt.encode()).hexdigest() if spelt else "", spelt))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "a", " lead", "trail  ", "a  b\n c\t d\r\n\n  e   f　 g", "<|endoftext|> <s> </s> <unk> <0x0A> x", "▁ odd ▁x", "café naïve 中文字 日本 \U0001d538b\U0001f600",
    "don't we'll I'M 'tis", "(a)b,c. d;e\"f\" 12345 3.14159 x=y+1 http://a.b/c?d=e&f#g user@example.com", "x" * 30_000, "ab " * 20_000, "\x00\x01 \x7f \x85   ​‍", "ﬁ ½ ﾊ é İ", "a b   c  d", "\n\n\n", "if (x) {\r\n\treturn;\r\n}",
]


@pytest.mark.parametrize("seed", range(20))
def test_ends_equal_plain_walk(seed):
    rng = random.Random(seed)
    for _ in range(50):
        n = rng.randrange(1, 200)
        ends = [sorted({n, *rng.sample(range(1, n + 1), rng.randrange(n // 2, n + 1))}) for _ in range(2)] if rng.random() < 0.5 else [sorted({n, *(set(range(1, n)) - set(rng.sample(range(1, n + 1), n // 20)))}) for _ in range(2)]
        common = sorted(set(ends[0]) & set(ends[1]))
        got = align_ends(*ends)
        assert [list(map(e.index, common)) for e in ends] == [[k - 1 for k in part] for part in got]
    assert align_ends([], []) == ([], [])


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "again"), (3, "again")]
    rows += [(100 + k, "".join(rng.choice(["a", "b", "é", " ", "  ", "\n", ".", "the", "Ing", "　", "'s", "7", "中", "\t", "ation"]) for _ in range(rng.randrange(80)))) for k in range(200)]
    spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_a int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = slow_rows(rows)
    got = registry.op12_align_tokens(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == [r[:-1] for r in want]
    assert sum(r[1] > 0 for r in want) > 150 and sum(r[1] == 0 for r in want) >= 4
    spelt = align_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), A, B)
    assert sorted(((r["doc_id"], r["n_a"], r["groups"]) for r in spelt.collect()), key=repr) == sorted(((r[0], r[1], r[-1]) for r in want), key=repr)


def test_query_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.op12_align_tokens(spark, SF).collect()), key=repr) == [r[:-1] for r in slow_rows(rows)]


def test_many_small_blocks_and_a_short_memory(monkeypatch):
    """Blocks and what is forgotten change nothing; here in one process, where both may be set."""
    import pyarrow as pa

    texts = pa.array([" ".join(random.Random(k).choices(["alpha", "beta,", "gamma.", "delta"], k=30)) + f" w{k}" for k in range(40)])
    whole = alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(alignment, "_REMEMBERED", 5)
    short = alignment.Aligner(A, B)
    for k in range(40):
        numbers, groups, (distinct, nth, times, ends) = short.align(texts.slice(k, 1))
        start = whole[2][3][k - 1] if k else 0
        assert numbers.tolist() == whole[0][k : k + 1].tolist() and groups == whole[1][k : k + 1] and ends.tolist() == [len(nth)]
        assert distinct[nth].tolist() == whole[2][0][whole[2][1][start : whole[2][3][k]]].tolist() and times.tolist() == whole[2][2][start : whole[2][3][k]].tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_links(docs, A, B).collect() == [] and align_documents(docs, A, B).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, score_links(nulls, A, B).collect()), key=repr) == [(1, *[0] * 6, ""), (None, *[0] * 6, "")]
