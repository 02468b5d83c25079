"""Near-duplicates within buckets of many texts."""

import numpy as np

from lumbra.llm import near_dedup as N


def test_the_largest_component_of_a_bucket_does_not_meet_itself(spark, monkeypatch):
    rows = {}
    monkeypatch.setattr(N, "materialise", lambda df, name: rows.setdefault(name, df.localCheckpoint()))
    sig = np.arange(N.REGISTERS, dtype="<u2").tobytes()
    body = lambda n: [f"palavra{n}x{k}" for k in range(30)]
    texts = [(f"g{n:03d}".encode(), b"g000", " ".join(body(n))) for n in range(700)]
    texts += [(f"o{n:02d}".encode(), f"o{n:02d}".encode(), " ".join([*body(10 * n), "fim"])) for n in range(20)]
    table = spark.createDataFrame([(7, 0, t, r, sig, x) for t, r, x in texts], "bucket long, band int, tid binary, root binary, sig binary, _text string")
    found = N._links_across(table.select("bucket", "band", "tid", "root"), table.select("tid", "sig"), table.select("tid", "_text"), 0.8)
    assert sorted(tuple(sorted(map(bytes, r))) for r in found.collect()) == [(f"g{10 * n:03d}".encode(), f"o{n:02d}".encode()) for n in range(20)]
    # each of the 700 meets the others once, not all blocks of the bucket
    assert rows["partnered"].count() < 1500


def test_alike_by_products_as_one_by_one(monkeypatch):
    monkeypatch.setattr(N, "_COLUMNS", 64)
    draw = np.random.default_rng(5)
    sets = []
    for k in range(40):
        elements = np.unique(draw.integers(0, 900, draw.integers(0, 900)).astype(np.uint64))
        sets.append((elements, draw.integers(1, 4, len(elements)) if k % 2 else np.ones(len(elements), int)))
    alike = N._alike(sets, 0.3)
    pairs = [(i, j) for i in range(40) for j in range(i)]
    assert [alike(i, j) for i, j in pairs] == [N.similarity(sets[i], sets[j]) >= 0.3 for i, j in pairs]
    assert 0 < sum(alike(i, j) for i, j in pairs) < len(pairs)
