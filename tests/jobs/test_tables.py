"""Jobs on tables: indicators, answers, documents, index, terms and vectors."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumbra.operators import answers, chunking, index, retrieval, tfidf, vectors
from lumbra.operators import indicators as I
from lumbra.sources import documents as S
from lumbra.sources import registry as R


@pytest.fixture
def joined(spark):
    rows = [
        ("1", "42", "São A", "MICRO EMPRESA", "X", None),
        ("1", "42", "São A", "MICRO EMPRESA", "X", "s"),
        (None, "42", "São A", None, "Y", "s"),
        ("2", "", None, "MICROEMPREENDEDOR INDIVIDUAL", None, "s"),
        ("3", "7", "B", "EMPRESA DE PEQUENO PORTE", "X", "s"),
    ]
    registry = spark.createDataFrame(rows, "nr_cnpj string, cd_municipio string, nm_municipio string, ds_porte string, ds_setor string, ds_segmento string")
    regions = spark.createDataFrame([("42", "Sul", "T")], "cod_ibge string, regional string, territorio string")
    return I.with_regions(registry, regions)


def test_counts_keep_null_keys_and_reconcile(joined):
    counts = I.count_by_category(joined)
    per_type = {r[0]: r[1] for r in counts.groupBy("tipo_categoria").agg(F.sum("contagem por cnpj")).collect()}
    assert per_type == {"Porte": 4, "Setor": 4, "Segmento": 4}
    sizes = {(r["cod_ibge"], r["categoria"]): r["contagem por cnpj"] for r in counts.where("tipo_categoria = 'Porte'").collect()}
    assert sizes[("42", "MICRO EMPRESA")] == 2 and sizes[("42", None)] == 0 and sizes[("", "MICROEMPREENDEDOR INDIVIDUAL")] == 1
    tidy = {(r["Municipio"], r["categoria"]) for r in I.label_indicators(counts).collect()}
    assert ("Sao A", "ME") in tidy and ("nan", "MEI") in tidy


DATA = "codigo_ibge string, municipio string, regional string, porte string, data_referencia string, total string"


@pytest.fixture
def dataset(spark):
    rows = [
        ("1", "Florianópolis", "Grande Florianópolis", "ME", "2026-06", "10"),
        ("1", "Florianópolis", "Grande Florianópolis", "MEI", "2026-06", "12.7"),
        ("2", "São José", "Grande Florianópolis", "ME", "2026-06", "30"),
        ("3", "São José do Cedro", "Oeste", "ME", "2026-07", "5"),
        ("4", "Lages", None, "ME", "2026-06", "7"),
        ("5", "Itá", "Oeste", None, "2026-06", "1"),
        ("6", "Xaxim", "Oeste", "ME", "2026-06", "n/d"),
    ]
    return I.whole_totals(spark.createDataFrame(rows, DATA))


def test_totals_and_ranking(dataset):
    assert I.slice_total(dataset).collect()[0]["valor"] == 65
    assert [(r["municipio"], r["total"], r["posicao"]) for r in I.place_ranking(dataset, 3).orderBy("posicao").collect()] == [("São José", 30, 1), ("Florianópolis", 22, 2), ("São José do Cedro", 5, 3)]
    shares = {r["porte"]: r["participacao"] for r in I.size_breakdown(dataset).collect()}
    assert shares == {"ME": pytest.approx(52 / 64), "MEI": pytest.approx(12 / 64)}
    assert I.slice_total(dataset.limit(0)).collect()[0]["linhas"] == 0


def test_answers(spark, dataset):
    rows = [
        (1, "Quantas empresas em São José do Cedro?"),
        (2, "Quantos MEI em Florianópolis"),
        (3, "total da Grande Florianópolis"),
        (4, "empresas em Zubrowka"),
        (5, "quantas microempresas no estado por porte e ranking"),
        (6, "MEI em Lages"),
        (7, "regional Oeste, por porte"),
        (8, "sem lugar"),
    ]
    asked = spark.createDataFrame(rows, "question_id long, text string")
    found = answers.answer_questions(asked, dataset)
    got = {r["question_id"]: (r["encontrado"], r["valor"], r["escopo"], r["escopo_label"], r["porte"]) for r in found.collect()}
    assert got == {
        1: (True, 5, "municipio", "São José do Cedro", None),
        2: (True, 12, "municipio", "Florianópolis", "MEI"),
        3: (True, 22, "municipio", "Florianópolis", None),
        4: (False, None, None, None, None),
        5: (True, 52, "estado", "Santa Catarina", "ME"),
        6: (False, None, "municipio", "Lages", "MEI"),
        7: (True, 6, "regional", "Regional Oeste", None),
        8: (True, 65, "estado", "Santa Catarina", None),
    }
    texts = {r["question_id"]: r["resposta"] for r in answers.render_answers(found, dataset).collect()}
    assert "Zubrowka" in texts[4] and texts[4].startswith("Não encontrei")
    assert "1. São José (Grande Florianópolis): 30" in texts[5] and "Distribuição" not in texts[5]
    assert "- ME: 5 (100.0%)" in texts[7] and "Municípios considerados: 2" in texts[7]
    assert answers.answer_questions(asked, dataset.limit(0)).where("encontrado").count() == 0


def test_answers_name_sources_and_details(spark, dataset):
    asked = spark.createDataFrame([(1, "total em Lages"), (2, "regional Oeste"), (3, "quantas microempresas no estado"), (4, "empresas em Zubrowka")], "question_id long, text string")
    sourced = dataset.withColumn("fonte", F.when(F.col("codigo_ibge") == "5", "b").otherwise("a"))
    found = answers.answer_questions(asked, sourced)
    assert {r["question_id"]: r["fonte"] for r in found.collect()} == {1: "a", 2: "a, b", 3: "a", 4: None}
    details = answers.answer_details(found, sourced)
    assert details.columns == ["question_id", *sourced.columns]
    got = sorted((r["question_id"], r["municipio"], r["porte"] or "", r["total"]) for r in details.collect())
    assert [x for x in got if x[0] < 3] == [(1, "Lages", "ME", 7), (2, "Itá", "", 1), (2, "São José do Cedro", "ME", 5)]
    assert sum(x[3] for x in got if x[0] == 3) == 52 and not [x for x in got if x[0] == 4]
    texts = {r["question_id"]: r["resposta"] for r in answers.render_answers(found, sourced).collect()}
    assert "\n- Fonte: a, b\n" in texts[2]
    assert "Fonte" not in answers.render_answers(answers.answer_questions(asked, dataset), dataset).where("question_id = 2").collect()[0]["resposta"]
    empty = answers.answer_questions(asked, sourced.limit(0)).collect()
    assert all(not r["encontrado"] and r["escopo"] is None and r["porte"] is None and r["mensagem"] == "A fonte estática 'empresas_por_municipio' não está disponível ou está vazia." for r in empty) and len(empty) == 4


def test_places_inside_each_other_are_known(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choices("abcd", k=rng.randrange(2, 7))).title()
    known, asked = [*(name() for _ in range(7)), "Abcab Dd"], [(n, f"empresas em {name()}") for n in range(150)]
    places = spark.createDataFrame([(k,) for k in known], "name string")
    rows = spark.createDataFrame(asked, "question_id long, text string")
    got = {r["question_id"] for r in answers.unknown_place(rows, places, ["zz"]).collect()}
    norm = [" ".join(k.lower().split()) for k in known]
    cands = [r for r in rows.select("question_id", F.explode(F.regexp_extract_all("text", F.lit(answers._AFTER_PREPOSITION), F.lit(1))).alias("c")).collect()]
    want = {r["question_id"] for r in cands if not any(r["c"].lower() in k or k in r["c"].lower() for k in [*norm, "zz"]) and r["c"].lower() not in answers.SIZE_ALIASES}
    assert got == want and 20 < len(want) < 140


def test_registry_columns_by_position(spark, tmp_path):
    (tmp_path / "r.csv").write_text(",".join(f"h{n}" for n in range(19)) + "\n" + ",".join(["1"] * 10 + ["42.0"] + ["x"] * 8) + "\n" + ",".join(["2"] * 10 + [""] + ["x"] * 8) + "\n")
    assert [(r["nr_cnpj"], r["cd_municipio"]) for r in R.read_registry(spark, str(tmp_path / "r.csv")).collect()] == [("1", "42"), ("2", "")]
    assert R.read_dataset(spark, str(tmp_path), "missing").count() == 0


def test_listing_reading_and_notes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a" / "X.MD").write_bytes("\ufefftítulo".encode())
    (tmp_path / "b.markdown").write_bytes(b"bad \xff")
    (tmp_path / "n.md").write_text("nota")
    (tmp_path / ".hidden" / "h.md").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    listed = S.list_documents(spark, str(tmp_path)).collect()
    assert {"a/X.MD", "b.markdown", "n.md"} <= {r["chave"] for r in listed} and all(r["etag"].startswith("mtime-") for r in listed)
    read = {r["chave"]: r for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert read["a/X.MD"]["conteudo"] == "título" and read["a/X.MD"]["hash_bruto"] != read["a/X.MD"]["conteudo_hash"] and read["b.markdown"]["conteudo"] == "bad �"
    assert [r["path"] for r in S.read_notes(spark, str(tmp_path)).collect()] == ["n.md"]


def test_pending_and_sync(spark):
    listing = spark.createDataFrame([("new", "1"), ("same", "1"), ("changed", "2"), ("none", None), ("empty", "")], "chave string, etag string")
    state = spark.createDataFrame([("same", "1"), ("changed", "1"), ("none", None), ("empty", ""), ("gone", "1")], "documento_chave string, origem_etag string")
    assert {r["chave"]: r["pendente"] for r in S.split_pending(listing, state).collect()} == {"new": True, "same": False, "changed": True, "none": True, "empty": True}
    assert S.split_pending(listing, state, force=True).where("pendente").count() == 5
    assert [r[0] for r in S.removed_documents(listing, state).collect()] == ["gone"]
    local = spark.createDataFrame([("a", "r", "t"), ("b", "r", "t"), ("c", "r", "t"), ("d", "r", "t")], "chave string, hash_bruto string, conteudo_hash string")
    remote = spark.createDataFrame([("b", "t"), ("c", "x"), ("d", "r"), ("e", "r")], "chave string, remoto_hash string")
    plan = lambda **k: {r["chave"]: r["status"] for r in S.sync_plan(local, remote, **k).collect()}
    assert plan(remove=True) == {"a": "enviado", "b": "inalterado", "c": "atualizado", "d": "inalterado", "e": "removido"}
    assert plan(force=True) == {"a": "enviado", "b": "atualizado", "c": "atualizado", "d": "atualizado"}


def test_index_is_idempotent(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "documento_chave string, chunk_indice int, t string")
    new = spark.createDataFrame([("a", 0, "n")], old.schema)
    once = index.replace_chunks(old, new, new)
    twice = index.replace_chunks(once, new, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 0, "n"), ("b", 0, "z")]
    assert [r["documento_chave"] for r in index.remove_documents(old, spark.createDataFrame([("a",), ("q",)], "documento_chave string")).collect()] == ["b"]


def test_chunks_hold_their_rules(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12)))
    texts = ["", "   ", "x" * 3000, "# T\n## A\n" + "w " * 900 + "\n### B\n" + "k. " * 700, "```\n# no\n```\n# Yes\ntext"]
    for _ in range(60):
        texts.append("".join(word() + rng.choice([" ", " ", "\n", "\n\n", ". ", "\n## ", "\n### "]) for _ in range(rng.randrange(900))))
    docs = spark.createDataFrame([(f"d{n}", "t", t) for n, t in enumerate(texts)], "chave string, titulo string, body string")
    rows = chunking.chunk_documents(docs).collect()
    for n, text in enumerate(texts):
        own = sorted((r for r in rows if r["documento_chave"] == f"d{n}"), key=lambda r: r["chunk_indice"])
        assert [r["chunk_indice"] for r in own] == list(range(len(own)))
        assert bool(own) == bool(text.strip())
        assert all(0 < len(r["chunk_texto"]) <= 1200 and r["chunk_texto"] == r["chunk_texto"].strip() for r in own)


def test_chunks_and_headings_of_single_texts(spark):
    short = "a" * 1100 + "\n\n" + "b" * 150 + "\n\n" + "c" * 1000
    heads = "# T\n### C\ntext\n## B #\n```\n# x\n```\n"
    odd = "\x1c # V\u2028a\x85#b\r\n####### no\x0b\u3000## \x1f é # \x1d#\n#x"
    rows = spark.createDataFrame([(0, "a" * 1300), (1, short), (2, heads), (3, odd), (4, None)], "n int, t string")
    chunks = {r[0]: r[1] for r in rows.select("n", chunking.split_text(F.col("t"))).collect()}
    assert chunks[0] == ["a" * 1200, "a" * 300] and chunks[4] == []
    assert chunks[1] == ["a" * 1100, "b" * 150 + "\n\n" + "c" * 1000] or chunks[1][-1].startswith("b")
    paths = {r[0]: [tuple(h) for h in r[1] or []] for r in rows.select("n", chunking.heading_paths(F.col("t"))).collect()}
    assert paths[2] == [(0, "T"), (4, "T > C"), (15, "T > B")]
    assert paths[3] == [(1, "V"), (odd.index("\u3000"), "V > é")]
    assert "Python" not in chunking.chunk_documents(rows.selectExpr("n AS chave", "'' AS titulo", "t AS body"))._jdf.queryExecution().toString()


def test_headings_of_a_document_with_half_of_all_rows(spark):
    rng = random.Random(9)
    docs = [*["big"] * 6000, *(f"d{k % 300}" for k in range(6000))]
    rng.shuffle(docs)
    heads = [(d, rng.randrange(100_000), f"h{k}") for k, d in enumerate(docs) if rng.random() < 0.02] + [("only", 5, "x")]
    heads = list({(d, at): (d, at, h) for d, at, h in heads}.values())
    asked = [(d, rng.randrange(100_000)) for d in docs] + [(heads[0][0], heads[0][1]), ("none", 3), ("none", 3)]
    positions, headings = spark.createDataFrame(asked, "doc string, posicao int"), spark.createDataFrame(heads, "doc string, inicio int, caminho string")
    by = {}
    for d, at, h in sorted(heads):
        by.setdefault(d, []).append((at, h))
    want = sorted({(d, at, next((h for start, h in reversed(by.get(d, [])) if start <= at), "")) for d, at in asked})
    assert sorted(map(tuple, chunking.heading_asof(positions, headings).select("doc", "posicao", "caminho").collect())) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in chunking._in_ranges(positions, headings).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_weighted_terms(spark):
    rows = [(1, ["Saldo de empregos", "saldo", "SALDO"]), (2, ["turismo"]), (3, []), (4, [f"termo{n}" for n in range(40)])]
    chunks = spark.createDataFrame(rows, "k long, termos array<string>")
    got = {r["k"]: r["metadados_tfidf"] for r in tfidf.weighted_terms(chunks, ["k"]).collect()}
    assert got[1] == "Saldo de empregos" and got[2] == "turismo" and got[3] == "" and len(got[4].split(", ")) == 25
    df = {r["token"]: (r["df"], r["n"]) for r in tfidf.document_frequency(chunks, ["k"]).collect()}
    assert df["saldo"] == (1, 4)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], None), (3, [1.0, 0.0], [0.0, 1.0])], "k long, v array<double>, m array<double>")
    got = {r["k"]: r["b"] for r in rows.select("k", vectors.blended(F.col("v"), F.col("m")).alias("b")).collect()}
    assert math.hypot(*got[1]) == pytest.approx(1) and got[2] == [0.0, 0.0] and got[3] == pytest.approx([0.9 / math.hypot(0.9, 0.1), 0.1 / math.hypot(0.9, 0.1)])
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "v array<double>, m array<double>")
    with pytest.raises(Exception, match="different lengths"):
        bad.select(vectors.blended(F.col("v"), F.col("m"))).collect()


def test_scope_sums_count_each_municipality_once(spark):
    rng = random.Random(2)
    rows = [(str(k), rng.choice([None, *(f"m{n}" for n in range(40))]), rng.choice([None, "Sul", "Norte"]), rng.choice([None, "ME", "MEI"]), rng.choice(["2025", "2026"]), rng.randrange(9), rng.choice(["f", "g"])) for k in range(600)]
    data = spark.createDataFrame(rows, "codigo_ibge string, municipio string, regional string, porte string, data_referencia string, total long, fonte string").repartition(5)
    want = {}
    for _, town, office, size, date, total, source in rows:
        for scope, key in (("municipio", town), ("regional", office), ("estado", "")):
            for asked in {None, size}:
                if key is not None:
                    w = want.setdefault((scope, key, asked), [0, 0, set(), set(), set()])
                    w[0], w[1] = w[0] + total, w[1] + 1
                    w[2] |= {town} - {None}
                    w[3].add(date)
                    w[4].add(source)
    got = {(r["_scope"], r["_key"], r["_size"]): (r["valor"], r["linhas"], r["municipios"], set(r["_datas"]), set(r["_fontes"])) for r in answers.scope_sums(data).collect()}
    assert got == {k: (v, n, len(towns), dates, sources) for k, (v, n, towns, dates, sources) in want.items()}


def test_nearest_chunks_filters_and_ties(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0], 2020, "Sul", None), (2, [0.0, 1.0], None, None, "em")], "question_id long, vetor array<double>, ano_min int, regional string, tema string")
    rows = [(1, [1.0, 0.0], 2021, None, "emprego"), (2, [2.0, 0.0], 2020, "Sul", None), (3, [1.0, 0.0], 2019, "Sul", "x"), (4, [1.0, 0.0], 2022, "Norte", "x"), (5, [0.0, 0.0], 2022, "Sul", "emprego"), (6, [0.0, 3.0], None, None, "tema")]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, ano int, regional string, tema string")
    got = sorted((r["question_id"], r["posicao"], r["chunk_id"]) for r in vectors.nearest_chunks(asked, chunks).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 6)]


def test_groups_of_vectors_are_passed_over_and_none_is_missed(spark):
    rng = random.Random(6)
    middles = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(20)]
    near = lambda m: [x + rng.gauss(0, 0.08) for x in m]
    rows = [(k, near(middles[0] if k % 3 == 0 else rng.choice(middles)), 2000 + k % 9, rng.choice([None, "Sul", "Norte"])) for k in range(3000)]
    rows += [(9000, [0.0] * 12, 2005, None), (9001, rows[5][1], 2008, None), (9002, rows[5][1], 2008, None)]
    asked = [(k, near(rng.choice(middles)), rng.choice([None, 2004]), rng.choice([None, "Sul"])) for k in range(80)] + [(500, [0.0] * 12, None, None), (501, rows[5][1], None, None), (502, [-x for x in middles[3]], None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, ano int, regional string")
    questions = spark.createDataFrame(asked, "question_id long, vetor array<double>, ano_min int, regional string")
    for most in (None, 0.5):
        met = []
        got = vectors.nearest_chunks_by_group(questions, chunks, max_distance=most, groups=40, met=met).select("question_id", "posicao", "chunk_id", F.round("distancia", 9)).collect()
        want = vectors.nearest_chunks(questions, chunks, max_distance=most).select("question_id", "posicao", "chunk_id", F.round("distancia", 9)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 400
        products = sum(m.select(F.sum(F.size("c").cast("long") * F.size("q"))).first()[0] or 0 for m in met)
        assert products < 0.6 * 3003 * 83
    none = vectors.nearest_chunks_by_group(questions, chunks.limit(0))
    assert none.collect() == [] and none.columns == ["question_id", "chunk_id", "distancia", "posicao"]


def test_notes(spark):
    rows = [("a.md", "---\ntitle: Empresas ativas\ntags: [mei, porte]\n---\ncontagem de empresas"), ("b.md", "---\nstatus: Deprecated\n---\nempresas"), ("c.md", "turismo e hotelaria")]
    notes = retrieval.parse_notes(spark.createDataFrame(rows, "path string, conteudo string"), ["que"])
    asked = spark.createDataFrame([(1, "quantas empresas por porte"), (2, "hotelaria"), (3, "nada")], "question_id long, text string")
    got = [(r["question_id"], r["path"], r["pontos"]) for r in retrieval.rank_notes(asked, notes, ["que"]).orderBy("question_id", "posicao").collect()]
    assert got == [(1, "a.md", 11), (2, "c.md", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_ranking_of_many_notes_meets_few_and_misses_none(spark, seed):
    """Against all pairs, on words as uneven as those of texts."""
    rng = random.Random(seed)
    words = [f"pal{n}" for n in range(400)]
    draw = lambda n: rng.choices(words, [1 / (1 + k) for k in range(400)], k=n)
    notes = {f"d{k % 5}/n{k:03}.md": (sorted(set(draw(3))), sorted(set(draw(40)))) for k in range(300)}
    asked = {k: " ".join(draw(rng.choice([1, 3, 8, 14]))) for k in range(60)} | {100: "pal0", 101: "nada disso"}
    want = []
    every = 0
    for q, text in asked.items():
        tokens = set(text.split())
        points = {p: 3 * len(tokens & set(k)) + len(tokens & set(b)) for p, (k, b) in notes.items()}
        every += sum(len(tokens & set(k)) + len(tokens & set(b)) for k, b in notes.values())
        best = sorted((p for p in points if points[p]), key=lambda p: (-points[p], p.split("/")[-1], p))[:5]
        want += [(q, p, points[p], n + 1) for n, p in enumerate(best)]
    met = []
    frame = spark.createDataFrame([(p, k, b) for p, (k, b) in notes.items()], "path string, keywords array<string>, body_tokens array<string>")
    got = retrieval.rank_notes(spark.createDataFrame(list(asked.items()), "question_id long, text string"), frame, [], met=met)
    assert sorted(map(tuple, got.select("question_id", "path", "pontos", "posicao").collect())) == sorted(want)
    pairs = [m.count() for m in met]
    assert pairs[0] < every / 2 and sum(pairs) < every


def test_context_falls_back(spark):
    asked = spark.createDataFrame([(1,), (2,)], "question_id long")
    found = spark.createDataFrame([(1, 2, "B", "b"), (1, 1, "A", "a")], "question_id long, posicao int, referencia string, texto string")
    got = {r["question_id"]: r for r in retrieval.context_texts(asked, found).collect()}
    assert got[1]["contexto"] == "[1] A\na\n\n---\n\n[2] B\nb" and got[1]["fontes"] == "- A\n- B" and got[2]["resposta"] == retrieval.NOTHING_FOUND


def test_weighted_terms_of_any_case_are_looked_up_not_folded(spark, capsys):
    rare = [f"Rare{k:03d} word{k:03d}" for k in range(60)]
    chunks = spark.createDataFrame([(1, ["Common", "COMMON", *rare, *(x.upper() for x in rare)]), (2, ["common"]), (3, []), (4, None)], "k int, termos array<string>")
    weighed = tfidf.weighted_terms(chunks, ["k"], limit=7)
    got = {r["k"]: r["metadados_tfidf"] for r in weighed.collect()}
    assert got == {1: ", ".join(rare[:7]), 2: "common", 3: "", 4: ""}
    weighed.explain(True)
    assert not re.search(r"\baggregate\(", capsys.readouterr().out)
