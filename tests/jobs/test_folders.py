"""Folders of documents: what is written, one file per row, and what reading gives back."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumbra.sources import documents as S
from lumbra.sources import folders
from lumbra.sources.writer import FolderWriter, place, write_documents


def test_files_are_where_keys_say(spark, tmp_path):
    root = f"{tmp_path}/a folder"
    rows = [("a/b.md", "um"), ("/a//./c.MD", "dois"), ("x\\y é.markdown", "três"), ("vazio.md", None), (".z/d.md", "q"), ("z.txt", "t")]
    write_documents(spark.createDataFrame(rows, "chave string, conteudo string").repartition(3), root)
    found = {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}
    assert found == {"a/b.md": "um", "a/c.MD": "dois", "x/y é.markdown": "três", "vazio.md": "", ".z/d.md": "q", "z.txt": "t"}
    assert json.loads((Path(root) / "_SUCCESS").read_text()) == {"files": 6, "bytes": 13}
    assert [r["chave"] for r in S.list_documents(spark, root).collect()] == ["a/b.md", "a/c.MD", "x/y é.markdown"]
    assert {r["chave"]: r["conteudo"] for r in S.read_documents(spark, f"file://{root}").collect()}["x/y é.markdown"] == "três"
    # written again, files are replaced
    write_documents(spark.createDataFrame([("a/b.md", bytearray(b"\xef\xbb\xbfnovo\xff"))], "chave string, conteudo binary"), root)
    assert {r["chave"]: r["conteudo"] for r in S.read_documents(spark, root).collect()}["a/b.md"] == "novo�"
    assert "a/b.md" not in [r["path"] for r in S.read_notes(spark, root).collect()]


@pytest.mark.parametrize("key", ["../x.md", "a/../../x.md", "", "/", None, "a\\..\\x.md"])
def test_keys_stay_below_the_root(key):
    with pytest.raises(ValueError, match="below the root"):
        place("/r", key)


def test_a_failed_task_leaves_nothing(tmp_path):
    import pyarrow as pa

    def batches():
        yield pa.record_batch({"chave": ["a.md", "b/c.md"], "conteudo": ["x", "y"]})
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        FolderWriter(str(tmp_path)).write(batches())
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_empty_tables_and_modes(spark, tmp_path):
    root = f"{tmp_path}/none"
    empty = spark.createDataFrame([], "chave string, conteudo string")
    write_documents(empty, root)
    assert S.list_documents(spark, root).count() == 0
    with pytest.raises(Exception, match="append"):
        empty.write.format("document_folder").mode("overwrite").save(root)


def test_trees_of_digests_lead_to_changed_buckets(spark):
    leaves = 4096
    docs = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("chave"), F.sha2(F.concat(F.lit("raw"), "id"), 256).alias("hash_bruto"), F.sha2(F.concat(F.lit("txt"), "id"), 256).alias("conteudo_hash"))
    same = docs.select("chave", F.col("conteudo_hash").alias("remoto_hash"))
    mine = [S.digest_tree(docs, c, leaves).cache() for c in ("hash_bruto", "conteudo_hash")]
    tree = S.digest_tree(same.repartition(7), "remoto_hash", leaves)
    got_leaves = docs.select(F.pmod(F.xxhash64("chave"), F.lit(leaves))).distinct().count()
    assert {r["nivel"]: r["n"] for r in tree.groupBy("nivel").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: got_leaves, 1: 16, 2: 1}
    assert tree.where("nivel = 2").first()["chaves"] == 3000
    assert S.differing_leaves(mine, tree, leaves) == [] and S.sync_changes(docs, same, mine, tree, leaves=leaves).count() == 0
    other = same.where("chave <> 'd7'").withColumn("remoto_hash", F.when(F.col("chave") == "d9", "x").when(F.col("chave") == "d11", None).otherwise(F.col("remoto_hash"))).unionByName(same.limit(1).withColumn("chave", F.lit("novo")))
    changed = S.digest_tree(other, "remoto_hash", leaves)
    found = S.differing_leaves(mine, changed, leaves)
    keys = spark.createDataFrame([("d7",), ("d9",), ("d11",), ("novo",)], "chave string")
    assert found == sorted({r[0] for r in keys.select(F.pmod(F.xxhash64("chave"), F.lit(leaves)).cast("int")).collect()})
    plan = S.sync_changes(docs, other, mine, changed, remove=True, leaves=leaves)
    assert {r["chave"]: r["status"] for r in plan.collect()} == {"d7": "enviado", "d9": "atualizado", "d11": "atualizado", "novo": "removido"}


def test_many_small_files_make_few_tasks(spark, tmp_path):
    root = f"{tmp_path}/many"
    write_documents(spark.range(3000).selectExpr("concat('d', id % 7, '/', id, '.md') AS chave", "concat('texto ', id) AS conteudo"), root)
    found = S.read_documents(spark, root)
    # by Spark's own rule 3,000 files of a few bytes make 94 partitions or more
    assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert {(r["chave"], r["conteudo"]) for r in found.collect()} == {(f"d{n % 7}/{n}.md", f"texto {n}") for n in range(3000)}
    assert S.list_documents(spark, root).count() == 3000


def test_folders_are_walked_by_several_tasks(spark, tmp_path):
    root = tmp_path / "tree"
    for n in range(60):
        path = root / f"a{n % 3}" / f"b{n % 5}" / "c" / f"{n}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * n)
    (root / ".oculta").mkdir()
    (root / ".oculta" / "h.md").write_text("x")
    (root / "gone.md").symlink_to(root / "nowhere")
    (root / "_f3a9c1d2e4b5f6a7988796a5b4c3d2e1-new.md").write_text("unfinished")
    (root / "_dois.md").write_text("x")
    want = {(str(p.relative_to(root)).encode(), p.stat().st_size, int(p.stat().st_mtime)) for p in [*root.glob("a*/*/*/*.md"), root / "_dois.md"]}
    for at_once in (1, 4, 1000):
        assert sorted(tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in folders.listed(spark, str(root), at_once).collect()) == sorted(want)


def test_names_that_are_no_text_are_read(spark, tmp_path):
    with open(os.fsencode(str(tmp_path)) + b"/a\xff.md", "wb") as out:
        out.write(b"nota")
    assert [(r["path"], r["conteudo"]) for r in S.read_notes(spark, str(tmp_path)).collect()] == [("a\ufffd.md", "nota")]


def test_roots_elsewhere_go_through_sparks_reader(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("nota")
    assert folders.reachable(spark, str(tmp_path)) and not folders.reachable(spark, f"{tmp_path}/{{a,b}}")
    assert [r["conteudo"] for r in S.read_notes(spark, f"{tmp_path}/{{a,b}}").collect()] == ["nota"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_notes(spark, f"{tmp_path}/none")


def test_files_read_are_not_in_the_plan(spark, tmp_path):
    root = f"{tmp_path}/planned"
    write_documents(spark.range(300).selectExpr("concat('d', id % 7, '/', id, '.md') AS chave", "concat('texto ', id) AS conteudo"), root)
    # a plan that names each file is held by the driver
    for found in (S.read_notes(spark, root), S.read_documents(spark, root)):
        assert len(found.inputFiles()) < 30 and found.count() == 300


def test_a_listing_is_not_held_by_the_driver(spark, tmp_path):
    root = f"{tmp_path}/listed"
    write_documents(spark.range(300).selectExpr("concat('d', id % 7, '/', id, '.md') AS chave", "concat('texto ', id) AS conteudo"), root)
    found = S.list_documents(spark, root)
    assert len(found.inputFiles()) < 30
    want = {(f"d{n % 7}/{n}.md", f"file:{root}/d{n % 7}/{n}.md", f"mtime-{int(Path(root, f'd{n % 7}/{n}.md').stat().st_mtime)}", len(f"texto {n}")) for n in range(300)}
    assert {tuple(r) for r in found.collect()} == want and [r["chave"] for r in found.collect()] == sorted(w[0] for w in want)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables of which documents have empty texts, byte order marks and names that Spark's readers hide."""
    made = tmp_path_factory.mktemp("odd")
    for table in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if table.name != "documents.parquet":
            (made / table.name).symlink_to(table)
    texts = ["", "um", "\n", "a\x00é", "um"]
    rows = [(n, texts[n % 5], "en", ["src1", "_src2"][n % 11 == 0], 0) for n in range(-20, 400)]
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema), made / "documents.parquet")
    return str(made)


def expected(odd, name):
    import __spark_entry__

    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        for table in Path(odd).glob("*.parquet"):
            con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
        return sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["folder_documents", "folder_listing", "folder_notes", "folder_rendered"])
def test_empty_files_and_hidden_names_as_in_sql(spark, odd, name):
    import __spark_entry__

    assert sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, odd).collect()) == expected(odd, name)
