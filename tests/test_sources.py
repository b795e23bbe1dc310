"""Reading, identity and versions on small files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from dqloom.operators.counts import column_catalog
from dqloom.sources import files, identity, versions


def test_csv_types_and_leading_zeros(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text(
        "zip_code,code_plain,amount,qty,flag,note\n"
        "00123,7,1.5,1,true,NA\n45678,8,2,02,false,\n,9,,3,true,x\n", encoding="utf-8")
    df = files.read_table(spark, str(path))
    assert dict(df.dtypes) == {
        "zip_code": "string", "code_plain": "bigint", "amount": "double", "qty": "bigint",
        "flag": "boolean", "note": "string"}
    rows = df.collect()
    assert rows[0].zip_code == "00123" and rows[2].zip_code is None and rows[0].note == "NA"
    assert files.read_text_table(spark, str(path), na_values=["NA"]).collect()[0].note is None


def test_csv_encoding_fallback(spark, tmp_path):
    path = tmp_path / "accents.csv"
    path.write_bytes("id,name\n1,Café\n2,Müller\n".encode("cp1252"))
    names = [r.name for r in files.read_table(spark, str(path)).orderBy("id").collect()]
    assert names == ["Café", "Müller"]


def test_discovery_and_duplicate_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("z\nq\n")
    paths = files.list_tables(spark, str(tmp_path))
    got = {(r.table_name, r.column_name): r.row_count for r in
           files.discover_tables(spark, paths).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 2, ("b", "z"): 1}
    twice = spark.range(1).select(F.lit(1).alias("k"), F.lit(2).alias("k"))
    assert files.unique_names(twice).columns == ["k", "k__pos1"]
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "book.xlsx"))


def test_fingerprints(spark, tmp_path):
    for name, body in (("B.csv", "1"), ("a.csv", "2")):
        (tmp_path / name).write_text(body)
    prints = identity.file_fingerprints(spark, [str(tmp_path)])
    by_name = {r.filename: r.fingerprint for r in prints.collect()}
    assert by_name["B.csv"] == hashlib.sha256(b"1").hexdigest()
    text = "\n".join(f"{n}|{by_name[n]}" for n in ("a.csv", "B.csv"))
    assert identity.content_fingerprint(prints).first()[0] == hashlib.sha256(text.encode()).hexdigest()
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    schema = column_catalog(df, "t").withColumn("table_order", F.lit(0))
    expected = "TABLE:t\nCOLUMN:k|TYPE:int\nCOLUMN:v|TYPE:string"
    assert identity.schema_fingerprint(schema).first()[0] == hashlib.sha256(expected.encode()).hexdigest()


def test_batch_verdicts(spark):
    known = spark.createDataFrame(
        [("h1", "d", None), ("h2", "d", "2024-01-01")],
        "fingerprint string, dataset_id string, deleted_at string")

    def verdict(*hashes):
        incoming = spark.createDataFrame([(h, h) for h in hashes], "filename string, fingerprint string")
        return identity.batch_verdict(identity.classify_upload(incoming, known)).first().verdict

    assert verdict("h1") == "all_duplicates" and verdict("h2", "h3") == "all_new"
    assert verdict("h1", "h3") == "review_required"


def test_versions_are_immutable(spark, tmp_path):
    root = str(tmp_path / "lake")
    df = spark.createDataFrame([(1, " a")], "k int, v string")
    assert versions.write_version(spark, root, "d", {"t": df}) == 1
    assert versions.write_version(spark, root, "d", {"t": df.withColumn("w", F.lit(1))}, 1) == 2
    with pytest.raises(ValueError):
        versions.write_version(spark, root, "other", {"t": df}, 1)
    with pytest.raises(Exception):
        df.write.mode("errorifexists").parquet(f"{root}/d/v1/t")
    got = {r.version_number: r for r in versions.versions(spark, root).collect()}
    assert got[2].parent_version == 1 and got[1].schema_fingerprint != got[2].schema_fingerprint
    assert versions.read_version(spark, root, "d", 1, "t").count() == 1


def test_files_over_what_spark_reads_at_once_are_hashed_in_pieces(spark, tmp_path):
    """Such files failed, and all others were held in memory whole."""
    data = {"a b%20.bin": bytes(range(256)) * 40, "c.csv": b"x,y\n1,2\n", "d.gz": b"\x1f\x8b" * 3000}
    for name, octets in data.items():
        (tmp_path / name).write_bytes(octets)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {r.filename: (r.bytes, r.fingerprint) for r in identity.file_fingerprints(spark, [str(tmp_path)]).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {n: (len(o), hashlib.sha256(o).hexdigest()) for n, o in data.items()}
