"""Whole files, one for each row."""

from pathlib import Path

from pyspark.sql import functions as F

from leadlake.sources import readers as rd
from leadlake.sources import writers as wr


def test_whole_files_share_folders_and_have_no_companions(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("first\n"), "id").alias("value"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    wr.whole_files(rows, path, "kind")
    files = [f for f in Path(path).rglob("*") if f.is_file() and "SUCCESS" not in f.name]
    assert len(files) == 40 and {f.parent.name for f in files} == {"kind=even", "kind=odd"} and {f.suffix for f in files} == {".txt"}
    got = {(r.url.split("kind=")[1].split("/")[0], r.text) for r in rd.text_files(spark, path).collect()}
    assert got == {("even" if k % 2 == 0 else "odd", f"first\n{k}\n") for k in range(40)}


def test_text_and_xml_files_make_no_folder_for_each_file(spark, tmp_path, monkeypatch):
    from leadlake import catalog
    from leadlake.plans import pipelines

    made = []
    monkeypatch.setattr(pipelines, "shared_path", lambda s, name: made.append(str(tmp_path / name)) or made[-1])
    docs = [(k, None if k % 11 == 0 else f"a & <b>\r\n{k}", "en" if k % 3 else "de") for k in range(300)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("S14_text_files", "S14_xml_files"):
        rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert {(r.lang, r.part) for r in rows} == {(k, p) for k in ("en", "de") for p in range(6)} and len(rows) == 12
        assert {p.name for p in Path(made[-1]).rglob("*") if p.is_dir()} == {"lang=en", "lang=de"}
