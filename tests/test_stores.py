import pytest

from driftlab.plans import stores
from driftlab.sources import files


def test_sources_of_index_files(spark, tmp_path):
    head = "image_path,label,source,generator\n"
    for folder, name, rows in (("a", "web", "1.jpg,0,crawl,\n2.jpg,1,other,g1\n"), ("b", "phone", "3.jpg,0,,\n4.jpg,1,named,g2\n"), ("b", "none", "")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}_index.csv").write_text(head + rows)
    got = {(r.image_path, r.label, r.source, r.generator) for r in files.read_by_source(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()}
    assert got == {("1.jpg", 0, "crawl", None), ("2.jpg", 1, "crawl", "g1"), ("3.jpg", 0, "phone", None), ("4.jpg", 1, "phone", "g2")}


@pytest.mark.parametrize("name", ["merged_indexes", "source_manifests", "cache_reuse", "size_matched_ablation"])
def test_stores_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = stores.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({stores.SQL[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
