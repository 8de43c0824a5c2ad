from noteloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_first_turn_is_a_query(spark):
    first = {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").where("turn = 0").collect()}
    found = catalog.QUERIES["bm25_foreign_queries"](spark, SF).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == sorted((q, k) for q in first for k in (1, 2, 3))
