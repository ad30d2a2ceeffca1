from tidemark.plans import memory_store


def test_all_pending_nodes_are_given(spark, tmp_path):
    spark.range(250).selectExpr("id % 3 as tenant", "id as node_hash").write.parquet(f"{tmp_path}/context_node.parquet")
    spark.createDataFrame([(7,), (8,), (7,), (None,)], "node_hash bigint").write.parquet(f"{tmp_path}/context_event.parquet")
    pending = sorted((n % 3, n) for n in range(250) if n not in (7, 8))
    for name, want in (("embedding_pending", pending), ("embedding_drain", pending[:100])):
        assert [(r["tenant"], r["node_hash"]) for r in memory_store.QUERIES[name](spark, str(tmp_path)).collect()] == want
