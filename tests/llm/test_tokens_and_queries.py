from helpers import duck, rows, table_of

from tidegrain.llm import queries, tokens


def test_sizes_of_null_empty_and_long_texts(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "hello world", 9), (4, "word " * 50_000, 9)], "doc_id bigint, text string, tokens int")
    assert rows(tokens.with_sizes(df, ["doc_id"])) == [(1, 0), (2, 0), (3, 2), (4, 50_001)]


def test_queries_run(spark, sf):
    for name, q in queries.QUERIES.items():
        assert q(spark, sf).count() > 0, name


def test_queries_equal_their_oracles(spark, sf):
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf), duck(sf).sql(sql)
        assert table_of(got.columns, got.collect()) == table_of(want.columns, want.fetchall()), name


def test_packing_and_mixing_of_the_documents(spark, sf):
    packed = queries.p8_pack(spark, sf)
    used = packed.groupBy("container").sum("tokens").collect()
    assert max(r[1] for r in used) <= 1024 and sum(r[1] for r in used) > 0.97 * 1024 * (len(used) - 2)
    shares = queries.p9_shares(spark, sf).collect()
    assert abs(sum(r["actual_share"] for r in shares) - 1) < 1e-4
