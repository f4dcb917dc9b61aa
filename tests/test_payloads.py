from helpers import rows
from pyspark.sql import functions as F

from tidegrain.sources import payloads as P


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_body_classes(spark):
    of = lambda b, status=200: one(spark, P.body_class(F.lit(b).cast("string"), F.lit(status)))
    assert of(None) == "no-response" and of("{}", 503) == "error-body" and of("{}", None) == "error-body" and of("{bad") == "unrecognised-shape"
    assert of("[]") == "confirmed-empty" and of("[1]") == "ok" and of('"text"') == "unrecognised-shape" and of("{}") == "unrecognised-shape"
    assert of('{"error":"no key"}') == "error-body" and of('{"error":false,"data":[1]}') == "ok" and of('{"statusCode":404,"data":[]}') == "error-body" and of('{"data":[]}') == of('{"results":null}') == of('{"cards":{}}') == "confirmed-empty"
    assert of('{"data":"x","card_id":3}') == "ok" and of('{"totalCount":0}') == "confirmed-empty" and of('{"meta":{"total":4}}') == "ok"


def test_search_and_paths(spark):
    find = lambda b, *n: one(spark, P.find_field(F.lit(b).cast("string"), *n))
    deep = '{"a":{"near_mint":"","x":[{"Near Mint":7}]},"b":{"nearMint":{"v":1}}}'
    assert find(deep, "nearmint") == '{"v":1}' and find('{"a":[{"Near Mint":7}]}', "near_mint") == "7" and find(None, "x") is None and find("{", "x") is None
    paths = lambda b, d=6: one(spark, P.key_paths(F.lit(b).cast("string"), d))
    assert paths('{"a":{"b":[{"c":1},{"d":2}]},"e":[]}') == ["a", "a.b", "a.b[].c", "e"] and paths('{"a":{"b":{"c":1}}}', 1) == ["a", "a.b"] and paths(None) == [] and paths("[]") == []
    nested = "{}"
    for _ in range(12):
        nested = '{"k":' + nested + "}"
    assert len(paths(nested)) == 7


def test_sealed_products_and_attributes(spark):
    of = lambda h: one(spark, P.sealed_product(F.lit(h)))
    assert of('{"cardType":null,"rarity":null}') and of('{"type":"","rarity":""}') and not of('{"rarity":null}') and not of('{"cardType":null,"type":"Unit"}') and not of('{"cardType":null,"rarity":"R"}')
    m = F.create_map(F.lit("ILLUSTRATOR"), F.lit("x"), F.lit("Artist"), F.lit(""))
    assert one(spark, P.attribute(m, "artist", "illustrator")) == "x" and one(spark, P.attribute(m, "rarity")) is None and one(spark, P.attribute(F.lit(None).cast("map<string,string>"), "a")) is None


def test_flattening_routing_and_replay(spark):
    a = spark.createDataFrame([(1, '{"salesByGrade":{"PSA10":{"median":5.5,"count":3},"cgc_9":7,"odd":1,"BGS 8":{"count":2}},"populationByGrader":{"psa":{"10":4,"raw":9,"9":null}}}'), (2, "{}"), (3, None)], "id int, body string")
    assert rows(P.graded_sales(a, "body", ["id"]).withColumn("price", F.col("price").cast("double"))) == [(1, "CGC", "9", 7.0, None), (1, "PSA", "10", 5.5, 3)]
    assert rows(P.populations(a, "body", ["id"])) == [(1, "PSA", "10", 4)]
    w = spark.createDataFrame([(1, 250, 0, None), (2, None, 99, 100)], "id int, loose bigint, nine bigint, ten bigint")
    assert rows(P.minor_to_long(w, ["id"], {"loose": ("raw", None), "nine": ("9", "PSA"), "ten": ("10", "PSA")}).withColumn("amount", F.col("amount").cast("double"))) == [(1, "raw", None, 2.5), (2, "10", "PSA", 1.0), (2, "9", "PSA", 0.99)]
    r = P.route(spark.createDataFrame([("a",), ("b",), (None,)], "kind string"), "kind", ("a",))
    assert {k: v.count() for k, v in r.items()} == {"a": 1, "unrouted": 2}
    q = spark.createDataFrame([(1, "x/1"), (2, "x/1"), (3, "x/1"), (4, "y/1"), (5, "z")], "n int, url string")
    assert [x["reply"] for x in P.replay(q, "url", ["n"], (("^x/", ("first", "rest")), ("/1$", ("other",)))).orderBy("n").collect()] == ["first", "rest", "rest", "other", None]


def test_pages_lose_nothing(spark):
    d = spark.createDataFrame([("s" if i % 3 else None, i) for i in range(50)], "k string, v int")
    p = P.pages(d, ["k"], ["v"], "v", size=4)
    back = p.select("k", F.explode(F.from_json("body", "array<struct<v:int>>")).alias("x")).select("k", "x.v")
    assert rows(back) == rows(d) and p.count() > 5
