import math
import random
from collections import defaultdict

from tidegrain.llm import packing


def load(spark, sizes):
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "doc_id bigint, tokens bigint, container int")
    return packing.pack(df, "doc_id", "tokens", capacity=100, bins_per_shard=50).collect()


def check(spark, sizes):
    got = load(spark, sizes)
    fill, parts = defaultdict(int), defaultdict(int)
    for r in got:
        fill[r["container"]] += r["size"]
        parts[r["doc_id"]] += r["size"]
        assert r["size"] == 100 or sizes[r["doc_id"]] <= 100 or r["piece"] == sizes[r["doc_id"]] // 100
    assert max(fill.values(), default=0) <= 100
    assert parts == {i: s for i, s in enumerate(sizes) if s}
    return fill


def test_everything_is_packed_once_and_tightly(spark):
    r = random.Random(3)
    sizes = [min(250, max(1, int(r.lognormvariate(3.3, 0.7)))) for _ in range(3000)]
    fill = check(spark, sizes)
    assert len(fill) <= 1.005 * math.ceil(sum(sizes) / 100) + 2  # twenty shards and the rounds after them


def test_edges(spark):
    assert check(spark, []) == {}
    assert sorted(check(spark, [100, 200, 250, 50]).values()) == [100] * 6
    assert sorted(check(spark, [100, 0, 350]).values()) == [50, 100, 100, 100, 100]
    got = load(spark, [None, 5, 5, 5])
    assert [r["size"] for r in got] == [5, 5, 5]


def test_search_raises_the_sum_of_squares():
    r = random.Random(5)
    sizes = [r.randrange(20, 70) for _ in range(400)]
    bins = [[i] for i in range(0, 400)]
    before = sum(s * s for s in sizes)
    after = packing.improve([list(b) for b in bins], sizes, 100)
    assert sorted(i for b in after for i in b) == list(range(400))
    fills = [sum(sizes[i] for i in b) for b in after]
    assert max(fills) <= 100 and sum(f * f for f in fills) > before and len(after) < 400


def test_the_search_does_the_packing(spark):
    r = random.Random(9)
    sizes = [min(99, max(1, int(r.lognormvariate(3.3, 0.7)))) for _ in range(2000)]
    bound = math.ceil(sum(sizes) / 100)
    dealt = packing.next_fit(sizes, 100)
    found = packing.improve([list(b) for b in dealt], sizes, 100)
    assert len(dealt) > 1.1 * bound and len(found) <= 1.001 * bound + 1
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint")
    count = lambda sweeps: packing.pack(df, "doc_id", "tokens", capacity=100, sweeps=sweeps).select("container").distinct().count()
    assert count(0) > 1.1 * bound and count(None) <= 1.001 * bound + 1


def test_it_ends_where_nothing_gains():
    r = random.Random(2)
    sizes = [r.randrange(1, 100) for _ in range(300)]
    once = packing.improve(packing.next_fit(sizes, 100), sizes, 100)
    fills = sorted(sum(sizes[i] for i in b) for b in once)
    again = packing.improve([list(b) for b in once], sizes, 100)
    assert sorted(sum(sizes[i] for i in b) for b in again) == fills


def test_items_that_cannot_share(spark):
    assert sorted(check(spark, [60] * 300).values()) == [60] * 300


def test_bins_of_many_items_exchange_two_for_one():
    sizes = [40, 50, 30, 30, *[2] * 11]
    bins = packing.improve([[0, 1], list(range(2, 15))], sizes, 100, sweeps=1)
    assert [30, 30, 40] in [sorted(sizes[i] for i in b) for b in bins]


def test_an_exchange_behind_many_that_do_not_help_is_found():
    sizes = [60, 34, 10] + [35, 61] * 9
    bins = packing.improve([[0], [1, 2], *[[i, i + 1] for i in range(3, 21, 2)]], sizes, 100, sweeps=1)
    assert sum(sizes[i] for i in next(b for b in bins if 0 in b)) == 94
