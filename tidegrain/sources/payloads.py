"""Payloads of any shape: classified, searched, flattened, routed. Columns hold JSON as text.

A field that is absent and one that is null stay apart. Searches and digests walk trees of unknown shape, for
which the engine has no function; they run in Arrow batches and look at one text at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrain.functions import identity as I  # noqa: E741
from tidegrain.functions import text as X

#: Fields that hold the records of an answer, and fields that tell an error.
ENVELOPES = ("data", "results", "cards", "items", "records", "matches")
ERRORS = ("error", "errors", "detail", "exception", "fault")
DEPTH = 6


def _loads(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _objects(tree: object) -> Iterator[dict]:
    """Every object of a tree, level by level, so a field near the top wins."""
    level = [tree]
    while level:
        yield from (x for x in level if isinstance(x, dict))
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]


def find_field(body: Column, *names: str) -> Column:
    """The value of the field named like one of ``names`` (letters and digits count) nearest the top, as text; empty ones are passed over."""
    wanted = {"".join(ch for ch in n.lower() if ch.isalnum()) for n in names}

    def first(text: str | None) -> str | None:
        for o in _objects(_loads(text)):
            for k, v in o.items():
                if "".join(ch for ch in k.lower() if ch.isascii() and ch.isalnum()) in wanted and v not in (None, "", [], {}):
                    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        return None

    return F.pandas_udf(lambda s: s.map(first), T.StringType())(body)


def key_paths(body: Column, depth: int = DEPTH) -> Column:
    """The sorted paths of all fields down to ``depth`` levels, without values; of a list its first element speaks."""

    def paths(text: str | None) -> list[str]:
        out, todo = set(), [("", _loads(text), 0)]
        while todo:
            at, tree, level = todo.pop()
            if level > depth:
                continue
            if isinstance(tree, dict):
                for k, v in tree.items():
                    here = f"{at}.{k}" if at else k
                    out.add(here)
                    todo.append((here, v, level + 1))
            elif isinstance(tree, list) and tree:
                todo.append((at + "[]", tree[0], level + 1))
        return sorted(out)

    return F.pandas_udf(lambda s: s.map(paths), T.ArrayType(T.StringType()))(body)


def body_class(body: Column, status: Column) -> Column:
    """no-response, error-body, ok, confirmed-empty or unrecognised-shape: only a well-formed empty envelope proves absence."""
    get = lambda k: F.get_json_object(body, f"$.{k}")
    keys = F.json_object_keys(body)
    loose = F.transform(F.coalesce(keys, F.array().cast("array<string>")), X.loose_key)
    hollow = lambda v: F.coalesce(v.isin("", "[]", "{}", "false"), F.lit(True))
    failed = F.lit(False)
    for k in ERRORS:
        failed = failed | (F.array_contains(loose, k) & ~hollow(get(k)))
    code = X.number_in(F.coalesce(get("statusCode"), get("status_code")))
    failed = failed | F.coalesce(code >= 400, F.lit(False))
    listed = F.json_array_length(body)
    out = F.when(F.arrays_overlap(loose, F.array(*[F.lit(k) for k in ("id", "cardid", "name")])), "ok")
    total = X.number_in(F.coalesce(get("total"), get("totalCount"), get("count"), F.get_json_object(body, "$.meta.total")))
    out = out.when(total > 0, "ok").when(total.isNotNull(), "confirmed-empty").otherwise("unrecognised-shape")
    for k in reversed(ENVELOPES):
        holds = F.array_contains(keys, k) & (get(k).isNull() | get(k).startswith("[") | get(k).startswith("{"))
        out = F.when(holds, F.when(F.coalesce(get(k).isin("[]", "{}"), F.lit(True)), "confirmed-empty").otherwise("ok")).otherwise(out)
    return (
        F.when(body.isNull(), "no-response").when(~F.coalesce(status.between(200, 299), F.lit(False)), "error-body").when(F.try_parse_json(body).isNull(), "unrecognised-shape")
        .when(listed > 0, "ok").when(listed == 0, "confirmed-empty").when(keys.isNull(), "unrecognised-shape").when(failed, "error-body").otherwise(out)
    )


def sealed_product(hit: Column) -> Column:
    """Whether a record's type fields are present and all empty and its rarity is too; silence is no answer."""
    keys = F.json_object_keys(hit)
    names = ("cardType", "card_type", "type")
    some, all_empty = F.lit(False), F.lit(True)
    for n in names:
        has = F.coalesce(F.array_contains(keys, n), F.lit(False))
        some, all_empty = some | has, all_empty & (~has | (F.coalesce(F.get_json_object(hit, f"$.{n}"), F.lit("")) == ""))
    return some & all_empty & (F.coalesce(F.get_json_object(hit, "$.rarity"), F.lit("")) == "")


def attribute(attributes: Column, *names: str) -> Column:
    """The first non-empty of the named entries of a map, whatever the case of its keys; of keys equal but for case the last."""
    lower = F.transform(F.map_entries(attributes), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    pick = lambda n: F.nullif(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(lower, lambda e: e["key"] == n.lower()), lambda e: e["value"])), -1), F.lit(""))
    return F.coalesce(*[pick(n) for n in names])


def graded_sales(answers: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """``keep, grader, grade, price, sample`` per readable key of ``salesByGrade``; entries are numbers or objects."""
    entry = F.explode(F.from_json(F.get_json_object(body, "$.salesByGrade"), "map<string,string>"))
    got = answers.select(*keep, entry.alias("_key", "_v")).withColumn("_g", I.grade_in(F.col("_key")))
    inner = lambda *names: F.coalesce(*[F.get_json_object("_v", f"$.{n}") for n in names])
    price = F.coalesce(inner("median", "average", "price"), F.when(~F.col("_v").startswith("{"), F.col("_v"))).try_cast("decimal(18,4)")
    return got.where("_g.grade IS NOT NULL").select(*keep, "_g.grader", "_g.grade", price.alias("price"), inner("count").try_cast("int").alias("sample")).where("price IS NOT NULL")


def populations(answers: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """``keep, grader, grade, count`` per grader and readable grade of ``populationByGrader``; raw and empty counts are none."""
    by = F.explode(F.from_json(F.get_json_object(body, "$.populationByGrader"), "map<string,map<string,string>>"))
    got = answers.select(*keep, by.alias("_grader", "_grades")).select(*keep, "_grader", F.explode("_grades").alias("_k", "_n"))
    grade = I.lookup(F.lower("_k"), I.GRADES)
    return got.select(*keep, F.upper("_grader").alias("grader"), grade.alias("grade"), F.col("_n").try_cast("bigint").alias("count")).where("grade IS NOT NULL AND grade != 'raw' AND count IS NOT NULL")


def minor_to_long(rows: DataFrame, keep: Sequence[str], fields: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """``keep, grade, grader, amount``: one row per priced field, minor units as exact decimals; null and 0 are no price."""
    long = rows.unpivot(list(keep), list(fields), "_field", "_minor").where("_minor IS NOT NULL AND _minor != 0")
    grade, grader = I.lookup(F.col("_field"), {k: v[0] for k, v in fields.items()}), I.lookup(F.col("_field"), {k: v[1] for k, v in fields.items() if v[1]})
    return long.select(*keep, grade.alias("grade"), grader.alias("grader"), (F.col("_minor").cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)").alias("amount"))


def route(records: DataFrame, kind: str, sinks: Sequence[str]) -> dict[str, DataFrame]:
    """The records of every sink by their kind, and under ``unrouted`` those no sink takes, null kinds included."""
    out = {s: records.where(F.col(kind) == s) for s in sinks}
    return out | {"unrouted": records.where(~F.coalesce(F.col(kind).isin(*sinks), F.lit(False)))}


def replay(requests: DataFrame, url: str, order: Sequence[str], fixtures: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``requests`` with ``reply``: the first pattern that fits the url answers with its n-th body, the last one repeating.

    Fixtures are a setting; n counts the requests of one url, so urls are ranked apart from each other.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(url).orderBy(*order))
    reply = F.lit(None).cast("string")
    for pattern, bodies in reversed(fixtures):
        at = F.least(n, F.lit(len(bodies))).cast("int")
        reply = F.when(F.col(url).rlike(pattern), F.element_at(F.array(*[F.lit(b) for b in bodies]), at)).otherwise(reply)
    return requests.withColumn("reply", reply)


def setting_rows(settings: Mapping, at: str = "") -> list[tuple[str, str | None, str]]:
    """``(path, value, kind)`` per leaf of nested settings."""
    out: list[tuple[str, str | None, str]] = []
    for k, v in settings.items():
        here = f"{at}.{k}" if at else str(k)
        if isinstance(v, Mapping):
            out += setting_rows(v, here)
        else:
            out.append((here, None if v is None else str(v), "null" if v is None else type(v).__name__))
    return out


def landed(answers: DataFrame, source: str, at: str, folder: str) -> None:
    """Payloads as they came, before anything is parsed, one folder per source and month."""
    answers.withColumn("month", F.date_format(at, "yyyy-MM")).hint("rebalance", source, "month").write.mode("append").partitionBy(source, "month").parquet(folder)


def pages(rows: DataFrame, keys: Sequence[str], item: Sequence[str], order: str, size: int = 500) -> DataFrame:
    """``keys, page, body``: rows as JSON lists of at most about ``size`` items; no list grows with its group."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(n[k])
    paged = rows.join(n.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n"), [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys])
    page = F.pmod(F.xxhash64(order), F.greatest(F.ceil(F.col("_n") / size), F.lit(1))).cast("int")
    return paged.withColumn("page", page).groupBy(*keys, "page").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*item)))).alias("body"))
