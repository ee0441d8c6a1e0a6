"""Fiscal JSON: answers of many services, of which known names are found at any depth.

A body's root is chosen first (``data``, ``result``, ``invoice`` or ``document`` if the body has one that isn't empty, 0 or false). Its
members are walked depth first, in the order of the text; of each field the first hit counts. A body is cut into tokens once, in Arrow
batches, so there is no pass for the depth of bodies, no row a member and no shuffle, but for merging equal ids. What
is no JSON for ``try_parse_json`` isn't walked.

Null, empty and malformed bodies, and bodies without a hit, have empty fields, a total of 0 and no items. Equal ids are one
document, unless the caller says that there are none. Names are compared without regard to case; null and empty members are passed over. An item counts if it has a name or a total.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V

TEXT = r'"(?:[^"\\]++|\\.)*+"'
#: A key, if there is one, and a text, a bracket or another scalar; commas and colons needn't be looked at.
TOKEN = re.compile(rf'(?:({TEXT})\s*:\s*)?({TEXT}|[{{}}\[\]]|[^\s{{}}\[\]:,"]++)', re.S)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def depth(text: Column) -> Column:
    """How deep objects and arrays are nested; brackets within strings don't count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda s, x: F.struct((s["now"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"]).alias("most"))
    end = lambda s: F.greatest(s["most"], s["now"])
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, end)


MAP = "map<string,string>"
KINDS = {"{": "object", "[": "array", '"': "text"}


def said(token: str) -> str:
    """What a text of JSON says; other scalars as they stand. Half a surrogate pair is a question mark, as in the JVM."""
    if token[0] != '"':
        return token
    return json.loads(token, strict=False).encode("utf-8", "replace").decode() if "\\" in token else token[1:-1]


def members(body: str, names: set[str]) -> list[list]:
    """Place, depth, lower-case key, kind, begin and end of the wanted members of a body, in the order of the text.

    Those are the body itself, what stands directly in it as a possible root, and members with one of the names. Places count all members.
    """
    out, stack, place = [], [], -1
    for m in TOKEN.finditer(body):
        key, token = m.groups()
        mark = token[0]
        if mark in "}]":
            stack.pop()[5] = m.end()
            if not stack:
                break
            continue
        place += 1
        low = key and said(key).lower()
        wanted = low in names or not stack or len(stack) == 1 and low in V.JSON_ROOTS and said(key) == low
        if wanted or mark in "{[":
            node = [place, len(stack), low, KINDS.get(mark, "scalar"), m.start(2), m.end()]
            if wanted:
                out.append(node)
            if mark in "{[":
                stack.append(node)
    return out


def chosen(body: str, found: list[list]) -> list | None:
    """The member in which fields are sought."""
    top = found[0]
    direct = {}
    for node in found[1:]:
        if node[1] == 1 and node[2] in V.JSON_ROOTS and top[3] == "object":
            direct.setdefault(node[2], node)
    for name in V.JSON_ROOTS:
        node = direct.get(name)
        if node and node[3] in ("object", "array"):
            return node
        if node and said(body[node[4] : node[5]]) != "" and (node[3] == "text" or body[node[4] : node[5]] not in ("null", "0", "0.0", "false")):
            return None
    return top if top[3] in ("object", "array") else None


def first_hits(body: str | None, fields: dict[str, set[str]], names: set[str]) -> dict[str, dict]:
    """place, raw and kind of the first member of each field that isn't empty."""
    found = members(body, names) if body and body.strip() else []
    root = chosen(body, found) if found else None
    out = {}
    for place, _, low, kind, begin, end in found if root else ():
        if begin <= root[4] or end > root[5] or low not in names:
            continue
        raw = said(body[begin:end]) if kind in ("text", "scalar") else body[begin:end]
        if raw == "" or kind == "scalar" and raw == "null":
            continue
        for field, own in fields.items():
            if field not in out and low in own:
                out[field] = {"place": place, "raw": raw, "kind": kind}
    return out


HIT = pa.struct([("place", pa.int32()), ("raw", pa.string()), ("kind", pa.string())])


def _hits(fields: dict[str, tuple[str, ...]], along: tuple[str, ...]):
    own = {f: {n.lower() for n in names} for f, names in fields.items()}
    every, kept = set().union(*own.values()), ("doc_id", *along)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_hits(body, own, every) for body in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array([x.get(f) for x in found], HIT) for f in own)], [*kept, *own])

    return run


def number(raw: Column) -> Column:
    return S.let(raw, lambda x: F.when(x.rlike(NUMBER), F.trim(x).try_cast("double")).otherwise(0.0))


def item_fields(m: Column) -> dict[str, Column]:
    """The fields of an item (a map); each has several names, some of which are passed over if empty, others only if null."""
    some = lambda f: F.coalesce(*(S.let(F.element_at(m, k), lambda x: F.when(~x.isin("", "0", "false"), x)) for k in V.JSON_ITEM[f]), F.lit(""))
    amount = lambda f: F.coalesce(number(F.coalesce(*(F.element_at(m, k) for k in V.JSON_ITEM[f]))), F.lit(0.0))
    unit = S.let(some("unit"), lambda x: F.when(x == "", "un").otherwise(x))
    return {"code": S.digits(some("code")), "name": some("name"), "quantity": amount("quantity"), "unit": unit, "unit_price": amount("unit_price"), "total": amount("total"), "discount": amount("discount")}


def normalize(docs: DataFrame, unique: bool = False, along: tuple[str, ...] = ()) -> DataFrame:
    """market, cnpj, date, time, total and rows (its items as maps) of each document of (doc_id, body); ``unique`` says that no id comes twice, so other columns may come along."""
    if along and not unique:
        raise ValueError("columns come along with unique ids only")
    texts = docs.select("doc_id", *along, F.when(F.try_parse_json("body").isNotNull(), F.col("body")).alias("text"))
    kinds = ", ".join(f"{f} struct<place:int,raw:string,kind:string>" for f in V.JSON_FIELDS)
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *along))
    x = texts.mapInArrow(_hits(V.JSON_FIELDS, along), f"{kept}, {kinds}")
    if not unique:
        x = x.groupBy("doc_id").agg(*(F.min(f).alias(f) for f in V.JSON_FIELDS))
    # objects and arrays without white space, as Spark writes them
    bare = lambda f: F.element_at(F.from_json(F.concat(F.lit('{"x":'), F.col(f"{f}.raw"), F.lit("}")), MAP), "x")
    said = lambda f: F.coalesce(F.when(F.col(f"{f}.kind").isin("object", "array"), bare(f)).otherwise(F.col(f"{f}.raw")), F.lit(""))
    time = F.when(said("date").contains("T"), F.substring(said("date"), 12, 8)).otherwise(F.substring(said("time"), 1, 8))
    each = F.transform(F.from_json("items.raw", "array<string>"), lambda r: F.from_json(r, MAP))
    listed = F.coalesce(F.from_json("items.raw", f"array<{MAP}>"), each)  # the latter where not all are objects
    rows = F.when(F.col("items.kind") == "array", listed).when(F.col("items.kind") == "object", F.array(F.from_json("items.raw", MAP))).otherwise(F.array().cast(f"array<{MAP}>"))
    x = x.select("doc_id", *along, said("market").alias("market"), S.digits(said("cnpj")).alias("cnpj"), F.substring(said("date"), 1, 10).alias("date"), time.alias("time"), number(said("total")).alias("total"), rows.alias("rows"))
    counts = lambda m: (item_fields(m)["name"] != "") | (item_fields(m)["total"] != 0)
    return x.withColumn("rows", F.filter("rows", counts))


def item_structs(rows: Column) -> Column:
    """The fields of each item. All of them stand in a lambda: as code of a whole stage they are more than the JVM compiles."""
    return F.transform(rows, lambda r: F.struct(*(c.alias(k) for k, c in item_fields(r).items())))


def items(normalized: DataFrame) -> DataFrame:
    """doc_id, n (from 1) and fields of each item."""
    x = normalized.select("doc_id", F.posexplode(item_structs(F.col("rows"))).alias("at", "item"))
    return x.select("doc_id", (F.col("at") + 1).cast("long").alias("n"), "item.*")
