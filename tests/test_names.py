"""The edit join and product matching against all pairs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import scalars as S
from ledgerloom.operators import matching
from ledgerloom.operators.names import edit_join


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def misread(rng, text):
    out = list(text)
    for _ in range(rng.randrange(6)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", "a", "f", "e"])
    return "".join(out)


def names(seed):
    rng = random.Random(seed)
    a = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(18))) for _ in range(110)]
    return a + [None, "", "a", "aa"], [misread(rng, rng.choice(a)) for _ in range(110)] + [None, "", "aaaa", "b" * 60]


@pytest.mark.parametrize("theta", [0.3, 0.4857, 0.55, 0.6, 0.714, 0.83, 0.95, 1.0])
def test_edit_join_equals_all_pairs(spark, theta):
    a, b = names(round(theta * 100))
    frame = lambda side: spark.createDataFrame([(i, s, "xy"[i % 2], theta) for i, s in enumerate(side)], "id long, name string, block string, theta double")
    got = edit_join(frame(a), frame(b)).collect()
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2 and x and y and 1 - distance(x, y) / max(len(x), len(y)) >= theta - 1e-9}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_edit_join_of_nothing(spark):
    none = spark.createDataFrame([], "id long, name string, block string, theta double")
    assert edit_join(none, none).collect() == []


def test_a_block_of_many_unlike_names_gives_few_rows(spark):
    rng = random.Random(1)
    side = spark.createDataFrame([(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)), "hot", 0.714) for i in range(2000)], "id long, name string, block string, theta double")
    assert edit_join(side, side).count() == 2000


def test_scores_equal_those_of_all_pairs(spark):
    """Random items and products with equal and unequal attributes, scored by the plain formula."""
    rng = random.Random(3)
    words = ["leite", "integral", "refrigerante", "cola", "zero", "acucar", "arroz", "tipo", "papel"]
    pick = lambda *x: rng.choice([None, *x])
    row = lambda i, name: (f"{i}", pick("1", "2"), name, pick("Uniao", "Neve", "Coca Cola"), pick("2 l", "1 kg"), pick("un", "kg"), pick("Bebidas", "Mercearia"))
    plain = [" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(60)]
    kind = "barcode string, name string, brand string, pack string, unit string, category string"
    items = spark.createDataFrame([row(i, misread(rng, rng.choice(plain))) for i in range(120)] + [("e", None, "", None, None, None, None), ("n", *[None] * 6)], f"item_id string, {kind}")
    products = spark.createDataFrame([(*row(i, s), [misread(rng, s), ""] if i % 3 else None) for i, s in enumerate(plain)], f"product_id string, {kind}, aliases array<string>")
    got = {(r[0], r[1]): r[3] for r in matching.score_matches(items, products).collect()}
    n, one = S.normalize_receipt, lambda side, c: F.col(f"{side}.{c}")
    both = items.alias("i").crossJoin(products.alias("p"))
    same = lambda f: F.when((f("i") != "") & (f("i") == f("p")), 1.0).otherwise(0.0)
    brand, code = lambda s: n(one(s, "brand")), lambda s: S.digits(one(s, "barcode"))
    pack = lambda s: n(F.when(S.blank(one(s, "pack")) != "", one(s, "pack")).otherwise(S.parse_pack(one(s, "name"))))
    near = F.when((brand("i") != "") & (brand("p") != "") & (brand("i") != brand("p")) & (S.jaccard(S.tokens(one("i", "brand")), S.tokens(one("p", "brand"))) >= 0.8), 0.08).otherwise(0.0)
    of = lambda s: 0.65 * S.jaccard(S.tokens(one("i", "name")), S.tokens(s)) + 0.35 * S.edit_similarity(n(one("i", "name")), n(s))
    best = F.greatest(of(one("p", "name")), *(F.coalesce(of(F.get("p.aliases", F.lit(k))), F.lit(0.0)) for k in (0, 1)))
    raw = best + 0.15 * same(brand) + near + 0.12 * same(pack) + 0.05 * same(lambda s: S.canonical_unit(one(s, "unit"))) + 0.03 * same(lambda s: n(one(s, "category")))
    all_ = both.select("item_id", "product_id", raw.alias("raw"), code("i").alias("ic"), code("p").alias("pc")).collect()
    equal = {(r[0], r[1]) for r in all_ if r["ic"] and r["ic"] == r["pc"]}
    assert set(got) - equal <= {(r[0], r[1]) for r in all_ if r["raw"] >= matching.LEAST - 1e-9}
    assert {(r[0], r[1]) for r in all_ if r["raw"] >= matching.LEAST + 1e-9} | equal <= set(got)
    free = {(r[0], r[1]): min(1.0, r["raw"]) for r in all_ if not (r["ic"] and r["pc"])}
    assert all(abs(got[k] - free[k]) < 1e-9 for k in set(got) & set(free))


def test_items_without_a_common_word_are_found(spark, sf_dir):
    rows = {r["item_id"]: r for r in catalog.queries()["product_match_scores"](spark, sf_dir).collect() if r["item_id"].endswith("-1") and r["product_id"] == r["item_id"][:-2]}
    part = duckdb.connect().execute(f"select count(distinct p_name) from '{sf_dir}/part.parquet'").fetchall()[0][0]
    assert len(rows) >= part // 4 and all(r["status"] in ("WEAK", "NEW", "REVIEW", "STRONG") for r in rows.values())
