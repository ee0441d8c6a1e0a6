"""Entity resolution: products, markets, OCR clusters and vision rows.

Candidates are made by equi-joins on codes, on shared words and on letters, never by pairing all rows, and no pair that
decides anything is lost; distinct names are scored once each and joined back. Scores are capped at 1 before candidates are ranked; ties go by product id.
The two greedy algorithms depend on the order of a receipt's rows and run once per receipt.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..plans import duck as D
from ..plans.model import Model
from ..plans.registry import Extended, Fixture, query
from .names import edit_join
from .scalars import PAIRS_SQL, name_pairs, score4

PRODUCTS = Fixture(
    "product_id string, barcode string, name string, aliases array<string>, brand string, pack string, unit string, category string",
    [
        ("p1", "7891", "Refrigerante Coca Cola 2L", ["coca cola 2 litros", "bebida cola"], "Coca Cola", "2 l", "un", "Bebidas"),
        ("p2", "7892", "Refrigerante Coca Cola Zero 2L", [], "Coca Cola", "2 l", "un", "Bebidas"),
        ("p3", "7893", "Açúcar União 1kg", ["acucar refinado uniao"], "União", "1 kg", "un", "Mercearia"),
        ("p4", None, "Papel Higiênico Neve 12 rolos", None, "Neve", None, None, None),
        ("p5", "7895", "Leite Integral 1L", [], None, "1 l", "l", "Laticínios"),
    ],
)
WANTED = Fixture(
    "item_id string, barcode string, name string, brand string, pack string, unit string, category string",
    [
        ("m1", "7891", "REFRI COCA COLA 2L", None, None, None, None),
        ("m2", None, "Bebida cola 2L", None, None, "un", None),
        ("m3", "9999", "Refrigerante Coca Cola 2L", "Coca Cola", "2 l", "un", "Bebidas"),
        ("m4", "7892", "Refrigerante Coca Cola 2L", None, None, None, None),
        ("m5", None, "Refrigerante Coca Cola 2L", "Coca Cola", "2 l", "un", None),
        ("m6", None, "Acuc União 1kg", "União", "1 kg", "un", "Mercearia"),
        ("m7", None, "p hig neve 12 rolos", "neve", None, None, None),
        ("m8", None, "Detergente", None, None, None, None),
        ("m9", None, None, None, None, None, None),
    ],
)


#: A pair below this score decides nothing: .60 makes a match, and a rival within .08 makes it ambiguous.
LEAST = 0.52
#: What equal attributes add to the score of the names, in the order in which they are added.
BRAND, NEAR_BRAND, PACK, UNIT, CATEGORY = 0.15, 0.08, 0.12, 0.05, 0.03
SLACK = 1e-9


def match_features(side: DataFrame, id_col: str, names: Column) -> DataFrame:
    """id, code, name and the normalized attributes that a score compares; ``names`` are all names of a row."""
    n = S.normalize_receipt
    filled = F.filter(names, lambda s: S.blank(s) != "")
    packed = n(F.when(S.blank(F.col("pack")) != "", F.col("pack")).otherwise(S.parse_pack(F.col("name"))))
    attributes = {"brand": n(F.col("brand")), "brand_words": S.tokens(F.col("brand")), "pack": packed, "unit": S.canonical_unit(F.col("unit")), "category": n(F.col("category"))}
    forms = F.transform(filled, lambda s: F.struct(n(s).alias("name"), S.tokens(s).alias("words")))
    return side.select(F.col(id_col).alias("id"), S.digits(F.col("barcode")).alias("code"), n(F.col("name")).alias("own"), forms.alias("forms"), *(c.alias(k) for k, c in attributes.items()))


def attribute_rules(a: str, b: str) -> list[tuple[Column, float]]:
    """Conditions on two rows of features, and what each adds."""
    pair = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    equal = lambda c: (pair(c)[0] != "") & (pair(c)[0] == pair(c)[1])
    near = (pair("brand")[0] != "") & (pair("brand")[1] != "") & (pair("brand")[0] != pair("brand")[1]) & (S.jaccard(*pair("brand_words")) >= 0.8)
    return [(equal("brand"), BRAND), (near, NEAR_BRAND), (equal("pack"), PACK), (equal("unit"), UNIT), (equal("category"), CATEGORY)]


def added(start: Column, rules: list[tuple[Column, float]]) -> Column:
    for rule, more in rules:
        start = start + F.when(rule, more).otherwise(0.0)
    return start


def by_shared_word(items: DataFrame, products: DataFrame, least: float) -> DataFrame:
    """Pairs with a word in common whose score can reach ``least``: the words' part is exact, the letters' at most the lengths' ratio.

    A pair of names meets at each common word and is kept at the first, within the join's condition.
    """
    of = lambda f: f.withColumn("form", F.explode("forms")).withColumn("word", F.explode("form.words"))
    i, p = of(items).alias("i"), of(products).alias("p")
    first = F.get(F.array_intersect("i.form.words", "p.form.words"), F.lit(0)) == F.col("i.word")
    li, lp = F.length("i.form.name"), F.length("p.form.name")
    most = 0.65 * S.jaccard(F.col("i.form.words"), F.col("p.form.words")) + 0.35 * F.least(li, lp) / F.greatest(li, lp)
    can = added(most, attribute_rules("i", "p")) >= least - SLACK
    return i.join(p, (F.col("i.word") == F.col("p.word")) & first & can).select(F.col("i.id").alias("item_id"), F.col("p.id").alias("product_id"))


def by_letters(items: DataFrame, products: DataFrame, least: float) -> DataFrame:
    """Pairs that can reach ``least`` without a word in common: equal attributes make up for it, so only rows with equal ones are joined."""
    blocks = [(("brand", "pack", "unit", "category"), BRAND + PACK + UNIT + CATEGORY), (("brand", "pack"), BRAND + PACK + UNIT), (("brand",), BRAND + UNIT + CATEGORY), (("pack",), NEAR_BRAND + PACK + UNIT + CATEGORY)]
    made = []
    for at, (keys, most) in enumerate(blocks):
        theta = (least - most) / 0.35
        if theta <= 1:
            full = F.array_size(F.filter(F.array(*keys), lambda x: x != "")) == len(keys)
            made.append(F.when(full, F.struct(F.concat_ws("|", F.lit(str(at)), *keys).alias("block"), F.lit(max(theta, SLACK)).alias("theta"))))
    if not made:
        return items.select(F.col("id").alias("item_id"), F.col("id").alias("product_id")).where(F.lit(False))
    split = lambda f: f.withColumn("name", F.explode("forms.name")).withColumn("b", F.explode(F.array_compact(F.array(*made)))).select("id", "name", "b.block", "b.theta")
    return edit_join(split(items), split(products)).toDF("item_id", "product_id")


def match_candidates(items: DataFrame, products: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of features with one code, and all pairs whose score reaches ``least`` (some that don't are among them)."""
    code = lambda f, name: f.where("code <> ''").select(F.col("id").alias(name), "code")
    by_code = code(items, "item_id").join(code(products, "product_id"), "code").select("item_id", "product_id")
    return by_code.unionByName(by_shared_word(items, products, least)).unionByName(by_letters(items, products, least)).distinct()


def score_matches(items: DataFrame, products: DataFrame, least: float = LEAST) -> DataFrame:
    """item_id, product_id, status and score of each pair with one code or a score of ``least`` or more; no such pair is missing."""
    a = match_features(items, "item_id", F.array("name"))
    b = match_features(products, "product_id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    x = match_candidates(a, b, least).join(a.alias("i"), F.col("item_id") == F.col("i.id")).join(b.alias("p"), F.col("product_id") == F.col("p.id"))
    ib, pb = F.col("i.code"), F.col("p.code")
    both = (ib != "") & (pb != "")
    variant = F.lit(False)
    for v in V.VARIANTS:
        variant = variant | (F.col("i.own").contains(v) != F.col("p.own").contains(v))
    one = F.get("i.forms", F.lit(0))
    best = F.coalesce(F.array_max(F.transform("p.forms", lambda s: 0.65 * S.jaccard(one["words"], s["words"]) + 0.35 * S.edit_similarity(one["name"], s["name"]))), F.lit(0.0))
    rules = attribute_rules("i", "p")
    x = x.withColumn("best", best).withColumn("raw", added(F.col("best"), rules))
    x = x.withColumn("reasons", sum((F.when(rule, 1).otherwise(0) for rule, _ in rules), F.when(F.col("best") >= 0.55, 1).otherwise(0)))
    x = x.withColumn("kind", F.when(both & (ib != pb), "CONFLICT").when(both & variant, "REVIEW").when(both, "EXACT"))
    firm = F.col("reasons") >= 2
    status = F.when((F.col("raw") >= 0.9) & firm, "STRONG").when((F.col("raw") >= 0.78) & firm, "REVIEW").when(F.col("raw") >= 0.6, "WEAK").otherwise("NEW")
    score = F.when(F.col("kind") == "CONFLICT", 0.0).when(F.col("kind") == "REVIEW", 0.89).when(F.col("kind") == "EXACT", 1.0).otherwise(F.least(F.lit(1.0), F.col("raw")))
    return x.where((both & (ib == pb)) | (F.col("raw") >= least)).select("item_id", "product_id", F.coalesce("kind", status).alias("status"), score.alias("score"))


def _score_sql() -> str:
    best = f"list_max([0.65::double * ({D.jaccard('ti', D.tokens('nm'))}) + 0.35::double * ({D.edit('si', D.norm_receipt('nm'))}) for nm in names])"
    variant = " or ".join(f"contains({D.norm_receipt('i.name')}, '{v}') <> contains({D.norm_receipt('p.name')}, '{v}')" for v in V.VARIANTS)
    pk = lambda s: D.norm_receipt(f"(case when coalesce({s}.pack, '') <> '' then {s}.pack else {D.pack(s + '.name')} end)")
    return f"""sa as (select i.item_id, p.product_id, {D.digits('i.barcode')} as ib, {D.digits('p.barcode')} as pb, ({variant}) as variant, {D.tokens('i.name')} as ti, {D.norm_receipt('i.name')} as si,
 [z for z in list_concat([p.name], coalesce(p.aliases, [])) if coalesce(z, '') <> ''] as names, {D.norm_receipt('i.brand')} as br, {D.norm_receipt('p.brand')} as pr, {D.tokens('i.brand')} as bt, {D.tokens('p.brand')} as pt,
 {pk('i')} as ipk, {pk('p')} as ppk, {D.unit('i.unit')} as iu, {D.unit('p.unit')} as pu, {D.norm_receipt('i.category')} as ic, {D.norm_receipt('p.category')} as pc from i, p),
sb as (select *, ib <> '' and pb <> '' as coded, coalesce({best}, 0.0)::double as best, br <> '' and br = pr as same_brand, br <> '' and pr <> '' and br <> pr and ({D.jaccard('bt', 'pt')}) >= 0.8 as near_brand from sa),
sc as (select *, best + case when same_brand then 0.15::double else 0 end + case when near_brand then 0.08::double else 0 end + case when ipk <> '' and ipk = ppk then 0.12::double else 0 end + case when iu <> '' and iu = pu then 0.05::double else 0 end + case when ic <> '' and ic = pc then 0.03::double else 0 end as raw,
 (best >= 0.55)::int + same_brand::int + near_brand::int + (ipk <> '' and ipk = ppk)::int + (iu <> '' and iu = pu)::int + (ic <> '' and ic = pc)::int as reasons from sb),
scored as (select item_id, product_id, case when coded and ib <> pb then 'CONFLICT' when coded and variant then 'REVIEW' when coded then 'EXACT' when raw >= 0.9 and reasons >= 2 then 'STRONG' when raw >= 0.78 and reasons >= 2 then 'REVIEW' when raw >= 0.6 then 'WEAK' else 'NEW' end as status,
 case when coded and ib <> pb then 0.0 when coded and variant then 0.89 when coded then 1.0 else least(1.0::double, raw) end::double as score from sc where (coded and ib = pb) or raw >= {LEAST}::double)"""


#: One product for each distinct name of the part table, and items that misread it: all vowels double (no word is left), letters as
#: digits, cut, or as it is. The statements run in both engines.
CATALOG = "select min(p_partkey) as k, p_name as name, min(p_brand) as brand, min(p_type) as category from part group by p_name"
CATALOG_PRODUCTS = "select 'k' || k as product_id, case when k % 5 = 0 then '788' || k end as barcode, name, null as aliases, brand, case when k % 2 = 0 then '2 l' end as pack, 'un' as unit, category from base"
MISREAD_ITEMS = " union all ".join(
    f"select 'k' || k || '-{i}' as item_id, {code} as barcode, {name} as name, {brand} as brand, {pack} as pack, 'un' as unit, {category} as category from base"
    for i, (code, name, brand, pack, category) in enumerate([
        ("null", "name", "null", "null", "null"),
        ("null", "replace(replace(replace(replace(replace(name, 'a', 'aa'), 'e', 'ee'), 'i', 'ii'), 'o', 'oo'), 'u', 'uu')", "brand", "'2 l'", "category"),
        ("null", "translate(name, 'lis', '1l5')", "brand", "null", "null"),
        ("case when k % 5 = 0 then '788' || k else '777' end", "upper(substr(name, 3))", "null", "'2 l'", "category"),
    ])
)


def match_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items and products of the fixtures and of the part table."""
    base = f"with base as ({CATALOG.replace('from part', 'from {part}')}) "
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    items, products = spark.sql(base + MISREAD_ITEMS, part=part), spark.sql(base + CATALOG_PRODUCTS, part=part)
    as_is = lambda df, like: df.select(*(F.col(f.name).cast(f.dataType) for f in like.schema))
    i, p = WANTED.df(spark), PRODUCTS.df(spark)
    return i.unionByName(as_is(items, i)), p.unionByName(as_is(products, p))


SCORES = f"with {WANTED.cte('wi')}, {PRODUCTS.cte('wp')}, base as ({CATALOG}), i as (select * from wi union all ({MISREAD_ITEMS})), p as (select * from wp union all ({CATALOG_PRODUCTS})), {_score_sql()}"


@query("product_match_scores", f"{SCORES} select item_id, product_id, status, {D.score4('score')} as score from scored")
def product_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with one code or a score of .52 or more."""
    return score_matches(*match_inputs(spark, sf_dir)).select("item_id", "product_id", "status", score4(F.col("score")).alias("score"))


def decide_matches(items: DataFrame, products: DataFrame) -> DataFrame:
    """item_id, status, ambiguous, score and product of each item; the product only if exact or strong and alone."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "product_id")
    ranked = score_matches(items, products).where("status <> 'CONFLICT'").withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("rank = 1")
    x = items.select("item_id").join(ranked, "item_id", "left")
    ambiguous = F.coalesce((F.col("status") != "EXACT") & F.col("next").isNotNull() & (F.col("score") >= 0.6) & (F.col("score") - F.col("next") < 0.08), F.lit(False))
    status = F.when(ambiguous, "AMBIGUOUS").otherwise(F.coalesce("status", F.lit("NEW")))
    return x.select("item_id", status.alias("status"), ambiguous.alias("ambiguous"), score4(F.coalesce("score", F.lit(0.0))).alias("score"), F.when(~ambiguous & F.col("status").isin("EXACT", "STRONG"), F.col("product_id")).alias("product_id"))


@query("product_match_decision", f"""{SCORES}, rk as (select *, row_number() over w as r, lead(score) over w as nx from scored where status <> 'CONFLICT' window w as (partition by item_id order by score desc, product_id)),
tp as (select i.item_id, coalesce(status <> 'EXACT' and nx is not null and score >= 0.6 and score - nx < 0.08, false) as ambiguous, status, score, product_id from i left join (select * from rk where r = 1) using (item_id))
select item_id, case when ambiguous then 'AMBIGUOUS' else coalesce(status, 'NEW') end as status, ambiguous, {D.score4('coalesce(score, 0.0)')} as score, case when not ambiguous and status in ('EXACT', 'STRONG') then product_id end as product_id from tp""")
def product_match_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide_matches(*match_inputs(spark, sf_dir))


@query("product_name_neighbours", f"with {PAIRS_SQL}, s as (select * from (select a, b, 0.65::double * ({D.jaccard('ta', 'tb')}) + 0.35::double * ({D.edit('sa', 'sb')}) as score from pairs) where score > 0.35::double), o as (select a, b, score from s union all select b, a, score from s), r as (select *, row_number() over (partition by a order by floor(score * 10000 + 0.5) desc, b) as r from o) select a as name, b as neighbour, {D.score4('score')} as score from r where r <= 5")
def product_name_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest names of each product name (five is how many candidates a decision shows), of those that score above .35.

    Names without a word in common reach .35 at most, so the join on words finds all of them.
    """
    x = name_pairs(spark, sf_dir)
    s = 0.65 * S.jaccard(S.tokens(F.col("a")), S.tokens(F.col("b"))) + 0.35 * S.edit_similarity(S.normalize_receipt(F.col("a")), S.normalize_receipt(F.col("b")))
    one = x.withColumn("exact", s).where("exact > 0.35D").select("a", "b", score4(F.col("exact")).alias("score"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return both.withColumn("r", F.row_number().over(w)).where("r <= 5").select(F.col("a").alias("name"), F.col("b").alias("neighbour"), "score")


ITEM_PAIRS = Extended(
    "id long, code_a string, name_a string, total_a double, qty_a double, code_b string, name_b string, total_b double, qty_b double",
    [(1, "789", "Leite", 5.0, 1.0, "7-89", "leite", 5.03, 1.0), (2, None, "Leite integral", 5.0, 1.0, None, "Leite desnatado", 5.04, 2.0), (3, "1", "", 0.0, None, "2", None, 0.0, None), (4, None, "Pão de queijo", 9.0, 1.0, None, "queijo de pao", 9.0, 1.0005)],
    "select l_orderkey + 1000000 as id, case when l_partkey % 3 = 0 then cast(l_partkey as varchar(20)) end as code_a, p_name as name_a, l_extendedprice as total_a, l_quantity as qty_a, case when l_partkey % 2 = 0 then cast(l_partkey as varchar(20)) end as code_b, case when l_linenumber = 1 then upper(p_name) else p_name || ' zero' end as name_b, l_extendedprice + (l_orderkey % 3) * 0.02e0 as total_b, l_quantity + l_orderkey % 2 as qty_b from {lineitem} join {part} on l_partkey = p_partkey",
)


def item_similarity(a: dict[str, Column], b: dict[str, Column], tolerance: float = 0.03, with_quantity: bool = True) -> Column:
    """Code .55, equal name .35 or .30 times the words' Jaccard, total .25, quantity .10; capped at 1."""
    ca, cb, na, nb = S.digits(a["code"]), S.digits(b["code"]), S.normalize(a["name"]), S.normalize(b["name"])
    wa, wb = F.array_distinct(F.split(na, " ")), F.array_distinct(F.split(nb, " "))
    name = F.when((na == "") | (nb == ""), 0.0).when(na == nb, 0.35).otherwise(0.3 * F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))
    some = lambda x, y: F.coalesce((x != 0) & (y != 0), F.lit(False))
    s = F.when((S.blank(a["code"]) != "") & (S.blank(b["code"]) != "") & (ca == cb), 0.55).otherwise(0.0) + name
    s = s + F.when(some(a["total"], b["total"]) & (F.abs(a["total"] - b["total"]) <= tolerance), 0.25).otherwise(0.0)
    if with_quantity:
        s = s + F.when(some(a["qty"], b["qty"]) & (F.abs(a["qty"] - b["qty"]) <= 0.001), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), s)


def _similarity_sql(tolerance: float, quantity: bool) -> str:
    na, nb = D.norm("name_a"), D.norm("name_b")
    wa, wb = f"list_distinct(string_split({na}, ' '))", f"list_distinct(string_split({nb}, ' '))"
    more = " + case when coalesce(qty_a <> 0 and qty_b <> 0, false) and abs(qty_a - qty_b) <= 0.001 then 0.1::double else 0 end" if quantity else ""
    return f"least(1.0::double, case when coalesce(code_a, '') <> '' and coalesce(code_b, '') <> '' and {D.digits('code_a')} = {D.digits('code_b')} then 0.55::double else 0 end + case when {na} = '' or {nb} = '' then 0.0::double when {na} = {nb} then 0.35::double else 0.3::double * len(list_intersect({wa}, {wb})) / len(list_distinct(list_concat({wa}, {wb}))) end + case when coalesce(total_a <> 0 and total_b <> 0, false) and abs(total_a - total_b) <= {tolerance} then 0.25::double else 0 end{more})"


@query("item_similarity", f"with {ITEM_PAIRS.cte('t')} select id, {D.score4(_similarity_sql(0.03, True))} as ocr, {D.score4(_similarity_sql(0.05, False))} as vision from t")
def item_similarity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: {"code": F.col(f"code_{s}"), "name": F.col(f"name_{s}"), "total": F.col(f"total_{s}"), "qty": F.col(f"qty_{s}")}
    return ITEM_PAIRS.df(spark, sf_dir).select("id", score4(item_similarity(side("a"), side("b"))).alias("ocr"), score4(item_similarity(side("a"), side("b"), 0.05, False)).alias("vision"))


def key_lookup(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """Code first, else name: two equi-joins and the best hit, not a join on OR. Names are reduced to one product first."""
    wanted = wanted.select("code", "name").distinct()
    k = products.select("product_id", F.col("name").alias("p_name"))
    by_code = wanted.join(k, F.col("code") == F.col("product_id")).select("code", "product_id", F.lit(1).alias("by_key"))
    first = k.groupBy("p_name").agg(F.min("product_id").alias("product_id"))
    by_name = wanted.join(first, F.col("name") == F.col("p_name")).select("code", "product_id", F.lit(2).alias("by_key"))
    best = by_code.unionByName(by_name).groupBy("code").agg(F.min(F.struct("by_key", "product_id")).alias("b"))
    return best.select("code", "b.product_id", "b.by_key")


@query("or_key_lookup", """with l as (select distinct l_partkey as code, p_name as name from lineitem left join part on l_partkey = p_partkey),
hits as (select l.code, k.p_partkey, 1 as pri from l join part k on l.code = k.p_partkey union all select l.code, k.p_partkey, 2 from l join (select p_name, min(p_partkey) as p_partkey from part group by 1) k on l.name = k.p_name)
select code, p_partkey as product_id, pri as by_key from (select *, row_number() over (partition by code order by pri, p_partkey) as r from hits) where r = 1""")
def or_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct codes of all lines with their names."""
    m = Model(spark, sf_dir)
    codes = m.items.select(F.col("product_id").alias("code")).distinct()
    return key_lookup(codes.join(m.products.select(F.col("product_id").alias("code"), "name"), "code", "left"), m.products)


SEED_MARKETS = Fixture("name string, neighborhood string, address string", [("Customer#000000001", "NATION_19", ""), ("Supermercado Novo", "Centro", "Rua A, 1"), ("supermercado  NOVO", "centro", "rua a 1"), ("Mercado Velho", None, None)])


@query("anti_seed_insert", f"with {SEED_MARKETS.cte('s')}, m as (select {D.norm('c_name')} as n, {D.norm('n_name')} as b from customer join nation on c_nationkey = n_nationkey), k as (select *, {D.norm('name')} as n, {D.norm('neighborhood')} as b, {D.norm('address')} as a from s), u as (select n, b, a, max(name) as name from k group by 1, 2, 3) select name, n as key from u where not exists (select 1 from m where m.n = u.n and m.b = u.b and u.a = '')")
def anti_seed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: S.normalize(F.col(c))
    seeds = SEED_MARKETS.df(spark).select("name", key("name").alias("n"), key("neighborhood").alias("b"), key("address").alias("a"))
    seeds = seeds.groupBy("n", "b", "a").agg(F.max("name").alias("name"))
    there = Model(spark, sf_dir).markets.select(key("name").alias("n"), key("neighborhood").alias("b"), F.lit("").alias("a"))
    return seeds.join(there, ["n", "b", "a"], "left_anti").select("name", F.col("n").alias("key"))


READINGS = Extended(
    "receipt_id string, seq long, total string, date string, structural double, ocr double", [("a", 1, "10.00", "2026-01-01", 20.0, 0.5), ("a", 2, "12.00", "2026-01-02", 25.0, 0.1), ("a", 3, "12.00", "2026-01-01", 19.0, 0.9), ("a", 4, "10.00", None, 3.0, None), ("b", 1, None, "", 4.0, 0.2), ("b", 2, "7.50", "2026-02-01", 4.0, 0.2)],
    "select 'o' || o_orderkey as receipt_id, 1 as seq, cast(o_totalprice as varchar(30)) as total, cast(cast(o_orderdate as date) as varchar(20)) as date, (o_orderkey % 23) * 1e0 as structural, case when o_orderkey % 4 <> 1 then (o_orderkey % 7) / 1e1 end as ocr from {orders} union all select 'o' || o_orderkey as receipt_id, 2 as seq, case when o_orderkey % 3 = 0 then '1.00' else cast(o_totalprice as varchar(30)) end as total, '' as date, (o_orderkey % 19) * 1e0 as structural, case when o_orderkey % 4 <> 2 then (o_orderkey % 7) / 1e1 end as ocr from {orders} union all select 'o' || o_orderkey as receipt_id, 3 as seq, case when o_orderkey % 3 = 0 then '1.00' else cast(o_totalprice as varchar(30)) end as total, cast(cast(o_orderdate as date) as varchar(20)) as date, (o_orderkey % 29) * 1e0 as structural, case when o_orderkey % 4 <> 3 then (o_orderkey % 7) / 1e1 end as ocr from {orders}",
)


@query("consensus_vote", f"with {READINGS.cte('t')}, v as (select receipt_id, 'total' as field, total as value, seq from t union all select receipt_id, 'date', date, seq from t), c as (select receipt_id, field, value, count(*) as votes, min(seq) as first from v where coalesce(value, '') <> '' group by 1, 2, 3), r as (select *, row_number() over (partition by receipt_id, field order by votes desc, first) as r from c) select receipt_id, field, value, votes from r where r = 1")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, of equals the one seen first; struct order replaces a sort."""
    both = F.explode(F.array(F.struct(F.lit("total").alias("field"), F.col("total").alias("value")), F.struct(F.lit("date").alias("field"), F.col("date").alias("value"))))
    v = READINGS.df(spark, sf_dir).select("receipt_id", "seq", both.alias("v")).select("receipt_id", "seq", "v.*").where("coalesce(value, '') <> ''")
    counted = v.groupBy("receipt_id", "field", "value").agg(F.count("*").alias("votes"), F.min("seq").alias("first"))
    best = counted.groupBy("receipt_id", "field").agg(F.max(F.struct("votes", -F.col("first"), "value")).alias("b"))
    return best.select("receipt_id", "field", "b.value", "b.votes")


@query("ocr_topk", f"with {READINGS.cte('t')}, r as (select *, structural + 8 * coalesce(ocr, 0) as score, row_number() over (partition by receipt_id order by structural + 8 * coalesce(ocr, 0) desc, seq) as r from t) select receipt_id, seq, {D.score4('score')} as score, r as rank from r where r <= 12")
def ocr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best readings of each receipt (the limit is the operator's)."""
    score = F.col("structural") + 8 * F.coalesce("ocr", F.lit(0.0))
    w = Window.partitionBy("receipt_id").orderBy(score.desc(), "seq")
    return READINGS.df(spark, sf_dir).select("receipt_id", "seq", score4(score).alias("score"), F.row_number().over(w).cast("long").alias("rank")).where("rank <= 12")


SEEN = Fixture(
    "receipt_id string, source string, seq long, code string, name string, quantity double, unit_price double, total double, confidence double",
    [("a", "p4", 1, "789", "Leite", 1.0, 5.0, 5.0, 0.9), ("a", "p4", 2, None, "Pao frances", 2.0, 1.0, 2.0, 0.6), ("a", "p6", 3, "789", "LEITE", 1.0, 5.0, 5.0, 0.8), ("a", "p6", 4, None, "Pão francês", None, None, 2.0, 0.7), ("a", "p6", 5, None, "Queijo", 1.0, 9.0, 9.0, 0.5), ("b", "p4", 1, None, "Queijo", 1.0, 9.0, 9.0, 0.5)],
)


def _plain(text: object) -> str:
    import re
    import unicodedata

    base = "".join(c for c in unicodedata.normalize("NFD", str(text or "").lower()) if not "̀" <= c <= "ͯ")
    return re.sub("[^a-z0-9]+", " ", base).strip()


def _rows(pdf: pd.DataFrame) -> list[dict]:
    """A receipt's rows in order, each with what comparisons need of its name and code."""
    if pdf.empty:
        return []
    rows = pdf.sort_values("seq").astype(object).where(pdf.notna(), None).to_dict("records")
    for r in rows:
        name = _plain(r["name"])
        r |= {"_name": name, "_words": set(name.split()), "_digits": "".join(c for c in str(r["code"] or "") if c.isdigit())}
    return rows


def _similar(a: dict, b: dict, tolerance: float, quantity: bool) -> float:
    some = lambda v: v is not None and v == v and v != 0
    score = 0.55 if a["code"] and b["code"] and a["_digits"] == b["_digits"] else 0.0
    if a["_name"] and b["_name"]:
        score += 0.35 if a["_name"] == b["_name"] else 0.3 * len(a["_words"] & b["_words"]) / len(a["_words"] | b["_words"])
    score += 0.25 * (some(a["total"]) and some(b["total"]) and abs(a["total"] - b["total"]) <= tolerance)
    if quantity:
        score += 0.1 * (some(a["quantity"]) and some(b["quantity"]) and abs(a["quantity"] - b["quantity"]) <= 0.001)
    return min(1.0, score)


def cluster_items(rows: DataFrame) -> DataFrame:
    """Greedy first-fit clusters of a receipt's readings: a row joins the first cluster with a member of .62 or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list[dict]] = []
        for row in _rows(pdf):
            home = next((c for c in clusters if any(_similar(x, row, 0.03, True) >= 0.62 for x in c)), None)
            if home is None:
                clusters.append([row])
            else:
                home.append(row)
        out = []
        for k, c in enumerate(clusters):
            ranked = sorted(c, key=lambda x: x["confidence"] or 0)
            best = dict(ranked[-1])
            for x in ranked:
                best |= {f: x[f] for f in ("code", "name", "quantity", "unit_price", "total") if not best[f] and x[f]}
            sources = len({x["source"] for x in c})
            confidence = min(1.0, sum(x["confidence"] or 0 for x in c) / len(c) + min(0.15, (sources - 1) * 0.05))
            out.append((best["receipt_id"], k, len(c), sources, best["code"], best["name"], best["quantity"], best["total"], round(confidence, 4), sources < 2 or confidence < 0.82))
        return pd.DataFrame(out, columns=["receipt_id", "cluster", "rows", "sources", "code", "name", "quantity", "total", "confidence", "needs_review"])

    return rows.groupBy("receipt_id").applyInPandas(run, "receipt_id string, cluster long, rows long, sources long, code string, name string, quantity double, total double, confidence double, needs_review boolean")


@query("ocr_cluster")
def ocr_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_items(SEEN.df(spark))


def merge_vision(local: DataFrame, vision: DataFrame) -> DataFrame:
    """Each vision row takes the best unused local row of .55 or more; local rows left over follow, to be reviewed."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, out, used = _rows(a), [], set()
        for v in _rows(b):
            best, sim = None, -1.0
            for k, x in enumerate(left):
                s = _similar(x, v, 0.05, False)
                if k not in used and s > sim:
                    best, sim = k, s
            hit = left[best] if best is not None and sim >= 0.55 else None
            if hit:
                used.add(best)
            merged = {**(hit or {}), **{k: x for k, x in v.items() if x is not None}}
            out.append((v["receipt_id"], "vision", merged.get("code"), merged.get("name"), merged.get("total"), max(v["confidence"] or 0.0, (hit or {}).get("confidence") or 0.0), sim < 0.7))
        for k, x in enumerate(left):
            if len(b) == 0 or (k not in used and (x["total"] or 0) > 0 and x["name"]):
                out.append((x["receipt_id"], "local", x["code"], x["name"], x["total"], min(x["confidence"] or 0.6, 0.78) if len(b) else x["confidence"], bool(len(b))))
        return pd.DataFrame(out, columns=["receipt_id", "source", "code", "name", "total", "confidence", "needs_review"])

    return local.groupBy("receipt_id").cogroup(vision.groupBy("receipt_id")).applyInPandas(run, "receipt_id string, source string, code string, name string, total double, confidence double, needs_review boolean")


@query("vision_local_merge")
def vision_local_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two frames: both sides of a cogroup must not share their attributes
    return merge_vision(SEEN.df(spark).where("source = 'p4'"), SEEN.df(spark).where("source = 'p6'"))


KNOWN = Extended(
    "market_id string, name string", [("k1", "Supermercado Alvorada"), ("k2", "Padaria Central"), ("k3", "Mercado Bom Preço"), ("k4", "")],
    "select 's' || s_suppkey as market_id, 'Supermercado ' || replace(s_name, 'Supplier#', 'Loja') as name from {supplier}",
)
FOUND = Extended(
    "seq long, name string", [(1, "Alvorada"), (2, "Hortifruti do Vale"), (3, "mercado do VALE"), (4, "Bom Dia Mercado"), (5, None)],
    "select s_suppkey + 1000 as seq, case s_suppkey % 4 when 0 then replace(s_name, 'Supplier#', 'Loja') when 1 then 'Hortifruti Bairro ' || s_suppkey when 2 then 'Mercado ' || replace(s_name, 'Supplier#', 'Loja') || ' Centro Norte Sul' else 'Padaria ' || replace(s_name, 'Supplier#', 'loja') end as name from {supplier}",
)


def check_markets(known: DataFrame, found: DataFrame) -> DataFrame:
    """status, name and confidence: known markets that no source has are uncertain, found ones unlike any known are new.

    Pairs are made by shared word; of found names with one key the last counts, at the first one's place.
    """
    k = known.select("market_id", "name", S.market_key(F.col("name")).alias("key"))
    f = found.select("seq", F.col("name").alias("f_name"), S.market_key(F.col("name")).alias("f_key"))
    f = f.groupBy("f_key").agg(F.max_by("f_name", "seq").alias("f_name"))
    words = lambda df, key: df.withColumn("word", F.explode(F.array_distinct(F.split(key, " ")))).where("word <> ''")
    pairs = words(k.select("market_id", "key"), "key").join(words(f.select("f_key"), "f_key"), "word").select("market_id", "key", "f_key").distinct()
    scored = pairs.withColumn("s", S.market_similarity(F.col("key"), F.col("f_key")))
    known_best = k.join(scored.groupBy("market_id").agg(F.max("s").alias("best")), "market_id", "left").where("coalesce(best, 0D) = 0D")
    found_best = f.join(scored.groupBy("f_key").agg(F.max("s").alias("best")), "f_key", "left").where("coalesce(best, 0D) < 0.72D")
    return known_best.select(F.lit("uncertain").alias("status"), "name", F.lit(0.35).alias("confidence")).unionByName(found_best.select(F.lit("new").alias("status"), F.col("f_name").alias("name"), F.lit(0.82).alias("confidence")))


CHECK_SQL = f"""with {KNOWN.cte('a')}, {FOUND.cte('b')}, k as (select market_id, name, {D.market_key('name')} as key from a), f as (select {D.market_key('name')} as key, arg_max(name, seq) as name from (select seq, name from b) group by 1),
s as (select k.market_id, f.key as fk, {D.market_similarity('k.key', 'f.key')} as s from k, f),
out as (select 'uncertain' as status, name, 0.35::double as confidence from k where coalesce((select max(s) from s where s.market_id = k.market_id), 0) = 0 union all select 'new', name, 0.82::double from f where coalesce((select max(s) from s where s.fk = f.key), 0) < 0.72)"""


@query("market_check", f"{CHECK_SQL} select * from out")
def market_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_markets(KNOWN.df(spark, sf_dir), FOUND.df(spark, sf_dir))


@query("market_check_summary", f"{CHECK_SQL} select count(*) filter (status = 'new') as new, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'inactive') as inactive, count(*) filter (status = 'uncertain') as uncertain, count(*) filter (status <> 'uncertain') as total_changes, count(*) as review_count from out")
def market_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    kinds = [F.count_if(s == k).alias(k) for k in ("new", "changed", "inactive", "uncertain")]
    return check_markets(KNOWN.df(spark, sf_dir), FOUND.df(spark, sf_dir)).agg(*kinds, F.count_if(s != "uncertain").alias("total_changes"), F.count("*").alias("review_count"))


SCORED_MARKETS = Extended(
    "market_id string, price double, variety double, distance double, quality double, service double", [("a", 0.9, 0.5, 0.3, 0.8, 0.7), ("b", 0.2, 1.0, 1.0, None, 0.1)],
    "select 's' || s_suppkey as market_id, (s_suppkey % 10) / 1e1 as price, (s_suppkey % 7) / 1e1 as variety, (s_suppkey % 3) / 2e0 as distance, case when s_suppkey % 5 > 0 then (s_suppkey % 9) / 1e1 end as quality, s_acctbal / 1e5 as service from {supplier}",
)
WEIGHTS = {"price": 0.45, "variety": 0.2, "distance": 0.15, "quality": 0.1, "service": 0.1}


@query("market_score", f"with {SCORED_MARKETS.cte('t')} select market_id, {D.score4(' + '.join(f'{w}::double * coalesce({c}, 0)' for c, w in WEIGHTS.items()))} as score from t")
def market_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = sum((w * F.coalesce(c, F.lit(0.0)) for c, w in list(WEIGHTS.items())[1:]), WEIGHTS["price"] * F.coalesce("price", F.lit(0.0)))
    return SCORED_MARKETS.df(spark, sf_dir).select("market_id", score4(value).alias("score"))
