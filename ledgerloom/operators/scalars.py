"""Queries of the scalar functions, over driver tables or small fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import duck as D
from ..plans.registry import Extended, Fixture, query
from .names import edit_join

KEY, QR_KEY = "35160917833301002223650010003839831012345676", "35260444823938000187551090000002691092067649"


def score4(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NUMBERS = Extended(
    "id long, s string", [(i, s) for i, s in enumerate(["350,01", "350.01", "1.234,56", "1.234", "1.234.567", "R$ 12,90", "1,234.56", "", None, "abc", "-3,5", "12 345,6", "1,2,3", "r$7", ".5", "5.", "1.2345", "x12,5y", "+4"])],
    "select l_orderkey + 1000000 as id, case l_partkey % 5 when 0 then replace(cast(l_extendedprice as varchar(30)), '.', ',') when 1 then cast(l_extendedprice as varchar(30)) when 2 then 'R$ ' || replace(cast(l_tax as varchar(30)), '.', ',') when 3 then '1.' || l_partkey || ',' || l_linenumber else cast(l_quantity as varchar(30)) end as s from {lineitem}",
)
MODES = ("app", "audit", "receipt", "loose")


@query("parse_br_number", f"with {NUMBERS.cte('t')} select id, " + ", ".join(f"{D.parse_number('s', m)} as {m}" for m in MODES) + " from t")
def parse_br_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NUMBERS.df(spark, sf_dir).select("id", *(S.parse_number(F.col("s"), m).alias(m) for m in MODES))


ROUNDS = Extended(
    "id long, x double", [(1, 1.005), (2, -2.5), (3, 2.345), (4, 0.0), (5, 12.994999), (6, -0.125), (7, 1e9 + 0.005)],
    'select l_orderkey + 1000000 as id, l_extendedprice * l_discount as x from {lineitem}',
)


@query("round_money", f"with {ROUNDS.cte('t')} select id, floor((x + 2.220446049250313e-16) * 100 + 0.5) / 100 as app, floor(x * 100 + 0.5) / 100 as audit from t")
def round_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUNDS.df(spark, sf_dir).select("id", S.round2(F.col("x"), True).alias("app"), S.round2(F.col("x")).alias("audit"))


DATES = Extended(
    "id long, s string", [(i, s) for i, s in enumerate(["10/09/26", "31-12-1999", "01.02.49", "01.02.50", "2026-09-10", "32/01/2020", "", None, "em 05/06/2024 as 10:22"])],
    "select o_orderkey + 1000000 as id, lpad(cast(day(o_orderdate) as varchar(2)), 2, '0') || '/' || lpad(cast(month(o_orderdate) as varchar(2)), 2, '0') || '/' || cast(year(o_orderdate) as varchar(4)) || ' 10:' || lpad(cast(o_orderkey % 60 as varchar(2)), 2, '0') as s from {orders}",
)


@query("parse_br_date", f"with {DATES.cte('t')} select id, {D.date('s')} as date, regexp_extract(coalesce(s, ''), '\\b((?:[01]?\\d|2[0-3]):[0-5]\\d(?::[0-5]\\d)?)\\b', 1) as time from t")
def parse_br_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DATES.df(spark, sf_dir).select("id", S.parse_date(F.col("s")).alias("date"), S.parse_time(F.col("s")).alias("time"))


@query("normalize_text", f"select doc_id, md5({D.norm('text')}) as digest, length({D.norm('text')}) as chars from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.normalize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("chars"))


NAMES = Extended(
    "id long, s string", [(i, s) for i, s in enumerate(["REFRI COCA-COLA 2L", "Cerv. Skol c/12", "P/ limpeza & cia", "qjo prato acuc", "Açúcar União 1kg", "PÃO DE AÇÚCAR LTDA", "2,5 kg arroz", "cod. 123 vl. total", "bisc mist conc", "p hig neve 12 rolos", "leite 500ML integral", "", None, "Adocante zero 100 ml", "Maçã gala", "ovos pç", "qtde. 3 und"])],
    "select p_partkey + 1000000 as id, case p_partkey % 5 when 0 then 'Refri ' || p_name || ' ' || p_size || 'L' when 1 then upper(p_name) || ' c/' || p_size when 2 then p_name || ' ' || p_size || ',5 kg' when 3 then p_type || ' leite ' || p_name else p_name || ' ' || p_size || ' ml' end as s from {part}",
)


@query("normalize_receipt", f"with {NAMES.cte('t')} select id, {D.norm_receipt('s')} as name from t")
def normalize_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark, sf_dir).select("id", S.normalize_receipt(F.col("s")).alias("name"))


@query("tokens", f"with {NAMES.cte('t')}, n as (select id, s from t union all select p_partkey + 1000, p_name from part) select id, array_to_string(list_sort({D.tokens('s')}), ' ') as tokens from n")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("id"), F.col("p_name").alias("s"))
    return NAMES.df(spark, sf_dir).unionByName(parts).select("id", F.array_join(F.array_sort(S.tokens(F.col("s"))), " ").alias("tokens"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct product names that share a word: blocked by word, so no pair without one is made."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    words = names.select("name", F.explode(S.tokens(F.col("name"))).alias("word"))
    return words.alias("a").join(words.alias("b"), "word").where("a.name < b.name").select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()


PAIRS_SQL = f"n as (select distinct p_name as name, {D.tokens('p_name')} as t, {D.norm_receipt('p_name')} as s from part), pairs as (select a.name as a, b.name as b, a.t as ta, b.t as tb, a.s as sa, b.s as sb from n a, n b where a.name < b.name)"


@query("jaccard_pairs", f"with {PAIRS_SQL} select a, b, {D.score4(D.jaccard('ta', 'tb'))} as score from pairs where {D.jaccard('ta', 'tb')} > 0")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of names whose words have a Jaccard similarity above 0."""
    return name_pairs(spark, sf_dir).select("a", "b", score4(S.jaccard(S.tokens(F.col("a")), S.tokens(F.col("b")))).alias("score"))


#: Names of products, as they are and as receipts misread them.
MISREAD = "select p_name as name from part union select replace(p_name, 'e', 'ee') from part union select translate(p_name, 'lis', '1l5') from part union select substr(p_name, 2) from part union select p_name || ' 2l' from part"
SIMILAR = 0.6


@query("edit_similarity", f"with n as (select distinct name, {D.norm_receipt('name')} as s from ({MISREAD})), p as (select a.name as a, b.name as b, {D.edit('a.s', 'b.s')} as score from n a, n b where a.name < b.name) select a, b, {D.score4('score')} as score from p where score >= {SIMILAR}::double")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of names, product names and misread ones, with an edit similarity of .6 or more."""
    names = spark.sql(MISREAD.replace("from part", "from {part}"), part=read(spark, sf_dir, "part")).select(F.col("name").alias("id"), S.normalize_receipt(F.col("name")).alias("name"))
    pairs = edit_join(*2 * [names.select("id", "name", F.lit("").alias("block"), F.lit(SIMILAR).alias("theta"))]).where("left_id < right_id")
    score = S.edit_similarity(S.normalize_receipt(F.col("left_id")), S.normalize_receipt(F.col("right_id")))
    return pairs.withColumn("score", score).where(f"score >= {SIMILAR}D").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), score4(F.col("score")).alias("score"))


UNITS = Extended(
    "id long, s string", [(i, s) for i, s in enumerate(["UND", "Unidades", "KG", "quilo", "Lt", "litros", "ml", "CX", "dúzia", "rolo", "", None, "pct", "Fardos"])],
    "select p_partkey + 1000000 as id, case p_size % 6 when 0 then 'Kilos' when 1 then 'LITRO ' when 2 then 'gramas' when 3 then 'pct.' when 4 then 'Un' else p_brand end as s from {part}",
)


@query("unit_canonical", f"with {UNITS.cte('t')} select id, {D.unit('s')} as unit from t")
def unit_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UNITS.df(spark, sf_dir).select("id", S.canonical_unit(F.col("s")).alias("unit"))


@query("infer_unit", f"with {NAMES.cte('t')} select id, case when regexp_matches({D.norm_receipt('s')}, '\\bkg\\b|quilo|quilograma') then 'kg' when regexp_matches({D.norm_receipt('s')}, '\\bml\\b|mililitro') then 'ml' when regexp_matches({D.norm_receipt('s')}, '\\bl\\b|litro') then 'l' when regexp_matches({D.norm_receipt('s')}, '\\bg\\b|grama') then 'g' when {D.pack('s')} like '%kg%' then 'kg' when {D.pack('s')} <> '' then 'un' else '' end as unit from t")
def infer_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark, sf_dir).select("id", S.infer_unit(F.col("s"), F.lit(None).cast("string"), S.parse_pack(F.col("s"))).alias("unit"))


@query("parse_pack", f"with {NAMES.cte('t')} select id, {D.pack('s')} as pack from t")
def parse_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark, sf_dir).select("id", S.parse_pack(F.col("s")).alias("pack"))


OCR = Extended(
    "id long, s string", [(1, "O1 I2 l3 | S5 B8 Z2 G6"), (2, "17.B33.3O1/OO22-2E"), (3, ""), (4, None), (5, "sbzg o")],
    "select c_custkey + 1000000 as id, translate(lpad(cast(c_custkey as varchar(20)), 14, '0'), '0158', 'OIsB') || ' ' || c_name as s from {customer}",
)


@query("ocr_digit_fix", f"with {OCR.cte('t')} select id, {D.sub('''translate(coalesce(s, ''), 'OoIl|SsBbZzGg', '0011155882266')''', '\\s+', '')} as fixed from t")
def ocr_digit_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OCR.df(spark, sf_dir).select("id", S.ocr_digits(F.col("s")).alias("fixed"))


MONEYS = Extended(
    "id long, s string", [(1, "2 UN x 14,90 = 29,80"), (2, "TOTAL R$ 1.234,56 -2,00"), (3, "10/09/26 sem valor"), (4, None), (5, "1 234,50 e 12.99")],
    "select l_orderkey + 1000000 as id, cast(l_quantity as int) || ' UN x ' || replace(cast(l_extendedprice as varchar(30)), '.', ',') || ' = ' || cast(l_extendedprice as varchar(30)) as s from {lineitem}",
)


@query("money_tokens", f"with {MONEYS.cte('t')} select id, array_to_string(regexp_extract_all(coalesce(s, ''), {D.q(S.V.MONEY)}), '|') as found from t")
def money_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MONEYS.df(spark, sf_dir).select("id", F.array_join(S.money_tokens(F.col("s")), "|").alias("found"))


@query("infer_category", f"with {NAMES.cte('t')} select id, {D.category('s')} as category from t")
def infer_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark, sf_dir).select("id", S.infer_category(F.col("s")).alias("category"))


@query("html_to_text", f"select page_id, md5({D.html_text('html')}) as digest, length({D.html_text('html')}) as chars from pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.html_to_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("chars"))


URLS = Fixture("page_id long, url string", [(-1, "https://www.fazenda.rj.gov.br/nfce?p=1"), (-2, "http://www.sefaz.gov.br/x"), (-3, "https://evilsefaz.br/x"), (-4, "https://127.0.0.1/x"), (-5, "https://user@nfe.svrs.rs.gov.br:443/a"), (-6, "https://10.0.0.1.gov.br/"), (-7, "https://172.20.1.1/"), (-8, "nothing")])


@query("url_allowlist", f"with {URLS.cte('t')}, u as (select * from t union all select page_id, url from pages) select page_id, {D.host('url')} as host, {D.allowed_url('url')} as allowed from u")
def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = URLS.df(spark).unionByName(read(spark, sf_dir, "pages").select("page_id", "url"))
    return urls.select("page_id", S.url_host(F.col("url")).alias("host"), S.allowed_fiscal_url(F.col("url")).alias("allowed"))


KEYS = Extended(
    "id long, s string", [(1, KEY), (2, KEY[:-1] + "8"), (3, "3516 0917 8333 0100 2223 6500 1000 3839 8310 1234 5676"), (4, QR_KEY), (5, "123"), (6, None)],
    "select o_orderkey + 1000000 as id, lpad(cast(o_orderkey as varchar(20)), 43, '3') || cast(o_orderkey % 10 as varchar(1)) as s from {orders}",
)


@query("fiscal_key_check", f"with {KEYS.cte('t')}, d as (select id, {D.digits('s')} as d from t) select id, {D.key_valid('d')} as valid from d")
def fiscal_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KEYS.df(spark, sf_dir).select("id", F.coalesce(S.fiscal_key_valid(F.col("s")), F.lit(False)).alias("valid"))


TEXTS = Extended(
    "id long, s string", [(1, "Chave: 3516 0917 8333 0100 2223 6500 1000 3839 8310 1234 5676"), (2, "CHAVE\n" + KEY.replace("0", "O").replace("5", "S") + "\nfim"), (3, "99" + KEY + "1"), (4, KEY[:20] + "\n" + KEY[20:]), (5, "sem chave"), (6, None)],
    "select o_orderkey + 1000000 as id, 'Chave: ' || lpad(cast(o_orderkey as varchar(20)), 43, '3') || cast(o_orderkey % 10 as varchar(1)) || ' de ' || lpad(cast(day(o_orderdate) as varchar(2)), 2, '0') || '/' || lpad(cast(month(o_orderdate) as varchar(2)), 2, '0') || '/' || cast(year(o_orderdate) as varchar(4)) as s from {orders}",
)


@query("key_from_text", f"""with {TEXTS.cte('t')}, f as (select id, translate(upper(coalesce(s, '')), 'OQDILZSBG', '000112586') as x from t),
l as (select id, list_concat([regexp_replace(v, '[^0-9]', '', 'g') for v in string_split(x, chr(10))], [regexp_replace(x, '[^0-9]', '', 'g')]) as ds from f),
w as (select id, flatten([[substr(d, p, 44) for p in range(1, greatest(length(d) - 42, 1))] for d in ds]) as ks from l)
select id, coalesce([k for k in ks if {D.key_valid('k')}][1], '') as key from w""")
def key_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEXTS.df(spark, sf_dir).select("id", S.key_from_text(F.col("s")).alias("key"))


QRS = Extended(
    "id long, s string", [(1, f"https://nfce.fazenda.rj.gov.br/consulta?p={QR_KEY}|2|1"), (2, f"https://x.gov.br/?a=1&P={KEY}%7C2"), (3, KEY), (4, "https://x.gov.br/?p=123"), (5, None), (6, "sem " + KEY[:-1] + "0")],
    "select o_orderkey + 1000000 as id, 'https://nfce.fazenda.rj.gov.br/consulta?p=' || lpad(cast(o_orderkey as varchar(20)), 43, '3') || cast(o_orderkey % 10 as varchar(1)) || '|2|' || (o_orderkey % 3) as s from {orders}",
)


@query("qr_parse", f"""with {QRS.cte('t')}, k as (select id, regexp_replace(regexp_extract(url_decode(coalesce(s, '')), '(?:^|[?&])p=([^&#|]*)', 1, 'i'), '[^0-9]', '', 'g') as a, regexp_extract(regexp_replace(coalesce(s, ''), '\\s', '', 'g'), '(\\d{{44}})', 1) as b from t),
c as (select id, case when {D.key_valid('a')} then a when {D.key_valid('b')} then b else '' end as key from k)
select id, key, key <> '' as valid, substr(key, 21, 2) as model, case when key <> '' then 0.99::double else 0.0::double end as confidence from c""")
def qr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = QRS.df(spark, sf_dir).select("id", S.key_from_qr(F.col("s")).alias("key"))
    return keyed.select("id", "key", (F.col("key") != "").alias("valid"), F.substring("key", 21, 2).alias("model"), F.when(F.col("key") != "", 0.99).otherwise(0.0).alias("confidence"))


CNPJS = Extended(
    "id long, s string", [(1, "17.833.301/0022-23"), (2, "17.893.301/0022-23"), (3, "09653290000147"), (4, "11111111111111"), (5, "17.B33.3O1/OO22-23"), (6, "123"), (7, None)],
    "select c_custkey + 1000000 as id, lpad(cast(c_custkey as varchar(20)), case when c_custkey % 5 = 0 then 13 else 14 end, '1') as s from {customer}",
)


@query("cnpj_check", f"with {CNPJS.cte('t')}, d as (select id, {D.digits('s')} as d from t) select id, {D.cnpj_valid('d')} as valid, {D.cnpj('d')} as canonical from d")
def cnpj_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CNPJS.df(spark, sf_dir).select("id", S.cnpj_valid(F.col("s")).alias("valid"), S.canonical_cnpj(F.col("s")).alias("canonical"))


@query("cnpj_repair", f"""with {CNPJS.cte('t')}, d as (select id, regexp_replace(translate(coalesce(s, ''), 'OoIl|SsBbZzGg', '0011155882266'), '[^0-9]', '', 'g') as d from t),
c as (select id, d, case when length(d) = 14 then flatten([[substr(d, 1, p - 1) || cast(r as varchar) || substr(d, p + 1) for r in range(0, 10)] for p in range(1, 15)]) else [] end as cs from d)
select id, case when {D.cnpj_valid('d')} then {D.cnpj('d')} else coalesce({D.cnpj('''([k for k in cs if ''' + D.cnpj_valid('k') + '''][1])''')}, '') end as repaired from c""")
def cnpj_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CNPJS.df(spark, sf_dir).select("id", S.repaired_cnpj(F.col("s")).alias("repaired"))


GTINS = Extended(
    "id long, s string", [(1, "7891000100103"), (2, "7891000100104"), (3, "2707"), (4, "96385074"), (5, "036000291452"), (6, "10614141000415"), (7, "12345"), (8, None), (9, "789-1000-100103")],
    "select p_partkey + 1000000 as id, case p_partkey % 3 when 0 then lpad(cast(p_partkey as varchar(20)), 13, '7') when 1 then lpad(cast(p_partkey as varchar(20)), 8, '9') else lpad(cast(p_partkey as varchar(20)), 12, '0') end as s from {part}",
)


@query("gtin_check", f"with {GTINS.cte('t')}, d as (select id, {D.digits('s')} as d from t) select id, {D.gtin_valid('d')} as valid from d")
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GTINS.df(spark, sf_dir).select("id", F.coalesce(S.gtin_valid(F.col("s")), F.lit(False)).alias("valid"))


@query("market_similarity", f"with n as (select distinct n_name as a from nation), k as (select a, {D.market_key('''a || ' Supermercado' ''')} as x, {D.market_key('''a || ' hortifruti norte' ''')} as y from n) select a, {D.score4(D.market_similarity('x', 'y'))} as score from k")
def market_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("a")).distinct()
    x, y = S.market_key(F.concat("a", F.lit(" Supermercado"))), S.market_key(F.concat("a", F.lit(" hortifruti norte")))
    return names.select("a", score4(S.market_similarity(x, y)).alias("score"))


PACKS = Extended(
    "id long, s string, price double", [(1, "Arroz 5kg", 25.0), (2, "Leite 500 ml", 3.0), (3, "Suco 1,5 l", 9.0), (4, "Farinha 500g", 4.5), (5, "Sabão un", 2.0), (6, None, 1.0)],
    "select p_partkey + 1000000 as id, p_name || ' ' || p_size || case p_partkey % 4 when 0 then 'kg' when 1 then ' ml' when 2 then 'g' else ' l' end as s, p_retailprice as price from {part}",
)


@query("unit_price_equivalent", f"""with {PACKS.cte('t')}, p as (select id, price, {D.pack('s')} as pack from t), n as (select id, price, cast(nullif(split_part(pack, ' ', 1), '') as double) as n, split_part(pack, ' ', 2) as u from p)
select id, case u when 'g' then 'kg' when 'ml' then 'l' else u end as base, case when u in ('g', 'ml') then floor(price / (n / 1000) * 100 + 0.5) / 100 when u in ('kg', 'l') then floor(price / n * 100 + 0.5) / 100 end as per_base from n""")
def unit_price_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per kilogram or litre; grams and millilitres are converted, other units have none."""
    p = PACKS.df(spark, sf_dir).withColumn("pack", S.parse_pack(F.col("s")))
    n, u = F.split("pack", " ")[0].try_cast("double"), F.coalesce(F.get(F.split("pack", " "), 1), F.lit(""))
    each = F.when(u.isin("g", "ml"), S.round2(F.col("price") / (n / 1000))).when(u.isin("kg", "l"), S.round2(F.col("price") / n))
    return p.select("id", F.when(u == "g", "kg").when(u == "ml", "l").otherwise(u).alias("base"), each.alias("per_base"))


DISPLAY = Fixture("id long, s string", [(1, "refr. coca"), (2, "Cerv  skol"), (3, "leite p/ cafe c/ 12"), (4, "adocante zero"), (5, None)])


@query("display_name", f"with {DISPLAY.cte('t')}, n as (select 'f' || id as id, s from t union all select 'p' || p_partkey, case p_partkey % 4 when 0 then 'refri. ' when 1 then 'Cerv ' when 2 then 'refr ' else 'copo p / ' end || p_name || ' c / 6' from part) select id, {D.display('s')} as name from n")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.element_at(F.array(*map(F.lit, ("refri. ", "Cerv ", "refr ", "copo p / "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(start, "p_name", F.lit(" c / 6")).alias("s"))
    return DISPLAY.df(spark).withColumn("id", F.concat(F.lit("f"), "id")).unionByName(parts).select("id", S.display_name(F.col("s")).alias("name"))
