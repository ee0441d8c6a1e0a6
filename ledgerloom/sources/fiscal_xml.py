"""Fiscal XML: a source and a sink of files (Spark's XML reader and writer, one row an ``infNFe`` element) and a parser of text columns.

Both use one schema, with a column for records that aren't well formed. Those, and documents whose elements stand elsewhere, are read
by the first element of a name instead, so a document that was cut off keeps what it has. Entities are
resolved once for an element and once more for what stands in it (senders escape names twice). Missing elements are empty texts
and zeros; null and empty documents have no items. An item counts if it has a name or a total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

CORRUPT = "not_well_formed"
PRODUCT = "cEAN string, cBarra string, xProd string, qCom string, uCom string, vUnCom string, vProd string, vDesc string"
TOTALS = "struct<vNF:string>"
SCHEMA = (
    "_Id string, ide struct<dhEmi:string,dEmi:string,hEmi:string>, emit struct<CNPJ:string,xNome:string,xFant:string>, "
    f"det array<struct<prod:struct<{PRODUCT.replace(' ', ':').replace(',:', ',')}>>>, total struct<ICMSTot:{TOTALS}>, ICMSTot {TOTALS}, {CORRUPT} string"
)
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreNamespace": "true", "attributePrefix": "_"}


def tag(scope: Column, name: str) -> Column:
    """The text of the first element of that name, entities decoded; empty if there is none."""
    return decoded(F.trim(F.regexp_extract(S.blank(scope), rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)))


def decoded(s: Column) -> Column:
    """Text with its entities resolved."""
    plain = s
    for entity, to in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(to))
    # numbered characters: what lies between them and the characters take turns
    number = F.regexp_extract_all(s, F.lit("(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), 1)
    code = lambda x: F.when(F.lower(x).startswith("x"), F.conv(F.substring(x, 2, 6), 16, 10)).otherwise(x).cast("int")
    letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32")
    between = F.split(s, "(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});")
    return F.when(~plain.contains("&"), plain).when(F.size(number) == 0, s).otherwise(F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(letter(F.get(number, i)), F.lit("")))), ""))


def loose(xml: Column) -> Column:
    """The same struct as the schema's, from the first elements of each name wherever they stand."""
    ide, emit = tag(xml, "ide"), tag(xml, "emit")
    rows = F.regexp_extract_all(S.blank(xml), F.lit(r"(?is)<det(?:\s[^>]*)?>(.*?)</det>"), 1)
    product = lambda d: F.struct(*(tag(d, c.split()[0]).alias(c.split()[0]) for c in PRODUCT.split(", ")))
    return F.struct(*(tag(ide, c).alias(c) for c in ("dhEmi", "dEmi", "hEmi")), *(tag(emit, c).alias(c) for c in ("CNPJ", "xNome", "xFant")), tag(tag_block(xml, "ICMSTot"), "vNF").alias("vNF"), F.transform(rows, product).alias("products"))


def tag_block(xml: Column, name: str) -> Column:
    return F.regexp_extract(S.blank(xml), rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}>", 0)


def strict(x: str) -> Column:
    """That struct from a parsed record."""
    f = lambda name: decoded(F.trim(F.coalesce(F.col(f"{x}.{name}"), F.lit(""))))
    amount = F.trim(F.coalesce(f"{x}.total.ICMSTot.vNF", f"{x}.ICMSTot.vNF", F.lit("")))
    names = [c.split()[0] for c in PRODUCT.split(", ")]
    text = lambda c, s: decoded(s) if c in ("xProd", "uCom") else s
    product = lambda d: F.struct(*(text(c, F.trim(F.coalesce(d["prod"][c], F.lit("")))).alias(c) for c in names))
    rows = F.coalesce(F.transform(F.col(f"{x}.det"), product), F.transform(F.array(), lambda _: F.struct(*(F.lit("").alias(c) for c in names))))
    return F.struct(*(f(f"ide.{c}").alias(c) for c in ("dhEmi", "dEmi", "hEmi")), *(f(f"emit.{c}").alias(c) for c in ("CNPJ", "xNome", "xFant")), amount.alias("vNF"), rows.alias("products"))


def number(x: Column) -> Column:
    return F.coalesce(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def first(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def fields(p: str) -> list[Column]:
    """market, cnpj, date, time, total and items of such a struct."""
    f = lambda c: F.col(f"{p}.{c}")
    time = F.when(f("dhEmi") != "", F.substring(f("dhEmi"), 12, 8)).otherwise(f("hEmi"))
    item = lambda d: F.struct(S.digits(first(d["cEAN"], d["cBarra"])).alias("code"), d["xProd"].alias("name"), number(d["qCom"]).alias("quantity"), first(d["uCom"], F.lit("un")).alias("unit"), number(d["vUnCom"]).alias("unit_price"), number(d["vProd"]).alias("total"), number(d["vDesc"]).alias("discount"))
    kept = F.filter(F.transform(f("products"), item), lambda i: (i["name"] != "") | (i["total"] != 0))
    return [first(f("xNome"), f("xFant")).alias("market"), S.digits(f("CNPJ")).alias("cnpj"), F.substring(first(f("dhEmi"), f("dEmi")), 1, 10).alias("date"), time.alias("time"), number(f("vNF")).alias("total"), kept.alias("items")]


def parse(docs: DataFrame, *along: str) -> DataFrame:
    """well_formed and the fields of each document of (doc_id, xml); other columns may come along."""
    scope = F.regexp_extract(S.blank(F.col("xml")), r"(?s)<infNFe[\s>].*</infNFe>", 0)
    x = docs.select("doc_id", *along, "xml", S.once(F.from_xml(first(scope, S.blank(F.col("xml"))), SCHEMA, OPTIONS)).alias("r"))
    # an element that is there but not where the schema has it
    astray = F.lit(False)
    for name, there in (("det", F.col("r.det").isNotNull()), ("emit", F.col("r.emit").isNotNull()), ("ide", F.col("r.ide").isNotNull()), ("vNF", F.coalesce("r.total.ICMSTot.vNF", "r.ICMSTot.vNF").isNotNull())):
        astray = astray | (~there & S.blank(F.col("xml")).rlike(rf"(?i)<{name}[\s>]"))
    formed = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
    x = x.select("doc_id", *along, formed.alias("well_formed"), S.once(F.when(formed & ~astray, strict("r")).otherwise(loose(F.col("xml")))).alias("p"))
    return x.select("doc_id", *along, "well_formed", *fields("p"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, well_formed and the fields of each ``infNFe`` element in the files of a folder."""
    x = spark.read.format("xml").options(**OPTIONS, rowTag="infNFe").schema(SCHEMA).load(path)
    x = x.select(F.struct(*x.columns).alias("r"))
    cut = F.col(f"r.{CORRUPT}")
    x = x.select(F.coalesce(F.col("r._Id"), F.regexp_extract(S.blank(cut), r"Id=[\"']([^\"']*)", 1)).alias("id"), cut.isNull().alias("well_formed"), S.once(F.when(cut.isNull(), strict("r")).otherwise(loose(cut))).alias("p"))
    return x.select("id", "well_formed", *fields("p"))


def write(receipts: DataFrame, path: str) -> None:
    """Files of ``infNFe`` elements of receipts of (k, market, cnpj, date, time, total, lines), as many as there are partitions; compressed, as tags are most of them."""
    moment = F.struct(F.concat("date", F.lit("T"), "time", F.lit("-03:00")).alias("dhEmi"))
    names = {"code": "cEAN", "name": "xProd", "quantity": "qCom", "unit": "uCom", "unit_price": "vUnCom", "total": "vProd", "discount": "vDesc"}
    rows = F.transform("lines", lambda x: F.struct(F.struct(*(x[a].cast("string").alias(b) for a, b in names.items())).alias("prod")))
    total = F.struct(F.struct(F.col("total").cast("string").alias("vNF")).alias("ICMSTot"))
    emit = F.struct(F.col("cnpj").alias("CNPJ"), F.concat("market", F.lit(" & Cia")).alias("xNome"))
    x = receipts.select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("_Id"), moment.alias("ide"), emit.alias("emit"), rows.alias("det"), total.alias("total"))
    x.write.format("xml").options(rootTag="enviNFe", rowTag="infNFe", attributePrefix="_", compression="gzip").save(path)
