"""The JSON walk and the XML source on odd documents."""

import json
import random

from pyspark.sql import functions as F

from ledgerloom.functions import vocabulary as V
from ledgerloom.sources import fiscal_json as J
from ledgerloom.sources import fiscal_xml as X


def found(value, names):
    """The first member, depth first, that has one of the names and isn't empty."""
    members = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, inner in members:
        if str(key).lower() in names and inner is not None and inner != "":
            return inner
        hit = found(inner, names)
        if hit is not None:
            return hit
    return None


def made(rng, deep):
    kind = rng.randrange(6 if deep else 3)
    if kind < 3:
        return rng.choice(["", "x", None, 7, "a{b", '{"name":"no"}', True])
    if kind == 3:
        return [made(rng, deep - 1) for _ in range(rng.randrange(4))]
    keys = ["name", "NOME", "xNome", "total", "a", "b", "date", "data", "cnpj"]
    return {k: made(rng, deep - 1) for k in rng.sample(keys, rng.randrange(5))}


def test_first_hits_equal_a_recursive_walk(spark):
    rng = random.Random(8)
    bodies = [{k: made(rng, 5) for k in ("q", "data", "name", "z")} for _ in range(300)]
    got = J.normalize(spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "doc_id long, body string"))
    got = {r["doc_id"]: r for r in got.collect()}
    for i, b in enumerate(bodies):
        root = b["data"] if b["data"] not in (None, "") else b
        want = found(root, {n.lower() for n in V.JSON_FIELDS["market"]})
        if isinstance(want, (dict, list)):
            assert json.loads(got[i]["market"]) == want
        else:
            assert got[i]["market"] == ("" if want is None else str(want).lower() if want is True else str(want))


def test_depth_ignores_brackets_in_strings(spark):
    texts = ["{}", "[[]]", '{"a":"[[[","b":{"c":["}\\"]"]}}', '"x"', "", '{"a":"' + "\\\\x" * 20000 + '"}']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", J.depth(F.col("t")).alias("d"))
    assert [r["d"] for r in got.orderBy("i").collect()] == [1, 2, 3, 0, 0, 1]


def test_json_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, body string")
    assert J.normalize(none).collect() == [] and J.items(J.normalize(none)).collect() == []
    odd = J.normalize(spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "5"), (4, "5")], "doc_id long, body string")).collect()
    assert sorted(r["doc_id"] for r in odd) == [1, 2, 3, 4] and all(r["market"] == "" and r["rows"] == [] for r in odd)


def test_xml_cut_anywhere_keeps_what_it_has(spark):
    text = "<infNFe Id='k'><emit><CNPJ>1</CNPJ><xNome>A &amp; B</xNome></emit><det><prod><xProd>x</xProd><vProd>1,5</vProd></prod></det><det><prod><xProd>y</xProd></prod></det></infNFe>"
    rows = spark.createDataFrame([(i, text[:i]) for i in range(len(text) + 1)], "doc_id int, xml string")
    got = {r["doc_id"]: r for r in X.parse(rows).collect()}
    assert [i for i in got if got[i]["well_formed"]] == [len(text)]
    for i, r in got.items():
        assert r["market"] == ("A & B" if "</emit>" in text[:i] else "")
        assert [x["name"] for x in r["items"]] == ["x", "y"][: text[:i].count("</det>")]
    assert got[len(text)]["items"][0]["total"] == 1.5


def test_xml_files_of_many_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><infNFe Id='1'><emit><xNome>A</xNome></emit></infNFe><infNFe Id='2'><ICMSTot><vNF>2,5</vNF></ICMSTot></infNFe></all>")
    (tmp_path / "b.xml").write_text("<infNFe Id='3' xmlns='http://x'><det nItem='1'><prod><cEAN>SEM</cEAN><vProd>1</vProd></prod></det></infNFe>")
    got = {r["id"]: r for r in X.read(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["1", "2", "3"] and got["1"]["market"] == "A" and got["2"]["total"] == 2.5 and got["3"]["items"][0]["code"] == ""


def test_json_items_that_are_no_objects(spark):
    bodies = ['{"items":[1,{"name":"a"},"x",null,[{"name":"no"}],{"total":2,"name":{"k" : [1, "}"]}}]}', '{"total":"1e2","items":{"name":"one","qty":3}}', '\n {"a":"\\"items\\":[{","itens":[]}', '{"name":"\\ud800x","ITEMS":[{"name":"\\u00e9"}]}']
    got = {(r["doc_id"], r["n"]): (r["name"], r["quantity"], r["total"]) for r in J.items(J.normalize(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string"))).collect()}
    assert got == {(0, 1): ("a", 0.0, 0.0), (0, 2): ('{"k":[1,"}"]}', 0.0, 2.0), (1, 1): ("one", 3.0, 0.0), (3, 1): ("é", 0.0, 0.0)}


def test_json_of_unique_ids_is_neither_counted_nor_shuffled(spark):
    """Fields come from one pass: no job before the query, and no exchange of bodies in it."""
    docs = spark.range(4).selectExpr("id as doc_id", """'{"data":{"a":[{"name":"x"}],"items":[{"name":"y"}]}}' as body""")
    tracker, group = spark.sparkContext.statusTracker(), "json-no-job"
    spark.sparkContext.setJobGroup(group, group)
    found = J.items(J.normalize(docs, unique=True))
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["name"] for r in found.collect()] == ["y"] * 4


def test_xml_files_are_compressed_and_read_back(spark, tmp_path):
    from ledgerloom.operators.fiscal import receipts
    from ledgerloom.plans.model import Model

    path = str(tmp_path / "nfe")
    X.write(receipts(Model(spark, "/root/testdata/sf0.001")), path)
    files = [f for f in (tmp_path / "nfe").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".xml.gz") for f in files)
    rows = X.read(spark, path).select("id", F.size("items").alias("n")).collect()
    assert len({r["id"] for r in rows}) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert sum(r["n"] for r in rows) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_enriching_deals_out_lines_once(spark, sf_dir):
    """A document's JSON and XML stand in one row: lines are dealt out by order only, and not once more by document."""
    from ledgerloom.operators import fiscal

    plan = fiscal.enriched_items(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and plan.count("Relation [l_orderkey") == 1


def test_enriched_documents_take_what_their_xml_lacks(spark):
    from ledgerloom.operators import fiscal

    body = '{"data":{"name":"J","cnpj":"1","date":"2026-01-02","total":7,"items":[{"name":"own","qty":2,"total":7}]}}'
    xmls = {"a": None, "b": "", "c": "<infNFe><emit><xNome>X</xNome></emit></infNFe>", "d": "<infNFe><det><prod><xProd>x</xProd><vProd>3</vProd></prod></det></infNFe>", "e": "<infNFe><total><ICMSTot><vNF>9</vNF></ICMSTot></total><det><prod><xProd>cut</xProd>"}
    docs = spark.createDataFrame([(k, body, x) for k, x in xmls.items()], "doc_id string, body string, xml string")
    got = {r["doc_id"]: (r["market"], r["total"], [(i["name"], i["quantity"]) for i in r["items"]]) for r in fiscal.enrich(docs).collect()}
    own = [("own", 2.0)]
    assert got == {"a": ("J", 7.0, own), "b": ("J", 7.0, own), "c": ("X", 7.0, own), "d": ("J", 7.0, [("x", 0.0)]), "e": ("J", 9.0, own)}


def test_lines_are_dealt_out_without_what_follows_from_them(spark, sf_dir):
    """What a document shows of a line (code, unit, amounts in units) is made after the shuffle; of texts only the name is in it."""
    from ledgerloom.operators import fiscal

    plan = fiscal.enrich_from_xml(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    dealt = next(x for x in plan.split("\n") if "collect_list(" in x)
    assert dealt.split("collect_list(")[1].count("#") <= 20 and "789" not in dealt and "UN" not in dealt


def test_json_is_read_only_where_the_xml_lacks_something(spark, monkeypatch):
    from ledgerloom.operators import fiscal

    real, seen = J.normalize, []

    def normalize(docs, *args, **kinds):
        seen.append({r["doc_id"] for r in docs.where("body is not null").collect()})
        return real(docs, *args, **kinds)

    monkeypatch.setattr(J, "normalize", normalize)
    det = "<det><prod><xProd>x</xProd><vProd>3</vProd></prod></det>"
    head = "<ide><dhEmi>2026-01-02T10:00:00</dhEmi></ide><emit><CNPJ>1</CNPJ><xNome>X</xNome></emit>"
    xmls = {"none": None, "items": f"<infNFe>{det}</infNFe>", "head": f"<infNFe>{head}<ICMSTot><vNF>3</vNF></ICMSTot></infNFe>", "whole": f"<infNFe>{head}{det}<ICMSTot><vNF>3</vNF></ICMSTot></infNFe>"}
    docs = spark.createDataFrame([(k, '{"name":"J","total":7,"items":[{"name":"own"}]}', x) for k, x in xmls.items()], "doc_id string, body string, xml string")
    headers, only = fiscal.enrich(docs).collect(), fiscal.enrich(docs, items_only=True).collect()
    assert seen == [{"none", "items", "head"}, {"none", "head"}]
    names = {"none": ["own"], "items": ["x"], "head": ["own"], "whole": ["x"]}
    assert all({r["doc_id"]: [i["name"] for i in r["items"]] for r in rows} == names for rows in (headers, only))
    assert {r["doc_id"]: (r["market"], r["total"]) for r in headers} == {"none": ("J", 7.0), "items": ("J", 7.0), "head": ("X", 3.0), "whole": ("X", 3.0)}
