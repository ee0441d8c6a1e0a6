"""Known answers of the receipt domain, and the sources' round trips."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import audit, extraction, matching
from ledgerloom.sources import backup, xlsx


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_receipts(spark):
    x = by(audit.audit_receipts(audit.HEADERS.df(spark), audit.audit_lines(audit.LINES.df(spark)), audit.HISTORY.df(spark)), "receipt_id")
    want = {"R1": "PASS", "R1-total": "BLOCK", "R1-line": "BLOCK", "L-weight": "PASS", "L-missing": "BLOCK", "R-net": "PASS", "R-gross": "PASS", "R-review": "REVIEW", "R-manual": "PASS", "R-bad": "BLOCK", "R-edge": "BLOCK", "R-cash": "PASS", "R-cash-bad": "BLOCK", "R-fee": "PASS", "R-count": "BLOCK", "R-dup-key": "BLOCK", "R-dup-ctx": "BLOCK", "R-dup-one": "REVIEW", "R-dup-many": "REVIEW", "R-empty": "BLOCK"}
    assert {k: r["status"] for k, r in x.items()} == want
    assert x["R1"]["gross_c"] == x["R1"]["expected_c"] == 9551 and x["R1"]["passed"] == 5
    assert (x["R-net"]["gross_c"], x["R-net"]["discount_c"], x["R-net"]["receipt_discount_c"], x["R-net"]["expected_c"]) == (2980, 200, 0, 2780)
    assert x["R-bad"]["issues"] == ["TOTAL_MORE"] and not x["R-dup-one"]["can_auto_launch"] and x["R1"]["can_auto_launch"]


def test_lines(spark):
    x = {(r["receipt_id"], r["line_id"]): r for r in audit.audit_lines(audit.LINES.df(spark)).collect()}
    assert x["R-net", "ITEM-001"]["basis"] == "NET_AFTER_DISCOUNT"
    assert x["R-gross", "ITEM-001"]["basis"] == "GROSS_BEFORE_DISCOUNT"
    assert x["R1", "ITEM-001"]["basis"] == "GROSS_EQ_NET"
    assert x["L-missing", "ITEM-001"]["missing"] == ["preço unitário"]
    assert x["R-edge", "ITEM-001"]["status"] == "PASS" and x["R-edge", "ITEM-002"]["status"] == "BLOCK"


def test_product_matches(spark):
    x = by(matching.decide_matches(matching.WANTED.df(spark), matching.PRODUCTS.df(spark)), "item_id")
    assert (x["m1"]["status"], x["m1"]["product_id"]) == ("EXACT", "p1")
    assert x["m2"]["status"] in ("WEAK", "REVIEW", "AMBIGUOUS") and x["m2"]["product_id"] is None
    assert x["m3"]["status"] == "NEW" and x["m3"]["product_id"] is None
    assert x["m4"]["status"] == "REVIEW" and x["m4"]["score"] == 0.89
    assert x["m5"]["ambiguous"] and x["m5"]["score"] == 1.0
    assert (x["m6"]["status"], x["m6"]["product_id"]) == ("STRONG", "p3")
    assert x["m8"]["status"] == x["m9"]["status"] == "NEW"


def test_key_lookup_takes_all_lines(spark, sf_dir):
    codes = {r[0] for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct().collect()}
    assert {r["code"] for r in matching.or_key_lookup(spark, sf_dir).collect()} == codes
    wanted = spark.createDataFrame([(1, "b"), (8, "b"), (8, "a"), (9, None), (None, "b")], "code long, name string")
    products = spark.createDataFrame([(1, "a"), (3, "b"), (2, "b")], "product_id long, name string")
    got = {tuple(r) for r in matching.key_lookup(wanted, products).collect()}
    assert got == {(1, 1, 1), (8, 1, 2), (None, 2, 2)}


def test_identifiers_and_numbers(spark):
    key = "35160917833301002223650010003839831012345676"
    one = spark.range(1).select(
        S.fiscal_key_valid(F.lit(key)).alias("k1"), S.fiscal_key_valid(F.lit(key[:-1] + "8")).alias("k2"), S.key_from_text(F.lit("Chave: 3516 0917 8333 0100 2223 6500 1000 3839 8310 1234 5676")).alias("k3"),
        S.key_from_qr(F.lit("https://x/?p=35260444823938000187551090000002691092067649|2|1")).alias("k4"), S.repaired_cnpj(F.lit("17.893.301/0022-23")).alias("cnpj"), *(S.parse_number(F.lit(s)).alias(f"n{i}") for i, s in enumerate(["350,01", "350.01", "1.234,56", "1.234"])),
    ).first()
    assert one["k1"] and not one["k2"] and one["k3"] == key and one["k4"].endswith("7649") and one["cnpj"] == "17.833.301/0022-23"
    assert [one[f"n{i}"] for i in range(4)] == [350.01, 350.01, 1234.56, 1.234]


def test_accents_of_latin_letters(spark):
    text = "".join(map(chr, range(0xC0, 0x180)))
    import unicodedata

    got = spark.createDataFrame([(text,)], "t string").select(S.unaccented(F.col("t"))).first()[0]
    want = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    same = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    assert len(got) == len(want) and not same


def test_receipt_text(spark):
    head = by(extraction.receipt_headers(extraction.RECEIPTS.df(spark)), "doc_id")
    assert head[1]["total"] == 40.2 and str(head[1]["date"]) == "2026-09-10" and head[2]["cnpj"] == "17.833.301/0022-23"


def test_clusters_and_merge(spark):
    x = {(r["receipt_id"], r["cluster"]): r for r in matching.cluster_items(matching.SEEN.df(spark)).collect()}
    assert (x["a", 0]["rows"], x["a", 0]["sources"], x["a", 0]["confidence"]) == (2, 2, 0.9)
    assert len(x) == 5
    merged = matching.vision_local_merge(spark, "").collect()
    assert sum(r["source"] == "vision" for r in merged) == 3


def test_workbooks(tmp_path, spark):
    data = xlsx.write_rows([xlsx.TEMPLATE, ["Pão <1>", "", "", "", "", "2", "", "9"], [], ["", "x"]], "Minha LISTA")
    assert xlsx.read_rows(data)[1][0] == "Pão <1>" and len(xlsx.list_rows(data)) == 1
    assert xlsx.read_rows(b"PK\3\4 broken") == [] and xlsx.column_name(28) == "AB" and xlsx.column_number("AB7") == 28
    (tmp_path / "l.xlsx").write_bytes(data)
    assert [r["name"] for r in xlsx.read_lists(spark, str(tmp_path)).collect()] == ["Pão <1>"]


def test_backup_with_binary_and_nulls(tmp_path, spark):
    df = spark.createDataFrame([(1, bytearray(b"\0\xff"), None), (2, None, [1, 2])], "id int, blob binary, xs array<int>")
    backup.export_backup({"t": df}, str(tmp_path / "b"))
    back = backup.restore_backup(spark, str(tmp_path / "b"))["t"]
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    spark.createDataFrame([("other", 1, "t", "{}")], "format string, schema_version int, name string, schema string").write.json(str(tmp_path / "c/manifest"))
    with pytest.raises(ValueError):
        backup.restore_backup(spark, str(tmp_path / "c"))


def test_rest_stands_without_llm():
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['ledgerloom.llm'] = None; import __spark_entry__ as e; assert 'spend_by_category' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_plans_push_down(spark, sf_dir):
    from ledgerloom.plans.model import Model

    plan = Model(spark, sf_dir).active_items.groupBy("product_id").agg(F.sum("net_cents"))._jdf.queryExecution().toString()
    assert "l_tax" not in plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].split("Relation")[0]
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_workbooks_that_are_damaged_or_too_large(monkeypatch):
    import io
    import zipfile

    from ledgerloom.sources import xlsx

    book = xlsx.write_rows([["Nome", "Quantidade"], ["Arroz", "2"], ["Feijão " * 40, "1"]])
    assert len(xlsx.list_rows(book)) == 2
    names = {"Arroz", ("Feijão " * 40).strip()}
    for at in range(0, len(book), 3):  # any one byte changed, and any prefix
        broken = bytearray(book)
        broken[at] ^= 0x5A
        assert all(set(r) <= set(xlsx.FIELDS) for r in xlsx.list_rows(bytes(broken)))
        assert xlsx.list_rows(book[:at]) == []
    encrypted = bytearray(book)
    for mark, flag in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        at = encrypted.find(mark)
        while at >= 0:
            encrypted[at + flag] |= 1
            at = encrypted.find(mark, at + 1)
    assert xlsx.list_rows(bytes(encrypted)) == []
    monkeypatch.setattr(xlsx, "MOST", 4096)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            new.writestr(name, old.read(name) + b" " * (10**6 if "sheet1" in name else 0))
    assert xlsx.list_rows(out.getvalue()) == []
    assert {r["name"] for r in xlsx.list_rows(book)} == names


def test_streamed_counts_replace_what_a_batch_wrote(spark, tmp_path):
    from ledgerloom.streaming.audit_log import stream_event_counts

    rows = [(i, f"2024-01-01 0{i % 3}:30:00", "a" if i % 2 else "b") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = stream_event_counts(spark, str(tmp_path)).collect()
    assert sum(r["rows"] for r in got) == 40 and len(got) == 6


def test_rows_of_public_pages_match_brute_force(spark, sf_dir):
    import re

    def brute(html):
        text = re.sub(r"(?is)<script.*?</script>|<style.*?</style>", " ", html or "")
        text = re.sub(r"<[^>]+>", " ", text)
        for entity, to in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
            text = re.sub(entity, to, text, flags=re.I)
        text, out = re.sub(r"\s+", " ", text, flags=re.A).strip(" "), []
        for part in re.split(r"(?=\b\d{4,14}\b\s+)", text, flags=re.A):
            code, prices = re.search(r"\b(\d{4,14})\b", part, re.A), re.findall(r"(\d+[.,]\d{2})", part, re.A)
            if code and prices:
                name = re.sub(r"\b(?:R\$|C[oó]digo|Qtde?|Quantidade|UN|KG)\b", " ", re.sub(r"\b\d{4,14}\b", "", part, flags=re.A), flags=re.I)
                name = re.sub(r"\s+", " ", name.strip(" "), flags=re.A)[:120]
                if len(name) >= 2 and not re.match("(CNPJ|CPF|TOTAL|DESCONTO|PAGAMENTO|EMISS)", name, re.I):
                    amounts = [float(p.replace(",", ".")) for p in prices]
                    out.append((code[1], name, amounts[-2] if len(amounts) > 1 else amounts[-1], amounts[-1]))
        seen = {}
        for row in out[:200]:
            seen.setdefault((row[0], row[1], row[3]), row)
        return sorted(seen.values())

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    pages[-1] = "<p>2707 PAO 8,00</p>" * 3 + "".join(f"<p>{10000 + i} item {i} UN 1,50 {i},25</p>" for i in range(250))
    frame = spark.createDataFrame([*pages.items(), (-2, None)], "page_id long, html string")
    got = {}
    for r in extraction.public_rows(frame).collect():
        got.setdefault(r["page_id"], []).append((r["code"], r["name"], r["unit_price"], r["total"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(v) for k, v in pages.items() if brute(v)}
    assert len(got[-1]) == 198
