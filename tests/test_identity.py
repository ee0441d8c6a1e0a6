"""Fingerprints, repeats and evidence on odd receipts."""

from ledgerloom.operators import extraction, identity

HEAD = "receipt_id long, market string, cnpj string, date string, time string, document string, total double, fiscal_key string"
LINE = "receipt_id long, barcode string, name string, unit string, quantity double, unit_price double, total double, discount double"


def test_each_part_of_a_fingerprint_counts(spark):
    base = ("Loja", "17.833.301/0022-23", "2026-09-10", "10:00:30", "7", 10.0, None)
    other = [("Laja", *base[1:]), (base[0], "09653290000147", *base[2:]), (*base[:2], "2026-09-11", *base[3:]), (*base[:3], "10:00:31", *base[4:]), (*base[:4], "8", *base[5:]), (*base[:5], 10.01, None)]
    same = [(" loja", "17833301002223", *base[2:])]
    heads = [(i, *h) for i, h in enumerate([base, *other, *same, base, base, (*base[:6], "3516" + "0" * 40)])]
    lines = [(i, "7-89", "Leite", "UN", 2.0, 5.0, 10.0, 0.0) for i in range(8)] + [(8, "789", "Leite", "un", 2.0, 5.0001, 10.0, 0.0)]
    lines += [(i, None, None, None, None, None, None, None) for i in range(2)] + [(7, None, "", "", 0.0, 0.0, 0.0, None)]
    lines = [x for x in lines if not (x[0] == 0 and x[2] is None)] + [(0, None, None, None, None, None, None, None)]
    got = {r["receipt_id"]: r for r in identity.fingerprints(spark.createDataFrame(heads, HEAD), spark.createDataFrame(lines, LINE)).collect()}
    assert got[0]["fingerprint"] == got[7]["fingerprint"] and got[0]["context"] == got[7]["context"]
    assert len({r["fingerprint"] for r in got.values()}) == len(got) - 1
    assert got[0]["coarse"] == "17833301002223|2026-09-10|10.00" and got[10]["coarse"] is None
    assert got[10]["fingerprint"] == "FISCAL:3516" + "0" * 40


def test_a_repeat_needs_the_minute_and_a_number(spark):
    kind = "purchase_id long, fingerprint string, date string, time string, total double, cnpj string, document string, active boolean"
    a, b = "17833301002223", "09653290000147"
    rows = [
        (1, "f", "d", "10:00:10", 5.0, a, "1", True), (2, "g", "d", "10:00:50", 5.0, a, "2", True), (3, "h", "d", "10:01", 5.0, a, "3", True), (4, "f", "e", "11:00", 6.0, b, "4", True),
        (5, "i", "d", "10:00", 5.0, b, "2", True), (6, "j", "d", "10:00", 5.0, "", "", True), (7, "k", "d", "10:00", 5.0, "", None, True), (8, "l", "z", None, None, b, "x", False), (9, "l", "z", None, None, b, "x", True), (10, "l", "z", None, None, b, "x", True),
    ]
    got = {r["purchase_id"]: r["existing"] for r in identity.first_repeats(spark.createDataFrame(rows, kind)).collect()}
    assert got == {2: 1, 4: 1, 5: 2, 10: 9}


def test_items_of_receipts_take_shown_names_and_least_totals(spark):
    text = "CERV. ESCURA 500 ml (Código: 7892)\nQtde.: 2 UN Vl. Unit.: 3,00 6,00\nREFRI COLA 2L (Código: 7891) Vl. Total\nsem quantidade 9,00 4,00"
    rows = extraction.receipt_items(extraction.receipt_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("line").collect()
    assert [(r["name"], r["pack"], r["needs_review"], r["total"]) for r in rows] == [("Cerveja ESCURA 500 ml", "500 ML", False, 6.0), ("Refrigerante COLA 2L", "2 L", True, 4.0)]


def test_totals_stand_apart_from_their_labels(spark):
    text = "Loja\nVALOR A PAGAR\na\nb\nc\nd R$ 12,50\nfim 99,00\nx\ny\nz"
    row = extraction.receipt_headers(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row["total"] == 12.5
