"""Files in other forms, on awkward ones made here."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import crypt
from ledgerloom.operators import passthrough
from ledgerloom.sources import iso20022, json_ledgers, sheets


def test_workbooks(spark):
    book = sheets.workbook_bytes("A & B", [["t", None], ["x < y", "2", None, "4"], [None, None, None, None], ["", "late"]], ["A1:B1", "A2:A3", "D2:E3"])
    files = spark.createDataFrame([("good", bytearray(book)), ("bad", bytearray(b"no zip")), ("none", None)], "file string, content binary")
    rows = sheets.workbooks(files).collect()
    got = {r.row_no: r.cells for r in rows if r.file == "good"}
    assert {r.sheet for r in rows if r.file == "good"} == {"A & B"}
    assert got == {1: ["t", "t"], 2: ["x < y", "2", None, "4", "4"], 3: ["x < y", None, None, "4", "4"], 4: ["", "late"]}
    assert {(r.file, r.fault) for r in rows if r.fault} == {("bad", "BadZipFile"), ("none", "BadZipFile")}


def test_workbook_by_shared_strings(spark):
    import io
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="q" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="7"><c r="AB7" t="s"><v>1</v></c><c r="A7"><v>45292.5</v></c></row></sheetData></worksheet>')
    rows = list(sheets.workbook_rows(out.getvalue()))
    assert rows == [("one", 7, ["45292.5", *[None] * 26, "bc"])]


def test_html_rows(spark):
    page = "<p><table x=1><tr><th>a<b>b</b></th><th>c</th></tr><tr><td>1 &lt; 2<td> d\n e</tr></table><script>'<table><tr><td>no</td></tr></table>'</script><ul><li>x</li><li><a href=q>y</a></ul>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    assert [tuple(r) for r in sheets.html_rows(pages, "id", "html").orderBy("row_no").collect()] == [(1, 0, 0, ["ab", "c"]), (1, 0, 1, ["1 < 2", "d e"])]
    assert [r.cells for r in sheets.html_rows(pages, "id", "html", "ul", "li", "").orderBy("row_no").collect()] == [["x"], ["y"]]


def test_iso20022(spark):
    pacs = """<d:Document xmlns:d="u"><d:FIToFICstmrCdtTrf><d:GrpHdr/><d:CdtTrfTxInf><d:PmtId><d:EndToEndId>E1</d:EndToEndId><d:TxId>T1</d:TxId></d:PmtId><d:IntrBkSttlmAmt Ccy="VND">12.5</d:IntrBkSttlmAmt>
        <d:Dbtr><d:Nm>Nguyễn &amp; Co</d:Nm></d:Dbtr><d:DbtrAcct><d:Id><d:Othr><d:Id>77</d:Id></d:Othr></d:Id></d:DbtrAcct></d:CdtTrfTxInf></d:FIToFICstmrCdtTrf></d:Document>"""
    camt = '<Document xmlns="u"><BkToCstmrStmt><Stmt><Acct><Id><IBAN>A</IBAN></Id></Acct><Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="VND">5</Amt><CdtDbtInd>DBIT</CdtDbtInd></Bal><Ntry><NtryRef>N1</NtryRef><Amt Ccy="VND">3</Amt><CdtDbtInd>DBIT</CdtDbtInd><AddtlNtryInf>note</AddtlNtryInf></Ntry></Stmt></BkToCstmrStmt></Document>'
    files = spark.createDataFrame([("swift-1", pacs), ("c", camt), ("bad", "x"), ("none", None)], "file string, content string")
    rows = {r.file: r for r in iso20022.rows(files, 2).collect()}
    assert set(rows) == {"swift-1", "c"}
    assert tuple(rows["swift-1"]) == ("swift-1", "SWIFT", "pacs.008", None, 1, "E1", "credit", 1250, None, "Nguyễn & Co", "77", None)
    assert tuple(rows["c"]) == ("c", "CITAD", "camt.053", "A", 1, "N1", "debit", 300, None, None, None, "note")
    assert [tuple(r) for r in iso20022.balances(files).collect()] == [("c", "A", -5, None)]


def test_json_ledgers(spark):
    texts = {"a": '[{"id": "1", "amount": 5}, {"id": 2, "amount": "x"}]', "o": '{"entries": [{"doc_no": "D"}]}', "one": '{"id": "s", "amount": 9223372036854775807}', "bad": "[{", "empty": "[]", "none": None}
    files = spark.createDataFrame(list(texts.items()), "file string, content string")
    got = {(r.file, r.entry_no): (r.id, r.amount, r.doc_no) for r in json_ledgers.ledger_json(files).collect()}
    assert got == {("a", 0): ("1", 5, None), ("a", 1): ("2", None, None), ("o", 0): (None, None, "D"), ("one", 0): ("s", 2**63 - 1, None)}
    assert {tuple(r) for r in json_ledgers.rejected_json(files).collect()} == {("bad", "no JSON"), ("empty", "no entries"), ("none", "no JSON")}


def test_encrypted_fields(spark, capsys):
    key = b"0123456789abcdef"
    keys = spark.createDataFrame([(1, key), (2, key[::-1])], "key_id int, key binary")
    rows = spark.createDataFrame([(1, 1, "secret"), (2, 1, "secret"), (3, 1, None), (4, 9, "lost"), (5, 2, "")], "id long, k int, x string")
    path = crypt_path = __import__("tempfile").mkdtemp(prefix="spark-sealed-")
    sealed = crypt.encrypt_fields(rows, ["x"], keys, "k", "id")
    sealed.explain("extended")
    assert key.decode() not in capsys.readouterr().out and key.hex() not in capsys.readouterr().out
    sealed.write.mode("overwrite").parquet(f"{path}/s")
    closed = spark.read.parquet(f"{crypt_path}/s")
    held = {r.id: r.x for r in closed.collect()}
    assert held[1] != held[2] and held[3] is None and held[4] is None
    assert {r.id: r.x for r in crypt.decrypt_fields(closed, ["x"], keys, "k", "id").collect()} == {1: "secret", 2: "secret", 3: None, 4: None, 5: ""}
    moved = closed.where("id = 1").withColumn("id", F.lit(2).cast("long"))
    wrong = closed.where("id = 1").withColumn("k", F.lit(2))
    assert [r.x for r in crypt.decrypt_fields(moved.union(wrong), ["x"], keys, "k", "id").collect()] == [None, None]


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_later_drains(spark, block, monkeypatch):
    import random

    monkeypatch.setattr(passthrough, "BLOCK", block)
    rng = random.Random(9)
    rows = [(k, rng.choice([1, 10, 90, 100, 100, 95, 2_000, rng.randrange(1, 300)]), 0, rng.random() < 0.5, "") for k in range(300)]
    tx = spark.createDataFrame(rows, "tx_id long, amount long, ts long, is_credit boolean, narration string")
    want = set()
    for i, a, _, credit, _ in rows:
        if credit and a >= 5:
            out = next((j for j, b, _, c, _ in rows if j > i and not c and 90 * a <= 100 * b <= 100 * a), None)
            if out is not None:
                want.add((i, out))
    assert {tuple(r) for r in passthrough.later_drains(tx, floor=5).collect()} == want
    assert passthrough.later_drains(tx.limit(0)).count() == 0


def test_no_frame_of_later_drains_shrinks(spark):
    """Frames up to the last row are read again for each row, which took a time quadratic in a block."""
    tx = spark.createDataFrame([(1, 100, 0, True, ""), (2, 95, 0, False, "")], "tx_id long, amount long, ts long, is_credit boolean, narration string")
    assert "unboundedfollowing" not in passthrough.later_drains(tx, floor=5)._jdf.queryExecution().toString().lower()


def test_xml_is_read_once_for_a_kind_of_message(spark):
    """Each text is parsed by one expression of the branch that its kind belongs to; texts of both kinds and of none are right."""
    both = "<Document><BkToCstmrStmt><Stmt><Acct><Id><IBAN>A</IBAN></Id></Acct><Ntry><Amt>1.00</Amt></Ntry></Stmt><Stmt><Acct><Id><IBAN>B</IBAN></Id></Acct></Stmt></BkToCstmrStmt><FIToFICstmrCdtTrf><CdtTrfTxInf><InstdAmt>2.00</InstdAmt></CdtTrfTxInf></FIToFICstmrCdtTrf></Document>"
    files = spark.createDataFrame([("a", both), ("b", "no BkToCstmrStmt <xml"), ("c", None), ("d", "<Document><BkToCstmrStmt/></Document>")], "file string, content string")
    got = iso20022.rows(files, places=2)
    assert sorted((r.file, r.kind, r.account or "", r.row_id, r.amount) for r in got.collect()) == [("a", "camt.053", "A", 1, 100), ("a", "pacs.008", "", 1, 200)]
    assert sorted((r.file, r.account) for r in iso20022.balances(files, places=2).collect()) == [("a", "A"), ("a", "B")]
    for made, kinds in ((got, 2), (iso20022.balances(files, places=2), 1)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == kinds


def test_small_sheets_are_parsed_whole_and_large_ones_as_streams(spark, monkeypatch):
    """Both ways give the same rows, merged cells and faults, and rows of many small files share a batch."""
    rows = [["a", None, "c"], [None, "x", None], ["d", "e", "f"]]
    book = sheets.workbook_bytes("S", rows, ["A1:B2", "C1:C3"])
    whole = list(sheets.workbook_rows(book))
    passes = []
    real = sheets.ElementTree.iterparse
    monkeypatch.setattr(sheets.ElementTree, "iterparse", lambda held: passes.append(1) or real(held))
    assert list(sheets.workbook_rows(book)) == whole and not passes
    monkeypatch.setattr(sheets, "WHOLE", 0)
    assert list(sheets.workbook_rows(book)) == whole and passes
    assert whole == [("S", 1, ["a", "a", "c"]), ("S", 2, ["a", "x", "c"]), ("S", 3, ["d", "e", "f"])]
