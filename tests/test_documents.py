"""Documents as users have them: workbooks, code pages, damaged and encrypted archives."""

import zipfile

import pytest

from lodestrata.operators import documents

SHEET = """<worksheet xmlns="m"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><r><t>in</t></r><r><t> line</t></r></is></c></row>
<row r="3"><c r="A3"><v>12</v></c><c r="AB3"><v>7.5</v></c><c t="b"><v>1</v></c><c r="AE3"/></row></sheetData></worksheet>"""


def workbook(path, sheet=SHEET, **parts):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Room</t></si><si><r><t>Ar</t></r><r><t>ea</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="q"><sheets><sheet name="Rooms &amp; more" r:id="r2"/><sheet name="Empty" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r2" Target="worksheets/sheet1.xml"/><Relationship Id="r1" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet xmlns="m"><sheetData/></worksheet>')


@pytest.fixture
def folder(tmp_path):
    workbook(tmp_path / "rooms.xlsx")
    workbook(tmp_path / "wrong.xlsx", SHEET.replace("<v>1</v></c><c r=\"C1\"", "<v>9</v></c><c r=\"C1\""))
    workbook(tmp_path / "torn.xlsx", SHEET[:200])
    (tmp_path / "old.txt").write_bytes("Стена № 5".encode("windows-1251"))
    (tmp_path / "wide.csv").write_bytes(b"\xff\xfe" + "a;б".encode("utf-16-le"))
    (tmp_path / "utf.txt").write_bytes(b"\xef\xbb\xbf" + "дверь".encode())
    (tmp_path / "plan.svg").write_text("<svg><text>Level&#160;1</text><path d='M0 0'/></svg>")
    (tmp_path / "cut.docx").write_bytes((tmp_path / "rooms.xlsx").read_bytes()[:90])
    (tmp_path / "empty.docx").write_bytes((tmp_path / "rooms.xlsx").read_bytes())  # no document in it
    (tmp_path / "blob.bin").write_bytes(bytes(range(256)))
    (tmp_path / "big.txt").write_text("x" * 5000)
    locked = bytearray((tmp_path / "rooms.xlsx").read_bytes())
    for sign, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag that says: encrypted
        start = locked.find(sign)
        while start >= 0:
            locked[start + at] |= 1
            start = locked.find(sign, start + 4)
    (tmp_path / "locked.xlsx").write_bytes(bytes(locked))
    packed = bytearray((tmp_path / "rooms.xlsx").read_bytes())
    for sign, at in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):  # a method that is not known
        start = packed.find(sign)
        while start >= 0:
            packed[start + at] = 97
            start = packed.find(sign, start + 4)
    (tmp_path / "packed.xlsx").write_bytes(bytes(packed))
    return tmp_path


def test_every_file_has_a_text_or_an_error(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.read(spark, str(folder), most=4096).collect()}
    text = {n: r.text for n, r in rows.items()}
    assert text["rooms.xlsx"] == "Room\tArea\tin line\n12\t7.5\tTRUE"
    assert text["old.txt"] == "Стена № 5" and text["wide.csv"] == "a;б" and text["utf.txt"] == "дверь" and text["plan.svg"] == "Level 1"
    bad = {"wrong.xlsx", "torn.xlsx", "cut.docx", "empty.docx", "blob.bin", "big.txt", "locked.xlsx", "packed.xlsx"}
    assert {n for n, r in rows.items() if r.error} == bad and all(rows[n].text is None for n in bad)
    assert rows["blob.bin"].error == "binary" and "encrypted" in rows["locked.xlsx"].error and "4096" in rows["big.txt"].error
    assert len(rows) == 13


def test_cells_have_their_places(spark, folder):
    got = [tuple(r)[1:] for r in documents.cells(spark, str(folder)).where("path like '%rooms.xlsx'").orderBy("row", "column").collect()]
    assert got == [("Rooms & more", 1, 1, "Room"), ("Rooms & more", 1, 2, "Area"), ("Rooms & more", 1, 3, "in line"), ("Rooms & more", 3, 1, "12"), ("Rooms & more", 3, 28, "7.5"), ("Rooms & more", 3, 29, "TRUE")]
    assert documents.cells(spark, str(folder)).select("path").distinct().count() == 1
