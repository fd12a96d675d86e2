"""STEP files by entity, against a scanner over the whole text."""

import random

import pytest

from lodestrata.operators import linking
from lodestrata.sources import step


def whole(text):
    """Records of a text, one character at a time."""
    out, held, state, i = [], "", "", 0
    while i < len(text):
        c = text[i]
        if state == "" and text[i : i + 2] == "/*":
            state, i, held = "*", i + 2, held + " "
            continue
        if state == "*":
            if text[i : i + 2] == "*/":
                state, i = "", i + 1
            i += 1
            continue
        if c == "'":
            state = "" if state else "'"
        if c == ";" and not state:
            out.append(held)
            held = ""
        else:
            held += c
        i += 1
    return out


def awkward(draw, n):
    parts = ["'it''s; x'", "'a /* b'", "/* it's; */", "/* \n ; ' */", "(1.,'*/;')", "#7", "\n", "IFCWALL", "'\n;\n'", "''", "é"]
    return "".join("#%d=" % i + "".join(draw.choices(parts, k=draw.randint(0, 7))) + ";" for i in range(n))


@pytest.mark.parametrize("size", ["1b", "40b", "1kb", "128m"])
def test_ranges_of_any_size_give_the_records_of_the_whole(spark, tmp_path, size):
    draw = random.Random(size)
    texts = {f"{k}.ifc": awkward(draw, 60) for k in range(2)} | {"long.ifc": "#1='" + "x;" * 3000 + "';#2=/*" + ";'" * 3000 + "*/y;\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", {"1b": "37b"}.get(size, size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = step.records(spark, str(tmp_path)).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        got = [r["text"] for r in sorted((r for r in rows if r["file"].endswith("/" + name)), key=lambda r: (r["block"], r["seq"]))]
        got = got[:-1] if got and not got[-1].strip() else got  # what stands behind the last semicolon
        assert got == [t.replace("\r", "") for t in whole(text)]


def test_escapes(spark):
    pairs = {r"\X2\0421\X0\tal": "Сtal", r"a\\b": "a\\b", r"\X\E9t\X\E9": "été", r"\S\d": "ä", r"\PA\x": "x", r"\X4\0001F600\X0\!": "\U0001f600!", r"\X2\D83DDE00\X0\\X\41": "\U0001f600A", "plain": "plain", "\\": "\\", "": ""}
    df = spark.createDataFrame([(k,) for k in pairs], "t string")
    assert {r[0]: r[1] for r in df.select("t", step.decoded(df.t)).collect()} == pairs


MODEL = """ISO-10303-21;
HEADER; /* made by; nobody's tool */
DATA;
#1=IFCPROJECT('p',#2,'P',$,$,$,$,(#5),#6);
#10= IFCBUILDINGSTOREY('s0',#2,
  'Level; 0',$,$,#8,$,$,.ELEMENT.,0.);
#11=IFCSPACE('r0',#2,'Room',$,$,#8,$,$,.ELEMENT.,.INTERNAL.,$);
#20=IFCCURTAINWALL('w0',#2,'\\X2\\0421\\X0\\-1',$,$,#8,
   #9,
   $);
#21=IFCPLATE('w1',$,$,$,(1,(2,(3.,'x)'))),#8,#9,$,.USERDEFINED.);
#22=IFCDOOR('d0',#2,'Door',$,$,#8,#9,$,2.,1.);
#23=IFCWALLTYPE('t0',#2,'Type',$,$,$,$,$,$,.STANDARD.);
#24=IFCPROPERTYSET('q0',#2,'Pset',$,(#1));
#30=IFCRELCONTAINEDINSPATIALSTRUCTURE('c0',#2,$,$,(#20,
 #21),#10);
#31=IFCRELAGGREGATES('a0',#2,$,$,#10,(#11));
ENDSEC;
"""


def test_two_files_keep_their_numbers_apart(spark, tmp_path):
    (tmp_path / "a.ifc").write_text(MODEL)
    other = MODEL.replace("'s0'", "'s1'").replace("(#20,\n #21),#10", "(#22),#10").replace("'w", "'v").replace("'d0'", "'d1'").replace("'r0'", "'r1'")
    (tmp_path / "b.ifc").write_text(other)
    model = linking.read_model(spark, str(tmp_path)).cache()
    rows = {(r.file[-5:-4], r.ref): r for r in model.collect()}
    assert sorted(rows) == [(f, r) for f in "ab" for r in (1, 10, 11, 20, 21, 22)]
    assert rows["a", 20].name == "С-1" and rows["a", 21].name is None and rows["a", 10].name == "Level; 0" and rows["b", 20].guid == "v0"
    assert [rows[k].container for k in (("a", 20), ("a", 21), ("a", 22), ("b", 20), ("b", 22), ("a", 11))] == [10, 10, None, None, 10, 10]
    rooms = {(r.file[-5:-4], r.ref): r.room for r in linking.rooms_of(model).collect()}
    assert rooms == {("a", 20): 11, ("a", 21): 11, ("a", 22): None, ("b", 20): None, ("b", 21): None, ("b", 22): 11}
    model.unpersist()


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "e.ifc").write_text("")
    (tmp_path / "n.ifc").write_text("no semicolon")
    assert linking.read_model(spark, str(tmp_path)).count() == 0
