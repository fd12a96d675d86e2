import hashlib
import random
import re

import pytest

from lodestrata.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PARTS = ["+1 (644) 555-7859", "4429526289707589", "4429-5262-8970-7589", "1.2.3.4", "999.1.2.3", "01.002.3.255", "a@b.c", "a.b@c..d", "x@y.z_q@r.s", "\U0001f600", "+12-", "-", "12", "1.2.3.4.5.6.7.8", "joe (at) mail (dot) com", "\u00e9", "00000000000000", "12345678901234567890123"]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def texts():
    rnd = random.Random(7)
    letters = "0123456789" * 2 + ".-+@ ()ab_\u00e9"
    rows = [(i, "".join(rnd.choice(letters if rnd.random() < 0.7 else "0123456789 -.") for _ in range(rnd.randint(0, 90)))) for i in range(500)]
    return rows + [(i, rnd.choice(" ,").join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 9)))) for i in range(500, 900)]


def test_base_spans_against_brute_force(spark, make_docs, odd_rows, monkeypatch):
    rows = texts() + [(1000 + i, t) for i, (_, t) in enumerate(odd_rows)]
    monkeypatch.setattr(pii, "table", lambda *_: make_docs(rows))
    found = {r.doc_id: r for r in pii.query(spark, "").collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base = brute(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
        assert set(base) <= set(filter(None, found[i].spans.split(",")))


def test_a_number_of_known_format_is_found_without_its_prefix(spark, make_docs):
    rnd = random.Random(8)
    rows = [(i, f"call +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} now") for i in range(300)]
    rows += [(300 + i, f"code {rnd.randint(10**9, 10**10)} here") for i in range(300)]
    df = make_docs(rows)
    assert pii.detect(df).selectExpr("sum(size(b3))").first()[0] == 300


@pytest.mark.parametrize("hidden, plain", [(20, 100), (400, 100), (20, 0), (20, 2), (20, 12), (20, 1000)])
def test_spans_beyond_the_base_patterns(spark, make_docs, hidden, plain):
    """Planted forms that no base pattern takes, few or more than the base ones; what only looks alike stays out."""
    rnd = random.Random(9)

    def card(sep=""):
        d = "".join(rnd.choice("0123456789") for _ in range(15))
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def mail(at="@", dot="."):
        return f"{rnd.choice('abcdef')}{rnd.randint(10, 99)}{at}mail{rnd.randint(1, 9)}{dot}example{dot}com"

    def phone(prefix="+1 "):
        return f"{prefix}({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"

    def ip(dot="."):
        return dot.join(str(rnd.randint(0, 255)) for _ in range(4))

    rows = [(i, f"the words {x} and on") for i, x in enumerate(f() for _ in range(plain) for f in (card, mail, phone, ip))]
    planted = {}
    for i in range(hidden):
        for j, (kind, x) in enumerate((("email", mail(" (at) ", " (dot) ")), ("email", mail(" at ", " dot ")), ("phone", phone("")), ("phone", phone("1 ")), ("ip", ip("[.]")), ("card", card("/")))):
            planted[10_000 + 10 * i + j] = f"{kind}:10:{10 + len(x)}"
            rows.append((10_000 + 10 * i + j, f"the words {x} and on"))
    a, b = card(), card()
    planted[9000] = f"card:10:{10 + len(a)},card:{11 + len(a)}:{11 + len(a) + len(b)}"
    rows.append((9000, f"the words {a} {b} and on"))
    clean = [(50_000 + i, f"the words {x} and on") for i, x in enumerate(y for _ in range(40) for y in (str(rnd.randint(10**9, 10**10)), "in at and. The", f"ab{rnd.randint(10**9, 10**10)}cd", "1.2.3", "we meet at noon", "1234-5678-9012-3456"))]
    found = {r.doc_id: r.spans for r in pii.detect(make_docs(rows + clean)).select("doc_id", pii.joined(pii.F.col("spans")).alias("spans")).collect()}
    caught = sum(found[i] == spans for i, spans in planted.items())
    assert caught >= 0.95 * len(planted), {found[i] for i in planted if found[i] != planted[i]}
    assert [found[i] for i, _ in clean if found[i]] == []


def test_redaction_keeps_rows_columns_and_clean_texts(make_docs):
    df = make_docs([(1, "mail a.b@c.de or +1 (644) 555-7859, \u00e9nd"), (2, "nothing here"), (3, None), (3, None), (None, "1.2.3.4")])
    out = pii.redact(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert {r.n_chars for r in pii.redact(df.withColumn("n_chars", pii.F.length("text").cast("long"))).collect()} == {len("mail [EMAIL] or [PHONE], \u00e9nd"), 12, None, 4}
    assert sorted((r.text for r in out.collect()), key=str) == sorted(["mail [EMAIL] or [PHONE], \u00e9nd", "nothing here", None, None, "[IP]"], key=str)


def test_empty_table(make_docs):
    assert pii.detect(make_docs([])).count() == 0 and pii.redact(make_docs([])).count() == 0


def test_trees_separate_and_calibrate():
    rows = [((i % 5, i % 3), float(i % 5 > 2) * 10, 10.0) for i in range(15)]
    start, trees = pii.boosted(rows)
    scored = [(start + sum(pii._leaf(t, x) for t in trees), p) for x, p, n in rows]
    threshold = pii.Model.calibrated(scored)
    assert all((z >= threshold) == (p > 0) for z, p in scored)
    assert pii.Model.calibrated([(1.0, 0.0)]) is None
