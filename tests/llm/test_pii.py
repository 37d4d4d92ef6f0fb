"""Base spans against Python's regular expressions; disclosure against a planted corpus."""
import hashlib
import re

from pyspark.sql import functions as F

from evq.llm import pii
from evq.llm.queries import op9

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.split(".")) if kind == "ip" else True,
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def plain(text):
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0])]


def spans(row):
    return [(s.kind, s.start, s.end) for s in row.pii if s.kind != "term"]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in op9(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = plain(d.text)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in PLAIN)
        assert all(f"{k}:{a}:{b}" in r.spans.split(",") for k, a, b in want)


def test_edges(spark, edge):
    found = pii.find(edge)
    assert found.columns[:-1] == edge.columns
    rows = found.collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r.doc_id != 7:
            assert spans(r) == plain(r.text)
    assert pii.find(edge.limit(0)).count() == 0
    cleaned = pii.sanitised_documents(edge)
    assert cleaned.columns == edge.columns
    assert cleaned.filter("doc_id = 1").first().text is None
    assert "[email], 1.2.3.4" not in cleaned.filter("doc_id = 5").first().text and "[ip]" in cleaned.filter("doc_id = 5").first().text


def test_long_runs_are_linear(spark):
    rows = [(1, "a" * 300000), (2, "7" * 300000), (3, "1-" * 100000), (4, "a@" + "b." * 100000 + "c"), (5, "1." * 100000), (6, "+1" + " 2" * 100000)]
    got = {r.doc_id: spans(r) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] == got[6] == [] and got[4] == [("email", 0, 200003)] and len(got[5]) == 25000


def test_ip_parts_beyond_int(spark):
    texts = ["1.2.3.20240115123", "9999999999.1.1.1", "1.2.3.2147483648", "1.2.3.2147483647", "1.99999999999999999999.3.4 1.2.3.4", "0000000000001.2.3.0000000000255", "1.2.3.0000000000256"]
    got = {r.doc_id: spans(r) for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: [s for s in got[i] if s[0] == "ip"] for i in got} == {i: [s for s in plain(t) if s[0] == "ip"] for i, t in enumerate(texts)}
    assert [sum(s[0] == "ip" for s in got[i]) for i in range(len(texts))] == [0, 0, 0, 0, 1, 1, 0]


def test_disclosing_terms(spark):
    """A project name that goes with one address in different lines is removed; common words and words of mere copies stay."""
    common = [f"the plan number{i} was sent and filed again today" for i in range(3000)]
    lines = [f"the Zephyrine file{i} of zoe@corp.example was sent" for i in range(4)]
    rows = [(i, t) for i, t in enumerate(common)] + [(9000 + i, "x\n" + t) for i, t in enumerate(lines)] + [(9500 + i, "the same copied oddity of bob@corp.example") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.value) for s in r.pii] for r in pii.find(docs).filter(F.size("pii") > 0).collect()}
    assert len(got) == 24
    assert got[9000] == [("email", "zoe@corp.example"), ("term", "Zephyrine"), ("term", "of")] or got[9000] == [("email", "zoe@corp.example"), ("term", "Zephyrine")]
    assert got[9500] == [("email", "bob@corp.example")]
    text = pii.sanitised_documents(docs).filter("doc_id = 9001").first().text
    assert "Zephyrine" not in text and "[email]" in text and text.startswith("x\nthe ")
