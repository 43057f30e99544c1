import hashlib
import re

from lodequery.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f", "x@y.z@w.v a@b@c.d ..@..a", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3", "4041894974608795 4041 8949 7460 8795 4041-8949-7460-8795 40418949746087950",
    "+1 (988) 555-2485, +12 3 and +1234567890123456 +1.....2 +49 30 1234567", "é𝄞 ü a@b.de 𝄞𝄞 10.0.0.1 ñ +1 (988) 555-2485", "1 " * 30_000, "a" * 12_000, "1" * 12_000, "a@" + "b." * 20_000 + "c",
    "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 not DE89370400440532013001", "SSN 123-45-6789 but 123-45-6789" + " " * 60 + "987-65-4329", "a@b.c a@b.c a@b.c",
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, f"x{i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for r in pii.digest(docs).collect():
        want = plain(TEXTS[r.doc_id])
        own = [s for s in r.spans.split(",") if s and s.split(":")[0] in BASE]
        assert own == want, TEXTS[r.doc_id][:60]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in BASE]


def test_added_kinds(spark):
    docs = spark.createDataFrame([(0, TEXTS[13]), (1, TEXTS[14])], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert [s for s in got[0].split(",") if s.startswith("iban")] == ["iban:0:27", "iban:32:54"]
    assert [s for s in got[1].split(",")] == ["ssn:4:15", "ssn:20:31"]


def test_redact(spark):
    docs = spark.createDataFrame([(0, "ü a@b.de, +1 (988) 555-2485!"), (1, None), (2, "clean"), (3, "+4041894974608795 x")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {0: "ü <EMAIL>, <PHONE>!", 1: None, 2: "clean", 3: "+<CARD> x"}


def test_empty_table(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ibans_before_capitals_and_digits(spark):
    ibans = {
        "IBAN DE89 3704 0044 0532 0130 00 Please pay": ["DE89 3704 0044 0532 0130 00"], "DE89370400440532013000 BIC COBADEFF": ["DE89370400440532013000"],
        "DE89370400440532013000 5 days": ["DE89370400440532013000"], "GB82 WEST 1234 5698 7654 32 A": ["GB82 WEST 1234 5698 7654 32"],
        "é𝄞 DE89370400440532013000 GB82WEST12345698765432 X": ["DE89370400440532013000", "GB82WEST12345698765432"], "AB12 DE89370400440532013000": ["DE89370400440532013000"],
        "DE89370400440532013001 A": [], "DE89370400440532013000x": [], "xDE89370400440532013000": [], "AB12 " * 2000: [],
    }
    docs = spark.createDataFrame(list(enumerate(ibans)), "doc_id long, text string")
    for r in pii.digest(docs).collect():
        text = list(ibans)[r.doc_id]
        at = [s.split(":")[1:] for s in r.spans.split(",") if s.startswith("iban")]
        assert [text[int(a) : int(b)] for a, b in at] == ibans[text], text[:60]
    assert pii.redact(docs.where("doc_id = 0")).first().text == "IBAN <IBAN> Please pay"


def test_many_hits_in_a_long_text(spark):
    """Positions and replacement stay right over block and piece borders."""
    text = "".join(f"é𝄞{'x' * (i % 37)} a{i}@b.de " for i in range(900))
    docs = spark.createDataFrame([(0, text), (1, text), (1, text)], "doc_id long, text string")
    got = pii.digest(docs).collect()
    assert len(got) == 3 and len({r.spans for r in got}) == 1
    assert [s for s in got[0].spans.split(",") if s.startswith("email")] == [s for s in plain(text) if s.startswith("email")] and got[0].n_email == 900
    assert pii.redact(docs).first().text == re.sub(BASE["email"], "<EMAIL>", text)


def test_context_raises_and_lowers(spark):
    texts = ["DE89370400440532013000", "IBAN DE89370400440532013000", "example DE89370400440532013000", "example IBAN DE89370400440532013000", "SSN 123-45-6789", "part no 123-45-6789 ssn", "order 4041894974608795", "visa 4041894974608795"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.split(":") for s in r.scored_spans.split(",") if s] for r in pii.digest(docs).collect()}
    score = lambda i, kind: [float(x[3]) for x in got[i] if x[0] == kind]
    assert score(0, "iban") == [0.75] and score(1, "iban") == [0.95] and score(2, "iban") == [] and score(3, "iban") == [0.65]
    assert score(4, "ssn") == [0.6] and score(5, "ssn") == []
    assert score(6, "card") == [0.4] and score(7, "card") == [0.9]
