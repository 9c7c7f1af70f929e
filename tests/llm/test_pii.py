import hashlib
import random
import re

from quire.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def samples():
    rnd = random.Random(7)
    bits = ["a", "b.", "@", "@x.y", ".", "1", "12", "255", "256", " ", "-", "+", "+1 (696) 555-2293", "4111 1111 1111 1111", "378282246310005", "1.2.3.4", "é😀", "\n", "10.0.0.1.5.6.7.8.9"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    return [*out, "", "a" * 100_000, "1" * 100_000, "@" * 1000, "1." * 3000 + "x@y.z"]


def test_base_spans_match_the_patterns():
    for t in samples():
        if len(t) < 10_000:
            assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE_KINDS] == brute(t), t
        else:
            pii.find(t)


def test_added_kinds_need_checksum_or_context():
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("to GB82 WEST 1234 5698 7654 32 today") == ["iban"]
    assert kinds("to GB83 WEST 1234 5698 7654 32 today") == []
    assert kinds("call me: 555-123-4567") == ["local_phone"] and kinds("part 555-123-4567") == []
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("item 123-45-6789") == []
    assert pii.redact("mail a@b.co or +49 30 1234567!", pii.find("mail a@b.co or +49 30 1234567!")) == "mail <email> or <phone>!"


def test_ibans_with_tokens_behind_and_over_cards():
    found = lambda t: [t[s[1] : s[2]] for s in pii.find(t) if s[0] == "iban"]
    whole, parts = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for behind in (" BIC COBADEFFXXX", " 2024", " OK", "", " and so on"):
        assert found(f"IBAN {whole}{behind}") == [whole] and found(f"IBAN {parts}{behind}") == [parts]
    assert found(f"IBAN {whole} {whole}") == [whole, whole]
    assert found("IBAN DE89370400440532013001 OK") == []
    digits = next(f"1234569876543{d}" for d in range(10) if pii.luhn(f"1234569876543{d}"))
    over = next(x for c in range(2, 99) if pii.mod97(x := f"GB{c:02d}WEST{digits}"))
    assert [s[0] for s in pii.find(f"IBAN {over}")] == ["card", "iban"]


def test_query_columns(spark):
    rows = [(1, "a@b.co 10.0.0.1 é"), (2, None), (3, ""), (None, "x 4111 1111 1111 1111"), (1, "a@b.co 10.0.0.1 é")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, spans string, n_ip int")
    got = pii.digest(pii.pii_spans(docs)).collect()
    want = []
    for i, t in rows:
        s = brute(t or "")
        text = ",".join(":".join(map(str, x)) for x in s)
        want.append((i or 0, *[sum(x[0] == k for x in s) for k in pii.BASE_KINDS], hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == sorted(want)
    assert pii.pii_spans(docs.limit(0)).count() == 0


def test_added_spans_that_touch_or_share_places():
    """An added span that shares a character with an earlier one goes, one that only touches stays; thousands are found in one pass."""
    one = "call 555-123-4567 now. "
    text = one * 3000
    found = pii.find(text)
    assert [s[0] for s in found] == ["local_phone"] * 3000 and all(text[a:z] == "555-123-4567" for _, a, z, _ in found)
    spans = sorted((a, z) for k, a, z, _ in pii.find("IBAN DE89370400440532013000 and card 4111 1111 1111 1111, ssn 123-45-6789, mail a@b.org") if k not in ("card",))
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
