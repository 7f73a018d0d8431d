"""Personal data: base spans against Python's re, method spans, edge cases."""

import hashlib
import random
import re

from climo.llm import personal

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DOCS = "doc_id long, text string, spans string, base_spans long"


def luhn(digits):
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "", None, "a@b.c_d@e.f x@y a.b+c@d-e.co.uk. @q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3 12.34.56.256",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111 9" , "+1 (663) 555-6869 +12 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "é\U0001f600 x@y.zz\n+49 30 1234567 8", "1" * 5000 + "." + "2" * 3000, "a" * 30000, "x." * 20000 + "@", "@" + "a." * 9000 + "b@c" + ".d" * 9000,
    "1 " * 9000, "+" + "1-" * 9000, "5 4 1 6" * 3,
]


def test_base_spans_equal_python(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["1", "23", "4111111111111111", " ", "-", ".", "@", "a", "b.c", "+", "(", ")", "255", "é", "_", "%"])
                             for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in personal.span_digest(docs).collect()}
    for i, t in enumerate(texts):
        want = plain(t or "")
        got = [s for s in rows[i].spans.split(",") if s.split(":")[0] in BASE]
        assert got == want, (t, got, want)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert personal.span_digest(docs.limit(0)).count() == 0


def test_method_spans(spark):
    cases = {
        "Pay to IBAN DE89 3704 0044 0532 0130 00 now": ["iban:12:39"],
        "GB82WEST12345698765432": ["iban:0:22"],
        "DE88 3704 0044 0532 0130 00": [],
        "my ssn is 078-05-1120.": ["ssn:10:21"],
        "part 078-05-1120 ok": [], "ssn 000-05-1120": [], "ssn 1078-05-1120": [],
        "amex card 378282246310005": ["card_short:10:25"], "order 378282246310005": [], "card 378282246310006": [],
        "call (663) 555-6869 today": ["phone_local:5:19"], "call +1 (663) 555-6869": ["phone:5:22"],
        "see 663 555-6869": [],
    }
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(cases)], DOCS)
    got = {r.doc_id: r.spans for r in personal.span_digest(docs).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert got[i] == ",".join(want), text
