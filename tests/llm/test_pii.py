"""Personal data against plain regular expressions, and redaction."""

import hashlib
import random
import re
import time

from textloom.llm.pii import BASE, find_pii, redact, span_digest

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right_sum(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and right_sum(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "", re.ASCII) if valid(kind, m[0])
    ]


def card(draw, n=16):
    head = "4" + "".join(draw.choice("0123456789") for _ in range(n - 2))
    return next(head + c for c in "0123456789" if right_sum(head + c))


def texts():
    draw = random.Random(4)
    parts = [
        lambda: "joe.smith+x@mail.example.co.uk", lambda: "a@b", lambda: "a@b@c.de", lambda: "x@y.z%q@r.st", lambda: "@a.b", lambda: "u@v..w",
        lambda: ".".join(str(draw.randrange(300)) for _ in range(draw.choice([3, 4, 5, 8]))), lambda: "010.001.0255.000000001",
        lambda: card(draw), lambda: " ".join(re.findall("....", card(draw))), lambda: card(draw, 19), lambda: card(draw)[:-1] + "x",
        lambda: "+49 (30) 123-45.67", lambda: "+1", lambda: "+12 3456789012345678", lambda: "+4 4", lambda: "é💡", lambda: "word", lambda: "\n",
        lambda: "call 212-555-0142 now", lambda: "the social security number is 123-45-6789", lambda: "iban GB82 WEST 1234 5698 7654 32", lambda: "" + "7" * draw.randrange(30),
    ]
    rows = ["".join(draw.choice(parts)() + draw.choice(["", " ", ", ", "-"]) for _ in range(draw.randrange(12))) for _ in range(400)]
    return [*rows, "", None, "1" * 30_000, "a." * 20_000 + "@", "+1 " + "-" * 20_000, "x@y.zz " * 3000]


def test_base_spans_are_those_of_plain_patterns(documents):
    rows = list(enumerate(texts()))
    found = {r["doc_id"]: r for r in span_digest(documents(rows, extra=True)).collect()}
    assert len(found) == len(rows)
    for key, text in rows:
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = found[key]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS], text[:200]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text[:200]
        assert r["spans"].startswith(joined)


def test_context_and_checksums_add_spans(documents):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "iban GB82 WEST 1234 5698 7654 33"), (3, "my phone: 212-555-0142"), (4, "item 212-555-0142"), (5, "social security 123-45-6789")]
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["found"]] for r in find_pii(documents(rows), "text", "found").collect()}
    assert found[1] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found[2] == [] and found[4] == []
    assert found[3] == [("local_phone", "212-555-0142")]
    assert found[5] == [("national_id", "123-45-6789")]


def test_redaction_keeps_the_rest(documents):
    rows = [(1, "Ünï joe@x.org and 10.0.0.1!"), (2, None), (3, ""), (4, "nothing here"), (None, "+49 30 1234567")]
    df = documents(rows, extra=True)
    out = redact(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Ünï [EMAIL] and [IP]!", 2: None, 3: "", 4: "nothing here", None: "[PHONE]"}
    assert redact(documents([])).count() == 0


def test_context_is_whole_words_on_either_side(documents):
    rows = [
        (1, "212-555-0142 is my mobile"), (2, "the hotel 212-555-0142"), (3, "discard 212-555-0142 at once"), (4, "123-45-6789 (passport)"),
        (5, "phone 212-555-0142 or 212-555-0143, 212-555-0144"), (6, "phone " + "x" * 60 + " 212-555-0142"), (7, "212-555-0142 " + "x" * 60 + " phone"),
    ]
    found = {r["doc_id"]: [(s["kind"], s["value"], s["start"]) for s in r["found"]] for r in find_pii(documents(rows), "text", "found").collect()}
    assert found[1] == [("local_phone", "212-555-0142", 0)] and found[4] == [("national_id", "123-45-6789", 0)]
    assert found[2] == found[3] == found[6] == found[7] == []
    assert [v[1] for v in found[5]] == ["212-555-0142", "212-555-0143", "212-555-0144"]


def test_redaction_is_that_of_plain_code(documents):
    draw = random.Random(9)
    rows = [(k, "".join(draw.choice(["é💡 ", "word ", "joe@x.org", "+49 30 1234567", " 10.0.0.1", card(draw), " phone 212-555-0142 ", "w" * 3000]) for _ in range(draw.randrange(30)))) for k in range(150)]
    spans = {r["doc_id"]: sorted((s["start"], s["stop"], s["kind"]) for s in r["f"]) for r in find_pii(documents(rows), "text", "f").collect()}
    found = {r["doc_id"]: r["text"] for r in redact(documents(rows)).collect()}
    for key, text in rows:
        out, at = "", 0
        for start, stop, kind in spans[key]:
            if start >= at:
                out, at = f"{out}{text[at:start]}[{kind.upper()}]", stop
            at = max(at, stop)
        assert found[key] == out + text[at:]


def test_many_matches_in_one_text_take_time_in_proportion(documents):
    text = " ".join(f"{k % 90 + 10} 10.0.{k % 256}.1" for k in range(100_000))
    began = time.time()
    r = span_digest(documents([(1, text)])).collect()[0]
    assert r["n_ip"] == 100_000
    out = redact(documents([(1, text)])).collect()[0]["text"]
    assert out == re.sub(r"10\.0\.\d+\.1", "[IP]", text)
    assert time.time() - began < 120


def test_kinds_mixed_in_one_text_take_time_in_proportion(documents):
    """Added spans (local phone numbers with their word) among base spans (e-mails): none is held against all."""
    text = " ".join(f"mail a{k}@example.com or call 030 555 {k % 9000 + 1000}" for k in range(100_000))
    began = time.time()
    r = span_digest(documents([(1, text)])).collect()[0]
    assert r["n_email"] == 100_000 and r["spans"].count(",") == 199_999
    assert time.time() - began < 60


def test_added_spans_give_way_to_base_spans_alone(documents):
    draw = random.Random(8)
    words = ["call", "030 555 1234", "+49 30 5551234", "a@b.de", "10.0.0.1", "4111 1111 1111 1111", "x", "DE89 3704 0044 0532 0130 00", "phone", "555-1234", "123-45-6789"]
    texts = [(k, " ".join(draw.choice(words) for _ in range(40))) for k in range(60)]
    for r in find_pii(documents(texts)).select("doc_id", "pii").collect():
        base = [s for s in r["pii"] if s["kind"] in BASE]
        assert all(not (b["start"] < s["stop"] and s["start"] < b["stop"]) for s in r["pii"] if s["kind"] not in BASE for b in base)
