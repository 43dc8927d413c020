import hashlib
import random
import re

from tracelith.llm.pii import find

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_brute_force(spark):
    r = random.Random(1)
    parts = ["a.b@c.de", "x@y", "@", "..", "a-_b@q-w.e.r-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "12 34 56", "+1 (234) 555-6789", "+12", "+1234567890123456", "é", " ", "\n", "日本", "7", "5-5 5", "++1 2 3 4 5 6 7 8."]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", "", " ", "\n"]) for _ in range(r.choice([0, 1, 3, 12])))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, "1 " * 30000), (703, "a" * 60000 + "." * 50), (704, "9" * 50000), (705, "a@b" + ".c" * 20000), (706, "a.b@c.d " * 300), (0, rows[0][1])]
    got = sorted(find(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, spans int")).collect(), key=lambda x: x.doc_id)
    assert len(got) == len(rows)
    for x, (d, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        want = brute(t or "")
        assert x.doc_id == d and x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (d, t and t[:200], want[:5], x.spans[:200])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert [s for s in x.spans.split(",") if s and not s.startswith("term")] == want


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"report {i} of Zorblatt sent to ann@x.org today v{i}") for i in range(5)]
    rows += [(10 + i, f"report {i} of others sent today to nobody v{i}") for i in range(200)]
    got = {x.doc_id: x for x in find(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got[3].text == "report 3 of [TERM] sent to [EMAIL] today v3"
    assert got[3].n_term == 1 and got[3].spans.endswith("term:12:20")
    assert got[15].text == rows[10][1] and got[15].spans == ""


def test_empty(spark):
    assert find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_on_other_lines_and_in_other_documents(spark):
    rows = [(i, f"Name: Zorblatt\nnote {i}\nEmail: ann@x.org\n" + "far away " * 30 + "zorblatt again") for i in range(8)]
    rows += [(8, "Zorblatt called")]
    rows += [(10 + i, f"Name: others\nEmail: nobody, far away again, called note {i}") for i in range(300)]
    got = {x.doc_id: x for x in find(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Name: [TERM]\nnote 3\nEmail: [EMAIL]\n" + "far away " * 30 + "[TERM] again" and got[3].n_term == 2
    assert got[8].text == "[TERM] called" and got[8].spans == "term:0:8" and got[8].n_email == 0
    assert got[15].text == dict(rows)[15] and got[15].spans == ""


def test_time_grows_with_the_spans(spark):
    """20,000 addresses in one text, all of them where plain Python finds them."""
    text = " ".join(f"u{i}@mail{i % 7}.org" for i in range(20_000))
    got = find(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    one = next(x for x in got if x.doc_id == 1)
    assert one.n_email == 20_000 and one.base_sha256 == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()


def disclosed(rows, support=3, share=0.8, bits=4.0):
    """Terms by plain Python: words outside base spans, judged by the documents that hold them."""
    import math

    docs = []
    for _, t in rows:
        t = t or ""
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute(t)]
        entities = {t[a:b].lower() for a, b in spans}
        plain = "".join("\x01" if any(a <= i < b for a, b in spans) else c for i, c in enumerate(t))
        docs.append((t, entities, {m[0].lower() for m in re.finditer(r"(?<![^\W_]|\x01)[^\W_]{3,}+(?!\x01)", plain) if not (m.start() and plain[m.start() - 1] == "\x01")}))
    out = set()
    for e in {e for _, es, _ in docs for e in es}:
        having = sum(e in es for _, es, _ in docs)
        for w in {w for _, es, ws in docs if e in es for w in ws}:
            both, holding = [t for t, es, ws in docs if e in es and w in ws], sum(w in ws for _, _, ws in docs)
            if len(set(both)) >= support and len(both) / holding >= share and math.log2(len(both) / holding * len(docs) / having) >= bits:
                out.add(w)
    return out


def test_terms_against_plain_python(spark):
    r = random.Random(9)
    people = [(f"name{i}", f"n{i}@mail.org") for i in range(12)]
    rows = []
    for i in range(400):
        words = [f"w{r.randrange(150):03d}" for _ in range(r.randrange(3, 25))]
        if r.random() < 0.35:
            name, mail = r.choice(people)
            words += [mail] + [name.title()] * (r.random() < 0.9) + [people[0][0]] * (r.random() < 0.05)
        elif r.random() < 0.06:
            words.append(r.choice(people)[0])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(i, rows[7][1]) for i in range(500, 520)] + [(900, None)]
    want = disclosed(rows)
    assert 3 < len(want) < 30
    for x in find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = dict(rows)[x.doc_id] or ""
        terms = [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("term")]
        assert terms == [m.span() for m in re.finditer(r"\w+", t) if m[0].lower() in want and not any(a <= m.start() < b for a, b in (tuple(map(int, s.split(":")[1:])) for s in brute(t)))]
