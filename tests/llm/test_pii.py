import hashlib
import re

import pytest

from tidewatch.llm.pii import KINDS, find_entities, find_spans, pii_digest, revealing_terms, sanitise

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_force(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if passes(k, m[0])]


TEXTS = [
    "a@b.co, x.y+z@q-r.example.com! é a@b.c_d@e.f é@x.de @@a@b.c..d a@b a@.b 😀 me@mail.example", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1..2.3.4 99999999999999999999999.1.1.1 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559 1234567890123 0000000000000", "+1 (555) 123-4567, +49 30 1234567890 ++1-2, +12345678, +1234567890123456 + 1 +1..2 +1 (5)", "4111 1111 1111 1111 4111 1111 1111 1111 1", "1" * 30_000, "a" * 30_000, "a." * 10_000 + "@b" + ".c" * 10_000, "1-" * 20_000, "+1" + "(" * 20_000, "", None, "1." * 9_999 + "1",
]


def test_base_spans(spark, edge_docs, docs):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, email int")
    for frame in (df, edge_docs, docs):
        text = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
        rows = pii_digest(frame).collect()
        assert len(rows) == len(text)
        for r in rows:
            want = brute_force(text[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[r.doc_id][:80]
            assert [r[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k + ":") for w in want) for k in KINDS]
            assert [s for s in r.spans.split(",") if s][: len(want)] == want


@pytest.fixture
def corpus(spark):
    filler = [f"w{i % 97}x w{i % 89}y w{i % 83}z w{i % 79}q w{i % 73}r w{i % 71}s" for i in range(400)]
    rows = [(i, f"{filler[i]} nickname Zorro writes from jane@doe.org about {filler[399 - i]}") for i in range(8)]
    rows += [(10 + i, f"{filler[i + 20]} the usual about {filler[i + 50]}") for i in range(300)]
    rows += [(400 + i, f"the same copied words here come with copy@cat.org and more of the copied text number {i}") for i in range(20)]
    rows += [(500, "Zorro! alone."), (501, None)]
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, term string").repartition(3)


def test_revealing_terms(corpus):
    got = {r.doc_id: r for r in find_spans(corpus.select("doc_id", "text")).collect()}
    text = {r.doc_id: r.text for r in corpus.collect()}
    for i in range(8):
        own = {text[i][s.start : s.end] for k in ("term", "general") for s in got[i][k]}
        assert "Zorro" in own and "nickname" in own and "about" not in own
    assert [s.value for s in got[500].term] == ["Zorro!"]
    assert all(not got[k].term and not got[k].general for k in got if k >= 400 and k != 500)


def test_sanitise(spark, corpus):
    rows = {r.doc_id: r for r in sanitise(corpus).collect()}
    assert "jane" not in rows[0].text and "Zorro" not in rows[0].text and "[EMAIL]" in rows[0].text
    assert rows[501].text is None and rows[0].term == "k"
    assert sanitise(corpus).columns == corpus.columns
    df = spark.createDataFrame([(1, "x 1.2.3.4 y +1.2.3.4567890 z 4111 1111 1111 1111")], "doc_id long, text string")
    assert sanitise(df).first().text == "x [IP] y [PHONE] z [CARD]"


def test_empty(no_docs):
    assert pii_digest(no_docs).count() == 0 and sanitise(no_docs).count() == 0


def test_no_entity_is_left_out(spark):
    """Copies of a passage, a fixed side and values that occur once leave an entity's terms revealing."""
    rows = [f"w{i % 97}x w{i % 89}y w{i % 83}z w{i % 79}q about w{i % 73}r w{i % 71}s" for i in range(600)]
    rows += [f"a{i} b{i} Zorro c{i} x@one.org d{i} e{i} about f{i}" for i in range(40)]
    rows += ["a quite fixed text here from x@one.org with fixed words following"] * 41
    rows += [f"g{i} h{i} about i{i} Batman j{i} y@two.org" for i in range(10)]  # ends its text
    rows += [f"k{i} l{i} m{i} reach Robin z@three.org n{i} o{i} about p{i}" for i in range(10)]  # follows the same label
    rows += [f"q{i} r{i} s{i} fon +1 555 {1000000 + i} t{i} u{i} about v{i}" for i in range(10)]  # each number once
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.term: r.share for r in revealing_terms(find_entities(df)).collect()}
    assert {"zorro", "batman", "reach", "robin", "fon"} <= got.keys() and "about" not in got
    assert not {"fixed", "quite", "following"} & got.keys()  # one observation, whatever its copies
    assert max(got.values()) <= 1
