import hashlib
import re

from evenkeel.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    """The row that the contract asks for, by strings and lists."""
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t ", "word", " word", "word ", "two words", "  a b  c d ", "\x85x\x1cy z", "é ü 你好 世界 🙂 ok",
    "marks <P> here", "half <P and S> <M", "<S>", "< P> <", "a\x00b c", "one  two\r\nthree\x0bfour\x0cfive", "x" * 50, "<", "P> x <S", "tail<P",
]


def test_equals_strings(spark, frame):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40 * len(TEXTS))] + [(None, "no id at all"), (7, "same id"), (7, "same id")]
    docs = frame("doc_id long, text string", rows).selectExpr("text AS output", "doc_id AS id", "text AS t", "1 AS n", "doc_id AS form")
    out = fim.fill_in_middle(docs.repartition(5), "id", "t")
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == sorted((by_hand(*r) for r in rows), key=repr)
    back = fim.restored(out).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_long_texts_and_many_to_a_stretch(spark, frame):
    long = [" ".join(f"wört{i % 977}" for i in range(400_000)), " " * 2_000_000, "a" * 2_000_000, "世" * 700_000 + " end"]
    rows = [(i, t) for i in range(8) for t in long[i % 4 : i % 4 + 1]]
    out = fim.fill_in_middle(frame("doc_id long, text string", rows))
    assert sorted(tuple(r) for r in out.collect()) == sorted(by_hand(*r) for r in rows)
    assert [r.text for r in fim.restored(out).orderBy("doc_id").collect()] == [t for _, t in rows]


def test_other_marks_and_shares(frame):
    docs = frame("doc_id long, text string", [(i, f"a b <P> c {i}") for i in range(60)])
    out = fim.fill_in_middle(docs, rate=100, spm=0, marks=("[pre]", "[suf]", "[mid]"))
    assert {r.form for r in out.collect()} == {"psm"}
    assert all(r.output.startswith("[pre]") for r in out.collect())
    again = fim.restored(out, ("[pre]", "[suf]", "[mid]"))
    assert {(r.doc_id, r.text) for r in again.collect()} == {(i, f"a b <P> c {i}") for i in range(60)}
    assert {r.form for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_empty_table(frame):
    out = fim.restored(fim.fill_in_middle(frame("doc_id string, text string", [])))
    assert out.collect() == []
    assert out.schema["doc_id"].dataType.simpleString() == "string"
