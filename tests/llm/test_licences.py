import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SF, awkward, documents, no_documents
from pyspark.sql import functions as F

from regionlens.llm import licences as x
from regionlens.llm.decontaminate import words_of


def brute(text, templates, threshold):
    """The best run of words from every word against every template, without any bound; the best ones that do not overlap."""
    text = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    words, found = words_of(text), []
    for name, t in templates:
        grams = x.bigrams(words_of(t.encode()))
        for a in range(len(words)):
            runs = [(-x.dice(x.bigrams(words[a:b]), grams), b) for b in range(a + 2, len(words) + 1)]
            if runs and -min(runs)[0] >= threshold:
                found.append((min(runs)[0], -sum(grams.values()), a, min(runs)[1], name))
    out = []
    for d, _, a, b, name in sorted(found):
        if all(b <= o[2] or a >= o[3] for o in out):
            out.append((name, -d, a, b))
    return [(n, d, spans[a][0], spans[b - 1][1]) for n, d, a, b in sorted(out, key=lambda r: r[2])]


TEMPLATES = [("A", "a b c a b"), ("B", "c c b a"), ("C", "a b c d a b c d a"), ("D", "b d")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "a.", "b\n", "c;"]), max_size=40), st.sampled_from([0.5, 0.8, 1.0]))
def test_bounds_lose_nothing(words, threshold):
    text = " ".join(words)
    found = x.Templates(TEMPLATES, threshold).find(text.encode())
    assert found == brute(text, TEMPLATES, threshold)


def test_notices_inside_a_sentence():
    own, body = x.Templates(), " ".join(x.TEMPLATES[0][1].split())
    for text, name in [
        ("All content here is licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("All code is released under the MIT License and may be reused freely.", "MIT"),
        ("(c) 2024 X | Licensed under CC BY 4.0 | Privacy", "CC-BY-4.0"),
        ("word " * 500 + re.sub(r"[.;:]", ",", body) + " word" * 500, "MIT"),
    ]:
        ((found, score, _, _),) = own.find(text.encode())
        assert (found, score) == (name, 1.0)


def test_many_copies_in_one_text():
    mit = " ".join(x.TEMPLATES[0][1].split())
    found = x.Templates().find(" and ".join([mit] * 200).encode())
    assert [(n, d) for n, d, _, _ in found] == [("MIT", 1.0)] * 200


def test_whole_licence_in_a_long_text():
    mit = x.TEMPLATES[0][1]
    changed = mit.replace("free of charge", "at no cost").replace("\n", "\n * ")
    text = "Some header here.\n\n" + changed + "\n\nint main() { return 0; }"
    (found,) = x.Templates().find(text.encode())
    # the changed words stand near the edge: Dice is highest for the passage that begins after them
    assert found[0] == "MIT" and 0.9 < found[1] < 1 and text.encode()[found[2] :].startswith(b"to any person")
    assert text.encode()[: found[3]].endswith(b"DEALINGS IN THE SOFTWARE")


def test_query(spark):
    got = {r["doc_id"]: r for r in x.op2_licences(spark, SF).collect()}
    docs = documents(spark).collect()
    assert len(got) == len(docs)
    for r in docs:
        line = next((t for t in x.TEMPLATES if len(t[1]) < 100 and t[1] in r["text"]), None)
        assert (got[r["doc_id"]]["licence"], got[r["doc_id"]]["n_found"]) == ((line[0], 1) if line else (None, 0))
    assert any(r["licence"] for r in got.values())


def test_awkward_rows(spark):
    docs = awkward(spark, ["Released under the MIT license", "RELEASED UNDER THE MIT LICENSE. Released under the MIT License!"]).withColumn("dice", F.lit(1))
    got = x.scan(docs, "found")
    assert got.columns == [*docs.columns, "found"] and got.count() == docs.count()
    n = {r["doc_id"]: len(r["found"]) for r in got.collect()}
    assert n[100] == 1 and n[101] == 2 and sum(n.values()) == 3
    assert x.scan(no_documents(spark), "found").count() == 0
