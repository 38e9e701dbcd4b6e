import random

from shelfwise.llm import leakage


def passage(rng, vocabulary, n=60):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def make():
    rng = random.Random(4)
    vocabulary = [a + b for a in "ka te li mo su ra ne po".split() for b in "ban dor fil gun mas ret sol vik".split()]
    passages = [(i, passage(rng, vocabulary)) for i in range(20)]
    filler = lambda n: passage(rng, vocabulary, n)
    docs, want, number = [], set(), 100

    def put(text, found):
        nonlocal number
        docs.append((number, text))
        want.update((number, p) for p in found)
        number += 1

    for i, text in passages[:12]:
        w = text.split()
        at = rng.randrange(0, 30)
        part = w[at : at + 27]
        put(f"{filler(80)}. {' '.join(part).upper().replace(' ', ',  ')}\n{filler(40)}", {i})  # 45 %, other dress
        edited = [rng.choice(vocabulary) if k % 10 == 5 else x for k, x in enumerate(w)]
        put(filler(30) + " " + " ".join(edited), {i})
        put(" ".join(w[:15]) + " " + filler(25) + " " + " ".join(w[15:35]), {i})  # a foreign sentence inside
        put(filler(50) + " " + " ".join(w[:18]) + " " + filler(60), set())  # 30 %
        put(" ".join(w[40:60]) + " " + filler(300) + " " + " ".join(w[:20]), set())  # no one stretch
    put(None, set())
    put("", set())
    put("­".join(passages[15][1]), {15})
    put(filler(60_000) + " " + passages[16][1] + " " + filler(100), {16})
    return docs, passages, want


def test_planted_passages(spark):
    docs, passages, want = make()
    frame = spark.createDataFrame(docs + docs[:3], "doc_id long, text string")
    held = spark.createDataFrame([(*p, "x") for p in passages + [(77, "too short"), (78, None)]], "passage_id long, text string, doc_id string")
    got = leakage.leaks(frame, held).collect()
    assert {(r.doc_id, r.passage_id) for r in got} == want and len(got) == len(want)
    texts = dict(docs)
    for r in got:
        assert 0.36 * 60 <= r.matched_words <= len(leakage.words(texts[r.doc_id][r.start : r.end])[0])


def test_slices_give_the_same(spark, monkeypatch):
    docs, passages, want = make()
    monkeypatch.setattr(leakage, "SLICE_BYTES", 1500)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    held = spark.createDataFrame(passages, "passage_id long, text string")
    assert {(r.doc_id, r.passage_id) for r in leakage.leaks(frame, held).collect()} == want


def test_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "passage_id long, text string")
    assert leakage.leaks(frame, none).collect() == []
    assert leakage.leaks(frame.limit(0), none).collect() == []


def test_long_foreign_sentence_and_answers(spark):
    """One foreign sentence may have any length, two long ones part the stretch; answers are told where they follow."""
    rng = random.Random(9)
    vocabulary = [a + b for a in "ka te li mo su ra ne po".split() for b in "ban dor fil gun mas ret sol vik".split()]
    w = passage(rng, vocabulary).split()
    long = lambda: passage(rng, vocabulary, 200)
    halves = " ".join(w[:14]), " ".join(w[14:28])
    docs = [
        (1, f"{halves[0]}. {long()}. {halves[1]}"),
        (2, f"{halves[0]}. {long()}. {long()}. {long()}. {halves[1]}"),
        (3, f"{' '.join(w)} Blue Whale"),
        (4, f"{' '.join(w)} {long()} blue whale"),
    ]
    held = spark.createDataFrame([(7, " ".join(w), "Blue whale.")], "passage_id long, text string, answer string")
    got = {r.doc_id: r.answer for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), held).collect()}
    assert got == {1: False, 3: True, 4: False}
