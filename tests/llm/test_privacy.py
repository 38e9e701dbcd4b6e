from itertools import combinations
from math import exp, log

import pytest

from shelfwise.llm import privacy
from shelfwise.llm.privacy_examples import sentences

GIVEN = "quentin davor magdalena felicitas bruno adrian flora katharina zoltan xenia ottilie nora ludmila theodor".split()


@pytest.fixture(scope="module")
def field():
    return privacy.fitted(GIVEN)


def test_held_out_accuracy(field):
    proposer, hit, wrong, missed = privacy.Proposer(frozenset(GIVEN)), 0, 0, 0
    for text, gold in sentences(GIVEN, 500, seed=1234):
        got = set(field.decode(proposer.candidates(text)))
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_decoding_is_the_best_of_all_sets():
    cands = [(0, 4, "phone", []), (2, 6, "id_number", []), (0, 6, "email", []), (6, 9, "phone", []), (5, 9, "person_name", [])]
    cands.sort(key=lambda c: (c[1], c[0]))
    field = privacy.Field({"phone": 1.0, "id_number": 1.5, "email": 2.2, "person_name": 2.6})
    free = lambda s: all(a[1] <= b[0] or b[1] <= a[0] for a, b in combinations(s, 2))
    sets = [s for n in range(6) for s in combinations(cands, n) if free(s)]
    best = max(sets, key=lambda s: sum(field.score(c[2], []) for c in s))
    assert set(field.decode(cands)) == {c[:3] for c in best}


def test_fitting_follows_the_likelihood():
    cands = [(0, 4, "phone", []), (0, 4, "id_number", []), (5, 9, "phone", [])]
    field = privacy.Field()
    field.fit([(cands, {(0, 4, "id_number")})], rounds=50)
    assert field.decode(cands) == [(0, 4, "id_number")]
    weight = field.weights
    total = sum(exp(x) for x in (0, weight["phone"], weight["id_number"])) * (1 + exp(weight["phone"]))
    assert weight["id_number"] - log(total) > log(0.8)


TEXT = (
    "We thank Quentin Pemilizuki, 25 Ferry Crescent, Tudirwick (q.pemilizuki [at] hydro [dot] example), tel. +61 2 5550 2549. "
    "The reader's card lists Mivafekoski, Katharina, SSN 000 99 0315.\n\nFollowing Gosupayak and Stabrumexon (1963), two copies of the Flora of "
    "Grepondera stand in bay 12. Item 183-77-7309 was reshelved in bay 64."
)


def test_mentions_and_placeholders(spark):
    authors = spark.createDataFrame([(i, None, g.capitalize()) for i, g in enumerate(GIVEN * 4)], "author_id long, family_name string, given_name string")
    rows = [(1, TEXT, "x"), (1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "Nothing to see.", "x"), (5, "word " * 50_000 + "Davor Getebrezuki.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entities string")
    got = {tuple(r) for r in privacy.mentions(docs, authors).collect()}
    assert got == {
        (1, "person_name", "Quentin Pemilizuki"),
        (1, "street_address", "25 Ferry Crescent"),
        (1, "email", "q.pemilizuki [at] hydro [dot] example"),
        (1, "phone", "+61 2 5550 2549"),
        (1, "person_name", "Mivafekoski, Katharina"),
        (1, "id_number", "000 99 0315"),
        (5, "person_name", "Davor Getebrezuki"),
    }
    out = {r.doc_id: r.text for r in privacy.redact(docs, authors).collect()}
    assert out[1].startswith("We thank [PERSON_NAME], [STREET_ADDRESS], Tudirwick ([EMAIL]), tel. [PHONE].") and "SSN [ID_NUMBER]." in out[1]
    assert out[2] is None and out[3] == "" and out[4] == "Nothing to see."
    assert privacy.mentions(docs.limit(0), authors).collect() == []
    assert privacy.mentions(docs.where("doc_id = 3"), authors.limit(0)).collect() == []


def test_case_is_judged_around_the_candidate(field):
    """A capital somewhere in a text does not hide names and addresses of a sentence without any."""
    proposer = privacy.Proposer(frozenset(GIVEN))
    text = "The Annual Report was late. we thank davor pemilizuki for the loan of the notes.\n\nparcel label: flora mivafekoski / 25 ferry crescent / tudirwick."
    found = {text[c[0] : c[1]] for c in proposer.candidates(text)}
    assert {"davor pemilizuki", "flora mivafekoski", "25 ferry crescent"} <= found
    assert "25 ferry crescent" not in {"Bay 12 HOLDS 25 ferry crescent X"[c[0] : c[1]] for c in proposer.candidates("Bay 12 HOLDS 25 ferry crescent X")}


def test_lexicon_holds_every_given_name(spark):
    """Rare names count as frequent ones do; words that are family names as a rule do not."""
    rows = [("Miller", "Xaverine")] + [("Miller", "Bruno")] * 40 + [("Bruno", "Miller"), (None, None), ("", "  ")] + [(f"f{k}x", f"g{k}y") for k in range(500)]
    names = privacy.given_names(spark.createDataFrame(rows, "family_name string, given_name string"))
    assert {"xaverine", "bruno"} | {f"g{k}y" for k in range(500)} == {r.name for r in names.collect()}
    lexicon = privacy.Lexicon(privacy.lexicon(names))
    assert all(f"g{k}y" in lexicon for k in range(500)) and "xaverine" in lexicon
    assert sum(f"other{k}" in lexicon for k in range(2000)) < 5
