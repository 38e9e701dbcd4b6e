import datetime as dt

import numpy as np

from shelfwise.llm import survivor

SCHEMA = "candidate_id long, item_id long, source string, confidence double, title string, abstract string, publication_year int, doi string, venue string, fetched_at timestamp, loaded_at timestamp, rank string"
DAY = dt.datetime(2020, 1, 1)


def row(candidate, source="crossref", confidence=0.5, title="T", year=2000, doi=None, venue=None, fetched=DAY, item=1):
    return (candidate, item, source, confidence, title, None, year, doi, venue, fetched, DAY, "extra")


def found(spark, rows):
    return {(r.item_id, r.field): r.candidate_id for r in survivor.surviving_fields(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_order_of_trust_confidence_time_and_id(spark):
    rows = [row(1, "llm"), row(2, " Cross Ref ".replace(" R", "r"), 80.0, title="n/a"), row(3, "CROSSREF", 0.7), row(4, "crossref", float("nan"))]
    rows += [row(5, "manual", item=2), row(6, "zotero-import", 0.6, item=2), row(7, None, 1.0, item=2), row(7, None, 1.0, item=2)]
    rows += [row(8, item=3), row(9, item=3, fetched=DAY + dt.timedelta(1)), row(10, item=3, fetched=None)]
    got = found(spark, rows)
    assert got[1, "title"] == 3 and got[1, "publication_year"] == 2
    assert got[2, "title"] == 6 and got[3, "title"] == 9


def test_values_and_single_candidates(spark):
    rows = [
        row(1, title="\xa0 ", year=2120, doi="10.99/", venue="TBA"),
        row(2, title="null", year=1499, doi="https://doi.org/", venue=None),
        row(3, "x", title="Real", year=1500, doi="see DOI 10.1234/abc", venue=" "),
        row(4, item=9),
    ]
    assert found(spark, rows) == {(1, "title"): 3, (1, "publication_year"): 3, (1, "doi"): 3}


def test_empty(spark):
    assert found(spark, []) == {}
    assert survivor.truth_model(spark.createDataFrame([], SCHEMA))[0].collect() == []


def planted(items=1500, seed=0):
    """Candidates of six sources of known quality; a third of the items have two true venues. Rows and the true (item, venue)."""
    rng = np.random.default_rng(seed)
    quality = {"crossref": (0.95, 0.97), "arxiv": (0.9, 0.95), "grobid": (0.7, 0.85), "LLM ": (0.55, 0.6), "scraper": (0.35, 0.45), "site_b": (0.85, 0.9)}
    rows, truths, number = [], set(), 0
    for i in range(items):
        true = {f"journal {i} {k}" for k in range(1 + (i % 3 == 0))}
        truths |= {(i, v) for v in true}
        for source, (hit, passed) in quality.items():
            if rng.random() < 0.2:
                continue  # a source that knows nothing of the item
            said = [v for v in sorted(true) if rng.random() < hit] + [f"error {i} {k}" for k in range(2) if rng.random() > passed]
            for v in said:
                number += 1
                rows.append(row(number, source, venue=v, item=i, title=None, year=None))
    return rows, truths


def test_em_finds_quality_and_truths(spark):
    rows, truths = planted()
    values, quality = survivor.truth_model(spark.createDataFrame(rows, SCHEMA))
    found = {r.source: (r.sensitivity, r.specificity) for r in quality.collect()}
    assert set(found) == {"crossref", "arxiv", "grobid", "llm", "scraper", "site_b"}
    assert found["crossref"] > found["grobid"] > found["scraper"] and found["crossref"][1] > found["scraper"][1] + 0.2
    got = {(r.item_id, r.value) for r in values.where("kept and field = 'venue'").collect()}
    precision, recall = len(got & truths) / len(got), len(got & truths) / len(truths)
    said = {}
    for r in rows:
        said.setdefault((r[1], r[8]), set()).add(r[2])
    sources = {}
    for (i, _), who in said.items():
        sources.setdefault(i, set()).update(who)
    majority = {k for k, who in said.items() if 2 * len(who) > len(sources[k[0]])}
    f = lambda own: 2 * len(own & truths) / (len(own) + len(truths))
    print("precision, recall, F", precision, recall, f(got), "majority F", f(majority))
    assert precision > 0.95 and recall > 0.95 and f(got) > f(majority) + 0.01


def test_truths_keep_several_values(spark):
    rows = [row(c, s, title=t, item=i) for i in range(1, 30) for c, s, t in ((10 * i, "crossref", "A good title"), (10 * i + 1, "arxiv", "a good title."), (10 * i + 2, "llm", "Wrong" + str(i)))]
    values, quality = survivor.truth_model(spark.createDataFrame(rows, SCHEMA))
    kept = {(r.item_id, r.value) for r in values.where("kept and field = 'title'").collect()}
    assert (1, "a good title") in kept and (1, "wrong1") not in kept
    assert {r.source for r in quality.collect()} == {"crossref", "arxiv", "llm"}
