import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as X


def one(spark, function, *values):
    names = [f"c{k}" for k in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
    return frame.select(function(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "value, want",
    [
        ("https://doi.org/10.1038/s41586-024-12345-6 ok", ["10.1038/s41586-024-12345-6"]),
        ("See 10.1234/foo.bar.", ["10.1234/foo.bar"]),
        ("10.1234/x and again 10.1234/x", ["10.1234/x"]),
        ("", []),
        ("10.12/x 10.1234567890/x", []),
    ],
)
def test_dois(spark, value, want):
    assert one(spark, X.dois, value) == want


@pytest.mark.parametrize(
    "value, want",
    [("arXiv:2401.01234v2", ["2401.01234"]), ("arXiv:hep-th/9901001", ["hep-th/9901001"]), ("arxiv.org/abs/2401.01234", ["2401.01234"]), ("none", []), ("arXiv:2401.00001 arxiv.org/abs/2402.00002", ["2402.00002", "2401.00001"])],
)
def test_arxiv(spark, value, want):
    assert one(spark, X.arxiv_ids, value) == want


def test_isbn(spark):
    assert one(spark, X.isbns, "ISBN: 978-0-13-110163-0") == ["9780131101630"]
    assert one(spark, X.isbns, "phone 415-555-1234") == []
    assert one(spark, X.isbn13, "0131101633") == "9780131101630"
    assert one(spark, X.isbn13, "080442957X") == "9780804429573"
    assert one(spark, X.isbn13, "9780131101631") is None
    assert one(spark, X.isbn13, None) is None


@pytest.mark.parametrize(
    "heading, want",
    [
        ("1. Introduction", "introduction"), ("Background and Motivation", "introduction"), ("Materials and Methods", "methods"), ("2.1. Methodology", "methods"), ("III. Results", "results"),
        ("Results and Discussion", "results"), ("4 Discussion", "discussion"), ("Summary", "conclusion"), ("Acknowledgements", "other"), ("", "other"), (None, "other"),
    ],
)
def test_section(spark, heading, want):
    assert one(spark, X.section, heading) == want


def test_names(spark):
    assert one(spark, X.author_key, "Müller-Lüdenscheidt", "Ägidius") == "muller-ludenscheidt,a"
    assert one(spark, X.author_key, None, None) == ","
    assert tuple(one(spark, X.split_name, "Ada B. Lovelace")) == ("Lovelace", "Ada B.")
    assert tuple(one(spark, X.split_name, "Plato")) == ("Plato", None)
    assert one(spark, X.display_name, "Doe", " ") == "Doe"


def test_small_functions(spark):
    assert [one(spark, X.lenient_int, v) for v in ("12a", "abc", "", " -7", None)] == [12, 0, 0, -7, None]
    assert one(spark, X.erratum_target, "Corrigendum to: “A title of some length.”") == "A title of some length"
    assert one(spark, X.erratum_target, "Erratum: foo") is None and one(spark, X.erratum_target, "A title") is None
    assert one(spark, X.edition_number, "3rd ed.") == 3 and one(spark, X.edition_number, "first") is None
    assert one(spark, X.strip_tags, "<jats:title>Abstract</jats:title><jats:p>Text <b>here</b></jats:p>") == "Text here"
    assert one(spark, lambda c: X.highlight(c, "or gate"), "<OR> & gate") == "&lt;<mark>OR</mark>&gt; &amp; <mark>gate</mark>"
    assert one(spark, X.strip_accents, "Ångström façade ﬁ") == "Angstrom facade ﬁ"
    assert X.query_phrases("OR-gate Müller") == [["or", "gate"], ["m"], ["ller"]] and X.query_phrases("Müller", unicode=True) == [["muller"]]
    assert one(spark, X.mime, "a/B.PDF") == "application/pdf" and one(spark, X.mime, "a/b") == "application/octet-stream"


def test_bibtex(spark):
    columns = "item_type string, title string, year int, venue string, volume string, issue string, pages string, doi string, isbn string, arxiv_id string, edition string, series string, language string, authors array<string>"
    rows = [
        ("paper", "Heat & flow in the core", 2024, "J. Test", "12", "3", "1-9", "10.1/x_y", None, "2101.00001", None, None, "en", ["Smith", "Doe"]),
        ("thesis", "Über alles", None, None, None, None, None, None, None, None, "2", "Notes", "de", []),
        ("chapter", "On it", 1999, "A Book", "", None, None, None, "978", None, None, None, None, ["Müller"]),
        ("map", None, None, None, None, None, None, None, None, None, None, None, None, []),
    ]
    frame = spark.createDataFrame(rows, columns)
    a, b, c, d = (r.x for r in frame.select(X.bibtex({c: F.col(c) for c in frame.columns}).alias("x")).collect())
    assert a == (
        "@article{smith_2024_heat,\n  title = {Heat \\& flow in the core},\n  author = {Smith and Doe},\n  year = {2024},\n  journal = {J. Test},\n  volume = {12},\n  number = {3},\n"
        "  pages = {1-9},\n  doi = {10.1/x\\_y},\n  eprint = {2101.00001},\n  archivePrefix = {arXiv}\n}"
    )
    assert b == "@phdthesis{uber,\n  title = {Über alles},\n  edition = {2},\n  series = {Notes},\n  language = {de}\n}"
    assert c == "@incollection{muller_1999,\n  title = {On it},\n  author = {Müller},\n  year = {1999},\n  booktitle = {A Book},\n  isbn = {978}\n}"
    assert d == "@misc{ref,\n\n}"


def test_compatibility_characters(spark):
    assert one(spark, X.asciify, "Ångström ﬁeld ² ﬃx Ⅳ") == "Angstrom field 2 ffix IV" and one(spark, X.asciify, "plain") == "plain"
    key = lambda f, g: spark.createDataFrame([(f, g)], "f string, g string").select(X.author_key(F.col("f"), F.col("g")).alias("k")).first().k
    assert [key(*x) for x in (("Martinez-García", "Luis"), ("", "A"), (None, "A"), ("ﬁsher", None), ("van der  Berg", " Éva"))] == ["martinez-garcia,l", ",", ",", "fisher,", "van-der-berg,e"]


def test_identifier_forms_and_sections(spark):
    ids = lambda t: list(one(spark, X.arxiv_ids, t))
    assert ids("arXiv 2101.00001 and arxiv:2101.00002v3, arXiv:hep-th/9901001") == ["2101.00001", "2101.00002", "hep-th/9901001"]
    assert ids("https://arxiv.org/abs/2101.00003v2") == ["2101.00003"]
    assert list(one(spark, X.isbns, "ISBN-13: 978-0-13-110163-0 isbn 0131101633")) == ["9780131101630"]
    labels = {t: one(spark, X.section, t) for t in ("2.1 Related Work", "Main Findings", "IV. Materials and Methods", "Abstract", "References", "Summary")}
    assert list(labels.values()) == ["introduction", "results", "methods", "other", "other", "conclusion"]
