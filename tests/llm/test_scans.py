import random

from shelfwise.llm import scans

SCHEMA = "chunk_id long, item_id long, chunk_index int, page int, text string, noise string"
WORDS = "the model of a modern valley shows that concentration and temperature increase during every winter campaign while boundary layers remain stable under constant load".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(14)).capitalize() + "."


def page(rng, n=5, width=9):
    words = " ".join(sentence(rng) for _ in range(n)).split()
    return [" ".join(words[k : k + width]) for k in range(0, len(words), width)]


def make():
    rng = random.Random(2)
    rows, want = [], set()
    for i in range(60):  # the corpus that gives the counts
        rows.append((1000 + i, 50 + i, 0, None, " ".join(page(rng, 12)), "x"))
    for p in range(1, 9):
        lines, n = page(rng), 100 + p
        if p != 4:
            lines.insert(0, ["Annals of Modern Valleys", "Anna1s of Modern Valleys", "A N N A L S   O F   M O D E R N   V A L L E Y S"][p % 3] + (f"  {p + 10}" if p % 2 else ""))
            want.add((n, "running_header"))
            if p % 3 == 1:
                want.add((n, "misread"))
            if p % 2:
                want.add((n, "page_number"))
        if p == 4:
            lines.append("- 14 -")
            want.add((n, "page_number"))
        if p in (2, 6):
            k = next(k for k, x in enumerate(lines) if "temperature" in x or "concentration" in x)
            word = "temperature" if "temperature" in lines[k] else "concentration"
            a, b = lines[k].split(word, 1)
            lines[k] = a + word[:5] + ("-" if p == 2 else "¬ ") + "\n" + word[5:] + b
            want.add((n, "hyphenation"))
        if p in (5, 8):
            k = next(k for k, x in enumerate(lines) if k and " campaign" in x)
            lines[k] = lines[k].replace(" campaign", " carnpaiqn" if p == 5 else " c@mpaign")
            want.add((n, "misread"))
        rows.append((n, 1, p, p, ("\r\n" if p == 3 else "\n").join(lines), "x"))
    rows += [(200, 2, 0, 1, "A title once\n" + "\n".join(page(rng)), "x"), (201, 2, 1, 1, "", "x"), (202, 2, 2, 2, None, "x"), (203, None, None, 3, "Half-finished.\n7", "x")]
    want.add((203, "page_number"))
    return rows, want


def test_kinds_of_noise(spark):
    rows, want = make()
    frame = spark.createDataFrame(rows + rows[-6:], SCHEMA)
    assert {tuple(r) for r in scans.noise(frame).collect()} == want
    assert scans.noise(frame.limit(0)).collect() == []


def test_repair(spark):
    rows, _ = make()
    clean = {r.chunk_id: r.text for r in scans.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    for n in range(101, 109):
        words = clean[n].lower().replace(".", "").split()
        assert set(words) <= set(WORDS), n
    assert "\n" not in clean[102] and clean[201] == ""


def test_compounds_keep_their_hyphen(spark):
    rows = [(1, 1, 0, 1, "A start-\nup and a tempera-\nture.", "x"), (2, 2, 0, None, "start-up start-up temperature", "x")]
    out = {r.chunk_id: r.text for r in scans.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1] == "A start-up and a temperature."


def test_confusions_and_strokes(spark):
    for true, seen in (("thesis", "tbesis"), ("prompt", "pr0rnpt"), ("defect", "defe(t"), ("increase", "iricreasc"), ("within", "vvitbin"), ("using", "usmg")):
        assert scans.confused(true, seen)
        rows = spark.createDataFrame([(true, seen)], "a string, b string").select(scans.strokes("a").alias("a"), scans.strokes("b").alias("b"))
        assert rows.first().a == rows.first().b
    assert scans.confused("valley", "volley") is None


def test_viterbi_takes_the_neighbours_into_account():
    line = [("", [("a", 0.0)]), ("tne", [("tne", -9.0), ("the", -3.0), ("tie", -2.5)]), ("", [("end", 0.0)])]
    assert scans.decode(line, {})[1] == "tie"
    assert scans.decode(line, {("a", "the"): 1.0})[1] == "the"


def test_lines_that_only_begin_alike_are_no_heads(spark):
    """Sentences with a common beginning stay; a head set with and without a ligature is one head."""
    ends = ["growth in cold water", "decay under constant load", "drift of the mean flow", "loss at every boundary"]
    rows = [(p, 1, p, p, f"Results from perturbation theory show {end}.\nAfter {end} it remains stable.", "x") for p, end in enumerate(ends, 1)]
    rows += [(10 + p, 2, p, p, f"Scienti{'fi' if p % 2 else chr(0xFB01)}c Annals\nAfter {ends[p]} it remains stable.", "x") for p in range(1, 4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in scans.heads_and_numbers(frame).collect()} == {(10 + p, "first", "running_header") for p in range(1, 4)}
    kept = {r.chunk_id: r.text for r in scans.repaired(frame).collect()}
    assert all(kept[p].startswith("Results from perturbation theory show") for p in range(1, 5))


def test_heads_and_numbers_on_any_chunk_of_a_page(spark):
    """A page cut into chunks may show its foot on a chunk that is not its last one."""
    rng, rows = random.Random(5), []
    for p in range(1, 5):
        rows.append((p, 1, 2 * p, p, "\n".join([*page(rng), "Annals of Modern Valleys", str(p)][: None if p > 1 else -2]), "x"))
        rows.append((10 + p, 1, 2 * p + 1, p, "\n".join(page(rng)), "x"))
    found = {tuple(r) for r in scans.noise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(p, "page_number") for p in range(2, 5)}


def test_marks_in_unknown_words_never_become_null(spark):
    """A word with digits that no letters can replace is left as it is."""
    rows = [(1, 1, 0, 1, "Sample b52a and w1nter and b0x.", "x"), (2, 2, 0, None, "a winter in winter and winter", "x"), (3, 3, 0, 1, "b52a", "x")]
    out = {r.chunk_id: r.text for r in scans.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1] == "Sample b52a and winter and box." and out[3] == "b52a"


def test_ten_copies_of_a_corpus_are_read_alike(spark):
    """Decisions rest on shares, so that copies under new ids give as many rows each."""
    rows, _ = make()
    rows = [r for r in rows if r[1] is not None]
    once = {tuple(r) for r in scans.noise(spark.createDataFrame(rows, SCHEMA)).collect()}
    many = [(r[0] + 10_000 * k, r[1] + 1000 * k, *r[2:]) for k in range(10) for r in rows]
    tenfold = {tuple(r) for r in scans.noise(spark.createDataFrame(many, SCHEMA)).collect()}
    assert tenfold == {(c + 10_000 * k, x) for k in range(10) for c, x in once}
