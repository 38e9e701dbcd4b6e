"""Noise in the text of scanned pages: found, and repaired into continuous paragraphs.

Misread words are found by a noisy channel. The corpus gives counts of words and of pairs of words; a word that can
have come from a far more frequent one by confusions of characters has that one as a candidate; confusion
probabilities are fitted to the candidate pairs; and for each line Viterbi decodes the most likely words from the
channel, the counts and the pairs around them. Words with digits or marks between letters may also be read as the
letters these stand for, when no known word fits.

Words that can be confused have one key (a spelling in strokes: m as iii, d as ci, ...), so that candidates come from
an equi-join of distinct words, never from all pairs; corrections reach the texts by a join as well, which Spark
makes a broadcast only while they are small.

Running heads are first or last lines of pages that recur, the whole line alike in strokes, on at least three pages of an item and
mostly do not run on into the next line; page numbers are numbers alone on such a line, or beside a head.

Defined results: chunks without a page or text have no noise; null items form no recurring heads; repeats count once
in results; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import byte_size, cut

#: Characters of the true word and what a scanner makes of them (fixed values).
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("c", "("), ("t", "f"), ("f", "t"), ("t", "l"), ("l", "t"), ("i", "1"), ("i", "!"), ("i", "l"), ("i", "|"),
    ("l", "1"), ("l", "|"), ("l", "i"), ("l", "!"), ("t", "1"), ("a", "@"), ("o", "0"), ("s", "5"), ("b", "6"), ("h", "b"), ("b", "h"),
    ("g", "q"), ("q", "g"), ("g", "9"), ("n", "ri"), ("ri", "n"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("m", "in"), ("ni", "m"), ("u", "ii"), ("ii", "u"),
    ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"), ("h", "li"), ("li", "h"), ("n", "u"), ("u", "n"), ("nn", "rm"),
)
#: Strokes of each character: confusions leave them as they are.
_SINGLE = ("rlt1!|fe(@0569q", "iiiiiiiccaosbgg")
_STROKES = (("n", "ii"), ("u", "ii"), ("h", "ii"), ("b", "ii"), ("m", "iii"), ("d", "ci"), ("w", "vv"))
#: Letters set as one character, and the letters they stand for.
_LIGATURES = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"))

#: A spelling comes into question for a misread one if another is so many times as frequent; the channel decides.
OFTENER = 20
#: Weight of the share of a word's occurrences that stand beside its neighbour.
PAIRED = 100
#: Chance of a confusion never seen beside a frequent word, and that a sound spelling comes from another one.
UNSEEN, SOUND = 1e-7, 1e-4
#: Bytes of the written table of corrections up to which it is broadcast; beyond, words are shuffled to it.
BROADCAST = 8 << 20
#: Pages of an item on which a running head recurs.
RECURS = 3

#: A word split over a line end: letters, a hyphen in one of its forms, the line end, letters.
SPLIT = r"[-\u2010\u2011\u00AC\u00AD](?<=\p{L}.)[^\S\r\n]*(?:\r\n|\n|\r)\s*(?=\p{L})"
_NUMBER = r"(?:\d{1,4}|(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
_ALONE = rf"^\s*(?:[-–—·\[(|~*]\s*)?(?:[Pp]age\s+|[Ss]eite\s+|p\.\s*)?({_NUMBER})(?:\s+(?:of|von)\s+\d+)?(?:\s*[-–—·\])|~*])?\s*$"
_BEFORE, _AFTER = rf"^\s*({_NUMBER})\s{{2,}}(\S.*)$", rf"^(.*\S)\s{{2,}}({_NUMBER})\s*$"
#: Words as a scanner may have left them; marks count inside, or before letters.
_WORD = r"[(!|@]?[\p{L}\p{N}@|]++(?:(?:[!(](?=[\p{L}\p{N}])|(?<=\p{L})\((?=\s))[\p{L}\p{N}@|]*+)*+"
#: A bracket that opens before a name is no letter.
_OPENING = r"\((?=\p{Lu})"


def strokes(text: Column) -> Column:
    """One key for all spellings that confusions of characters can make of a word."""
    out = F.translate(F.lower(text), *_SINGLE)
    for a, b in _STROKES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def confused(true: str, seen: str) -> list[tuple[str, str]] | None:
    """The fewest confusions that turn ``true`` into ``seen``; None if they cannot."""
    best: dict[tuple[int, int], list | None] = {}

    def walk(i: int, j: int) -> list | None:
        if i == len(true) and j == len(seen):
            return []
        if (i, j) in best:
            return best[i, j]
        best[i, j] = out = None
        if i < len(true) and j < len(seen) and true[i] == seen[j]:
            out = walk(i + 1, j + 1)
        if out != []:
            for a, b in CONFUSIONS:
                if true.startswith(a, i) and seen.startswith(b, j):
                    rest = walk(i + len(a), j + len(b))
                    if rest is not None and (out is None or len(rest) + 1 < len(out)):
                        out = [(a, b), *rest]
        best[i, j] = out
        return out

    return walk(0, 0)


def _letters_for(word: str) -> str | None:
    """The word with letters for the digits and marks between letters; None where there are none."""
    import re

    if not re.search(r"(?<=[^\W\d_])[0156@!|(]+(?=[^\W\d_])", word) or re.search(r"\d{2}", word):
        return None
    out = re.sub(r"(?<=[^\W\d_])[0156@!|(]", lambda m: {"0": "o", "1": "i", "5": "s", "6": "b", "@": "a", "!": "i", "|": "l", "(": "c"}[m.group()], word)
    return out if out.isalpha() else None


# --- running heads and page numbers -----------------------------------------------------------------------


def _pages(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id is not null and page is not null and text is not null").select("chunk_id", "item_id", "chunk_index", "page", "text")


#: The first two lines of a text that are not blank, from the first character that is none.
_FIRST_TWO = r"^[\s\u00a0\u2003]*+([^\r\n]++)[\r\n][\s\u00a0\u2003]*+([^\r\n]++)"


def edge_lines(chunks: DataFrame) -> DataFrame:
    """First and last lines of each chunk of a page: (chunk_id, item_id, page, at, runs_on, alone, numbered, key).

    A page cut into several chunks may show its head and foot on any of them. ``alone`` is a line that is a number and
    nothing else, ``numbered`` one with a number beside a head; ``key`` has the head's letters as strokes.
    """
    turned = F.reverse("text")
    first = [F.regexp_extract("text", _FIRST_TWO, g) for g in (1, 2)]
    last = [F.reverse(F.regexp_extract(turned, _FIRST_TWO, g)) for g in (1, 2)]
    rows = _pages(chunks).select("chunk_id", "item_id", "page", *[c.alias(n) for n, c in (("a1", first[0]), ("a2", first[1]), ("z1", last[0]), ("z2", last[1]))]).where("a1 <> ''")
    sides = F.explode(
        F.array(
            F.struct(F.lit("first").alias("at"), F.col("a1").alias("line"), F.regexp_like("a2", F.lit(r"^\s*\p{Ll}")).alias("runs_on")),
            F.struct(F.lit("last").alias("at"), F.col("z1").alias("line"), (~F.regexp_like("z2", F.lit(r"[.!?][\"'”’)\]]*\s*$"))).alias("runs_on")),
        )
    )
    lines = rows.select("chunk_id", "item_id", "page", sides.alias("x")).select("chunk_id", "item_id", "page", "x.*")
    lines = lines.select("*", F.regexp_like("line", F.lit(_ALONE)).alias("alone"), F.regexp_like("line", F.lit(_BEFORE)).alias("before"), F.regexp_like("line", F.lit(_AFTER)).alias("after"))
    head = F.when(F.col("before"), F.regexp_extract("line", _BEFORE, 2)).when(F.col("after"), F.regexp_extract("line", _AFTER, 1)).otherwise(F.col("line"))
    for a, b in _LIGATURES:
        head = F.replace(head, F.lit(a), F.lit(b))
    key = F.when(~F.col("alone"), strokes(F.regexp_replace(head, r"[^\p{L}01569@!|(]", "")))
    numbered = ~F.col("alone") & (F.col("before") | F.col("after"))
    return lines.select("chunk_id", "item_id", "page", "at", "runs_on", "alone", numbered.alias("numbered"), key.alias("key")).distinct()


def heads_and_numbers(chunks: DataFrame) -> DataFrame:
    """(chunk_id, at, noise): running_header or page_number on the first or last line of a chunk's page."""
    edges, _ = cut(edge_lines(chunks), "edges")
    lines = edges.where(~F.col("alone") & (F.length("key") >= 4))
    # pages are counted once each: first by page, then by item, so that no task gathers an item
    by_page = lines.where("item_id is not null").groupBy("item_id", "key", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if("runs_on").alias("on"))
    recurring = by_page.groupBy("item_id", "key").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.sum("on").alias("on")).where((F.col("pages") >= RECURS) & (F.col("on") * 2 < F.col("n")))
    heads, _ = cut(lines.join(recurring.select("item_id", "key"), ["item_id", "key"]).select("chunk_id", "at", "numbered"), "heads")
    numbers = edges.where("alone").select("chunk_id", "at").unionByName(heads.where("numbered").select("chunk_id", "at"))
    return heads.select("chunk_id", "at", F.lit("running_header").alias("noise")).unionByName(numbers.withColumn("noise", F.lit("page_number"))).distinct()


# --- misread words ----------------------------------------------------------------------------------------


def _tokens(text: Column, split: Column | None = None) -> Column:
    """The words of a text in lower case, split words joined; ``split`` tells where there are any."""
    joined = F.regexp_replace(text, SPLIT, "")
    if split is not None:
        joined = F.when(split, joined).otherwise(text)
    return F.regexp_extract_all(F.lower(F.regexp_replace(joined, _OPENING, " ")), F.lit(_WORD), F.lit(0))


def tokenised(chunks: DataFrame) -> DataFrame:
    """(chunk_id, paged, split, t array<string>): the words of every text, written once, in one string, for all that reads them."""
    split = F.regexp_like("text", F.lit(SPLIT))
    rows = chunks.where("text is not null").select("chunk_id", F.col("page").isNotNull().alias("paged"), split.alias("split"), "text")
    written, _ = cut(rows.select("chunk_id", "paged", "split", F.array_join(_tokens(F.col("text"), F.col("split")), " ").alias("t")), "tokens")
    return written.withColumn("t", F.when(F.col("t") != "", F.split("t", " ")).otherwise(F.array().cast("array<string>")))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(w1, w2, n) of neighbouring words over all chunks, with a page or without; w2 is null after a text's last word."""
    pair = F.arrays_zip(F.col("t").alias("w1"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("w2"))
    return cut(tokens.select(F.explode(pair).alias("p")).groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("n")), "pairs")[0]


def word_counts(pairs: DataFrame) -> DataFrame:
    """(word, n), from the pairs that each word begins."""
    return pairs.where(F.regexp_like("w1", F.lit(r"\p{L}"))).groupBy(F.col("w1").alias("word")).agg(F.sum("n").alias("n"))


_OPS = T.ArrayType(T.StringType())


@F.pandas_udf(_OPS)
def _confusions(true: pd.Series, seen: pd.Series) -> pd.Series:
    def one(a: str, b: str) -> list[str] | None:
        found = confused(a, b)
        return [f"{x}>{y}" for x, y in found] if found else None

    return pd.Series([one(a, b) for a, b in zip(true, seen)], dtype=object)


@F.pandas_udf(T.StringType())
def _lettered(words: pd.Series) -> pd.Series:
    return words.map(_letters_for)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, n, options array<struct<source, score>>, own): words that may be misread, with log scores of their sources.

    ``score`` is log P(source) + log P(confusions), ``own`` that of the word as it stands. All of them are shares, so
    that a corpus and ten copies of it are read alike.
    """
    counts, _ = cut(counts.withColumn("key", strokes(F.col("word"))), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    lettered = F.regexp_like("word", F.lit(r"^\p{L}+$"))
    sound = counts.where(lettered & (F.length("word") >= 2)).select(F.col("word").alias("source"), F.col("n").alias("m"), "key")
    pairs = (
        counts.where(F.length("word") >= 2)
        .join(sound, "key")
        .where((F.col("word") != F.col("source")) & (F.col("n") * OFTENER <= F.col("m")))
        .select("word", "n", "source", "m", _confusions("source", "word").alias("ops"))
        .where(F.col("ops").isNotNull())
    )
    pairs, _ = cut(pairs, "pairs")
    # one round of fitting: how often each confusion happened, over how often its characters stood there
    used = {r.op: r.n for r in pairs.select(F.explode("ops").alias("op"), "n").groupBy("op").agg(F.sum("n").alias("n")).collect()}
    letters = {a for a, _ in CONFUSIONS}
    stood = counts.agg(*[F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(a), F.lit("")))) / len(a)).alias(a) for a in sorted(letters)]).first()
    chance = {f"{a}>{b}": log(max(used.get(f"{a}>{b}", 0) / (stood[a] or 1), UNSEEN)) for a, b in CONFUSIONS}
    table = F.create_map(*[x for op, p in chance.items() for x in (F.lit(op), F.lit(p))])
    scored = pairs.select("word", "n", "source", (F.log(F.col("m") / total) + F.aggregate("ops", F.lit(0.0), lambda a, op: a + table[op])).alias("score"))
    known = scored.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(F.struct("source", "score")).alias("options"))
    # digits and marks between letters: read as letters even where the word is not known
    shaped = (
        counts.where(F.regexp_like("word", F.lit(r"\p{L}[0156@!|(]+\p{L}")))
        .select("word", "n", _lettered("word").alias("source"))
        .where(F.col("source").isNotNull())
        .join(known.select("word"), "word", "left_anti")
        .select("word", "n", F.array(F.struct("source", F.lit(log(0.1 / total) - 5).alias("score"))).alias("options"))
    )
    return known.unionByName(shaped).withColumn("own", F.log(F.col("n") / total) + F.when(lettered, log(SOUND)).otherwise(log(1e-9)))


def decode(words: list[tuple[str, list[tuple[str, float]]]], pairs: dict[tuple[str, str], float]) -> list[str]:
    """Viterbi: the most likely spelling of each position; pairs holds log gains of neighbours over independence."""
    back = []
    states: list[tuple[float, str]] = [(0.0, "")]
    for _, options in words:
        now, came = [], []
        for true, score in options:
            gain, at = max((s + pairs.get((w, true), 0.0), k) for k, (s, w) in enumerate(states))
            now.append((gain + score, true))
            came.append(at)
        states = now
        back.append(came)
    k, out = max(range(len(states)), key=lambda j: states[j][0]), []
    for (_, options), came in zip(reversed(words), reversed(back)):
        out.append(options[k][0])
        k = came[k]
    return out[::-1]


_FIXES = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("source", T.StringType())]))


@F.pandas_udf(_FIXES)
def _decoded(hits: pd.Series, pairs: pd.Series) -> pd.Series:
    def one(found, known) -> list[tuple[int, str]]:
        gain = {(p["w1"], p["w2"]): p["gain"] for p in known} if known is not None else {}
        at = {h["pos"]: h for h in found}
        out = []
        done = -1
        for pos in sorted(at):
            if pos <= done:
                continue
            line, p = [("", [(at[pos]["before"] or "", 0.0)])], pos
            while p in at:
                h = at[p]
                line.append((h["word"], [(h["word"], h["own"])] + [(o["source"], o["score"]) for o in h["options"]]))
                p += 1
            line.append(("", [(at[p - 1]["after"] or "", 0.0)]))
            for k, true in enumerate(decode(line, gain)[1:-1]):
                if true != line[k + 1][0]:
                    out.append((pos + k, true))
            done = p - 1
        return out

    return pd.Series([one(f, k) for f, k in zip(hits, pairs)], dtype=object)


def misread_words(tokens: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(chunk_id, words array<struct<pos, source>>): positions of misread words among a chunk's words, and their sources."""
    pairs = pair_counts(tokens) if pairs is None else pairs
    counts, _ = cut(word_counts(pairs), "counts")
    wrong, _ = cut(corrections(counts), "corrections")
    paged = tokens.where("paged and chunk_id is not null")
    n = F.greatest(F.size("t") - 1, F.lit(0))
    beside = F.arrays_zip(F.col("t").alias("word"), F.concat(F.array(F.lit(None).cast("string")), F.slice("t", F.lit(1), n)).alias("before"), F.slice("t", F.lit(2), n).alias("after"))
    words = paged.where("size(t) > 0").select("chunk_id", F.posexplode(beside).alias("pos", "w")).select("chunk_id", "pos", "w.*")
    few = wrong.drop("n")
    hits = words.join(F.broadcast(few) if byte_size(wrong) <= BROADCAST else few, "word").dropDuplicates(["chunk_id", "pos"])
    hits, _ = cut(hits, "hits")
    # which share of the occurrences of a word or source and of its neighbour are side by side
    texts = F.array_union(F.array("word"), F.transform("options", lambda o: o["source"]))
    asked = F.explode(F.array_union(F.transform(texts, lambda w: F.struct(F.col("before").alias("w1"), w.alias("w2"))), F.transform(texts, lambda w: F.struct(w.alias("w1"), F.col("after").alias("w2")))))
    per_hit, _ = cut(hits.select("chunk_id", asked.alias("p")).select("chunk_id", "p.*").where("w1 is not null and w2 is not null"), "asked")
    n1, n2 = (counts.select(F.col("word").alias(w), F.col("n").alias(n)) for w, n in (("w1", "n1"), ("w2", "n2")))
    share = F.col("n") / F.greatest("n1", "n2")
    gains = per_hit.select("w1", "w2").distinct().join(pairs, ["w1", "w2"]).join(n1, "w1", "left").join(n2, "w2", "left").select("w1", "w2", F.log1p(PAIRED * share).alias("gain"))
    known = per_hit.join(gains, ["w1", "w2"]).groupBy("chunk_id").agg(F.collect_set(F.struct("w1", "w2", "gain")).alias("pairs"))
    grouped = hits.groupBy("chunk_id").agg(F.collect_list(F.struct("pos", "word", "own", "options", "before", "after")).alias("hits"))
    return grouped.join(known, "chunk_id", "left").select("chunk_id", _decoded("hits", "pairs").alias("words")).where(F.size("words") > 0)


# --- results ----------------------------------------------------------------------------------------------


def noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise): the kinds of noise in each chunk of a scanned page."""
    tokens = tokenised(chunks)
    split = tokens.where("split and paged and chunk_id is not null").select("chunk_id", F.lit("hyphenation").alias("noise"))
    misread = misread_words(tokens).select("chunk_id", F.lit("misread").alias("noise"))
    return split.unionByName(misread).unionByName(heads_and_numbers(chunks).select("chunk_id", "noise")).distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): the paragraphs of each chunk with a page, heads and numbers gone, words and lines joined.

    A split compound keeps its hyphen where the corpus writes it with one more often than without.
    """
    tokens = tokenised(chunks)
    pairs = pair_counts(tokens)
    counts, _ = cut(word_counts(pairs), "counts")
    pages = _pages(chunks).select("chunk_id", "text").distinct()
    halves = F.regexp_extract_all("text", F.lit(r"\p{L}+" + SPLIT + r"\p{L}+"), F.lit(0))
    parts = F.transform(halves, lambda x: F.split(F.regexp_replace(F.lower(x), r"[-\u2010\u2011\u00AC\u00AD]\s*[\r\n]\s*", "-"), "-"))
    joins = pages.select("chunk_id", F.explode(parts).alias("p")).where(F.size("p") == 2).select("chunk_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    hyphened = chunks.where("text is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+-\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("h"))
    kept = (
        joins.select("chunk_id", F.concat_ws("-", "a", "b").alias("word"), F.concat("a", "b").alias("plain"))
        .join(hyphened, "word")
        .join(counts.select(F.col("word").alias("plain"), "n"), "plain", "left")
        .where(F.col("h") > F.coalesce("n", F.lit(0)))
        .groupBy("chunk_id")
        .agg(F.collect_set("word").alias("compounds"))
    )
    edges = heads_and_numbers(chunks).groupBy("chunk_id").agg(F.collect_set("at").alias("edges"))
    rows = pages.join(edges, "chunk_id", "left").join(misread_words(tokens, pairs), "chunk_id", "left").join(kept, "chunk_id", "left")
    return rows.select("chunk_id", _mended("text", "edges", "words", "compounds").alias("text"))


@F.pandas_udf(T.StringType())
def _mended(text: pd.Series, edges: pd.Series, words: pd.Series, compounds: pd.Series) -> pd.Series:
    import regex

    split, word, opening = regex.compile(SPLIT), regex.compile(_WORD), regex.compile(_OPENING)

    def one(t: str, at, fixes, kept) -> str:
        kept = set(kept) if kept is not None else set()
        # positions of words were counted with all split words joined
        plain = split.sub("", t)
        if fixes is not None and len(fixes):
            wanted = {f["pos"]: f["source"] for f in fixes}
            spans = [m.span() for m in word.finditer(opening.sub(" ", plain).lower())]
            for pos in sorted(wanted, reverse=True):
                if pos < len(spans):
                    s, e = spans[pos]
                    new = wanted[pos]
                    new = new.upper() if plain[s:e].isupper() and e - s > 1 else new.capitalize() if plain[s].isupper() else new
                    plain = plain[:s] + new + plain[e:]
        for k in kept:
            a, b = k.split("-")
            plain = regex.sub(rf"(?i)\b({regex.escape(a)})({regex.escape(b)})\b", r"\1-\2", plain)
        lines = regex.split(r"\r\n|\n|\r", plain)
        filled = [k for k, x in enumerate(lines) if x.strip()]
        if at is not None and filled:
            for side, k in (("first", filled[0]), ("last", filled[-1])):
                if side in at:
                    lines[k] = ""
        paragraphs = regex.split(r"\n\s*\n", "\n".join(lines).strip())
        return "\n\n".join(" ".join(p.split()) for p in paragraphs if p.strip())

    return pd.Series([one(*x) for x in zip(text, edges, words, compounds)], dtype=object)
