"""Personal information inside free text: a semi-Markov conditional random field over candidate segments.

Patterns propose segments of bounded length with a kind (several kinds may propose the same segment); everything
else is text outside entities. Each segment is scored as a whole, from its shape, a lexicon of given names and
the words around it, and a dynamic programme over segment ends finds the best set of segments that do not overlap:
boundaries and kinds are chosen jointly. The weights are fitted by maximum conditional likelihood (the same dynamic
programme, in sums) on labelled sentences that ``privacy_examples`` writes, a bounded sample of ``SAMPLE`` sentences.

The lexicon of given names is learnt from the authors' table: every word that stands as a given name at least as
often as in a family name, however rare. It is kept as a Bloom filter of ``LEXICON_BITS`` bits, which Spark fills, so
that its size has a bound while no name is left out. The sentences are filled with a sample of these names.

Defined results: null texts stay null, empty texts empty; a document without mentions keeps its text; repeats of a
row give the same mentions, which ``mentions`` returns once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Container, Iterator
from math import exp, log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, spread

KINDS = ("person_name", "email", "phone", "id_number", "street_address")
#: Sentences the field is fitted on; rounds of fitting; the most frequent given names that fill them.
SAMPLE, ROUNDS, SAMPLE_NAMES = 3000, 10, 5000
#: Bits of the lexicon's filter (8 MB at most) and bits set for each name: one in a hundred strange words passes at seven million names.
LEXICON_BITS, HASHES = 1 << 26, 4

#: Patterns of this process, and fitted weights by what they were fitted on.
_ready: dict[object, object] = {}


def _patterns() -> dict:
    """Patterns that propose segments; compiled once in each process."""
    if "patterns" not in _ready:
        import re

        import regex

        cap = r"\p{Lu}[\p{L}\p{M}’']*+(?:-\p{Lu}[\p{L}\p{M}’']*+)*"
        street = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Court|Ct|Row|Crescent|Cres|Terrace|Ter|Place|Pl|Drive|Dr|Square|Sq|Way|Walk|Hill|Gardens|Green|Grove|Mews|Parade|Boulevard|Blvd|Quay|Yard|Alley|Passage)"
        romance = r"(?i:rue|avenue|boulevard|chemin|quai|place|impasse|all[ée]e|cours|route|sentier|passage|square)"
        spanish = r"(?:calle|plaza|paseo|avenida|avda\.|camino|carrera|ronda|traves[ií]a|c/)"
        small = r"(?:d['’]|(?:de|du|des|del|la|las|le|les|los|aux?|el|y|l['’])\s+)"
        german = r"(?:str\.|stra(?:ß|ss)e|weg|platz|gasse|allee|ufer|damm|ring|steig|markt|hof)"
        _ready["patterns"] = {
            "run": regex.compile(rf"{cap}\.?(?:,?\s{{1,3}}{cap}\.?)+"),
            "run_lower": regex.compile(r"(?<![\p{L}\p{N}@.-])\p{Ll}[\p{L}’'-]*+\.?(?:,?[^\S\n]{1,2}\p{Ll}[\p{L}’'-]*+\.?)+"),
            "email": [
                regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*\s?@\s?[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}", regex.I),
                regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*\s*[\[({<]\s*at\s*[\])}>]\s*[\p{L}\p{N}-]+(?:\s*(?:\.|[\[({<]\s*dot\s*[\])}>])\s*[\p{L}\p{N}-]+)*(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*)\p{L}{2,}", regex.I),
                regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*\s+at\s+[\p{L}\p{N}-]+(?:\s+dot\s+[\p{L}\p{N}-]+)+", regex.I),
            ],
            "number": re.compile(r"(?<![\w.,/-])(?:\+ ?|\()?[0-9](?:(?:\)[ -]?|[ .\-/\u00a0\u2010-\u2013]| \()?[0-9]){6,16}(?![\w/-]|[.,][0-9])"),
            "code": re.compile(
                r"(?<![\w./-])(?:[A-Za-z]{1,2}[0-9]{6,9}[A-Za-z]?|[A-Za-z]{2}[ -][0-9]{2}(?:[ -][0-9]{2}){2}[ -][A-Za-z]|[A-Za-z]-[0-9]{7}-[A-Za-z]|[A-Za-z][0-9]{2,3}[A-Za-z][0-9]{4,6}|[0-9]{7,8}[ -]?[A-Za-z]|[0-9]{6,8}[-+][0-9]{4}|[0-9]{2}[A-Za-z][0-9]{5,7})(?![\w]|[/-][0-9])"
            ),
            "address": [
                regex.compile(rf"(?<![\p{{N}}.,/-])\d{{1,4}}\s?[a-zA-Z]?,?\s(?:\p{{Lu}}[\p{{L}}’'-]*\.?\s){{1,3}}{street}\b(?![’'])"),
                regex.compile(rf"(?<![\p{{N}}.,/-])\d{{1,4}}\s?[a-zA-Z]?,?\s(?:[\p{{L}}’'-]+\.?\s){{1,3}}{street}\b(?![’'])", regex.I),
                regex.compile(rf"(?<![\p{{N}}.,/-])\d{{1,4}}(?:\s?(?:bis|ter|[a-z]))?,?\s{romance}\s(?:{small}){{0,2}}\p{{Lu}}[\p{{L}}’'-]*(?:[ -](?:{small})?\p{{Lu}}[\p{{L}}’'-]*){{0,2}}"),
                regex.compile(rf"\b{spanish}\s(?:{small}){{0,2}}[\p{{L}}’'-]+(?:\s(?:{small})?\p{{Lu}}[\p{{L}}’'-]*){{0,2}},?\s(?:n\.?[ºo°]\s?)?\d{{1,4}}[a-z]?\b", regex.I),
                regex.compile(rf"\b(?:\p{{Lu}}[\p{{L}}-]*{german}|\p{{Lu}}[\p{{L}}]*[\s-](?:Str\.|Stra(?:ß|ss)e|Weg|Platz|Gasse|Allee|Ufer|Damm|Ring))\s\d{{1,4}}[a-z]?\b(?![.,]\d)", regex.I),
                regex.compile(r"\b(?:Am|An|Auf|Bei|Hinter|Im|In|Unter|Vor|Zum|Zur|Zwischen)\s(?:(?:der|dem|den|die)\s)?\p{Lu}[\p{L}-]+(?:\s\p{Lu}[\p{L}-]+)?\s\d{1,4}[a-z]?\b(?![.,]\d)"),
            ],
            # what a text must hold, in lower case, for a slow pattern to be worth trying
            "holds": {
                ("email", 0): ("@",),
                ("email", 1): tuple(a + b + "at" for a in "[({<" for b in ("", " ", "\n")),
                ("email", 2): (" dot ", "\ndot ", " dot\n"),
                ("address", 2): tuple(w for x in romance[4:-1].split("|") for w in ((x,) if "[" not in x else ("allée", "allee"))),
                ("address", 3): ("calle", "plaza", "paseo", "avenida", "avda.", "camino", "carrera", "ronda", "traves", "c/"),
            },
            "german": ("str.", "straße", "strasse", "weg", "platz", "gasse", "allee", "ufer", "damm", "steig", "markt", "hof"),
            "ring": re.compile(r"ring\s[0-9]"),
            # full stops after short words are those of abbreviations
            "ends": re.compile(r"(?<=\w\w\w[.!?])\s+|\n\s*\n"),
            # a stretch that may lack capitals begins with a small letter
            "small": re.compile(r"(?:\A|[.!?]\s|\n\s*\n)[\W\d_]*[^\W\d_A-Z]"),
            "word": regex.compile(r"[\p{L}\p{N}#&]+|[:;()<>/.,?!@+\"“”-]"),
            "digits": regex.compile(r"\d"),
            "letters": regex.compile(r"\p{L}"),
        }
    return _ready["patterns"]


#: Words that stand before a surname or after one without being part of a name (fixed values).
NOT_NAMES = frozenset(
    "the this these that those a an and or but not if in on at of for from with by to as it its we our their his her she he they i you "
    "re fwd dear how when where what which who is was are were be been has have had only neither either however moreover between "
    "figure table results following uncertainty even so taken together by comparison unexpectedly until room item run version station "
    "contract contact see shelf plate monte carlo old mill institute university society journal annals bulletin letters reports "
    "archive library street road avenue lane court close terrace row crescent place drive square way st rd ave ssn ni dni nie tel fax "
    "phone email e mail passport card number no prof dr mr mrs ms sr jr sir copy two copies entry sheet page vol volume chapter section "
    "der die das den dem des ein eine und oder wir es im am zu zur zum von mit für nach bei le la les un une des du de et nous il elle "
    "el los las una y en con por para según signed present minutes referee parcel label emergency correspondence handwritten interview "
    "dial write call please thank thanks summary record physical description second report notes note margin values station january february "
    "march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
)

TITLES = frozenset("dr prof professor mr mrs ms miss sir dame herr frau m mme mlle sr sra srta don doña ing dipl".split())


class Lexicon:
    """The given names, as a Bloom filter: words of 64 bits by their number."""

    def __init__(self, words: dict[int, int]):
        self.words, self.seen = words, {}

    def __contains__(self, name: str) -> bool:
        if name not in self.seen:
            import xxhash

            if len(self.seen) > 100_000:
                self.seen.clear()
            data = name.encode()
            bits = (xxhash.xxh64_intdigest(data, seed=k) % LEXICON_BITS for k in range(HASHES))
            self.seen[name] = all(self.words.get(b >> 6, 0) >> (b & 63) & 1 for b in bits)
        return self.seen[name]


def _is_initial(token: str) -> bool:
    return len(token.rstrip(".")) == 1


class Proposer:
    """Candidate segments of a text, with the names of their features."""

    def __init__(self, given: Container[str]):
        self.given, self.p = given, _patterns()
        self.tokens: dict[str, bool] = {}

    def known(self, token: str) -> bool:
        found = self.tokens.get(token)
        if found is None:
            if len(self.tokens) > 200_000:
                self.tokens.clear()
            found = self.tokens[token] = all(part in self.given for part in token.casefold().rstrip(".").split("-"))
        return found

    def _around(self, text: str, start: int, end: int) -> list[str]:
        before = [w.casefold() for w in self.p["word"].findall(text[max(0, start - 48) : start])][-3:]
        after = [w.casefold() for w in self.p["word"].findall(text[end : end + 32])][:2]
        mask = lambda w: "#" if w[0].isdigit() else w
        before, after = ["^"] * (3 - len(before)) + [mask(w) for w in before], [mask(w) for w in after] + ["$"] * (2 - len(after))
        return [f"l1={before[2]}", f"l2={before[1]}", f"l21={before[1]} {before[2]}", f"l3={before[0]}", f"r1={after[0]}", f"r12={after[0]} {after[1]}", "l=" + ("word" if before[2].isalpha() else before[2])]

    def _without_capitals(self, text: str) -> Iterator[tuple[int, int]]:
        """Sentences and paragraphs that hold letters, but no capital."""
        if not self.p["small"].search(text):
            return
        at = 0
        for m in self.p["ends"].finditer(text):
            if text[at : m.start()].islower():
                yield at, m.start()
            at = m.end()
        if text[at:].islower():
            yield at, len(text)

    def _names(self, text: str) -> Iterator[tuple[int, int, str, list[str]]]:
        pieces = [(m, False) for m in self.p["run"].finditer(text)]
        for start, end in self._without_capitals(text):
            pieces += [(m, True) for m in self.p["run_lower"].finditer(text, start, end)]
        for run, lower in pieces:
            tokens, at = [], run.start()
            for part in run.group().split():
                at = text.index(part, at)
                core = part.rstrip(",")
                tokens.append((at, at + len(core), core, part.endswith(",")))
                at += len(part)
            # without capitals, or with nothing else, only what holds a known given name can be a name
            strict = lower or run.group().isupper()
            sides = [x for x in (text[max(0, run.start() - 20) : run.start()], text[run.end() : run.end() + 20]) if any(c.isalpha() for c in x)]
            calm = not lower and all(any(c.islower() for c in x) for x in sides)
            known = [not strict or self.known(t[2]) or calm and len(t[2]) == 2 and t[2][1] == "." for t in tokens]
            for i in range(len(tokens) - 1):
                for n in (2, 3, 4):
                    if i + n <= len(tokens) and any(known[i : i + n]) and (c := self._name(text, tokens[i : i + n], lower, strict, calm)):
                        yield c

    def _name(self, text: str, part: list[tuple[int, int, str, bool]], lower: bool, strict: bool, calm: bool) -> tuple[int, int, str, list[str]] | None:
        words = [t[2] for t in part]
        commas = [k for k, t in enumerate(part[:-1]) if t[3]]
        if any(w.endswith(".") and not _is_initial(w) for w in words[:-1]):
            return None
        shape = "".join("I" if _is_initial(w) else "W" for w in words)
        if commas:
            if commas != [0] or shape not in ("WW", "WI", "WWI", "WII"):
                return None
            family, rest, form = words[0], words[1:], "F," + shape[1:]
        else:
            if shape not in ("WW", "IW", "WIW", "IIW", "WWW", "WIIW"):
                return None
            family, rest, form = words[-1], words[:-1], shape
        start, end = part[0][0], part[-1][1]
        last = words[-1]
        if last.endswith(".") and not (_is_initial(last)):
            end -= 1
        for tail in ("'s", "’s", "'", "’"):
            if text[start:end].endswith(tail):
                end -= len(tail)
                break
        bare = family.rstrip(".").casefold()
        for tail in ("'s", "’s"):
            bare = bare.removesuffix(tail)
        full = [w for w in rest if not _is_initial(w)]
        known = [self.known(w) for w in full]
        if bare in NOT_NAMES or len(bare) < 3 or any(w.rstrip(".").casefold() in NOT_NAMES | TITLES and not k for w, k in zip(full, known)):
            return None
        if (strict or all(w.isupper() for w in words)) and not (all(known) if known else calm):
            return None
        lex = "none" if not known else "all" if all(known) else "some" if any(known) else "no"
        names = [f"form={form}", f"lex={lex}", f"form={form} lex={lex}", f"surname_given={self.known(bare)}", f"caps={family.isupper()} {lower}", f"line={chr(10) in text[start:end]}"]
        context = self._around(text, start, end)
        before = text[max(0, start - 8) : start].casefold().split()
        if before and before[-1].rstrip(".") in TITLES:
            names.append("title")
        after = text[end : end + 14].lstrip(" ,(")
        if after[:2] in ("19", "20", "et") or after[:4].isdigit():
            names.append("cited")
        return start, end, "person_name", names + context + [f"lex={lex} {c}" for c in context[:1] + context[4:5]]

    def _number(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, str, list[str]]]:
        import re

        own = text[start:end]
        digits = sum(c.isdigit() for c in own)
        shape = re.sub(r"\d+", lambda m: str(len(m.group())), own)
        lead = "+" if own[0] == "+" else "(" if own[0] == "(" else "0" if own[0] == "0" else "1" if own[0] == "1" else "d"
        marks = "".join(sorted(set(re.sub(r"[\d]", "", own))))
        names = [f"shape={shape}", f"lead={lead}", f"lead={lead} n={digits}", f"marks={marks}", f"n={digits}"] + self._around(text, start, end)
        if 7 <= digits <= 15:
            yield start, end, "phone", names
        if 8 <= digits <= 12 and lead not in "+(":
            yield start, end, "id_number", names

    def _lower_around(self, text: str, start: int, end: int) -> bool:
        """Whether the words around, a line of text to each side, are words of sentences without a capital."""
        around = text[max(0, start - 100) : end + 100]
        return around.islower() and not NOT_NAMES.isdisjoint(around.split())

    def candidates(self, text: str) -> list[tuple[int, int, str, list[str]]]:
        """(start, end, kind, features), in order of their ends."""
        import re

        found = list(self._names(text))
        holds, low = self.p["holds"], text.lower()
        allowed = lambda kind, k: (kind, k) not in holds or any(w in low for w in holds[kind, k])
        for k, pattern in enumerate(self.p["email"]):
            if not allowed("email", k):
                continue
            for m in pattern.finditer(text):
                found.append((m.start(), m.end(), "email", [f"way={k}", f"blank={' @' in m.group()}"] + self._around(text, m.start(), m.end())))
        for m in self.p["number"].finditer(text):
            found += self._number(text, m.start(), m.end())
        for m in self.p["code"].finditer(text):
            own = m.group()
            shape = re.sub(r"[^\W\d_]+", lambda x: "L" * len(x.group()), re.sub(r"\d+", lambda x: str(len(x.group())), own))
            found.append((m.start(), m.end(), "id_number", [f"shape={shape}", f"head={own[:2].upper() if own[:2].isalpha() else ''}", f"upper={own.isupper()}"] + self._around(text, m.start(), m.end())))
        for k, pattern in enumerate(self.p["address"]):
            if not allowed("address", k) or k == 4 and not (any(w in low for w in self.p["german"]) or self.p["ring"].search(low)):
                continue
            for m in pattern.finditer(text, overlapped=k == 1):
                own = m.group()
                if k == 1 and not (own.isupper() or own.islower() and self._lower_around(text, m.start(), m.end())):
                    continue  # without capitals only where the text around has none
                found.append((m.start(), m.end(), "street_address", [f"way={k}", f"words={min(len(own.split()), 6)}", f"case={own.islower()}{own.isupper()}"] + self._around(text, m.start(), m.end())))
        return sorted(found, key=lambda c: (c[1], c[0]))


class Field:
    """Weights of the features of each kind; decoding and fitting by one dynamic programme."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights if weights is not None else {}

    def score(self, kind: str, names: list[str]) -> float:
        get = self.weights.get
        return get(kind, 0.0) + sum(get(f"{kind} {n}", 0.0) for n in names)

    def decode(self, cands: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str]]:
        """The best set of segments that do not overlap: best[k] is the best of the first k by their ends."""
        ends = [c[1] for c in cands]
        best, took, back = [0.0], [False], []
        for k, (start, _, kind, names) in enumerate(cands):
            prior = bisect_right(ends, start, 0, k)
            back.append(prior)
            gain = best[prior] + self.score(kind, names)
            took.append(gain > best[k])
            best.append(max(gain, best[k]))
        out, k = [], len(cands)
        while k:
            if took[k]:
                out.append(cands[k - 1][:3])
                k = back[k - 1]
            else:
                k -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[list, set]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 2e-3) -> None:
        """Gradient ascent on the conditional likelihood; an example is (candidates, labelled (start, end, kind))."""
        squares: dict[str, float] = {}
        for _ in range(rounds):
            for cands, gold in examples:
                if not cands:
                    continue
                ends = [c[1] for c in cands]
                prior = [bisect_right(ends, c[0], 0, k) for k, c in enumerate(cands)]
                scores = [self.score(c[2], c[3]) for c in cands]
                add = lambda a, b: max(a, b) + log1p(exp(-abs(a - b)))
                n = len(cands)
                before = [0.0] * (n + 1)
                for k in range(n):
                    before[k + 1] = add(before[k], before[prior[k]] + scores[k])
                # sums over what may follow: inside-outside by the derivative of the total
                share = [0.0] * (n + 1)
                share[n] = 1.0
                for k in range(n - 1, -1, -1):
                    if share[k + 1]:
                        taken = share[k + 1] * exp(before[prior[k]] + scores[k] - before[k + 1])
                        share[prior[k]] += taken
                        share[k] += share[k + 1] - taken
                        expected = taken
                    else:
                        expected = 0.0
                    start, end, kind, names = cands[k]
                    gap = ((start, end, kind) in gold) - expected
                    if abs(gap) > 1e-4:
                        for f in (kind, *(f"{kind} {x}" for x in names)):
                            w = self.weights.get(f, 0.0)
                            g = gap - decay * w
                            squares[f] = squares.get(f, 1e-2) + g * g
                            self.weights[f] = w + rate * g / squares[f] ** 0.5


def given_names(authors: DataFrame) -> DataFrame:
    """(name, n): words of at least three letters that stand as a given name, at least as often as in a family name."""
    parts = lambda c, given: F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s.,-]+"), lambda x: F.struct(x.alias("name"), F.lit(given).alias("given")))
    rows = authors.select(F.explode(F.concat(parts("given_name", 1), parts("family_name", 0))).alias("x")).select("x.*").where(F.length("name") >= 3)
    return rows.groupBy("name").agg(F.sum("given").alias("n"), F.count(F.lit(1)).alias("all")).where((F.col("n") > 0) & (F.col("n") * 2 >= F.col("all"))).select("name", "n")


def lexicon(names: DataFrame) -> dict[int, int]:
    """The filter of the names: its words of 64 bits that are not zero, by their number."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bits(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda x: [xxhash.xxh64_intdigest(x.casefold().encode(), seed=k) % LEXICON_BITS for k in range(HASHES)])

    spots = names.select(F.explode(bits("name")).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.col("bit").bitwiseAND(63).cast("int").alias("at"))
    filled = spots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    return {r.word: r.bits & (1 << 64) - 1 for r in filled.collect()}  # at most LEXICON_BITS / 64 rows


def fitted(given: list[str], known: Container[str] | None = None, sample: int = SAMPLE) -> Field:
    """A field fitted on ``sample`` labelled sentences filled with the names ``given``; ``known`` is the whole lexicon."""
    from .privacy_examples import sentences

    proposer, field = Proposer(frozenset(x.casefold() for x in given) if known is None else known), Field()
    field.fit([(proposer.candidates(text), gold) for text, gold in sentences(given, sample)])
    return field


_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("found", T.StringType())]))


def find(documents: DataFrame, authors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, entities array<struct<start, end, kind, found>>) of every document."""
    names, _ = cut(given_names(authors), "given_names")
    words = lexicon(names)
    sample = [r.name for r in names.orderBy(F.desc("n"), "name").limit(SAMPLE_NAMES).collect()]
    key = ("weights", hash((tuple(sample), tuple(sorted(words.items())))))
    if key not in _ready:
        _ready[key] = {f: round(w, 4) for f, w in fitted(sample, Lexicon(words)).weights.items() if abs(w) > 1e-3}
    weights = _ready[key]
    sent = documents.sparkSession.sparkContext.broadcast((words, weights))

    @F.pandas_udf(_FOUND)
    def entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        filled, learnt = sent.value
        proposer, field = Proposer(Lexicon(filled)), Field(learnt)

        def one(text: str | None) -> list:
            return [(s, e, k, text[s:e]) for s, e, k in field.decode(proposer.candidates(text))] if text else []

        for batch in texts:
            yield batch.map(one)

    return spread(documents.select(F.col(id_col), F.col(text_col).alias("text"))).withColumn("entities", entities("text"))


def mentions(documents: DataFrame, authors: DataFrame) -> DataFrame:
    """(doc_id, kind, found): every distinct mention."""
    return find(documents, authors).where("doc_id is not null").select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.kind", "e.found").distinct()


def redact(documents: DataFrame, authors: DataFrame) -> DataFrame:
    """(doc_id, text): the text with a typed placeholder in place of each mention."""

    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series, entities: pd.Series) -> pd.Series:
        def one(text: str | None, found: list) -> str | None:
            if text is None or found is None or not len(found):
                return text
            out, at = [], 0
            for e in found:
                out += [text[at : e["start"]], f"[{e['kind'].upper()}]"]
                at = e["end"]
            return "".join([*out, text[at:]])

        return pd.Series([one(t, e) for t, e in zip(texts, entities)], dtype=object)

    return find(documents, authors).select("doc_id", replaced("text", "entities").alias("text"))
