"""Variant spellings of names typed by people, linked to persons and organisations.

1. Every row is read into family name, given name, initials, or the words of an organisation's name, whatever the
   order, titles, case, accents, look-alike letters and additions. Nicknames are learnt: a rarer given name that
   stands beside one and the same other name under one ORCID, or in one family, far more often than by chance.
2. Whole names become vectors of weighted character n-grams: pairs of neighbouring letters, of letters around one, and
   threes, each without order, so that a slip of the keyboard changes few of them. A person's vector is that of the family
   name beside that of the given name, an organisation's holds all its words. Products of sparse blocks give all
   pairs of names whose cosine reaches the threshold. Persons are joined by similar family names and one of the rarer
   n-grams of the given name, which carry the weight that a similar pair must share (a prefix filter, without loss).
   Every partner above the threshold is kept, not the top n alone: a cap would lose links.
3. The pairs are grouped by average linkage of the cosines, names weighing as many as their rows. The average between two
   groups is the product of their mean vectors, so that only linked groups are compared. Components of
   the pairs are linked each in a task while they have at most ``COMPONENT`` names; larger ones by rounds of joins
   that merge mutual nearest neighbours, which gives the same groups.
4. Rows with one ORCID (checked by its check digit) are one person. The other rows take the person of their group of
   names and middle initial; bare initials are linked where one person alone has a similar family name.

All of it works on distinct spellings and keys, aggregated before they are shuffled; only the result, which by its
definition is all pairs inside an entity, grows with the square of an entity's rows.

Defined results: null author ids, and rows without any letters in the name, link to nothing; several rows with one
id count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..session import cut, new_path
from .groups import hash_to_min

#: Shares of family and given name in the cosine of two persons' names.
FAMILY, GIVEN = 0.6, 0.4
#: Least average cosine inside a group of persons' names, and of organisations' names.
PERSONS, ORGANISED = 0.75, 0.75
#: Vectors in a block.
BLOCK = 2048
#: Names of one component that are linked in one task.
COMPONENT = 5000
#: A nickname stands beside its name in so many groups at least, in this share of its groups, so many times as often as by chance.
NICKNAME_SEEN, NICKNAME_SHARE, NICKNAME_LIFT = 2, 0.15, 5
#: By how much one person's family name must be nearer to a bare initial's than any other person's.
MARGIN = 0.2

#: Additions to names that are no part of them (fixed values).
ADDITIONS = frozenset("dr prof professor mr mrs ms sir dame phd md msc ed eds editor jr sr junior senior ii iii iv hrsg herr frau".split())
#: Words of organisations' names and their common abbreviations (fixed values).
ORGANISATIONS = {
    "institute": ("inst", "institut"), "university": ("univ", "uni"), "society": ("soc",), "laboratory": ("lab", "labs", "laboratories"), "observatory": ("obs",), "association": ("assn", "assoc", "ass"),
    "commission": ("comm",), "centre": ("center", "ctr", "cent"), "department": ("dept", "dep"), "academy": ("acad",), "college": ("coll",), "school": ("sch",), "museum": ("mus",),
    "foundation": ("found", "fdn"), "council": ("counc",), "agency": ("agcy",), "committee": ("cttee",), "bureau": ("bur",), "library": ("libr",), "survey": ("surv",), "consortium": ("consort",), "group": ("grp",),
}
_SHORT = {short: full for full, shorts in ORGANISATIONS.items() for short in shorts}
_EMPTY_WORDS = frozenset("the of for and in at de la le du des der die das für fur et y del".split())
#: Cyrillic and Greek letters that look like Latin ones (fixed values).
_ALIKE = str.maketrans("аеорсухіјѕԁһӏкмнтвгАВЕКМНОРСТХУІЈЅαοινρτυκ", "aeopcyxijsdhlkmhtbrABEKMHOPCTXYIJSaoivptuk")


def fold(text: str) -> str:
    """Lower case, without accents and look-alike letters."""
    plain = unicodedata.normalize("NFKD", text.translate(_ALIKE)).casefold()
    return "".join(c for c in plain if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae")


def plain_orcid(text: str | None) -> str | None:
    """The 16 characters of an ORCID however written; None where its check digit is wrong."""
    import re

    if not text:
        return None
    found = re.search(r"(\d{4})[\s-]*(\d{4})[\s-]*(\d{4})[\s-]*(\d{3})([\dXx])\W*$", text)
    if not found:
        return None
    code, total = "".join(found.groups()).upper(), 0
    for c in code[:15]:
        total = (total + int(c)) * 2
    check = (12 - total % 11) % 11
    return code if code[15] == ("X" if check == 10 else str(check)) else None


def read_name(family: str | None, given: str | None) -> tuple[str | None, str | None, str | None, list[str] | None]:
    """(family, given or initial, middle initial, None) of a person; (None, None, None, words) of an organisation."""
    import re

    family = re.sub(r"\([^)]*\b(?:eds?|hrsg)\b[^)]*\)", " ", fold(family or ""))
    given = fold(given or "")
    words = re.findall(r"[^\W\d_]+", family)
    if not given.strip(" .,") and len(words) > 1:
        full = [_SHORT.get(w, w) for w in words if w not in _EMPTY_WORDS]
        if any(w in ORGANISATIONS for w in full):
            return None, None, None, sorted(full)
    clean = lambda s: [w for w in re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", s) if w not in ADDITIONS]
    if not given.strip(" .,"):
        head, _, tail = family.partition(",")
        if clean(tail):
            last, rest = clean(head), clean(tail)
        else:
            rest = clean(head)
            last = [rest.pop()] if rest and len(rest[-1]) > 1 else []
            if not last and rest:  # "Family D."
                last = [rest.pop(0)]
            while len(rest) > 1 and len(rest[-1]) > 1:  # "Given Family Family"
                last.insert(0, rest.pop())
    else:
        last, rest = clean(family), clean(given)
    if not last:
        return None, None, None, None
    first = rest[0] if rest else None
    middle = next((w[0] for w in rest[1:]), None)
    return " ".join(last).replace("-", " "), first, middle, None


_PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "middle", "orcid")] + [T.StructField("words", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARSED)
def _parsed(family: pd.Series, given: pd.Series, orcid: pd.Series) -> pd.DataFrame:
    rows = []
    for f, g, o in zip(family, given, orcid):
        last, first, middle, words = read_name(f, g)
        rows.append((last, first, middle, plain_orcid(o), words))
    return pd.DataFrame(rows, columns=["family", "given", "middle", "orcid", "words"])


# --- similar names ----------------------------------------------------------------------------------------


def ngrams(name: Column) -> Column:
    """Letters of each padded word: neighbours, those around one letter, and threes, without their order."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("^"), word, F.lit("$"))
        ordered = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
        last = F.length(padded)
        twos = F.transform(F.sequence(F.lit(1), last - 1), lambda k: ordered(F.substring(padded, k, F.lit(2))))
        around = F.transform(F.sequence(F.lit(1), last - 2), lambda k: F.concat(F.lit("_"), ordered(F.concat(F.substring(padded, k, F.lit(1)), F.substring(padded, k + 2, F.lit(1))))))
        threes = F.transform(F.sequence(F.lit(1), last - 2), lambda k: F.concat(F.lit("3"), ordered(F.substring(padded, k, F.lit(3)))))
        return F.concat(twos, around, threes)

    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(name, " "), lambda w: w != ""), of_word)))


def vectors(names: DataFrame, flat: bool = False) -> DataFrame:
    """(name, gram, w, rest) of distinct ``name``s: unit vectors, and the weight that a gram and all more common ones carry.

    Weights are the logarithm of an n-gram's rarity, or with ``flat`` its root.
    """
    grams, _ = cut(names.select("name", F.explode(ngrams(F.col("name"))).alias("gram")), "grams")
    total = names.count()
    rarity = F.log1p(F.lit(total) / F.col("df"))
    weights = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).select("gram", "df", (F.sqrt(rarity) if flat else rarity).alias("w"))
    own = W.Window.partitionBy("name")
    unit = grams.join(weights, "gram").withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))
    order = own.orderBy(F.desc("df"), "gram").rowsBetween(W.Window.unboundedPreceding, 0)
    return cut(unit.select("name", "gram", "w", F.sum(F.col("w") * F.col("w")).over(order).alias("rest")), "unit")[0]


def _prefix(unit: DataFrame, least: float) -> DataFrame:
    """(name, gram): the rarer n-grams; what is left of a vector after them has nothing similar hidden in it."""
    return unit.where(F.col("rest") >= least * least - 1e-9).select("name", "gram")


def cosines(pairs: DataFrame, unit: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs (a, b) of names."""
    left = unit.select(F.col("name").alias("a"), "gram", F.col("w").alias("wa"))
    right = unit.select(F.col("name").alias("b"), "gram", F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


class _Postings:
    """The vectors of one block by n-gram: which rows hold each, with which weight."""

    def __init__(self, table: pa.Table):
        grams = [np.frombuffer(x, np.int64) for x in table["grams"].to_pylist()]
        weights = [np.frombuffer(x, np.float64) for x in table["weights"].to_pylist()]
        self.names = table["name"].to_pylist()
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        grams, weights = np.concatenate(grams), np.concatenate(weights)
        order = np.argsort(grams, kind="stable")
        self.rows, self.weights = of[order], weights[order]
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.ends = np.append(starts, len(order))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[k], self.ends[k + 1])
        return self.rows[part], self.weights[part]


def _product(a: _Postings, b: _Postings) -> np.ndarray:
    """Cosines of all rows of two blocks: the sparse product, n-gram by n-gram."""
    out = np.zeros((len(a.names), len(b.names)))
    _, at_a, at_b = np.intersect1d(a.grams, b.grams, assume_unique=True, return_indices=True)
    for i, j in zip(at_a, at_b):
        (ra, wa), (rb, wb) = a.of(i), b.of(j)
        out[ra[:, None], rb] += wa[:, None] * wb
    return out


def _read_block(path: str, number: int) -> _Postings | None:
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    where = f"{root}/block={number}"
    if system.get_file_info(where).type == fs.FileType.NotFound:
        return None
    return _Postings(ds.dataset(where, filesystem=system, format="parquet").to_table())


def similar(unit: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of all names a < b whose vectors have a cosine of ``least`` or more.

    A product of sparse blocks: tasks read pairs of blocks of vectors from the shared folder and give back the pairs
    of names above the threshold alone, so that candidates are neither shuffled nor kept.
    """
    spark = unit.sparkSession
    rows = unit.groupBy("name").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), "w")).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").to_pylist()
            grams = pa.array([np.array([x["g"] for x in v], np.int64).tobytes() for v in lists], pa.binary())
            weights = pa.array([np.array([x["w"] for x in v], np.float64).tobytes() for v in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("block"), grams, weights], ["name", "block", "grams", "weights"])

    blocks = max(1, -(-unit.select("name").distinct().count() // BLOCK))
    path = new_path(spark, "names")
    rows.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).repartition(blocks, "block").mapInArrow(
        packed, "name string, block int, grams binary, weights binary"
    ).write.partitionBy("block").parquet(path)

    # pairs of blocks (i, i + d mod blocks), d up to half: each unordered pair once
    half = blocks // 2 + 1

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = -1, None
        for batch in batches:
            for t in batch.column("t").to_pylist():
                i, d = divmod(t, half)
                if i != at:
                    at, first = i, _read_block(path, i)
                if first is None or (blocks % 2 == 0 and d == half - 1 and i >= blocks // 2 and d):
                    continue
                second = _read_block(path, (i + d) % blocks) if d else first
                if second is None:
                    continue
                product = _product(first, second)
                for r, c in zip(*np.nonzero(product >= least)):
                    if d or r < c:
                        found.append((*sorted((first.names[r], second.names[c])), float(product[r, c])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["a", "b", "cosine"])
                    found.clear()

    found: list[tuple[str, str, float]] = []
    count = blocks * half
    return spark.range(0, count, 1, max(1, count)).withColumnRenamed("id", "t").mapInArrow(tiles, "a string, b string, cosine double")


def average_linkage(names: list[str], rows: list[int], vecs: list[dict[str, float]], near: list[tuple[int, int]], least: float) -> list[int]:
    """Group numbers of names: the two groups of highest average cosine merge while it is ``least`` or more.

    Averages are over the rows that names stand for; only groups with a pair ``near`` between them are compared.
    Of equal averages the one between the smaller names comes first.
    """
    total = [{g: w * n for g, w in v.items()} for v, n in zip(vecs, rows)]
    size, group, first = list(rows), list(range(len(rows))), list(names)
    links: list[set[int]] = [set() for _ in rows]
    for a, b in near:
        links[a].add(b)
        links[b].add(a)

    def entry(a: int, b: int) -> tuple:
        small, large = (total[a], total[b]) if len(total[a]) < len(total[b]) else (total[b], total[a])
        mean = sum(w * large[g] for g, w in small.items() if g in large) / (size[a] * size[b])
        return (-round(mean, 9), *sorted((first[a], first[b])), a, b, size[a], size[b])

    heap = [entry(a, b) for a in range(len(rows)) for b in links[a] if a < b]
    heapq.heapify(heap)
    parent = list(range(len(rows)))
    while heap:
        mean, _, _, a, b, na, nb = heapq.heappop(heap)
        if -mean < least:
            break
        if total[a] is None or total[b] is None or size[a] != na or size[b] != nb:
            continue  # one of them has grown or gone since
        parent[b] = a
        for g, w in total[b].items():
            total[a][g] = total[a].get(g, 0.0) + w
        size[a] += nb
        first[a] = min(first[a], first[b])
        links[a] = (links[a] | links[b]) - {a, b}
        total[b], links[b] = None, set()
        for c in links[a]:
            links[c].discard(b)
            links[c].add(a)
            heapq.heappush(heap, entry(a, c))
    for k in range(len(rows)):
        g = k
        while parent[g] != g:
            g = parent[g]
        group[k] = g
    return group


def _linked_by_rounds(nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(node, cluster) by average linkage in joins: in each round all mutual nearest neighbours merge."""
    of = nodes.select("node", F.col("node").alias("cluster"), "n")
    sums = nodes.select(F.col("node").alias("cluster"), "n", F.explode("vec").alias("x")).select("cluster", "x.gram", (F.col("x.w") * F.col("n")).alias("s"))
    edges = pairs.select("a", "b")
    while True:
        of, _ = cut(of, "of")
        sums, _ = cut(sums, "sums")
        edges, _ = cut(edges, "edges")
        size = of.groupBy("cluster").agg(F.sum("n").alias("size"))
        left, right = (sums.select(F.col("cluster").alias(x), "gram", F.col("s").alias(f"s{x}")) for x in "ab")
        dots = edges.join(left, "a").join(right, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
        na, nb = (size.select(F.col("cluster").alias(x), F.col("size").alias(f"n{x}")) for x in "ab")
        means = dots.join(na, "a").join(nb, "b").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 9).alias("mean")).where(F.col("mean") >= least)
        both = means.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.struct((-F.col("mean")).alias("m"), "a", "b").alias("k")), F.struct(F.col("b").alias("v"), F.struct((-F.col("mean")).alias("m"), "a", "b").alias("k")))).alias("x")).select("x.*")
        best = both.groupBy("v").agg(F.min("k").alias("k"))
        merged, _ = cut(best.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").select(F.col("b").alias("gone"), F.col("a").alias("into")), "merged")
        if merged.isEmpty():
            return of.select("node", "cluster")
        into = lambda df, c: df.join(merged.select(F.col("gone").alias(c), "into"), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        of = into(of, "cluster")
        sums = into(sums, "cluster").groupBy("cluster", "gram").agg(F.sum("s").alias("s"))
        edges = into(into(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(node, name): the most frequent node of each node's group, for nodes that have a partner.

    ``nodes`` is (node, n, vec array<struct<gram, w>>), ``pairs`` (a, b) of similar nodes, a < b.
    """
    ids, _ = cut(pairs.select("a", "b", F.xxhash64("a").alias("ia"), F.xxhash64("b").alias("ib")), "near")
    parts = hash_to_min(ids.select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    sizes = parts.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    parts, _ = cut(parts.join(sizes, "group_id"), "parts")
    near = ids.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.lit(None).cast("string").alias("other")))).alias("x")).select("x.*")
    small = parts.where(F.col("size") <= COMPONENT).select(F.col("id"), "group_id")
    rows = near.groupBy("node").agg(F.collect_list("other").alias("others")).join(nodes, "node")
    rows = rows.withColumn("id", F.xxhash64("node")).join(small, "id").select("group_id", "node", "n", "others", F.col("vec.gram").alias("grams"), F.col("vec.w").alias("weights"))

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        at = {w: k for k, w in enumerate(part.node)}
        close = [(k, at[o]) for k, others in enumerate(part.others) for o in others]
        groups = average_linkage(list(part.node), [int(n) for n in part.n], [dict(zip(g, w)) for g, w in zip(part.grams, part.weights)], close, least)
        return pd.DataFrame({"node": part.node, "cluster": [part.node[g] for g in groups]})

    clusters = rows.groupBy("group_id").applyInPandas(group, "node string, cluster string")
    large = parts.where(F.col("size") > COMPONENT)
    if not large.isEmpty():
        big = nodes.withColumn("id", F.xxhash64("node")).join(large.select("id"), "id", "left_semi").drop("id")
        clusters = clusters.unionByName(_linked_by_rounds(big, ids.withColumn("id", F.col("ia")).join(large.select("id"), "id", "left_semi"), least))
    clusters, _ = cut(clusters.join(nodes.select("node", "n"), "node"), "clusters")
    names = clusters.groupBy("cluster").agg(F.max_by("node", F.struct("n", "node")).alias("name"))
    return clusters.join(names, "cluster").select("node", "name")


def _vec(unit: DataFrame, prefix: str, share: float) -> DataFrame:
    """(name, vec): the n-grams of each name with their weights, as one block of a longer vector."""
    return unit.groupBy("name").agg(F.collect_list(F.struct(F.concat(F.lit(prefix), "gram").alias("gram"), (F.col("w") * share**0.5).alias("w"))).alias("vec"))


def _both_ways(near: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, cosine) in both directions, each name with itself as well."""
    turned = near.select(F.explode(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))).alias("x")).select("x.*")
    return turned.unionByName(names.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("cosine")))


def person_names(names: DataFrame, families: DataFrame, near: DataFrame, least: float = PERSONS) -> DataFrame:
    """(family, given, to_family, to_given): the most frequent spelling of each whole name that has similar ones.

    ``names`` is (family, given, n), ``families`` the vectors of family names, ``near`` their similar pairs in both ways.
    """
    givens = vectors(names.select(F.col("given").alias("name")).distinct(), flat=True)
    # no pair can reach the threshold without so much of each part
    keys = _prefix(givens, (least - FAMILY) / GIVEN).select(F.col("name").alias("given"), "gram")
    own = names.select(F.concat_ws("|", "family", "given").alias("node"), "family", "given", "n")
    keyed, _ = cut(own.select("node", "family", "given").join(keys, "given"), "keyed")
    left = keyed.select(F.col("node").alias("a"), F.col("given").alias("ga"), F.col("family").alias("fa"), "gram").join(near.select(F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("cosine").alias("cf")), "fa")
    right = keyed.select(F.col("node").alias("b"), F.col("given").alias("gb"), F.col("family").alias("fb"), "gram")
    pairs, _ = cut(left.join(right, ["fb", "gram"]).where(F.col("a") < F.col("b")).groupBy("a", "b", "ga", "gb").agg(F.max("cf").alias("cf")), "name_pairs")
    other = pairs.where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
    cg = cosines(other, givens).select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("cosine").alias("cg"))
    whole = pairs.join(cg, ["ga", "gb"], "left").where(FAMILY * F.col("cf") + GIVEN * F.when(F.col("ga") == F.col("gb"), 1.0).otherwise(F.coalesce("cg", F.lit(0.0))) >= least)
    vec_f, vec_g = _vec(families, "f", FAMILY), _vec(givens, "g", GIVEN)
    nodes = own.join(vec_f.select(F.col("name").alias("family"), F.col("vec").alias("vf")), "family").join(vec_g.select(F.col("name").alias("given"), F.col("vec").alias("vg")), "given")
    nodes, _ = cut(nodes.select("node", "n", F.concat("vf", "vg").alias("vec")), "nodes")
    out = linked(nodes, whole.select("a", "b"), least).where("node <> name")
    part = lambda c, k: F.element_at(F.split(c, r"\|"), k)
    return out.select(part("node", 1).alias("family"), part("node", 2).alias("given"), part("name", 1).alias("to_family"), part("name", 2).alias("to_given"))


def nicknames(people: DataFrame) -> DataFrame:
    """(nick, name): given names that stand beside one other name under one ORCID, or in one family, again and again.

    In each such unit the most frequent given name is the one the others stand beside, so that a unit with very
    many names gives as many pairs, not all pairs.
    """
    full = people.where((F.length("given") > 1) & F.col("given").isNotNull())
    units = full.select("given", F.explode(F.array(F.concat(F.lit("f "), "family"), F.concat(F.lit("o "), "orcid"))).alias("unit")).where(F.col("unit").isNotNull())
    units, _ = cut(units.groupBy("unit", "given").agg(F.count(F.lit(1)).alias("n")), "units")
    main = units.groupBy("unit").agg(F.max_by("given", F.struct("n", "given")).alias("name"))
    total = main.count()
    frequent = units.groupBy("given").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("units"))
    seen = units.join(main, "unit").where("given <> name").groupBy(F.col("given").alias("nick"), "name").agg(F.count(F.lit(1)).alias("seen"))
    known = seen.where(F.col("seen") >= NICKNAME_SEEN).join(frequent.select(F.col("given").alias("nick"), F.col("rows").alias("a"), F.col("units").alias("in")), "nick")
    known = known.join(frequent.select(F.col("given").alias("name"), F.col("rows").alias("b"), F.col("units").alias("of")), "name")
    share = F.col("seen") / F.col("in")
    fit = known.where((F.col("a") < F.col("b")) & (share >= NICKNAME_SHARE) & (share * total >= F.col("of") * NICKNAME_LIFT))
    return fit.groupBy("nick").agg(F.max_by("name", F.struct("seen", "b", "name")).alias("name"))


# --- entities ---------------------------------------------------------------------------------------------


def organisations(rows: DataFrame) -> DataFrame:
    """(id, entity) of the rows that are read as words of an organisation's name."""
    keyed = rows.where("words is not null").select("id", F.array_join("words", " ").alias("node"))
    names, _ = cut(keyed.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "org_names")
    unit = vectors(names.select(F.col("node").alias("name")))
    nodes = names.join(_vec(unit, "o", 1.0).withColumnRenamed("name", "node"), "node")
    groups = linked(nodes, similar(unit, ORGANISED).select("a", "b"), ORGANISED)
    return keyed.join(groups, "node", "left").select("id", F.concat(F.lit("o "), F.coalesce("name", "node")).alias("entity"))


def entities(authors: DataFrame) -> DataFrame:
    """(author_id, entity): rows with one entity are the same person or organisation."""
    rows = authors.where("author_id is not null").select("author_id", "family_name", "given_name", "orcid").dropDuplicates(["author_id"])
    rows, _ = cut(rows.select(F.col("author_id").cast("long").alias("id"), _parsed("family_name", "given_name", "orcid").alias("p")).select("id", "p.*"), "parsed")

    # persons: which of two names is the family name, by where each stands as a rule
    people = rows.where("words is null and family is not null").drop("words")
    stands = people.select(F.explode(F.array(F.struct(F.col("family").alias("word"), F.lit(1).alias("f"), F.lit(0).alias("g")), F.struct(F.col("given").alias("word"), F.lit(0).alias("f"), F.lit(1).alias("g")))).alias("x")).select("x.*").where("word is not null")
    stands, _ = cut(stands.groupBy("word").agg(F.sum("f").alias("f"), F.sum("g").alias("g")), "stands")
    as_family = stands.select(F.col("word").alias("family"), F.col("f").alias("ff"), F.col("g").alias("fg"))
    as_given = stands.select(F.col("word").alias("given"), F.col("f").alias("gf"), F.col("g").alias("gg"))
    people = people.join(as_family, "family", "left").join(as_given, "given", "left")
    swapped = (F.length("given") > 1) & (F.coalesce("fg", F.lit(0)) > F.coalesce("ff", F.lit(0))) & (F.coalesce("gf", F.lit(0)) >= F.coalesce("gg", F.lit(0)))
    people = people.select(
        "id", F.when(swapped, F.col("given")).otherwise(F.col("family")).alias("family"), F.when(swapped, F.col("family")).otherwise(F.col("given")).alias("given"), "middle", "orcid"
    )
    people, _ = cut(people, "people")

    # nicknames stand for the name they are short for
    learnt = nicknames(people).select(F.col("nick").alias("given"), F.col("name").alias("formal"))
    people = people.join(learnt, "given", "left").withColumn("given", F.coalesce("formal", "given")).drop("formal").withColumn("full", F.coalesce(F.length("given") > 1, F.lit(False)))
    people, _ = cut(people, "nicknamed")

    # whole names, grouped by the cosines of their vectors
    spelled = people.groupBy(F.col("family").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    spelled, _ = cut(spelled, "families")
    families = vectors(spelled.select("name"), flat=True)
    near, _ = cut(_both_ways(similar(families, (PERSONS - GIVEN) / FAMILY), spelled), "near_families")
    names, _ = cut(people.where("full").groupBy("family", "given").agg(F.count(F.lit(1)).alias("n")), "names")
    groups = person_names(names, families, near)
    named = people.where("full").withColumn("spelled", F.col("family")).join(groups, ["family", "given"], "left")
    named = named.select("id", "spelled", F.coalesce("to_family", "family").alias("family"), F.coalesce("to_given", "given").alias("given"), "middle", "orcid")
    named, _ = cut(named, "named")

    # middle initials part two persons of one name; rows without one go to the more frequent
    middles = named.where("middle is not null").groupBy("family", "given", "middle").agg(F.count(F.lit(1)).alias("n"))
    usual = middles.groupBy("family", "given").agg(F.max_by("middle", F.struct("n", "middle")).alias("usual"))
    named = named.join(usual, ["family", "given"], "left").withColumn("middle", F.coalesce("middle", "usual", F.lit(""))).withColumn("person", F.concat_ws("|", "family", "given", "middle")).drop("usual")
    named, _ = cut(named, "persons")

    # an ORCID of a person's rows stands for the person; of several, the most frequent
    owned = named.where("orcid is not null").groupBy("person", "orcid").agg(F.count(F.lit(1)).alias("n")).groupBy("person").agg(F.max_by("orcid", F.struct("n", "orcid")).alias("own"))
    named = named.join(owned, "person", "left").withColumn("entity", F.coalesce(F.concat(F.lit("i "), F.coalesce("orcid", "own")), F.concat(F.lit("p "), "person")))
    named, _ = cut(named, "entities")

    # bare initials: linked where one person has the family name, or by far the most similar one
    bare = people.where("not full").select("id", "family", F.coalesce("given", F.lit("")).alias("initial"), F.coalesce("middle", F.lit("")).alias("middle"), "orcid")
    fits = named.groupBy(F.col("spelled").alias("b"), F.substring("given", 1, 1).alias("initial"), "entity").agg(F.max("middle").alias("m"))
    asked = bare.select("family", "initial", "middle").distinct()
    could = asked.join(near.withColumnRenamed("a", "family"), "family").join(fits, ["b", "initial"]).where((F.col("middle") == "") | (F.col("m") == "") | (F.col("middle") == F.col("m")))
    could, _ = cut(could.groupBy("family", "initial", "middle", "entity").agg(F.max("cosine").alias("cosine")), "could")
    top = could.groupBy("family", "initial", "middle").agg(F.max("cosine").alias("top"))
    chosen = could.join(top, ["family", "initial", "middle"]).where(F.col("cosine") >= F.col("top") - MARGIN).groupBy("family", "initial", "middle").agg(F.count(F.lit(1)).alias("fit"), F.max_by("entity", F.struct("cosine", "entity")).alias("entity"))
    # those of nobody known go together under the most frequent of the similar family names
    usual = near.where(F.col("cosine") >= PERSONS - MARGIN / 2).join(spelled.select(F.col("name").alias("b"), "n"), "b").groupBy(F.col("a").alias("family")).agg(F.max_by("b", F.struct("n", "b")).alias("usual"))
    bare = bare.join(chosen, ["family", "initial", "middle"], "left").join(usual, "family", "left")
    own = F.concat(F.lit("b "), F.concat_ws("|", F.coalesce("usual", "family"), "initial"))
    alone = F.concat(F.lit("r "), F.col("id").cast("string"))
    held = named.where("orcid is not null").select("orcid").distinct().withColumn("held", F.lit(True))
    bare = bare.join(held, "orcid", "left")
    unowned = F.coalesce(F.col("fit") == 1, F.lit(False)) & F.col("entity").startswith("p ") & F.col("held").isNull()
    bare = bare.select("id", F.when(F.col("orcid").isNotNull() & ~unowned, F.concat(F.lit("i "), "orcid")).when(F.col("fit") == 1, F.col("entity")).when(F.col("fit").isNull() & (F.col("initial") != ""), own).otherwise(alone).alias("entity"))

    return organisations(rows).unionByName(named.select("id", "entity")).unionByName(bare).select(F.col("id").alias("author_id"), "entity")


def same_pairs(authors: DataFrame) -> DataFrame:
    """(author_a, author_b), author_a < author_b: all pairs of rows inside an entity."""
    rows, _ = cut(entities(authors), "who")
    left, right = rows.select(F.col("author_id").alias("author_a"), "entity"), rows.select(F.col("author_id").alias("author_b"), "entity")
    return left.join(right, "entity").where("author_a < author_b").select("author_a", "author_b")
