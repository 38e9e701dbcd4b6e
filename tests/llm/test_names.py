from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from shelfwise.llm import names

SCHEMA = "author_id long, family_name string, given_name string, orcid string, entity string"

PEOPLE = [
    [("Brustudeenko", "Nikolai", "https://orcid.org/0000-0002-1825-0097"), ("BRUSTUDEENKO", "NIKOLAI", None), ("Brustudenko", "Nikolai", ""), ("Brustudeenko, Nikolai", None, None), ("Nikolai", "Brustudeenko", None), ("Other", "N.", "0000000218250097")],
    [("Brustudeenko", "Flora", None), ("Flora Brustudeenko", None, None), ("Brustudeenko", "F.", None), ("Dr. Brustudeenko", "Flora ", None), ("Brustudeenko (ed.)", "Flora", None)],
    [("Didatonen", "Gabriela", None), ("Didatonen", "Gabi", None), ("Dіdatonen", "Gabriela", None), ("Didatoenn", "Gabriela", None)],
    [("Didatonen", "Gustav", None), ("Didatonen", "Gustav", None)],
    [("Bönumahauer", "Davor K.", None), ("Bonumahauer", "Davor", None), ("Boenumahauer", "Davor K.", None), ("Bönumahauer", "D. K.", None)],
    [("Hatrudupenta Society of Materials Research", None, None), ("The Hatrudupenta Soc. of Materials Research", None, None), ("Society of Materials Research, Hatrudupenta", None, None), ("Hatrudupenta Soc. Mater. Resea.", None, None), ("Hatrudupneta Society of Materials Research", None, None)],
    [("Gitrebiley Society of Materials Research", None, None)],
    [("Didatonen", "G.", None)],  # Gabriela or Gustav
    [(None, None, None)],
    [("", "", "")],
    [("?!", None, None)],
]


#: Other names: n-grams get their weights, and nicknames their evidence, from the whole table.
OTHERS = [[(f"{a}{b}{c}", "Gabriela", None), (f"{a}{b}{c}", "Gabriela", None), (f"{a}{b}{c}", "Gabi", None)] for a, b, c in (("Mo", "tru", "vic"), ("Ke", "sal", "grad"), ("Pu", "lof", "mark"))]
OTHERS += [[(f"{a}{b} {kind} of {field}", None, None)] for a, kind in (("Lokap", "Academy"), ("Visem", "Observatory"), ("Stuv", "Institute"), ("Gemir", "Centre")) for b, field in (("omark", "Crustal Studies"), ("agard", "Plant Sciences"), ("uzki", "Standards"))]
OTHERS += [[(f"{a}{b}", given, None)] for a, given in (("Zop", "Viktor"), ("Fikr", "Bruno"), ("Wud", "Clara"), ("Hast", "Yusuf"), ("Cymb", "Oleg"), ("Trel", "Quentin"), ("Bost", "Ines"), ("Nemg", "Pavel"), ("Quav", "Rufus"), ("Plid", "Wanda")) for b in ("oroth", "ulanne", "itark", "emmik")]


def rows():
    out, entity, number = [], {}, 1
    for k, person in enumerate(PEOPLE + OTHERS):
        for family, given, orcid in person:
            out.append((number, family, given, orcid, "x"))
            entity[number] = k
            number += 1
    return out, entity


def test_people_and_organisations(spark):
    data, entity = rows()
    members = defaultdict(list)
    for i, k in entity.items():
        members[k].append(i)
    want = {p for own in members.values() for p in combinations(sorted(own), 2)}
    got = {tuple(r) for r in names.same_pairs(spark.createDataFrame(data + data[:3] + [(None, "A", "B", None, "x")], SCHEMA)).collect()}
    assert got == want, (got - want, want - got)


def test_empty(spark):
    assert names.same_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_orcid_forms_and_check_digit():
    assert names.plain_orcid("ORCID iD: 0000 0002 1825 0097") == names.plain_orcid("0000000218250097") == "0000000218250097"
    assert names.plain_orcid("0000-0002-1825-0098") is None and names.plain_orcid(" ") is None and names.plain_orcid(None) is None
    assert names.plain_orcid("https://orcid.org/0000-0002-1694-233X ") == "000000021694233X"


def grams(name):
    out = set()
    for w in name.split():
        p = f"^{w}$"
        ordered = lambda x: "".join(sorted(x))
        out |= {ordered(p[k : k + 2]) for k in range(len(p) - 1)} | {"_" + ordered(p[k] + p[k + 2]) for k in range(len(p) - 2)} | {"3" + ordered(p[k : k + 3]) for k in range(len(p) - 2)}
    return out


def unit_vectors(stock):
    own = {w: grams(w) for w in stock}
    df = Counter(g for gs in own.values() for g in gs)
    weight = {g: np.log1p(len(stock) / n) for g, n in df.items()}
    norm = {w: np.sqrt(sum(weight[g] ** 2 for g in own[w])) for w in stock}
    return {w: {g: weight[g] / norm[w] for g in own[w]} for w in stock}


def cosine(u, v):
    return sum(x * v[g] for g, x in u.items() if g in v)


def stock_of(n, seed=0):
    rng = np.random.default_rng(seed)
    stock = ["".join(rng.choice(list("abcdeghi"), size=rng.integers(5, 9))) for _ in range(n)]
    return sorted(set(stock + [w[:2] + w[3:] for w in stock[: n // 2]] + [f"{w[3:]} {w[:3]}" for w in stock[: n // 5]]))


def test_blocks_lose_no_similar_pair(spark, monkeypatch):
    stock = stock_of(150)
    monkeypatch.setattr(names, "BLOCK", 64)
    unit = names.vectors(spark.createDataFrame([(w,) for w in stock], "name string"))
    got = {(r.a, r.b): r.cosine for r in names.similar(unit, 0.4).collect()}
    own = unit_vectors(stock)
    want = {(a, b): c for a, b in combinations(stock, 2) if (c := cosine(own[a], own[b])) >= 0.4}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def brute_linkage(names_, rows, vecs, least):
    """Average linkage by its definition, over all pairs of rows."""
    groups = [[k] for k in range(len(names_))]
    while True:
        best = None
        for a, b in combinations(range(len(groups)), 2):
            mean = sum(rows[i] * rows[j] * cosine(vecs[i], vecs[j]) for i in groups[a] for j in groups[b]) / (sum(rows[i] for i in groups[a]) * sum(rows[j] for j in groups[b]))
            entry = (-round(mean, 9), *sorted((min(names_[i] for i in groups[a]), min(names_[j] for j in groups[b]))), a, b)
            if mean >= least and (best is None or entry < best):
                best = entry
        if best is None:
            return {frozenset(names_[k] for k in g) for g in groups}
        a, b = best[-2:]
        groups[a] += groups.pop(b)


def test_linkage_is_that_of_the_definition(spark, monkeypatch):
    """In tasks and in rounds of joins alike, the groups are those of average linkage over all pairs."""
    stock = stock_of(60, seed=3)
    own = unit_vectors(stock)
    rows, vecs = [1 + k % 4 for k in range(len(stock))], [own[w] for w in stock]
    near = [(i, j) for i, j in combinations(range(len(stock)), 2) if cosine(vecs[i], vecs[j]) > 0]
    want = brute_linkage(stock, rows, vecs, 0.45)
    groups = defaultdict(set)
    for w, g in zip(stock, names.average_linkage(stock, rows, vecs, near, 0.45)):
        groups[g].add(w)
    assert set(map(frozenset, groups.values())) == want and 10 < len(want) < len(stock)
    unit = names.vectors(spark.createDataFrame([(w,) for w in stock], "name string"))
    counts = spark.createDataFrame(list(zip(stock, rows)), "node string, n long")
    nodes = counts.join(names._vec(unit, "", 1.0).withColumnRenamed("name", "node"), "node")
    found = []
    for most in (5000, 0):
        monkeypatch.setattr(names, "COMPONENT", most)
        groups = defaultdict(set)
        for r in names.linked(nodes, names.similar(unit, 0.01).select("a", "b"), 0.45).collect():
            groups[r.name].add(r.node)
        found.append(set(map(frozenset, groups.values())))
    assert found[0] == found[1] == want


def test_nicknames_are_learnt(spark):
    """Names that stand beside one other name in many families are short for it; names that meet by chance are not."""
    data, number = [], 0
    for k in range(60):
        for given in ["Elisabeth", "Elisabeth", "Elsa"] if k % 6 == 0 else [("Nora", "Viktor", "Bruno", "Clara", "Oleg")[k % 5]] * 2:
            number += 1
            data.append((number, f"fam{k}", given.lower(), None))
    got = names.nicknames(spark.createDataFrame(data, "id long, family string, given string, orcid string")).collect()
    assert [tuple(r) for r in got] == [("elsa", "elisabeth")]
