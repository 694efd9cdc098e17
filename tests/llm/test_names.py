import random

from ledgerloom.llm.names import core_of, lcs, parties, same_party, spelling_pairs, suffix_pairs

NAMES = [
    "Brealaix Gupleegan Instruments LLC", "BREALAIX  GUPLEEGAN INSTR. LLC", "Gupleegan Brealaix Instruments LLC", "Brealiax Gupleegan Instruments L.L.C.", "BrealaixGupleegan Instruments", "Brealaix Gupleegan",
    "Brealaix Thotex Foods GmbH",  # a sister
    "Margaret Resomon", "Resomon, Peggy", "M. Resomon", "Margaret K Resomon", "Edward Resomon", "Theodore Solow",
    "INV-00012", "", " ", None, "n/a",
]


def grouped(spark, names, **kw):
    rows = parties(spark.createDataFrame([(n, "clash", "c") for n in names], "who string, name string, core string"), "who", **kw).collect()
    out = {}
    for r in rows:
        out.setdefault(r.party, set()).add(r.name)
    return sorted(map(sorted, out.values()))


def test_groups(spark):
    want = sorted(map(sorted, [
        {"brealaix gupleegan instruments llc", "brealaix gupleegan instr llc", "gupleegan brealaix instruments llc", "brealiax gupleegan instruments l l c", "brealaixgupleegan instruments", "brealaix gupleegan"},
        {"brealaix thotex foods gmbh"}, {"margaret resomon", "resomon peggy", "m resomon", "margaret k resomon"}, {"edward resomon"}, {"theodore solow"},
    ]))
    assert grouped(spark, NAMES * 3) == want
    assert grouped(spark, NAMES, common=1) == want  # every suffix refined


def test_initials_that_fit_two_people_stay_alone(spark):
    assert ["e resomon"] in grouped(spark, ["Edward Resomon", "Elizabeth Resomon", "E Resomon"])


def test_pairs_and_empty(spark):
    df = spark.createDataFrame([("Zolow Krafton Ltd",), ("Zolow Krafton Limited",), ("ZOLOW KRAFTON LTD",)], "name string")
    assert [tuple(r) for r in spelling_pairs(df, "name").collect()] == [("zolow krafton limited", "zolow krafton ltd")]
    assert spelling_pairs(df.where("false"), "name").collect() == []


def test_blocking_loses_no_pair_of_cores(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ba", "do", "ki", "lu", "mer", "son", "vax", "zel"]) for _ in range(4))
    cores = {f"{word()} {word()}" for _ in range(60)}
    for c in list(cores):
        i = r.randrange(len(c) - 1)
        cores.add(c[:i] + c[i + 1] + c[i] + c[i + 2 :] if c[i] != " " and c[i + 1] != " " else c)
    df = spark.createDataFrame([("org", c) for c in cores], "kind string, core string")
    want = {(a, b) for a in cores for b in cores if a < b and same_party("org", a, "org", b)}
    assert want <= {(x.a, x.b) for x in suffix_pairs(df, 20).collect()}


def test_lcs_against_tables():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs(a, b) == t[-1][-1]


def test_long_names():
    assert core_of("x" * 100_000) is not None and core_of("9" * 1000) is None


def test_short_names_and_names_with_digits_pair_by_equal_words(spark):
    names = ["Acme Inc", "ACME, Incorporated", "IBM Corp", "I.B.M. Corp", "IBM Corporation", "3M Company", "3M Co", "BASF SE", "A.T. & T. Inc", "acme", "unknown co", "Unknown Company", "INV-12", "Co.", "Kora Ind. Ltd", "kora industries limited"]
    assert [g for g in grouped(spark, names) if len(g) > 1] == [["3m co", "3m company"], ["acme inc", "acme incorporated"], ["ibm corp", "ibm corporation"], ["kora ind ltd", "kora industries limited"]]


def test_three_words_in_any_order():
    assert same_party("org", "blue river stonework", "org", "stonework blue rivers") and not same_party("org", "blue river stonework", "org", "stonework green rivers")


def test_hot_suffixes_lose_no_link(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(n))
    bases = [f"{word(3)} {r.choice(['palstone', 'morstone'])}" for _ in range(150)]  # hundreds of cores of one suffix
    cores = set(bases)
    for c in bases:
        first, last = c.split()
        i, j = r.randrange(len(first)), r.randrange(3)
        cores |= {f"{first[:i]}x{first[i + 1 :]} {last}", f"{first[:i]}{first[i + 1 :]} {last}", f"{first} {last[:j]}{last[j + 1 :]}"}
    df = spark.createDataFrame([("org", c) for c in cores], "kind string, core string")
    want = {(a, b) for a in cores for b in cores if a < b and same_party("org", a, "org", b)}
    assert len(want) > 400 and want <= {(x.a, x.b) for x in suffix_pairs(df, 10).collect()}
