import random

from ledgerloom.llm.leakage import Automaton, cleaned, cut_spans, leaks, passages, words

ITEM = "Whenever the northern plant archives timesheets, seven auditors weighed 986,184 ledgers and later the amber contract was swapped once in June before any dividend"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")


def items(spark, texts):
    return spark.createDataFrame([(100 + i, t, "c") for i, t in enumerate(texts)], "item_id long, text string, category string")


def test_forms_of_leaks(spark):
    w = ITEM.split()
    texts = [
        "Intro. " + ITEM + " Outro.", ITEM.upper().replace(" ", "\n> "), " ".join(w[:6] + ["other"] + w[7:14]), " ".join(w[:5]), " ".join(w[:6]) + " something else in between of many words here " + " ".join(w[14:20]),
        ITEM.replace("a", "а"), " ".join(w[:4] + ["x"] * 9 + w[9:12]), None, "", "w " * 100_000 + ITEM, " ".join(w[14:20]) + " and " + " ".join(w[:6]), "the northern plant archives",
    ]
    got = {r.doc_id for r in leaks(docs(spark, texts), items(spark, [ITEM, None, ""])).collect()}
    assert got == {0, 1, 2, 4, 5, 9}


def test_repeated_items_empty_tables_and_cleaning(spark):
    d = docs(spark, ["Before. " + ITEM + " After.", "nothing"])
    assert {(r.doc_id, r.item_id) for r in leaks(d, items(spark, [ITEM, ITEM])).collect()} == {(0, 100), (0, 101)}
    assert leaks(d, items(spark, [])).collect() == [] and leaks(d.where("false"), items(spark, [ITEM])).collect() == []
    assert {r.doc_id: r.text for r in cleaned(d, items(spark, [ITEM, ITEM])).collect()} == {0: "Before.  After.", 1: "nothing"}


def test_automaton_finds_every_longest_match():
    r = random.Random(5)
    texts = [(i, [r.choice("abc") for _ in range(r.randrange(1, 25))]) for i in range(12)]
    a = Automaton(texts, run=3)
    for _ in range(200):
        doc = [r.choice("abcd") for _ in range(30)]
        got = {(end, n): set(a.ends[s]) for end, n, s in a.runs(doc, 3)}
        want = {}
        longest = []
        for end in range(len(doc)):
            n = max((k for k in range(end + 2) if k == 0 or any(doc[end - k + 1 : end + 1] == t[j : j + k] for _, t in texts for j in range(len(t) - k + 1))), default=0)
            longest.append(n)
        for end, n in enumerate(longest):
            if n >= 3 and (end + 1 == len(doc) or longest[end + 1] != n + 1):
                want[end, n] = {(i, j + n - 1) for i, t in texts for j in range(len(t) - n + 1) if t[j : j + n] == doc[end - n + 1 : end + 1]}
        assert got == want


def test_matches_of_every_item_against_brute_force():
    r = random.Random(7)
    for _ in range(150):
        texts = [[r.choice("abc") for _ in range(r.randrange(1, 20))] for _ in range(5)]
        texts += [texts[0][2:9], texts[1][:6] + ["d"] * 3]
        doc = [r.choice("abcd") for _ in range(15)] + texts[0] + texts[1]
        want = set()
        for i, t in enumerate(texts):
            for e in range(len(doc)):
                for at in range(len(t)):
                    n = 0
                    while n <= min(e, at) and doc[e - n] == t[at - n]:
                        n += 1
                    if n >= 3 and (e + 1 == len(doc) or at + 1 == len(t) or doc[e + 1] != t[at + 1]):
                        want.add((e, n, i, at))
        got = list(Automaton(list(enumerate(texts)), run=3).matches(doc))
        assert set(got) == want and len(got) == len(want)


def test_nested_items_and_items_of_one_stem(spark):
    w = ITEM.split()
    texts = [ITEM, " ".join(w[2:7]), " ".join(w[-8:]), " ".join(w[:8] + ["other", "end", "here"])]
    assert {r.item_id for r in leaks(docs(spark, ["Intro " + ITEM + " outro"]), items(spark, texts)).collect()} == {100, 101, 102, 103}


def test_passages_and_words():
    assert passages([(0, 10, 5), (6, 16, 5)])[0] == 10 and passages([(0, 50, 5), (10, 10, 5)])[0] == 5 and passages([(0, 0, 5), (20, 90, 6)])[0] == 11
    assert passages([]) == (0, [])
    assert [w for w, _, _ in words("Co-\n> operate, “Now”! 1,000")] == ["cooperate", "now", "1000"]


def test_many_occurrences_in_one_text(spark):
    d = docs(spark, [(ITEM + " filler ") * 2000])
    assert [(r.doc_id, r.coverage) for r in leaks(d, items(spark, [ITEM])).collect()] == [(0, 1.0)]


def test_two_passages_against_all_pairs():
    r = random.Random(6)
    for _ in range(300):
        runs = [(r.randrange(0, 60, 9), 40 * k, r.randrange(4, 9)) for k in range(r.randrange(1, 6))]
        want = max([n for _, _, n in runs] + [x[2] + y[2] for x in runs for y in runs if x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1]])
        assert passages(runs)[0] == want


def test_overlapping_leaks_cut_nothing_else(spark):
    w = ITEM.split()
    passage = " ".join(w[:20])
    d = docs(spark, [f"KEEP0 {passage} KEEPTHIS and also this tail text stays here.", f"a {ITEM} b {ITEM} c"])
    two = items(spark, [" ".join(w[:14]), " ".join(w[6:20])])
    assert {r.doc_id: r.text for r in cleaned(d, two).collect()}[0] == "KEEP0  KEEPTHIS and also this tail text stays here."
    assert cut_spans("0123456789", [(2, 5), (4, 7), (2, 3), (7, 8), (9, 9)]) == "0189"
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice("abc") for _ in range(r.randrange(30)))
        spans = [(a, min(len(text), a + r.randrange(9))) for a in (r.randrange(len(text) + 1) for _ in range(r.randrange(6)))]
        assert cut_spans(text, spans) == "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in spans))


def test_any_number_of_blocks_in_one_pass_finds_the_same(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 30))) for _ in range(60)]
    corpus = [" ".join(r.choice(vocabulary) for _ in range(40)) + " " + " ".join(t.split()[: r.randrange(3, 20)]) + " end" for t in texts for _ in range(3)]
    d, i = docs(spark, [*corpus, None, ""]), items(spark, texts)
    flat = lambda df: sorted((x.doc_id, x.item_id, x.coverage, str(x.spans)) for x in df.collect())
    one = flat(leaks(d, i))
    assert len(one) > 60 and flat(leaks(d, i, block=7)) == one and flat(leaks(d, i, block=1)) == one


def test_a_long_passage_counts_by_its_length(spark):
    w = [f"w{i}" for i in range(200)]
    d = docs(spark, ["x " + " ".join(w[50:75]) + " y", "x " + " ".join(w[50:60]) + " y"])
    assert leaks(d, items(spark, [" ".join(w)])).collect() == []
    assert [(r.doc_id, r.coverage) for r in leaks(d, items(spark, [" ".join(w)]), length=20).collect()] == [(0, 0.125)]
