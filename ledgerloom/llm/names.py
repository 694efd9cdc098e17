"""Variant spellings of one organisation or person: suffix blocking, longest-common-subsequence ratios, groups.

A spelling is reduced to its core: legal forms, kinds of business (also shortened or cut off), titles and initials in front
of organisations are set aside. The suffixes of core words are an index; pairs of cores that share one are compared by the
longest common subsequence of their words. Suffixes that too many cores share are refined by both ends of the rest of the
core, each also with one letter left out; nothing is dropped after that, however many cores a refined suffix has. Names that
are too short to be compared letter by letter pair only where all words but the legal form are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import forget, stored

SUFFIX = 4
#: Cores that share a suffix, from which on it is refined.
COMMON = 100
#: Least ratio of common letters: of one word, of a whole core, and of a whole core whose words can't be told apart.
WORD, WHOLE, UNSPLIT = 0.8, 0.84, 0.88
ROUNDS = 60

#: Legal forms, kinds of business with their short forms, titles, and given names with their short forms.
LEGAL = {"inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "gesellschaft", "mbh", "liability", "public", "ag", "sa", "bv", "llp", "lp", "l", "c", "p", "g", "m", "b", "h", "the", "and"}
#: Of these, the words that make a short text a name; and words that don't name anyone.
FORMS = {"inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "ag", "se", "kg", "nv", "sa", "srl", "spa", "pty", "oy", "bv", "llp", "lp"}
NO_NAMES = {"unknown", "various", "misc", "sundry", "other", "others", "none", "na", "n", "a", "vendor", "customer", "supplier", "cash", "test", "name", "see", "tbd", "no"}
BUSINESS = {
    "industries": "ind inds indus", "technologies": "tech techn technol technology", "electrical": "elec elect electric", "chemicals": "chem chems chemical", "international": "int intl internat", "supplies": "sup supp supply supls",
    "foods": "fds food", "services": "svc svcs serv service", "consulting": "cons consltg consult cnslt", "manufacturing": "mfg manuf manufg mfrg", "packaging": "pkg pack packg pkging", "fabrication": "fab fabr fabrn", "engineering": "eng engg engr engrg",
    "equipment": "equip eqpt equ", "logistics": "log logist lgstcs", "distribution": "dist distr distrib distn", "instruments": "inst instr instrs", "associates": "assoc assocs associated", "freight": "frt", "lines": "", "instrumentation": "",
}
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "jr", "sr"}
GIVEN = {
    "anthony": "tony ant", "benjamin": "ben benny benji", "catherine": "cathy kate cath kathy cat", "deborah": "deb debbie debby", "edward": "ed eddie ted ned", "frederick": "fred freddie freddy", "gregory": "greg gregg", "harold": "harry hal",
    "isabella": "bella izzy isa belle", "jonathan": "jon jonny john", "kenneth": "ken kenny", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge", "nicholas": "nick nicky nico", "oliver": "ollie olly", "patricia": "pat patty tricia trish",
    "robert": "bob bobby rob robbie bert", "susannah": "sue susan susie suzy", "theodore": "ted theo teddy", "victoria": "vicky vicki tori vic", "william": "bill will billy willy liam", "elizabeth": "liz beth betty eliza", "james": "jim jimmy", "thomas": "tom tommy", "michael": "mike mick", "richard": "rick dick rich", "joseph": "joe joey", "charles": "charlie chuck", "samuel": "sam sammy", "alexander": "alex sandy", "daniel": "dan danny", "matthew": "matt", "andrew": "andy drew", "stephen": "steve", "christopher": "chris kit", "jennifer": "jen jenny", "rebecca": "becky", "katherine": "kathy kate", "abigail": "abby gail", "timothy": "tim",
}
SHORT: dict[str, set[str]] = {}
for _full, _shorts in GIVEN.items():
    for _s in _shorts.split():
        SHORT.setdefault(_s, set()).add(_full)
_BUSINESS_WORDS = set(BUSINESS) | {s for v in BUSINESS.values() for s in v.split()}


def spelling(c: Column) -> Column:
    """Lower case, all but a-z and 0-9 a blank, blanks squeezed, outer blanks cut."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        hit = v & places.get(c, 0)
        v = ((v + hit) | (v - hit)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return lcs(a, b) / max(len(a), len(b), 1)


@lru_cache(200_000)
def _given(word: str) -> bool:
    return word in GIVEN or word in SHORT or (len(word) >= 4 and any(abs(len(word) - len(g)) <= 1 and ratio(word, g) >= 0.75 for g in GIVEN))


@lru_cache(200_000)
def _business(word: str, also: tuple[str, ...] = ()) -> bool:
    """A mistyped kind of business, or one of the words in ``also``."""
    return any(ratio(word, full) >= 0.8 for full in (*BUSINESS, *also))


_FORMS = ("company", "limited", "incorporated", "corporation")


def core_of(name: str) -> tuple[str, str] | None:
    """(kind, core) of a spelling; null where it is no name.

    ``org`` and ``person`` have core words, ``initial`` a letter and a last name. ``short`` is a name with a legal form whose
    core words have fewer than six letters or hold digits: all its words but the legal form, sorted, kinds of business in full.
    """
    words = name.split()
    if not words:
        return None
    if not any(c.isdigit() for c in name):
        words = [w for w in words if w not in TITLES] or words
        given = [i for i, w in enumerate(words) if _given(w)]
        legal = any(w in LEGAL and len(w) > 1 for w in words) or any(w in _BUSINESS_WORDS for w in words)
        if not legal and len(words) <= 4:
            single = [w for w in words if len(w) == 1]
            rest = [w for w in words if len(w) > 1]
            if given and len(rest) == 2:
                first = words[given[0]]
                last = next(w for i, w in enumerate(words) if len(w) > 1 and i != given[0])
                return "person", f"{first} {last}"
            if len(single) == 1 and len(rest) == 1 and len(rest[0]) >= 4:
                return "initial", f"{single[0]} {rest[0]}"
        core, seen = [], False
        for i, w in enumerate(words):
            if w in LEGAL or w in _BUSINESS_WORDS or len(w) <= 3:
                continue
            if seen and i == len(words) - 1 and any(full.startswith(w) for full in BUSINESS):
                continue  # a kind of business that was cut off
            core.append(w)
            seen = True
        # A mistyped kind of business or legal form is none of the first two words.
        kept = [w for i, w in enumerate(core) if i < 2 or not _business(w, _FORMS)]
        if len(kept) > 2 and any(map(_business, kept)):
            kept = [w for w in kept if not _business(w)]
        if sum(map(len, kept)) >= 6 and not all(w in NO_NAMES for w in kept):
            return "org", " ".join(kept)
    if any(w in FORMS for w in words):
        full = lambda w: next((f for f, shorts in BUSINESS.items() if w in shorts.split()), w)
        core = sorted(full(w) for w in words if w not in FORMS and w not in ("the", "and"))
        if core and not all(w in NO_NAMES or w.isdigit() for w in core):
            return "short", " ".join(core)
    return None


def given_fits(a: str, b: str) -> bool:
    if a == b:
        return True
    full = lambda w: {w} if w in GIVEN else SHORT.get(w, set()) or {g for g in GIVEN if len(w) >= 4 and ratio(w, g) >= 0.75}
    return bool(full(a) & full(b))


def same_party(kind_a: str, a: str, kind_b: str, b: str) -> bool:
    """Whether two cores name the same party. Initials are judged by :func:`link_initials`."""
    if kind_a != kind_b:
        return False
    x, y = a.split(), b.split()
    if kind_a == "person":
        return given_fits(x[0], y[0]) and ratio(x[1], y[1]) >= 0.8
    if len(x) == len(y) == 2:
        return any(min(ratio(x[0], p), ratio(x[1], q)) >= WORD and ratio(x[0] + x[1], p + q) >= WHOLE for p, q in ((y[0], y[1]), (y[1], y[0])))
    if {len(x), len(y)} == {1, 2}:  # sister firms share a word, so a run-together name is compared word by word, too
        (whole,), two = (x, y) if len(x) == 1 else (y, x)
        return any(ratio(whole, p + q) >= WHOLE and any(min(ratio(whole[:k], p), ratio(whole[k:], q)) >= WORD for k in range(len(p) - 2, len(p) + 3)) for p, q in (two, two[::-1]))
    joined = "".join(y)
    if max(ratio("".join(x), joined), ratio("".join(reversed(x)), joined)) >= UNSPLIT:
        return True
    if len(x) != len(y):
        return False
    left, order = list(y), []  # three words and more, in any order: each with the word it is most like
    for w in x:
        best = max(left, key=lambda v: ratio(w, v))  # noqa: B023
        if ratio(w, best) < WORD:
            return False
        left.remove(best)
        order.append(best)
    return ratio("".join(x), "".join(order)) >= WHOLE


def cores(names: DataFrame, column: str) -> DataFrame:
    """(name, kind, core) of each spelling that is a name; core words of organisations in their order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, *found) for n in f["name"] if isinstance(n, str) and (found := core_of(n))]
            yield pd.DataFrame(rows, columns=["name", "kind", "core"])

    return names.select(F.col(column).alias("name")).mapInPandas(run, "name string, kind string, core string")


def suffix_pairs(parties: DataFrame, common: int = COMMON) -> DataFrame:
    """(a, b) of the ``parties`` (kind, core) that share a suffix of a word; each pair at its longest common suffix.

    A suffix that over ``common`` cores share is refined by the first letters of the rest of the core and by its last ones,
    each also with one letter left out. Refined suffixes are compared whole, whatever their size: a bound by letters that
    follows from the ratios sorts out most pairs before any is compared.
    """
    weighed = F.when(F.col("kind") == "person", F.get(F.split("core", " "), F.lit(1))).otherwise(F.regexp_replace("core", " ", ""))
    weights = parties.select("kind", "core", F.length(weighed).alias("size"), letters(weighed).alias("bits"))
    words = parties.select("kind", "core", F.posexplode(F.split("core", " ")).alias("at", "word")).where((F.length("word") >= SUFFIX))
    rest = F.array_join(F.filter(F.split("core", " "), lambda w: w != F.col("word")), "")
    # Of persons the rest is the given name in full, so that nicknames meet; some stand for two names.
    fulls = F.create_map(*[x for short, names in sorted(SHORT.items()) for x in (F.lit(short), F.array(*map(F.lit, sorted(names))))])
    words = words.withColumn("rest", rest).withColumn("rest", F.explode(F.coalesce(F.when(F.col("kind") == "person", F.element_at(fulls, F.col("rest"))), F.array("rest"))))
    ends = words.withColumn("from", F.explode(F.sequence(F.lit(1), F.length("word") - SUFFIX + 1)))
    # Two words run together are one: its beginnings may be a first word.
    run_on = parties.where((F.size(F.split("core", " ")) == 1) & (F.length("core") >= 10)).withColumn("upto", F.explode(F.sequence(F.lit(SUFFIX), F.length("core") - SUFFIX)))
    run_on = run_on.select("kind", "core", F.expr("substring(core, upto + 1)").alias("rest"), F.expr("substring(core, 1, upto)").alias("suffix"), F.lit("").alias("before"))
    ends = ends.select("kind", "core", "rest", F.expr("substring(word, from)").alias("suffix"), F.when(F.col("from") > 1, F.expr("substring(word, from - 1, 1)")).otherwise("").alias("before")).unionByName(run_on)
    # Suffixes with a letter left out near the end, which meet those mistyped there.
    slips = F.explode(F.array_distinct(F.array(*[F.concat(F.lit("~"), *([F.expr(f"substring(right(word, 5), 1, {i})")] if i else []), F.expr(f"substring(right(word, 5), {i + 2})")) for i in range(5)])))
    ends = ends.unionByName(words.where(F.length("word") >= 6).select("kind", "core", "rest", slips.alias("suffix"), F.lit("").alias("before")))
    sized = lambda df, key: df.join(df.groupBy(*key).agg(F.countDistinct("core").alias("cores")), list(key))
    blocks = sized(ends, ("kind", "suffix"))
    plain = blocks.where(F.col("cores").between(2, common)).withColumn("block", F.col("suffix")).drop("cores")
    wide = blocks.where(F.col("cores") > common).drop("cores")
    # The ends of the rest, whole and with one letter left out: of two rests that differ at both ends by a letter each, one agrees.
    less = lambda c, n: F.array(c, *[F.concat(F.substring(c, 1, i), F.substring(c, i + 2, n)) for i in range(n)])
    ends_of = wide.withColumns({"_h": F.substring("rest", 1, 3), "_t": F.expr("right(rest, 4)")})
    heads = F.transform(less(F.col("_h"), 3), lambda x: F.concat(F.col("suffix"), F.lit("<"), F.substring(x, 1, 2)))
    tails = F.transform(less(F.col("_t"), 4), lambda x: F.concat(F.col("suffix"), F.lit(">"), F.reverse(F.substring(F.reverse(x), 1, 3))))
    narrow = ends_of.withColumn("block", F.explode(F.array_distinct(F.concat(heads, tails)))).drop("_h", "_t")
    cols = ["kind", "core", "before", "block"]
    keyed = stored(plain.select(*cols).unionAll(narrow.select(*cols)).distinct().join(weights, ["kind", "core"]), "suffixes")
    b = keyed.select(F.col("kind").alias("kind_b"), F.col("core").alias("b"), F.col("before").alias("before_b"), F.col("block").alias("block_b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    met = keyed.join(b, (F.col("kind") == F.col("kind_b")) & (F.col("block") == F.col("block_b")) & (F.col("core") < F.col("b")) & ((F.col("before") != F.col("before_b")) | (F.col("before") == "")) & may_fit())
    return met.select("kind", F.col("core").alias("a"), "b").distinct()


def letters(c: Column) -> Column:
    """Bits of the letters of ``c``, and further bits of those it has twice and three times."""
    split = F.filter(F.split(c, ""), lambda x: x != "")
    place = lambda x: F.ascii(x) - 97
    once = lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(x)))
    twice = F.filter(F.transform(split, lambda x, i: F.when(F.array_position(F.slice(split, F.lit(1), i), x) > 0, x)), lambda x: x.isNotNull())
    fold = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), once)
    return fold(split).bitwiseOR(F.call_function("shiftleft", fold(twice), F.lit(26)))


def may_fit() -> Column:
    """True for every pair that :func:`same_party` may accept, by letters alone: a bound that follows from its ratios.

    Of a text of n letters, a common subsequence with a text of m leaves n - r * max(n, m) letters at most that the other
    text needn't have. ``size`` and ``bits`` are of the whole core, of persons of the last name.
    """
    least = F.greatest("size", "size_b") * F.when(F.col("kind") == "person", 0.8).otherwise(WHOLE) - 1e-9
    left = lambda x, y, n: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) <= F.col(n) - least
    return left("bits", "bits_b", "size") & left("bits_b", "bits", "size_b")


def compare(pairs: DataFrame) -> DataFrame:
    """The pairs (kind, a, b) of the same party."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[same_party(k, a, k, b) for k, a, b in zip(f["kind"], f["a"], f["b"], strict=True)]]

    return pairs.select("kind", "a", "b").mapInPandas(run, "kind string, a string, b string")


def groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, party): the least node of each connected component, by passing least labels along links and through labels."""
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    old = labels = stored(nodes.select("node", F.col("node").alias("party")), "labels")
    for _ in range(ROUNDS):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("party").alias("heard"))
        least = labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.col("party").alias("was"), F.least("party", F.coalesce("heard", "party")).alias("party"))
        hop = least.select(F.col("node").alias("via"), F.col("party").alias("next"))
        jumped = stored(least.join(hop, least["party"] == hop["via"], "left").select("node", "was", F.least("party", F.coalesce("next", "party")).alias("party")), "labels")
        forget(old)
        labels, old = jumped.select("node", "party"), jumped
        if jumped.where("was != party").isEmpty():
            return labels
    raise RuntimeError("the groups didn't settle")


def link_initials(parties: DataFrame, labelled: DataFrame) -> DataFrame:
    """(node, party) of names with an initial that fit exactly one person's group; the others remain on their own.

    ``parties`` has (kind, core), ``labelled`` (node, kind, core, party) of persons. Initials fit if the last name is equal
    and the given name, or the name it is short for, begins with the letter.
    """
    short = F.create_map(*[F.lit(x) for s, fulls in sorted(SHORT.items()) for x in (s, sorted(fulls)[0])])
    people = labelled.where("kind = 'person'").select("party", F.split("core", " ").alias("w")).select("party", F.col("w")[1].alias("last"), F.substring(F.coalesce(F.element_at(short, F.col("w")[0]), F.col("w")[0]), 1, 1).alias("letter")).distinct()
    initials = parties.where("kind = 'initial'").select("kind", "core", F.split("core", " ")[1].alias("last"), F.substring("core", 1, 1).alias("letter"))
    fits = initials.join(people, ["last", "letter"], "left").groupBy("kind", "core").agg(F.countDistinct("party").alias("n"), F.min("party").alias("party"))
    return fits.select("kind", "core", F.when(F.col("n") == 1, F.col("party")).otherwise(F.concat(F.lit("initial:"), F.col("core"))).alias("party"))


def parties(values: DataFrame, column: str, common: int = COMMON) -> DataFrame:
    """(name, party): each spelling that is a name, with the group of spellings of the same organisation or person.

    Repeated values count once, before anything is shuffled whole; nulls, empty texts and values that are no names (with
    digits or fewer than six letters, and no legal form) are in no group. Names of under six letters or with digits pair where
    they are equal but for the legal form. Ties can't occur. Further columns are ignored.
    """
    names = stored(cores(values.select(spelling(F.col(column)).alias("name")).where("name != ''").distinct(), "name"), "names")
    distinct = stored(names.select("kind", "core").distinct(), "cores")
    tag = lambda kind, core: F.concat(kind, F.lit(":"), core)
    links = stored(compare(suffix_pairs(distinct.where("kind in ('org', 'person')"), common)), "same")
    nodes = distinct.where("kind != 'initial'").select(tag(F.col("kind"), F.col("core")).alias("node"), "kind", "core")
    found = groups(nodes, links.select(tag(F.col("kind"), F.col("a")).alias("a"), tag(F.col("kind"), F.col("b")).alias("b")))
    labelled = stored(nodes.join(found, "node"), "labelled")
    every = labelled.select("kind", "core", "party").unionByName(link_initials(distinct, labelled))
    out = stored(names.join(every, ["kind", "core"]).select("name", "party"), "parties")
    forget(names, distinct, links, labelled)
    return out


def spelling_pairs(values: DataFrame, column: str, common: int = COMMON) -> DataFrame:
    """(name_a, name_b): all pairs of spellings of one party, the smaller first."""
    named = parties(values, column, common)
    b = named.select(F.col("name").alias("name_b"), F.col("party").alias("party_b"))
    return named.join(b, (F.col("party") == F.col("party_b")) & (F.col("name") < F.col("name_b"))).select(F.col("name").alias("name_a"), "name_b")
