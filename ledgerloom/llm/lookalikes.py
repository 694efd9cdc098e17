"""One consistent form for text that looks the same: width, joined letters, accents, blanks, ignorable and look-alike characters.

Compatibility forms that a reader can't tell apart are replaced, characters without width deleted and accents separated. Then
each token is a lattice: every letter stands for all letters of its shape, whatever script it was typed in. Viterbi's algorithm
takes the path that is likeliest under character bigrams of the corpus, with a price for a change of script inside a token and
a prior from the letters of the text that only one script has. A letter and its look-alikes open the same column of the
lattice, so texts that look the same take the same path and get the same form.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import forget, stored

#: Letters of other scripts that have the shape of the Latin letter below them.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜаеорсухіјѕһԁԛԝ", "ABESIJKMHOPCTYXGQWaeopcyxijshdqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov")
ARMENIAN = ("ՕՍՏԼհոսօցզ", "OUSLhnuogq")
PHONETIC = ("ɑɡ", "ag")
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
LATIN_OF = {a: b for table in (CYRILLIC, GREEK, ARMENIAN, PHONETIC) for a, b in zip(*table, strict=True)}
LIKE = {}
for _script, _table in zip((*SCRIPTS[1:], "phonetic"), (CYRILLIC, GREEK, ARMENIAN, PHONETIC), strict=True):
    for _a, _b in zip(*_table, strict=True):
        LIKE.setdefault(_b, [(_b, "Latin")]).append((_a, _script))

#: Compatibility forms that look as what they stand for. Raised, circled, squared and styled ones look different.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
#: Worth of a change of script, of a letter of the text's script, and of one where the text can be of no other.
SWITCH, PRIOR, SURE = 6.0, 2.0, 50.0
CACHE = 200_000


class _Look(dict):
    """Character to its look, worked out when first met; with ``fold``, look-alike letters become the Latin one."""

    def __init__(self, fold: bool):
        super().__init__()
        self.fold = fold

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out = ""
        elif kind == "Zs":
            out = " "
        else:
            way, _, parts = unicodedata.decomposition(c).partition(" ")
            if not way.startswith("<"):
                out = unicodedata.normalize("NFD", c)
                out = "".join(LATIN_OF.get(x, x) for x in out) if self.fold else out
            else:
                becomes = "".join(chr(int(x, 16)) for x in parts.split())
                joined = way == "<compat>" and kind[0] == "L" and (len(becomes) > 1 or c == "µ") and all(unicodedata.category(x)[0] in "LM" for x in becomes)
                out = "".join(self[ord(x)] for x in becomes) if way in SAME_LOOK or joined else c
        self[code] = out
        return out


LOOK, _WIDTH = _Look(True), _Look(False)


def look(text: str) -> str:
    """The look of a text: equal for texts a reader can't tell apart, by the rules above."""
    return unicodedata.normalize("NFD", text.translate(LOOK))


def script_of(c: str) -> str | None:
    if c.isascii():
        return "Latin" if c.isalpha() else None
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s.upper())), None)


_TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_LATIN_TOKEN = re.compile(r"[A-Za-z]+")
_MARKS = re.compile(r"[\u0300-\u036f]")


#: Every letter that has look-alikes, with the column it opens in a lattice.
COLUMN = {c: column for column in LIKE.values() for c, _ in column}
_ALIKE = re.compile(f"[{''.join(LATIN_OF)}]")


def plain(text: str) -> str:
    """A text without compatibility forms and ignorable characters, its accents separated; letters of all scripts stay."""
    return text if text.isascii() else unicodedata.normalize("NFD", text.translate(_WIDTH))


def bigrams(tokens: Counter, into: Counter) -> None:
    """Count the letter pairs of tokens that are of one script and have a letter without look-alikes."""
    for token, n in tokens.items():
        letters = _MARKS.sub("", token)
        scripts = {script_of(c) for c in letters}
        if len(scripts) == 1 and None not in scripts and any(c not in COLUMN for c in letters):
            for a, b in zip("^" + letters, letters + "$", strict=True):
                into[a + b] += n


def train(documents: DataFrame, text: str) -> dict[str, float]:
    """Logarithms of the bigram counts of all documents. The table is bounded by the squares of the four alphabets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        tokens: Counter = Counter()
        for f in frames:
            for t in f["text"]:
                if isinstance(t, str):
                    tokens.update(_LATIN_TOKEN.findall(t) if t.isascii() else _TOKEN.findall(plain(t)))
            if len(tokens) > CACHE:
                bigrams(tokens, counts)
                tokens.clear()
        bigrams(tokens, counts)
        yield pd.DataFrame(list(counts.items()), columns=["pair", "n"])

    counted = documents.select(F.col(text).alias("text")).mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # pairs of letters of four alphabets
    return {r.pair: math.log(r.n + 1) for r in rows}


class Decoder:
    """Takes a text to its consistent form: Viterbi over the look-alikes of the letters as they were typed."""

    def __init__(self, model: dict[str, float]):
        self.model = model
        self.known: dict[tuple[str, str, float], str] = {}
        totals: Counter = Counter()
        for pair, n in model.items():
            totals[pair[0]] += math.exp(n) - 1
        self.total = {c: math.log(n + 1000) for c, n in totals.items()}

    def score(self, a: str, b: str) -> float:
        return self.model.get(a + b, 0.0) - self.total.get(a, 7.0)

    def path(self, letters: str, prior: str, weight: float) -> str:
        """The likeliest letters of the lattice; ``weight`` is what a letter of the text's own script is worth."""
        columns = [COLUMN.get(c) or [(c, script_of(c))] for c in letters]
        best = {o: (self.score("^", o[0]) + (weight if o[1] == prior else 0.0), None) for o in columns[0]}
        steps = [best]
        for column in columns[1:]:
            step = {}
            for o in column:
                gain = weight if o[1] == prior else 0.0
                step[o] = max(((s + self.score(p[0], o[0]) + gain - (SWITCH if None not in (p[1], o[1]) and p[1] != o[1] else 0.0), p) for p, (s, _) in best.items()), key=lambda x: (x[0], x[1][0]))
            best = step
            steps.append(best)
        at = max(best, key=lambda o: (best[o][0] + self.score(o[0], "$"), o[0]))
        out = []
        for step in reversed(steps):
            out.append(at[0])
            at = step[at][1]
        return "".join(reversed(out))

    def token(self, token: str, prior: str, weight: float) -> str:
        known = self.known.get((token, prior, weight))
        if known is None:
            if len(self.known) > CACHE:
                self.known.clear()
            letters = iter(self.path(_MARKS.sub("", token), prior, weight))
            known = self.known[(token, prior, weight)] = "".join(c if _MARKS.match(c) else next(letters) for c in token)
        return known

    def __call__(self, text: str) -> str:
        flat = plain(text)
        if flat.isascii():
            return flat  # only Latin letters: the path of each token is the token
        own: Counter = Counter()
        for c, n in Counter(flat).items():
            if c not in COLUMN and (s := script_of(c)):
                own[s] += n
        if own.keys() <= {"Latin"}:
            # No letter is of another script alone: the text is Latin, and only tokens typed otherwise can change.
            if _ALIKE.search(flat):
                flat = _TOKEN.sub(lambda m: self.token(m[0], "Latin", SURE) if _ALIKE.search(m[0]) else m[0], flat)
            return unicodedata.normalize("NFC", flat)
        prior = max(SCRIPTS, key=lambda s: (own.get(s, 0), -SCRIPTS.index(s)))
        return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: self.token(m[0], prior, PRIOR), flat))


def consistent(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, form): every document with its text in one consistent form.

    A null text has a null form; empty texts and texts of nothing but characters without width have an empty one. Whole
    texts are processed, of any length. Rows are neither dropped nor multiplied; further columns are ignored. Texts of ASCII
    characters alone are their own form and stay in the engine.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, text))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = Decoder(model.value)
        for f in frames:
            yield f.assign(form=[decode(t) for t in f["text"]])

    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ascii_only = F.octet_length("text") == F.length("text")
    other = rows.where(~ascii_only).mapInPandas(run, f"doc_id {kind}, text string, form string")
    return rows.where(F.coalesce(ascii_only, F.lit(True))).withColumn("form", F.col("text")).unionAll(other)


def same_look(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, same_as, variant) of each document whose form some differing text shares.

    ``same_as`` is the class, ``variant`` the text's own digest within it. Texts without any visible character are in none.
    """
    forms = consistent(documents, doc_id, text).where(F.trim(F.regexp_replace("form", r"\s", "")) != "")
    digests = stored(forms.select("doc_id", F.sha2("form", 256).alias("same_as"), F.sha2("text", 256).alias("variant")), "looks")
    shared = digests.groupBy("same_as", "variant").agg(F.count("*").alias("n")).groupBy("same_as").agg(F.count("*").alias("variants")).where("variants > 1").select("same_as")
    out = stored(digests.join(shared, "same_as"), "variants")
    forget(digests)
    return out


def look_pairs(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents that look the same but aren't equal.

    Pairs of variants come first and are then filled with documents, so copies of one text never meet each other.
    """
    docs = same_look(documents, doc_id, text)
    variants = docs.select("same_as", "variant").distinct()
    v = variants.select(F.col("same_as").alias("class_b"), F.col("variant").alias("variant_b"))
    pairs = variants.join(v, (F.col("same_as") == F.col("class_b")) & (F.col("variant") < F.col("variant_b"))).select("same_as", "variant", "variant_b")
    left = docs.select("same_as", "variant", F.col("doc_id").alias("x"))
    right = docs.select("same_as", F.col("variant").alias("variant_b"), F.col("doc_id").alias("y"))
    return pairs.join(left, ["same_as", "variant"]).join(right, ["same_as", "variant_b"]).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
