"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts, accented letters, full-width forms and
digit substitutions to one skeleton (i, l and 1 fall together), lower-cases, and turns
everything else into single blanks. Entries match from the start of a word. Matches
inside exception phrases don't count. The sum of the weights, as it is and per length, enters a
logistic score.

The lexicon starts from a fixed list. ``learn`` re-weighs it and adds word beginnings from a bounded
sample of labelled documents, if they occur beside many different words in toxic documents
and hardly in others; repeats of one document therefore count as one.
"""

from __future__ import annotations

import bisect
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.runtime import cut, one_of

#: Common insults, weight 3 unless labels say otherwise.
LEXICON = """idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass
asshole bastard bitch bullshit crap cunt dickhead dipshit douche fuck jackass motherfucker nigger faggot
retard shit slut twat wanker whore arschloch dummkopf hurensohn schlampe trottel vollidiot wichser
abruti connard connasse salaud salope cabron gilipollas hijoputa pendejo imbecil""".split()
#: Phrases in which an entry is harmless.
EXCEPTIONS = """trash can|trash bin|trash bag|trash collection|clown fish|clownfish|idiot proof|stupid question|
scunthorpe|shitake|shiitake|crap game|craps table|worthless check|sore loser|loser bracket|pond scum|soap scum|slut walk|
dostoevsky idiot|crapaud|cocktail|retardant|retardation factor""".replace("\n", "").split("|")
#: Look-alikes that Unicode decomposition doesn't resolve.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝһѵӏɑɡɩοαεικνρτυχβηω", "abekmhopctyxijsdqwhviagioaeiknptuxbnw", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "l": "i"}
PREFIX = (4, 10)
Z = 2.0


# Armenian, and Cherokee capitals, which are lower-cased first.
LOOKALIKES |= {c.lower(): x for c, x in zip("օոսհցզյᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "onuhgqjdrtiyajewmhygzbrwsvslcpkdb", strict=True)}


class _Table(dict):
    """What each code point folds to, made when it is first met."""

    def __missing__(self, i: int) -> str | None:
        c = chr(i)
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            out = None
        else:
            low = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c.lower()).lower())
            out = "".join(LOOKALIKES.get(x, x) for x in low if not unicodedata.combining(x))
            out = "".join(DIGITS.get(x, x) for x in out)
            out = "".join(x if x.isalnum() else " " for x in out)
        self[i] = out
        return out


TABLE = _Table()


def fold(text: str | None) -> str:
    """Skeleton of a text; words lie between single blanks, with a blank at either end."""
    return f" {' '.join((text or '').translate(TABLE).split())} "


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, ...]

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.weights.items():
            a.add_word(f" {e}", (len(e) + 1, w))
        for e in self.exceptions:
            a.add_word(f" {fold(e).strip()}", (len(fold(e).strip()) + 1, None))
        a.make_automaton()
        return a


def default_model() -> Model:
    return Model({fold(e).strip(): 3.0 for e in LEXICON}, tuple(EXCEPTIONS), (-5.0, 8.0, 1.0, 1.0))


def evidence(automaton, folded: str) -> tuple[float, float, int]:
    """(weight of the matches outside exceptions, the largest of them, words)."""
    hits, shields = [], []
    for end, (length, weight) in automaton.iter(folded):
        (shields if weight is None else hits).append((end + 1 - length, end, weight or 0.0))
    if shields:
        # The furthest end of the exception phrases that begin at or before each place.
        shields.sort()
        starts, ends = [x for x, _, _ in shields], list(itertools.accumulate((y for _, y, _ in shields), max))
        hits = [(a, b, w) for a, b, w in hits if not (i := bisect.bisect_right(starts, a)) or ends[i - 1] < b]
    found = [w for _, _, w in hits]
    return sum(found), max(found, default=0.0), folded.count(" ") - 1


def inputs(found: np.ndarray) -> np.ndarray:
    """Features of the score: the strongest match, all matches, and all matches per length."""
    total, most, words = found.reshape(-1, 3).T
    return np.column_stack([np.ones(len(total)), most / 6, np.log1p(total), np.log1p(100 * total / (words + 20))])


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int, seed: int) -> tuple[list[tuple[str, int]], float]:
    """(folded text, label) of at most about ``fit_rows`` labelled documents, a quarter of them toxic if there are so many; weight of the others."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic = min(n.get(1, 0), fit_rows // 4)
    clean = min(n.get(0, 0), fit_rows - toxic)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / float(1 << 53)
    share = F.when(F.col("toxic") == 1, toxic / max(n.get(1, 0), 1)).otherwise(clean / max(n.get(0, 0), 1))
    known = cut(known.where(u < share), "tox-labels")
    rows = docs.join(known, "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [(fold(r["text"]), r["toxic"]) for r in rows], n.get(0, 0) / max(clean, 1)


def _beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(PREFIX[0], min(PREFIX[1], len(word)) + 1)]


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000, least: int = 8, seed: int = 3) -> Model:
    """Model from labelled documents; the default one if there are too few.

    The driver holds the whole texts of the sample, about ``fit_rows`` of them.
    """
    rows, scale = _sample(docs, labels, fit_rows, seed)
    base = default_model()
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    if len(toxic) < least or len(clean) < least:
        return base
    fewest = max(3, len(toxic) // 100)
    often: Counter[str] = Counter()
    for t in toxic:
        often.update({p for w in set(t.split()) for p in _beginnings(w)})
    likely = {p for p, c in often.items() if c >= fewest}
    for t in clean:
        if not likely:
            break
        for w in set(t.split()):
            for p in _beginnings(w):
                if p in likely:
                    often[f"\0{p}"] += 1
    bound = lambda a, b: (a + Z * Z / 2 - Z * math.sqrt(a * b / max(a + b, 1) + Z * Z / 4)) / (a + b + Z * Z)  # noqa: E731  # Wilson, lower
    likely = {p for p in likely if often[f"\0{p}"] * scale <= 2 * often[p] + 2}

    def contexts(texts: list[str]) -> Counter[str]:
        """Different words before each beginning: repeats of a text add none."""
        seen = set()
        for t in texts:
            words = t.split()
            seen.update((p, before) for before, w in zip(["", *words], words, strict=False) for p in _beginnings(w) if p in likely)
        return Counter(p for p, _ in seen)

    beside, clean_beside = contexts(toxic), contexts(clean)
    good = {p for p in likely if bound(beside[p], clean_beside[p] * scale) >= 0.6}
    good = {p for p in good if not any(p[:n] in good for n in range(PREFIX[0], len(p)))}
    weights = dict(base.weights)
    hits = {e: [0, 0] for e in {*weights, *good}}
    trial = Model(dict.fromkeys(hits, 1.0), (), ()).automaton()
    for t, y in rows:
        for e in {t[end + 2 - n : end + 1] for end, (n, _) in trial.iter(t)}:
            hits[e][y] += 1
    for e, (n0, n1) in hits.items():
        if e in good or n0 + n1 >= least:
            weights[e] = max(0.0, min(6.0, math.log((n1 + 0.5) / (len(toxic) + 1)) - math.log((n0 + 0.5) / (len(clean) + 1))))
    model = Model(weights, base.exceptions, base.coefficients)
    automaton = model.automaton()
    x = np.array([evidence(automaton, t) for t, _ in rows])
    y = np.array([y for _, y in rows])
    model.coefficients = tuple(logistic(inputs(x), y, np.where(y == 1, 1.0, scale)))
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; slopes don't fall below 0."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) / 100 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * len(y) / 100 * b)
        b = b + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return np.concatenate([b[:1], np.maximum(b[1:], 0)])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row; null and empty texts get the score of no evidence."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != score_col]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = held.value.automaton()
        for texts in batches:
            x = np.array([evidence(automaton, fold(t)) for t in texts.to_pylist()])
            z = inputs(x) @ np.array(held.value.coefficients)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    made = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`"))
    return docs.select(*rest, made.alias(score_col))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; labels of rows with crc32(doc_id) mod 3 = 1 are never read.

    Rows with a null doc_id are not held out. Labels other than 0 and 1 and labels without a document
    are passed over; of several labels of one document the largest counts.
    """
    held_out = F.coalesce(one_of(F.col("doc_id"), 3, 1), F.lit(False))
    model = learn(docs.select("doc_id", "text"), labels.where(~one_of(F.col("doc_id"), 3, 1)).select("doc_id", "toxic"), fit_rows)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
