"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Learning takes labelled rows only, at most MOST_TRAINING of them (those of the least hashes of
doc_id).  A lexicon is a few seed words, and words and beginnings of words that stand in toxic
documents significantly more often than in others (a likelihood ratio beyond what the number of
candidates makes likely by chance).  The rows fall into halves: the trees see each row through the
lexicon of the other half, and scoring uses the lexicon of both.  The calibration is fitted out of fold.

Features of a text: densities and counts of lexicon words and beginnings, how near second-person
words stand to them, capitals, punctuation, and obfuscation (words that become lexicon words once
digits and signs are read as letters, letters with signs between them, stretched letters), and
length.  Neither labels nor lang, source or doc_id are features.

Null and empty texts have zero features and are scored as such; very long ones are read whole.
Repeated rows are scored each; in learning, equal rows count once, and where a doc_id has several labels
toxic holds.  Extra columns are ignored; an empty table gives no rows.  Without labelled rows, or with one class only, the score is the class's share (0 where no label is).
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import slices, stored

MOST_TRAINING = 20_000
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7

# Second-person words of the four languages, insults to begin a lexicon with, and
# letters that signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
SEED = frozenset("idiot idiots moron morons stupid loser losers pathetic worthless scum clown trash disgusting dumb jerk fool imbecile retard bastard bitch asshole idiota idiotas estúpido imbécil dummkopf trottel arschloch abschaum crétin connard salaud".split())
LEET = str.maketrans("0134578@$!|+", "oieastbasiit")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[^\W\d_][0-9@$!|+*#._-]+[^\W_]\S*(?!\S)")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_MARKS = re.compile(r"[!?]")
_PUNCTUATION = re.compile(r"[^\w\s]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")

FEATURES = (
    "log_words", "lexicon_count", "lexicon_density", "lexicon_distinct", "lexicon_weight", "stem_count", "stem_density", "stem_distinct", "stem_weight",
    "second_person_density", "second_person_near", "capitals", "capital_words", "punctuation", "marks", "mixed_words", "spaced_words", "stretched", "hidden_count", "hidden_density",
)


class Lexicon:
    """Weights (log odds) of words and of beginnings of words."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    def stem_of(self, word: str) -> str | None:
        return next((word[:n] for n in STEMS if len(word) > n and word[:n] in self.stems), None)


def featurize(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    places = [i for i, w in enumerate(words) if w in lexicon.words] if not lexicon.words.keys().isdisjoint(words) else []
    stems = []
    for k in STEMS:
        if any(len(s) == k for s in lexicon.stems):
            stems += [(i, w[:k]) for i, w in enumerate(words) if w[:k] in lexicon.stems and len(w) > k and w not in lexicon.words]
    hits = sorted({*places, *(i for i, _ in stems)})
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    for i in second:
        at = bisect_left(hits, i)
        near += any(abs(h - i) <= 5 for h in hits[max(0, at - 1) : at + 1])
    mixed, spaced = _MIXED.findall(lower), _SPACED.findall(lower)
    hidden = 0
    for token in [*mixed, *spaced]:
        for plain in {_PUNCTUATION.sub("", token.translate(LEET)), re.sub(r"[\W\d_]", "", token)} - {token}:
            hidden += plain in lexicon.words or lexicon.stem_of(plain) is not None
    found = {words[i] for i in places}
    begun = {s for _, s in stems}
    chars = len(text)
    return [
        math.log1p(n), len(places), 100 * len(places) / n, len(found), max((lexicon.words[w] for w in found), default=0.0),
        len(stems), 100 * len(stems) / n, len(begun), max((lexicon.stems[s] for s in begun), default=0.0),
        100 * len(second) / n, near, len(_CAPITALS.findall(text)) / chars, sum(map(str.isupper, text.split())) / n,
        len(_PUNCTUATION.findall(text)) / chars, len(_MARKS.findall(text)) / n, len(mixed) / n, len(spaced), len(_STRETCHED.findall(lower)) / n, hidden, 100 * hidden / n,
    ]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 3, is 1: rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _half() -> Column:
    return F.crc32(F.encode(F.concat(F.lit("half "), F.col("doc_id").cast("string")), "UTF-8")).bitwiseAND(F.lit(1)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    """(doc_id, text, toxic, half) of at most ``most`` labelled rows that may be learned from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    taken = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").dropDuplicates(["doc_id", "text"]).withColumn("half", _half())


_COUNT = pa.schema([("word", pa.string()), ("half", pa.int64()), ("toxic", pa.int64()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word or beginning ("word*"), by half and label."""
    for part in slices(batches):
        n: dict[tuple[str, int, int], int] = {}
        for text, toxic, half in zip(*(c.to_pylist() for c in part.columns), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            for w in words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}:
                n[w, half, toxic] = n.get((w, half, toxic), 0) + 1
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in n], _COUNT[i].type) for i in range(3)), pa.array(list(n.values()), pa.int64())], schema=_COUNT)


def learn_lexicons(rows: DataFrame) -> tuple[Lexicon, Lexicon, Lexicon]:
    """Lexicons of half 0, of half 1 and of both: words and beginnings whose share of toxic documents
    can't be chance, and the seed words."""
    totals = {(r.half, r.bad): r.n for r in rows.select("half", (F.col("toxic") == 1).alias("bad")).groupBy("half", "bad").agg(F.count("*").alias("n")).collect()}
    counted = rows.select("text", "toxic", "half").mapInArrow(_count_words, "word string, half long, toxic long, n long")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    bad = F.col("toxic") == 1
    words = counted.groupBy("word").agg(*(of((F.col("half") == h) & bad).alias(f"t{h}") for h in (0, 1)), *(of(F.col("half") == h).alias(f"n{h}") for h in (0, 1)))
    words = words.withColumns({"t2": F.col("t0") + F.col("t1"), "n2": F.col("n0") + F.col("n1")}).filter("n2 >= 2")
    candidates = words.count()
    # the chi-square value that about one of so many candidates passes by chance
    least = max(12.0, 2 * math.log(max(candidates, 1)) + 2)
    shares = []
    for which in (0, 1, 2):
        t, f = (sum(totals.get((h, x), 0) for h in ((0, 1) if which == 2 else (which,))) for x in (True, False))
        shares.append((t + 0.5) / (t + f + 1))
    part = lambda x, n, share: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    passed = []
    for which, share in enumerate(shares):
        t, n = F.col(f"t{which}"), F.col(f"n{which}")
        passed.append((2 * (part(t, n, share) + part(n - t, n, 1 - share)) >= least) & (10 * t >= 9 * n))
    found = words.select("word", "t0", "t1", "t2", "n0", "n1", "n2", *(p.alias(f"p{i}") for i, p in enumerate(passed))).filter("p0 OR p1 OR p2")
    found = found.collect()  # bounded by the words of the learned rows
    out = []
    for which, share in enumerate(shares):
        prior = math.log(share / (1 - share))
        weight = {r.word: math.log((r[f"t{which}"] + 0.5) / (r[f"n{which}"] - r[f"t{which}"] + 0.5)) - prior for r in found if r[f"p{which}"]}
        words_of = {w: 3.0 for w in SEED} | {w: x for w, x in weight.items() if not w.endswith("*")}
        out.append(Lexicon(words_of, {w[:-1]: x for w, x in weight.items() if w.endswith("*")}))
    return out[0], out[1], out[2]


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float = 1.0, penalty: float = 1.0) -> list:
    """One regression tree over binned features: nested (feature, bin, left, right) or a leaf's value."""
    value = -gradient.sum() / (hessian.sum() + penalty)
    if not depth or hessian.sum() < 2 * least:
        return [value]
    bins = int(x.max()) + 1
    whole = gradient.sum() ** 2 / (hessian.sum() + penalty)
    best = (1e-6, -1, -1)
    for f in range(x.shape[1]):
        g = np.cumsum(np.bincount(x[:, f], gradient, bins))[:-1]
        h = np.cumsum(np.bincount(x[:, f], hessian, bins))[:-1]
        g2, h2 = gradient.sum() - g, hessian.sum() - h
        gain = np.where((h >= least) & (h2 >= least), g * g / (h + penalty) + g2 * g2 / (h2 + penalty) - whole, -1.0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        return [value]
    left = x[:, best[1]] <= best[2]
    return [best[1], best[2], grow(x[left], gradient[left], hessian[left], depth - 1, least, penalty), grow(x[~left], gradient[~left], hessian[~left], depth - 1, least, penalty)]


def apply_tree(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = apply_tree(tree[2], x[left]), apply_tree(tree[3], x[~left])
    return out


class Boosted:
    """Logistic boosting of shallow trees over features cut into bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        self.base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        self.rate, self.trees = rate, []
        binned, margin = self.bin(x), np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            self.trees.append(grow(binned, p - y, p * (1 - p), depth))
            margin += rate * apply_tree(self.trees[-1], binned)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self.bin(x)
        return self.base + self.rate * sum((apply_tree(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending knots and values of the monotone fit, by pooling adjacent violators.

    A pool's value counts two more rows of the mean label, so small pools at the ends claim less.
    """
    order = np.argsort(score, kind="stable")
    knots, at = np.unique(score[order], return_index=True)
    sums, sizes = np.add.reduceat(y[order], at), np.diff(np.append(at, len(y)))
    pools: list[list] = []
    for knot, s, n in zip(knots, sums, sizes, strict=True):
        pools.append([float(s), int(n), [knot]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s2, n2, k2 = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += n2
            pools[-1][2] += k2
    xs, ys = [], []
    for s, n, own in pools:
        xs += [own[0], own[-1]] if len(own) > 1 else own
        ys += [(s + 2 * y.mean()) / (n + 2)] * (2 if len(own) > 1 else 1)
    return np.array(xs), np.maximum.accumulate(ys)


class Model:
    def __init__(self, lexicon: Lexicon, boosted: Boosted | None, knots: np.ndarray, values: np.ndarray, constant: float):
        self.lexicon, self.boosted, self.knots, self.values, self.constant = lexicon, boosted, knots, values, constant

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.boosted is None:
            return np.full(len(texts), self.constant)
        x = np.array([featurize(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.boosted.margin(x), self.knots, self.values), 0.0, 1.0)


_TRAIN = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("x", pa.list_(pa.float64()))])


def _tree_rows(lexicons: tuple[Lexicon, Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(d, t, featurize(s, lexicons[1 - h])) for d, s, t, h in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TRAIN)], schema=_TRAIN)

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model:
    """Learn from at most ``most`` labelled rows; only their features and the lexicon come to the driver."""
    rows = stored(training_rows(docs, labels, most), "training")
    *halves, lexicon = learn_lexicons(rows)
    got = rows.select("doc_id", "text", "toxic", "half").mapInArrow(_tree_rows(tuple(halves)), "doc_id long, toxic long, x array<double>").collect()
    got = sorted({(r.doc_id, int(r.toxic == 1), tuple(r.x)) for r in got})
    y = np.array([t for _, t, _ in got], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, np.zeros(0), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    x = np.array([v for _, _, v in got])
    fold = np.array([zlib.crc32(f"fold {d}".encode()) % 3 for d, _, _ in got])
    out = np.zeros(len(y))
    for k in range(3):
        rest = fold != k
        if y[rest].any() and not y[rest].all():
            out[~rest] = Boosted(x[rest], y[rest]).margin(x[~rest])
    knots, values = isotonic(out, y)
    return Model(lexicon, Boosted(x, y), knots, values, float(y.mean()))


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], schema=_SCORE)

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every text; no shuffle."""
    got = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _drop(model: Model, schema: pa.Schema):
    text = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(model.score(part.column(text).to_pylist()) < THRESHOLD))

    return run


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that are predicted toxic, all columns kept."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return docs.mapInArrow(_drop(model, to_arrow_schema(docs.schema)), docs.schema)
