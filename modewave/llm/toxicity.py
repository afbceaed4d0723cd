"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct words and their beginnings, hashed. Those that go with one label significantly are
selected and weighed by logistic regression. Where a labelled text names a group, its identity terms are swapped
for others of their kind, and the change of the score is penalised: naming a group by itself must not move the
score, so that neutral mentions are not taken for toxic ones.

Terms are those listed, each with others of its kind and language, and words that the labelled texts themselves show to be neutral and interchangeable:
words that stand in many texts without the label, or begin like words that are selected, and are not much more frequent in those with it; each with those
that follow the same words most alike. Each text is swapped SWAPS times, by the nearest, the next and so on. Terms are features whether selected or not, so that
the penalty decides what they weigh.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import U64
from .common import documents, stash

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings that are features of longer words.
BEGINNINGS = (4, 5, 6)
#: Identity terms by kind; terms of a kind are swapped for each other. Fixed values of this operator.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "indian", "arab"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens", "migrants"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
)
#: Swaps of a text.
SWAPS = 3
#: Learned terms: this share of the texts without the label at least hold them (or MIN_TEXTS, if they have a selected feature), no more than so many times that share
#: of those with it do, and so many there are at most.
TERM_SHARE, TERM_LIFT, MAX_TERMS = 0.02, 1.5, 200
#: Cells into which the words before a term are hashed.
CONTEXT_CELLS = 256
#: Labelled rows that the classifier is fitted on, at most about so many: the sample's bound.
MAX_TRAIN = 20_000
MAX_FEATURES = 4096
#: Least G statistic and least texts of a feature that is selected.
MIN_G, MIN_TEXTS = 25.0, 5
RIDGE, COUNTERFACTUAL = 1e-4, 1.0
THRESHOLD = 0.3
#: Words whose weight a worker remembers.
MEMORY = 400_000
PARTS = 16


@functools.cache
def listed_swaps() -> dict[str, list[str]]:
    """Each listed term, and the next ones of its kind."""
    return {t: [kind[(i + k) % len(kind)] for k in range(1, min(SWAPS, len(kind) - 1) + 1)] for kind in IDENTITY for i, t in enumerate(kind)}


def learned_swaps(train: DataFrame, n0: int, n1: int, keys: np.ndarray | None = None) -> dict[str, list[str]]:
    """Neutral words of the labelled texts (text, label), each with the SWAPS others whose contexts are most like its own.

    At most MAX_TERMS words, and their contexts in CONTEXT_CELLS cells, reach the driver. ``keys``: the selected features.
    """
    chosen = set() if keys is None else set(keys.tolist())

    def words(batches):
        near = Known(lambda w: not chosen.isdisjoint(features(w)))
        for b in batches:
            found = [(w, y, near[w]) for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True) for w in words_of(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["word", "label", "near"])

    seen = train.select("text", "label").mapInArrow(words, "word string, label long, near boolean").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.first("near").alias("near"))
    zeros, ones = (F.col("n") - F.col("ones")) / max(1, n0), F.col("ones") / max(1, n1)
    terms = [r["word"] for r in seen.where(((zeros >= TERM_SHARE) | (F.col("near") & (F.col("n") - F.col("ones") >= MIN_TEXTS))) & (ones <= TERM_LIFT * zeros)).orderBy(F.desc("near"), F.desc(zeros), "word").limit(MAX_TERMS).collect()]
    if len(terms) < 2:
        return {}
    place = {w: i for i, w in enumerate(terms)}

    def contexts(batches):
        out = np.zeros((len(terms), CONTEXT_CELLS), dtype=np.int64)
        cell = Known(lambda w: xxhash.xxh64_intdigest(w) % CONTEXT_CELLS)
        for b in batches:
            for t in b.column(0):
                ws = LETTERS.findall(t.as_py().lower())
                for before, w in zip(ws, ws[1:], strict=False):
                    if w in place:
                        out[place[w], cell[before]] += 1
        i, j = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out[i, j], pa.int64())], ["i", "j", "n"])

    near = np.zeros((len(terms), CONTEXT_CELLS))
    for r in train.select("text").mapInArrow(contexts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        near[r["i"], r["j"]] = r["n"]
    near = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    alike = near @ near.T
    np.fill_diagonal(alike, -1.0)
    return {w: [terms[j] for j in np.argsort(-alike[i], kind="stable")[:SWAPS].tolist()] for i, w in enumerate(terms)}


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def features(word: str) -> list[int]:
    """64-bit hashes of a word and of its beginnings."""
    return [xxhash.xxh64_intdigest(word), *(xxhash.xxh64_intdigest(word[:n], seed=n) for n in BEGINNINGS if len(word) > n)]


class Known(dict):
    """word -> what ``make`` gives for it; forgets everything when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = self.make(word)
        return out


def counted(train: DataFrame) -> DataFrame:
    """part, features, texts without and with the label. ``train``: text, label (0 or 1)."""

    def run(batches):
        known = Known(features)
        for b in batches:
            found = [np.unique(np.fromiter(itertools.chain.from_iterable(known[w] for w in words_of(t.as_py())), dtype=U64)) for t in b.column(0)]
            if not found:
                continue
            label = np.repeat(np.asarray(b.column(1)), [len(f) for f in found])
            keys, of = np.unique(np.concatenate(found), return_inverse=True)
            ones = np.bincount(of, label, len(keys)).astype(np.uint32)
            zeros = (np.bincount(of, minlength=len(keys)) - ones).astype(np.uint32)
            cuts = np.searchsorted(keys, np.arange(PARTS, dtype=U64) << U64(60)).tolist() + [len(keys)]
            rows = [(p, keys[x:y].tobytes(), zeros[x:y].tobytes(), ones[x:y].tobytes()) for p, (x, y) in enumerate(itertools.pairwise(cuts)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["part", "keys", "zeros", "ones"])

    return train.select("text", "label").mapInArrow(run, "part int, keys binary, zeros binary, ones binary")


def g_statistic(zeros: np.ndarray, ones: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Of each feature: how far its share in the two classes is from chance."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)

    total, n = zeros + ones, n0 + n1
    return 2 * (part(ones, total * n1 / n) + part(zeros, total * n0 / n) + part(n1 - ones, (n - total) * n1 / n) + part(n0 - zeros, (n - total) * n0 / n))


def selected(counts: DataFrame, n0: int, n1: int) -> np.ndarray:
    """Hashes of the features that are selected: MAX_FEATURES at most."""

    def best(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), dtype=U64) for x in t.column("keys")])
        zeros, ones = (np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in t.column(c)]).astype(float) for c in ("zeros", "ones"))
        distinct, of = np.unique(keys, return_inverse=True)
        zeros, ones = np.bincount(of, zeros), np.bincount(of, ones)
        g = g_statistic(zeros, ones, n0, n1)
        keep = np.flatnonzero((g >= MIN_G) & (zeros + ones >= MIN_TEXTS))
        keep = keep[np.lexsort((distinct[keep], -g[keep]))][:MAX_FEATURES]
        return pa.table({"key": pa.array(distinct[keep].view(np.int64), pa.int64()), "g": pa.array(g[keep], pa.float64())})

    rows = counts.groupBy("part").applyInArrow(best, "key long, g double").orderBy(F.desc("g"), "key").limit(MAX_FEATURES).collect()
    return np.sort(np.array([r["key"] for r in rows], dtype=np.int64).view(U64))


def designed(train: DataFrame, keys: np.ndarray, swap: dict[str, list[str]]) -> DataFrame:
    """label, own, swapped: places of the selected features of each text, and of the text as often as it is swapped (none without a term)."""
    place = {int(k): i for i, k in enumerate(keys)}

    def run(batches):
        known = Known(lambda w: [place[f] for f in features(w) if f in place])
        vector = lambda ws: np.array(sorted(itertools.chain.from_iterable(known[w] for w in ws)), dtype=np.uint16).tobytes()
        for b in batches:
            own, other = [], []
            for t in b.column(0):
                ws = words_of(t.as_py())
                own.append(vector(ws))
                most = max((len(swap[w]) for w in ws if w in swap), default=0)
                other.append([vector({swap[w][min(k, len(swap[w]) - 1)] if w in swap else w for w in ws}) for k in range(most)])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.binary()), pa.array(other, pa.list_(pa.binary()))], ["label", "own", "swapped"])

    return train.select("text", "label").mapInArrow(run, "label int, own binary, swapped array<binary>")


class Design:
    """The labelled texts as sparse rows, and the differences of each and its swapped forms."""

    def __init__(self, rows: list, n_features: int):
        own = [np.frombuffer(r["own"], dtype=np.uint16).astype(np.int64) for r in rows]
        self.n_features, self.y = n_features, np.array([r["label"] for r in rows], dtype=float)
        self.row, self.col = _flat(own)
        pairs = [(o, np.frombuffer(x, dtype=np.uint16).astype(np.int64)) for o, r in zip(own, rows, strict=True) for x in r["swapped"]]
        self.n_pairs = len(pairs)
        self.pair, self.pair_col = _flat([np.concatenate(p) for p in pairs])
        self.sign = np.concatenate([np.zeros(0), *(np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs)])

    def changes(self, weights: np.ndarray) -> np.ndarray:
        """Of each pair: how much the logit differs."""
        return np.bincount(self.pair, self.sign * weights[self.pair_col], self.n_pairs)

    def loss(self, theta: np.ndarray, counterfactual: float) -> tuple[float, np.ndarray]:
        """Mean log loss, the ridge, and the mean squared change under swaps; and their gradient."""
        w, n = theta[:-1], len(self.y)
        x = np.bincount(self.row, w[self.col], n) + theta[-1]
        p = 1 / (1 + np.exp(-x))
        miss = (p - self.y) / n
        change = self.changes(w)
        value = float(np.mean(np.logaddexp(0, x) - self.y * x)) + RIDGE / 2 * float(w @ w) + counterfactual * float(change @ change) / max(1, self.n_pairs)
        g = np.bincount(self.col, miss[self.row], self.n_features) + RIDGE * w
        g += 2 * counterfactual / max(1, self.n_pairs) * np.bincount(self.pair_col, self.sign * change[self.pair], self.n_features)
        return value, np.append(g, miss.sum())


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate([np.zeros(0, np.int64), *parts])


def fitted(d: Design, counterfactual: float, steps: int = 400) -> np.ndarray:
    """Weights and, last, the intercept; full gradients with Adam."""
    share = np.clip(d.y.mean(), 1e-3, 1 - 1e-3)
    theta = np.zeros(d.n_features + 1)
    theta[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, g = d.loss(theta, counterfactual)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta


class Classifier:
    """Weights of the selected features, at most MAX_FEATURES, so it may be broadcast; how many pairs of a text and its swapped form it was fitted on, and their root mean square change."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, intercept: float, pairs: int = 0, change: float = 0.0):
        self.weight = {int(k): float(w) for k, w in zip(keys, weights, strict=True)}
        self.intercept, self.pairs, self.change = intercept, pairs, change

    def scorer(self):
        known = Known(lambda w: sum(self.weight.get(f, 0.0) for f in features(w)))

        def score(text: str) -> float:
            x = self.intercept + sum(map(known.__getitem__, words_of(text)))
            return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))

        return score


def fit(train: DataFrame, text_col: str = "text", label_col: str = "label", counterfactual: float | None = None) -> Classifier:
    """A classifier of labelled texts; rows without a label are left out, null texts count as empty, long ones whole.

    ``train`` is read several times and should be bounded and written (see ``sample``). Without rows, or with one
    class only, every text scores the share of label 1.
    """
    rows = train.where(F.col(label_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(label_col) == 1).cast("int").alias("label"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1")).first()
    n1 = int(n["n1"] or 0)
    n0 = n["n"] - n1
    keys = selected(counted(rows), n0, n1) if n0 and n1 else np.zeros(0, dtype=U64)
    if not len(keys):
        share = np.clip(n1 / n["n"] if n["n"] else 0.0, 1e-3, 1 - 1e-3)
        return Classifier(keys, np.zeros(0), float(np.log(share / (1 - share))))
    swap = listed_swaps() | learned_swaps(rows, n0, n1, keys)
    keys = np.union1d(keys, np.array([xxhash.xxh64_intdigest(w) for w in swap], dtype=U64))
    design = Design(designed(rows, keys, swap).collect(), len(keys))  # max_train rows at most
    theta = fitted(design, COUNTERFACTUAL if counterfactual is None else counterfactual)
    change = design.changes(theta[:-1])
    return Classifier(keys, theta[:-1], float(theta[-1]), design.n_pairs, float(np.sqrt(np.mean(change**2))) if design.n_pairs else 0.0)


def sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, label): about ``max_rows`` labelled ids at most, chosen by a hash of the id."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(label_col).alias("label"))
    n = rows.count()
    return rows if n <= max_rows else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))


def in_part(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in this part; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 4, part: int = 2, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold``).

    ``labels`` has the id and ``toxic``. Labels of the held-out part are not learned from. Only the text enters a
    score; null and empty texts score the intercept, very long ones are scored whole. Ids that repeat are scored row by row. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = documents(df, id_col, text_col).withColumn("held_out", in_part("doc_id", parts, part))
    chosen = sample(labels.where(~in_part(id_col, parts, part)), id_col, "toxic", max_train)
    train = stash(docs.join(F.broadcast(chosen), "doc_id").select("text", "label"), "toxic-train")  # the sample's bound is max_train rows
    model = spark.sparkContext.broadcast(fit(train))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        score = model.value.scorer()
        for b in batches:
            s = [score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
