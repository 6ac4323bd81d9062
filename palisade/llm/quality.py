"""Quality classification by co-training.

Two views of a document, each with a logistic model of its own: the text (shares of kinds of
characters, repetition of words and lines, word lengths) and the metadata (language, source, stated
length). Over some rounds each view labels documents of a pool that it is confident about, and the
other view learns from them. Both views' outputs are then calibrated on held-out labels and combined,
and every document gets a score.

The labelled rows that fitting uses are at most ``max_labelled``, picked by a hash of the id; so many
feature rows go to the driver. The pool is every row without a label, whatever their number: features are
written once, each Newton step of a round sums gradients and curvatures over all of them in the tasks, and
only these sums, of a size that the number of features gives, reach the driver. Pseudo-labels of a class
weigh together at most ``trust`` times as much as the labels of that class, so a large pool does not drown
them. A teacher that is sure of one class only teaches nothing, which otherwise turns the other view to that
class. Pseudo-labels are told anew each round. Half of the held-out labels calibrate, the other half combine the views.
Scoring reads whole texts of all documents.

Null and empty texts, unknown languages and null metadata have features like any others. Labels that
are null are left out, conflicting ones averaged. Without labels of both kinds every document is
accepted with score 1. Documents with equal ids are scored one by one, and each of them is a row of its own
in fitting, with the id's label if there is one; rows with a null id have no label. Extra columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm._shared import Scratch, quoted, slices

KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"|", b"#$%&*@^~+=<>{}[]\\_", b" ", b"\n\t\r", bytes(range(128, 256))]
KIND_OF = np.zeros((256, len(KINDS)))
for _k, _chars in enumerate(KINDS):
    KIND_OF[list(_chars), _k] = 1
LANGUAGES, SOURCES = 16, 32


def text_features(text: bytes) -> list[float]:
    n = max(1, len(text))
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ KIND_OF / n
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:])) / w
    letters = max(share[0] + share[1] + share[9], 1e-9)
    return [
        *share, share[0] / letters, len(set(words)) / w, same, len(set(words)) / w**0.8, sum(map(len, words)) / w / 10,
        len(set(lines)) / len(lines), np.log1p(len(words)) / 10, float(share[6] > 0.02), float(share[5] > 0.01), float(share[4] > 0.02), float(same > 0.1),
    ]


def meta_bins(lang: str | None, source: str | None) -> tuple[int, int]:
    return zlib.crc32((lang or "").encode()) % LANGUAGES, zlib.crc32((source or "").encode()) % SOURCES


def meta_features(lang: np.ndarray, source: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """Rows of the bins of language and source, and stated lengths (nan: none)."""
    out = np.zeros((len(lang), LANGUAGES + SOURCES + 2))
    rows = np.arange(len(lang))
    out[rows, lang] = 1
    out[rows, LANGUAGES + source] = 1
    out[:, -2] = np.log1p(np.maximum(0, np.nan_to_num(stated))) / 10
    out[:, -1] = np.isnan(stated)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        return cls(mean, scale, np.zeros(x.shape[1] + 1))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 25) -> Logistic:
        out = cls.start(x)
        for _ in range(steps):
            if out.step(*out.sums(x, y)) < 1e-6:
                break
        return out

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient over the rows; sums of parts add up."""
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        p = _sigmoid(z @ self.weights)
        return (z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p)

    def step(self, curvature: np.ndarray, gradient: np.ndarray, ridge: float = 1.0) -> float:
        """Moves the weights and says how far."""
        penalty = np.full(len(self.weights), ridge)
        penalty[-1] = 1e-6
        by = np.linalg.solve(curvature + np.diag(penalty), gradient - penalty * self.weights)
        self.weights = self.weights + by
        return float(np.abs(by).max())

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])


@dataclass
class CoTrained:
    """One model per view, each view's calibration and the combination of both; None: accept all."""

    views: tuple[Logistic, Logistic] | None
    calibration: tuple[Logistic, Logistic] | None = None
    combination: Logistic | None = None

    def score(self, xs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, of the metadata view, and of both."""
        if self.views is None:
            return (np.ones(len(xs[0])),) * 3
        ps = [c.predict(_logit(v.predict(x))[:, None]) for v, c, x in zip(self.views, self.calibration, xs)]
        return *ps, self.combination.predict(np.column_stack([_logit(p) for p in ps]))


Views = tuple[np.ndarray, np.ndarray]
#: The sums over a pool for each view and pseudo-label: rows, curvature, gradient.
Sums = dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]


@dataclass
class Round:
    """What tasks need to sum over the pool: the views as fitted so far, and the teachers of this round with their calibration."""

    views: list[Logistic]
    teachers: list[Logistic]
    calibration: list[Logistic]
    confident: float

    def sums(self, xs: Views) -> Sums:
        said = [c.predict(_logit(t.predict(x))[:, None]) for t, c, x in zip(self.teachers, self.calibration, xs)]
        out = {}
        for v, (view, x, q) in enumerate(zip(self.views, xs, said[::-1])):  # each learns from the other
            for label, rows in ((0, 1 - q >= self.confident), (1, q >= self.confident)):
                out[v, label] = int(rows.sum()), *view.sums(x[rows], np.full(rows.sum(), float(label)))
        return out


def added(a: Sums | None, b: Sums) -> Sums:
    return b if a is None else {k: tuple(x + y for x, y in zip(a[k], b[k])) for k in b}


def co_train(labelled: Views, y: np.ndarray, pool: Callable[[Round], Sums], rounds: int = 3, confident: float = 0.98, held_out: int = 3, trust: float = 1.0, steps: int = 6) -> CoTrained:
    """Fit on two thirds of the labels and what the views tell each other about the pool; calibrate and combine on the rest.

    pool: sums over all rows without a label, with the views and teachers given.
    """
    if len(np.unique(y)) < 2 or min(np.bincount(y.astype(int))) < 2 * held_out:
        return CoTrained(None)
    test, half = np.zeros(len(y), bool), np.zeros(len(y), bool)
    for value in (0, 1):
        rows = np.flatnonzero(y == value)[::held_out]
        test[rows] = True
        half[rows[::2]] = True
    calibrated = lambda vs: [Logistic.fit(_logit(v.predict(x[half]))[:, None], y[half]) for v, x in zip(vs, labelled)]
    views = [Logistic.fit(x[~test], y[~test]) for x in labelled]
    calibration = calibrated(views)
    for _ in range(rounds):
        teachers = [replace(v) for v in views]
        for _ in range(steps):
            told = pool(Round(views, teachers, calibration, confident))
            moved = 0.0
            for v, view in enumerate(views):
                curvature, gradient = view.sums(labelled[v][~test], y[~test])
                for label in (0, 1) if told[v, 0][0] and told[v, 1][0] else ():
                    n, c, g = told[v, label]
                    weight = min(1.0, trust * np.count_nonzero(y[~test] == label) / max(1, n))
                    curvature, gradient = curvature + weight * c, gradient + weight * g
                moved = max(moved, view.step(curvature, gradient))
            if moved < 1e-3:
                break
        calibration = calibrated(views)
    rest = test & ~half
    ps = [c.predict(_logit(v.predict(x[rest]))[:, None]) for v, c, x in zip(views, calibration, labelled)]
    return CoTrained(tuple(views), tuple(calibration), Logistic.fit(np.column_stack([_logit(p) for p in ps]), y[rest]))


def _features(part: pa.RecordBatch) -> Views:
    text = np.array([text_features(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()])
    lang, source = np.array([meta_bins(*x) for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())]).T
    return text, meta_features(lang, source, part.column("stated").cast(pa.float64()).to_numpy(zero_copy_only=False))


def _stored(table: pa.RecordBatch | pa.Table) -> Views:
    """The views of rows of the features' table."""
    get = lambda c: table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
    text = np.array(table.column("a").to_pylist(), dtype=float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))
    return text, meta_features(get("lang"), get("source"), get("stated").astype(float))


def _view(df: DataFrame, first: Column, text_col: str, meta_cols: tuple[str, str, str]) -> DataFrame:
    lang, source, stated = (F.col(quoted(c)) if c in df.columns else F.lit(None) for c in meta_cols)
    return df.select(first, F.col(quoted(text_col)).cast("string").alias("text"), lang.cast("string").alias("lang"), source.cast("string").alias("source"), stated.cast("double").alias("stated"))


def _feature_table(docs: DataFrame) -> DataFrame:
    """id, a (features of the text), lang and source (bins), stated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = [text_features(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                lang, source = zip(*map(meta_bins, part.column("lang").to_pylist(), part.column("source").to_pylist()))
                columns = [part.column("id"), pa.array(text, pa.list_(pa.float32())), pa.array(lang, pa.int32()), pa.array(source, pa.int32()), part.column("stated")]
                yield pa.RecordBatch.from_arrays(columns, ["id", "a", "lang", "source", "stated"])

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)]).add("a", T.ArrayType(T.FloatType())).add("lang", "integer").add("source", "integer").add("stated", "double")
    return docs.mapInArrow(run, schema)


def pool_sums(rows: DataFrame, bins: int = 64) -> Callable[[Round], Sums]:
    """Sums over a table of features: in tasks, then in at most ``bins`` groups of tasks, whose sums the driver adds."""
    rows = rows.select("a", "lang", "source", "stated")

    def over(now: Round) -> Sums:
        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    total = added(total, now.sums(_stored(batch)))
            if total is not None:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"bin": pa.array([part % bins], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([pickle.dumps(total)], pa.binary())})

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, last = None, 0
            for batch in batches:
                for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                    total, last = added(total, pickle.loads(sums)), part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"part": pa.array([last], pa.int32()), "sums": pa.array([pickle.dumps(total)], pa.binary())})

        each = rows.mapInArrow(first, "bin int, part int, sums binary")
        few = each.repartition("bin").sortWithinPartitions("part").mapInArrow(second, "part int, sums binary").toArrow().sort_by("part")
        total = None
        for sums in few.column("sums").to_pylist():
            total = added(total, pickle.loads(sums))
        return total or {(v, label): (0, 0.0, 0.0) for v in (0, 1) for label in (0, 1)}

    return over


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, str, str] = ("lang", "source", "n_chars"), max_labelled: int = 8000, rounds: int = 3, confident: float = 0.98, trust: float = 1.0) -> CoTrained:
    """The model for the documents in ``df`` that ``labels`` (id, 0 or 1) covers in part."""
    scratch = Scratch(df.sparkSession, "quality")
    docs = _view(df, F.col(quoted(id_col)).alias("id"), text_col, meta_cols)
    known = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("double").alias("y")).dropna().groupBy("id").agg(F.avg("y").alias("y"))
    features = scratch.save(_feature_table(docs).join(known, "id", "left"), "features")
    # rows, also those with equal ids: at most max_labelled
    order = [F.xxhash64("id"), "id", F.xxhash64("a", "lang", "source", "stated")]
    table = features.filter("y IS NOT NULL").orderBy(*order).limit(max_labelled).toArrow()
    return co_train(_stored(table), (table.column("y").to_numpy() >= 0.5).astype(float), pool_sums(features.filter("y IS NULL")), rounds, confident, trust=trust)


def score(df: DataFrame, model: CoTrained, threshold: float = 0.5, text_col: str = "text", meta_cols: tuple[str, str, str] = ("lang", "source", "n_chars")) -> DataFrame:
    """``df``'s columns in a struct ``document``, with p_text, p_meta, score and accept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                a, b, both = model.score(_features(part))
                yield pa.RecordBatch.from_arrays([part.column("document"), *(pa.array(x) for x in (a, b, both)), pa.array(both >= threshold)], ["document", "p_text", "p_meta", "score", "accept"])

    rows = _view(df, F.struct(*map(quoted, df.columns)).alias("document"), text_col, meta_cols)
    schema = T.StructType([rows.schema["document"]]).add("p_text", "double").add("p_meta", "double").add("score", "double").add("accept", "boolean")
    return rows.mapInArrow(run, schema)


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.5, **columns) -> DataFrame:
    """The rows of ``df`` that the classifier accepts, with all their columns."""
    return score(df, fit(df, labels, **columns), threshold).filter("accept").select("document.*")
