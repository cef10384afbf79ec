"""Quality classifier by co-training (Blum and Mitchell, 1998): two views teach each other.

One view sees the text (statistics of its characters, words and lines), the other the page's metadata (source, language,
length and their pairs). Both are logistic regressions in numpy, first fitted on a bounded sample of labelled rows. In each round Spark
scores all documents by both views, and the rows that a view is surest of, of either class and in bounded number, join
the other's training rows, where that view has been right about such rows on held-out labels. Then each view is calibrated on
held-out labelled rows (Platt scaling), the calibrated views are combined by a last logistic regression on other held-out rows,
and every document is scored on Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, spool, table
from .text_hash import ALNUM, SPACED, slices, word_hashes

#: Labelled rows that fitting sees at most; rounds; rows that a view teaches in a round at most; held-out precision that it needs for that.
LABELLED, ROUNDS, TAUGHT, SURE = 6000, 3, 400, 0.8
#: Held-out rows at a bar that must be right, too.
LAST = 20
_KIND = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 6 if c in b".,;:'\"-?" else 5 for c in range(256)], dtype=np.uint8)
TEXT_FEATURES, SOURCES, PAIRS = 20, 64, 128


def text_features(texts: list[bytes]) -> np.ndarray:
    """A row of TEXT_FEATURES statistics for each text."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.float64)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    joined = b"\n".join(texts) + b"\n"
    kind = _KIND[np.frombuffer(joined, dtype=np.uint8)]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    share = np.bincount(owner * 7 + kind, minlength=7 * n).reshape(n, 7) / np.maximum(sizes, 1)[:, None]
    raw = np.frombuffer(joined, dtype=np.uint8)
    single = [np.bincount(owner[raw == c], minlength=n) / np.maximum(sizes, 1) for c in b"|!\n{"]
    words, text, starts, ends = word_hashes(texts, SPACED)
    count = np.bincount(text, minlength=n).astype(np.float64)
    per_word = np.maximum(count, 1)
    length = np.bincount(text, weights=ends - starts, minlength=n) / per_word
    order = np.lexsort((words, text))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=n) / per_word
    again = np.zeros(n)
    if len(words) > 1:
        twin = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        again = np.bincount(text[1:][twin], minlength=n) / per_word
    last = kind[ends - 1] if len(words) else kind[:0]
    odd_end = np.bincount(text[last == 5], minlength=n) / per_word
    plain, owner_p, *_ = word_hashes(texts, ALNUM)
    plain_count = np.bincount(owner_p, minlength=n) / per_word
    log = np.log1p(count)
    return np.column_stack([share, *single, np.minimum(length, 40) / 10, distinct, distinct * log, again, odd_end, plain_count, log, log * log / 10, share[:, 2] > 0.5])[:, :TEXT_FEATURES]


def metadata_features(source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> np.ndarray:
    """Hashed one-hot source, language and source with language, and the given length on several scales. Documents have no address."""
    code = lambda s, m: (pd.util.hash_array(s.fillna("").astype(str).to_numpy(dtype=object)) % np.uint64(m)).astype(np.int64)
    log = np.log1p(np.maximum(pd.to_numeric(n_chars).fillna(0).to_numpy(dtype=np.float64), 0))
    bins = np.clip((log * 1.5).astype(np.int64), 0, 23)
    pair = source.fillna("").astype(str) + "\t" + lang.fillna("").astype(str)
    return np.concatenate([np.eye(SOURCES)[code(source, SOURCES)], np.eye(16)[code(lang, 16)], np.eye(PAIRS)[code(pair, PAIRS)], np.eye(24)[bins], (log / 10)[:, None]], axis=1)


@dataclass
class Logistic:
    """Logistic regression with standardised inputs and their squares, fitted by Newton steps."""

    squares: bool = False
    ridge: float = 1.0
    parts: tuple = field(default=())

    def _design(self, x: np.ndarray) -> np.ndarray:
        mean, spread, _ = self.parts
        z = np.clip((x - mean) / spread, -6, 6)
        return np.concatenate([z, z * z, np.ones((len(z), 1))] if self.squares else [z, np.ones((len(z), 1))], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.parts = (x.mean(0), x.std(0) + 1e-6, None)
        z = self._design(x)
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.parts = (*self.parts[:2], w)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.parts[2], -30, 30)


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


@dataclass
class CoTrained:
    """Two views with their calibrations, and the last regression over both calibrated logits."""

    views: tuple[Logistic, Logistic]
    scales: tuple[Logistic, Logistic]
    last: Logistic

    def logits(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.column_stack([scale.logit(view.logit(x)[:, None]) for view, scale, x in zip(self.views, self.scales, (text, meta))])

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return probability(self.last.logit(self.logits(text, meta)))


def surest(p: np.ndarray, y: np.ndarray, good: bool, precision: float = SURE) -> float:
    """The least sureness at which held-out rows (probabilities p, labels y) are of the class good or bad with `precision`.

    A class that is common anyway needs more: half of the way from its share to certainty. Infinite where there is none.
    """
    sure, right = (p, y > 0.5) if good else (1 - p, y < 0.5)
    need = max(precision, (1 + right.mean()) / 2)
    order = np.argsort(-sure, kind="stable")
    held = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    # At the bar itself, too: of the last rows down to it as many are right, and none is likelier to be of the other class.
    sums = np.concatenate(([0], np.cumsum(right[order])))
    first = np.maximum(np.arange(1, len(y) + 1) - LAST, 0)
    near = (sums[1:] - sums[first]) / (np.arange(1, len(y) + 1) - first)
    ok = np.flatnonzero((held >= need) & (near >= need) & (sure[order] >= 0.5) & (np.arange(len(y)) >= min(9, len(y) - 1)))
    return float(sure[order][ok[-1]]) if len(ok) else float("inf")


class CoTraining:
    """Training rows of both views. Of five labelled rows three fit the views, one calibrates them, one combines them."""

    def __init__(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        part = np.arange(len(y)) % 5 if len(y) >= 20 else np.full(len(y), -1)
        pick = lambda n: (part == n) if len(y) >= 20 else np.ones(len(y), dtype=bool)
        fit = part < 3 if len(y) >= 20 else pick(0)
        self.scale, self.join, self.labelled, self.y = pick(3), pick(4), labelled, y
        self.xs, self.ys = [[v[fit]] for v in labelled], [[y[fit]], [y[fit]]]
        self.refit()

    def refit(self) -> None:
        self.views = tuple(view.fit(np.concatenate(x), np.concatenate(y)) for view, x, y in zip((Logistic(squares=True), Logistic()), self.xs, self.ys))

    def bars(self) -> list[tuple[float, float]]:
        """For each view how sure it must be of bad and of good rows to teach them."""
        held = self.scale | self.join
        return [tuple(surest(probability(v.logit(x[held])), self.y[held], good) for good in (False, True)) for v, x in zip(self.views, self.labelled)]

    def _calibrated(self) -> list[Logistic]:
        return [Logistic(ridge=1e-2).fit(v.logit(x[self.scale])[:, None], self.y[self.scale]) for v, x in zip(self.views, self.labelled)]

    def losses(self) -> np.ndarray:
        """The log loss of both views, calibrated on other rows, on each row of the last held-out part."""
        y, out = self.y[self.join], 0.0
        for view, scale, x in zip(self.views, self._calibrated(), self.labelled):
            p = np.clip(probability(scale.logit(view.logit(x[self.join])[:, None])), 1e-9, 1 - 1e-9)
            out = out - np.where(y > 0.5, np.log(p), np.log(1 - p))
        return out

    def state(self) -> tuple:
        return [list(x) for x in self.xs], [list(y) for y in self.ys], self.views

    def restore(self, state: tuple) -> None:
        self.xs, self.ys, self.views = state

    def teach(self, view: int, rows: np.ndarray, label: float) -> None:
        """rows, in the other view's features, which `view` is sure of."""
        self.xs[1 - view].append(rows)
        self.ys[1 - view].append(np.full(len(rows), label))

    def finish(self) -> CoTrained:
        scales = tuple(self._calibrated())
        model = CoTrained(self.views, scales, Logistic())
        model.last = Logistic(ridge=1e-1).fit(model.logits(*(x[self.join] for x in self.labelled)), self.y[self.join])
        return model


_FEATURES = "text_view array<double>, source string, lang string, n_chars bigint"


def text_views(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs(keys, text, source, lang, n_chars) -> the same with text_view, the text's features, for text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*(batch.column(k) for k in keys), pa.array(_text_features(batch).tolist(), pa.list_(pa.float64())), batch.column("source").cast(pa.string()), batch.column("lang").cast(pa.string()), batch.column("n_chars").cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "text_view", "source", "lang", "n_chars"])

    fields = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return map_texts(docs.select(*keys, "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")), run, fields + _FEATURES)


def _text_features(batch: pa.RecordBatch) -> np.ndarray:
    text = [text_features(texts) for _, texts in slices(batch.column("text"))]
    return np.concatenate(text) if text else np.zeros((0, TEXT_FEATURES))


def _both(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.array(rows["text_view"].tolist(), dtype=np.float64).reshape(-1, TEXT_FEATURES)
    return text, metadata_features(rows["source"], rows["lang"], rows["n_chars"])


def _sure_rows(pool: DataFrame, views: tuple[Logistic, Logistic], bars: list[tuple[float, float]], taught: DataFrame, rows: int) -> pd.DataFrame:
    """(view, good, id and features) of at most `rows` rows for each view and class that are surest, bars met and not yet taught."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, (view, x) in enumerate(zip(views, _both(batch))):
                p = probability(view.logit(x))
                for good, sure in enumerate((1 - p, p)):
                    ok = sure >= bars[k][good]
                    yield pd.DataFrame({"view": np.full(ok.sum(), k), "good": np.full(ok.sum(), good), "sure": sure[ok], "id": batch["id"].to_numpy()[ok]})

    # Rows of equal content have one id. Sureness in steps of a thousandth, then the id, which is a hash.
    found = pool.mapInPandas(run, "view int, good int, sure double, id long").groupBy("view", "good", "id").agg(F.max("sure").alias("sure"))
    found = spool(found.join(F.broadcast(taught), "id", "left_anti"), "sure")
    best = [found.where(f"view = {k} and good = {g}").orderBy(F.desc(F.floor(F.col("sure") * 1000)), "id").limit(rows).select("view", "good", "id") for k in (0, 1) for g in (0, 1)]
    chosen = spool(best[0].unionAll(best[1]).unionAll(best[2]).unionAll(best[3]), "chosen")
    # At most 4 * rows rows of three numbers.
    return pool.join(F.broadcast(chosen), "id").dropDuplicates(["view", "good", "id"]).toPandas().sort_values(["view", "good", "id"])


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, taught: int = TAUGHT) -> CoTrained | None:
    """The classifier from at most `labelled` labelled rows (labels: doc_id, quality 0 or 1) and all documents.

    Every document may be taught in each of the `rounds`; at most 4 * `taught` rows a round join the training rows. Labels of null ids or
    values, and of ids that no document has, are not used; repeated labels count once each (least quality); of repeated
    doc_ids the row of the least hash counts. None where fewer than two labelled rows or only one class remain.
    """
    pool = docs.select(F.xxhash64("text", "source", "lang", "n_chars").alias("id"), "doc_id", "text", "source", "lang", "n_chars")
    pool = spool(text_views(pool, ["id", "doc_id"]), "views")
    return _fitted(pool, labels, labelled, rounds, taught)


def _fitted(pool: DataFrame, labels: DataFrame, labelled: int, rounds: int, taught: int) -> CoTrained | None:
    """fit_quality from pool(id, doc_id, text_view, source, lang, n_chars)."""
    named = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = spool(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labelled")
    # At most `labelled` rows of two numbers, so this side is bounded; a row for each comes back.
    known = pool.join(F.broadcast(named), "doc_id")
    least = known.groupBy("doc_id").agg(F.min("id").alias("id"))
    known = known.join(least, ["doc_id", "id"]).dropDuplicates(["doc_id"]).toPandas().sort_values(["id", "doc_id"])
    y = known["quality"].to_numpy(dtype=float)
    if len(y) < 2 or len(set(y)) < 2:
        return None
    training, done = CoTraining(_both(known), y), {int(i) for i in known["id"]}
    for _ in range(rounds):
        bars = training.bars()
        if not np.isfinite(bars).any():
            break
        ids = pool.sparkSession.createDataFrame([(i,) for i in sorted(done)], "id long")
        rows = _sure_rows(pool, training.views, bars, ids, taught)
        rows = rows[rows.groupby("id")["good"].transform("nunique") == 1]  # a row that the views disagree on teaches nothing
        if not len(rows):
            break
        before, loss = training.state(), training.losses()
        features = _both(rows)
        for k in (0, 1):
            for good in (0, 1):
                own = ((rows["view"] == k) & (rows["good"] == good)).to_numpy()
                training.teach(k, features[1 - k][own], float(good))
        done |= {int(i) for i in rows["id"]}
        training.refit()
        rise = training.losses() - loss
        if rise.mean() > rise.std() / len(rise) ** 0.5:  # what was exchanged harms on held-out rows, by more than chance
            training.restore(before)
            break
    return training.finish()


SCORES = ("content_score", "metadata_score", "score")


def score_quality(docs: DataFrame, model: CoTrained | None, whole: bool = False, names: tuple[str, ...] | list[str] = SCORES) -> DataFrame:
    """doc_id (with `whole`, all columns of docs), content_score, metadata_score and score for each row of docs.

    Scores are calibrated probabilities of good quality. Without a model all are 0.5. Null and empty texts are scored as
    texts without words, null metadata as a value of its own; repeated rows are rows.
    """
    kept = docs.columns if whole else ["doc_id"]
    inner = list(dict.fromkeys([*kept, "text", "source", "lang", "n_chars"]))
    scores = list(names)  # with `whole`, names that docs doesn't have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scores(model, lambda: (_text_features(batch), metadata_features(*(batch.column(c).to_pandas() for c in ("source", "lang", "n_chars")))), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(o) for o in out)], names=[*kept, *scores])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} double" for c in scores)])
    return map_texts(docs.select(*[F.col(f"`{c}`") for c in inner]), run, fields)


def _scores(model: CoTrained | None, views: Callable[[], tuple[np.ndarray, np.ndarray]], rows: int) -> list[np.ndarray]:
    if model is None:
        return [np.full(rows, 0.5)] * 3
    text, meta = views()
    both = probability(model.logits(text, meta))
    return [both[:, 0], both[:, 1], model.score(text, meta)]


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, both calibrated views, score and keep (score of at least a half) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    # Texts are read once: the rows that are scored are those that the fit has seen.
    pool = spool(text_views(docs.withColumn("id", F.xxhash64("text", "source", "lang", "n_chars")), ["id", "doc_id"]), "views")
    model = _fitted(pool, table(spark, sf_dir, "labels"), LABELLED, ROUNDS, TAUGHT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Ids pass as they are: in pandas a null would turn the others into doubles.
            scores = _scores(model, lambda: _both(batch.to_pandas()), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in scores)], names=["doc_id", *SCORES])

    scored = map_texts(pool, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content_score double, metadata_score double, score double")
    return scored.withColumn("keep", F.col("score") >= 0.5)
