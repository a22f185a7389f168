"""Quality classifier by co-training two views of a document.

The text view is a logistic regression over hashed words and layout shares of the
text (binned into tokens), the page view one over what is known without reading
it: language, source, bytes and lines. Both start from a bounded sample of labelled documents. In each
round, each view scores all documents without a label and hands those it is most
sure of, a share of them all, to the other as pseudo-labels. At the end a logistic
regression on held-out labelled documents calibrates the views' log-odds and
weighs them by likelihood; that scores all documents. Its slopes have a prior
around 1, so that few held-out rows leave the plain sum of the views' log-odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import maybe_broadcast, staged, unused
from barloom.llm.layout import words_and_layout

VIEWS = ("text", "page")
#: Precision of the normal prior of a slope (around 1) and of the intercept (around 0) in the calibration.
PRIOR = (4.0, 4.0)


@dataclass(frozen=True)
class Fit:
    """Bound of the labelled sample (the first rows in the order of a hash of their id), and settings of the fit.

    share: of the documents without a label, per class, view and round.
    confident: the least calibrated chance of a pseudo-label.
    """

    labelled: int = 8000
    rounds: int = 2
    share: float = 0.01
    confident: float = 0.95
    held_out: int = 5
    features: int = 1 << 14
    iterations: int = 15
    penalty: float = 0.01


def _prefix(df: DataFrame) -> str:
    """Columns of our own carry this prefix, which no column of df has, and never reach a result."""
    found = "_quality_"
    while any(c.lower().startswith(found) for c in df.columns):
        found = "_" + found
    return found


def _with_features(df: DataFrame, text_col: str, page_cols: list[str], features: int, own: str) -> DataFrame:
    """df with the vectors of both views, in columns whose names start with own; rows need nothing but themselves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn(own + "split", words_and_layout(text))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    out = out.withColumns({own + "bytes": F.log1p(F.octet_length(text)), own + "lines": F.log1p(lines)})
    known = [f"{own}known{i}" for i in range(len(page_cols))]
    for name, c in zip(known, page_cols, strict=True):
        out = out.withColumn(name, F.coalesce(F.col(c).cast("string"), F.lit("")))
    stages = [HashingTF(inputCol=own + "split", outputCol=own + "text", numFeatures=features, binary=True)]
    if known:
        stages.append(FeatureHasher(inputCols=known, outputCol=own + "known", numFeatures=128))
    stages.append(VectorAssembler(inputCols=[*([own + "known"] if known else []), own + "bytes", own + "lines"], outputCol=own + "page"))
    out = PipelineModel(stages).transform(out)
    return out.drop(*known, *[own + c for c in ("split", "known", "bytes", "lines")])


def _fit_view(view: str, rows: DataFrame, settings: Fit, own: str) -> LogisticRegressionModel:
    """rows: label and the view's vector; both classes weigh the same."""
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    total = sum(n.values())
    weight = F.when(F.col("label") > 0, total / (2 * n.get(1.0, total))).otherwise(total / (2 * n.get(0.0, total)))
    learner = LogisticRegression(featuresCol=own + view, labelCol="label", weightCol="weight", maxIter=settings.iterations, regParam=settings.penalty, rawPredictionCol=own + "raw", probabilityCol="", predictionCol="")
    return learner.fit(rows.withColumn("weight", weight))


def _odds(model: LogisticRegressionModel, df: DataFrame, out: str, own: str) -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array(own + "raw")[1]).drop(own + "raw")


def calibrated(odds: np.ndarray, label: np.ndarray) -> tuple[list[float], float]:
    """Slopes and intercept of the logistic regression of the label on log-odds (a column a view), the likeliest under PRIOR."""
    x = np.column_stack([np.clip(odds, -30, 30), np.ones(len(odds))])
    centre = np.append(np.ones(x.shape[1] - 1), 0.0)
    precision = np.append(np.full(x.shape[1] - 1, PRIOR[0]), PRIOR[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - label * z) + precision @ (w - centre) ** 2 / 2)

    at = centre
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - label) + precision * (at - centre)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(precision), slope)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-12:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-10:
            break
    return [float(w) for w in at[:-1]], float(at[-1])


@dataclass(frozen=True)
class Views:
    """The fitted views with their calibration; none where there was nothing to learn from."""

    models: dict[str, LogisticRegressionModel]
    #: Slopes and intercept by name of a score: of each view on its own, and of both together.
    scales: dict[str, tuple[list[float], float]]
    #: How the names of its columns start.
    own: str = ""


def _hash_order(id_col: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, page_cols: list[str], label_col: str, settings: Fit) -> Views:
    own = _prefix(df)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).dropna()
    known = staged(known.groupBy("_id").agg((F.avg("label") >= 0.5).cast("double").alias("label")), "labels")
    sample = known.orderBy(*_hash_order("_id", 1)).limit(settings.labelled)
    sample = staged(sample.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(settings.held_out))), "sample")
    if sample.filter("_part > 0").select("label").distinct().count() < 2:
        return Views({}, {})
    page = [f"_known{i}" for i in range(len(page_cols))]
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(p) for c, p in zip(page_cols, page, strict=True)]).filter("_id IS NOT NULL")

    def features(rows: DataFrame) -> DataFrame:
        return _with_features(rows, "_text", page, settings.features, own).drop("_text", *page)

    # at most settings.labelled rows of an id and a label
    rows = staged(features(docs.join(F.broadcast(sample), "_id")), "labelled")
    learn, held = rows.filter("_part > 0").drop("_part"), rows.filter("_part = 0")
    if learn.select("label").distinct().count() < 2:
        return Views({}, {})
    taught = {v: learn.select("_id", "label", own + v) for v in VIEWS}
    models = {v: _fit_view(v, taught[v], settings, own) for v in VIEWS}
    if settings.rounds:
        # All documents without a label; a document of the sample's overflow has one and is left out too.
        free = docs.join(maybe_broadcast(known.select("_id"), known.count(), 16), "_id", "left_anti")
        free = staged(features(free), "unlabelled")

    def on_held(models: dict[str, LogisticRegressionModel]) -> tuple[np.ndarray, np.ndarray]:
        """The views' log-odds and the labels of the held-out rows: some settings.labelled / settings.held_out rows of three numbers."""
        rows = held
        for v in VIEWS:
            rows = _odds(models[v], rows, own + v + "odds", own)
        found = rows.select("label", *[own + v + "odds" for v in VIEWS]).toPandas().to_numpy(float)
        return found[:, 1:], found[:, 0]

    edge = float(np.log(settings.confident / (1 - settings.confident)))
    ends = F.array(F.lit(settings.share), F.lit(1 - settings.share))
    for _ in range(settings.rounds):
        # A view is as sure as its log-odds were right about the held-out rows. One pass
        # over all documents for the bounds of both teachers, one for the rows beyond them.
        odds, label = on_held(models)
        said, sure = free, {}
        for i, v in enumerate(VIEWS):
            (slope,), intercept = calibrated(odds[:, i : i + 1], label)
            said = _odds(models[v], said, own + v + "odds", own)
            said = said.withColumn(own + v + "odds", F.col(own + v + "odds") * slope + intercept)
        of = said.agg(*[F.percentile_approx(own + v + "odds", ends, 10000).alias(v) for v in VIEWS]).first()
        for v in VIEWS:
            low, high = of[v] or [0.0, 0.0]
            said_odds = F.col(own + v + "odds")
            sure[v] = (said_odds <= min(low, -edge)) | (said_odds >= max(high, edge))
        more = staged(said.filter(sure["text"] | sure["page"]), "pseudo-labels")
        for teacher, pupil in (VIEWS, VIEWS[::-1]):
            label = (F.col(own + teacher + "odds") > 0).cast("double").alias("label")
            rows = taught[pupil].unionByName(more.filter(sure[teacher]).select("_id", label, own + pupil))
            models[pupil] = _fit_view(pupil, rows, settings, own)
    odds, label = on_held(models)
    return Views(models, {"text": calibrated(odds[:, :1], label), "page": calibrated(odds[:, 1:], label), "both": calibrated(odds, label)}, own)


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    page_cols: tuple[str, ...] = ("lang", "source"),
    label_col: str = "quality",
    threshold: float = 0.5,
    settings: Fit = Fit(),
    names: tuple[str, str, str, str] = ("text_score", "page_score", "score", "keep"),
) -> DataFrame:
    """df with text_score, page_score and score (calibrated chances that the label is 1) and keep (score >= threshold).

    Every row is scored from its whole text; nothing is shuffled for that. Null and
    empty texts, null ids and repeated rows score like any other. Repeated labels of
    one id are averaged; labels without a document and nulls are left out. Where the
    labelled sample has fewer than two classes (no labels, an empty table) nothing
    can be learnt: all scores are 1 and every row stays. Columns of df with the new
    names are replaced; other names can be given for them.
    """
    page = [c for c in page_cols if c in df.columns]
    df = df.drop(*names)
    views = fit(df, labels, id_col, text_col, page, label_col, settings)
    if not views.models:
        return df.withColumns({n: F.lit(1.0) for n in names[:3]} | {names[3]: F.lit(True)})
    own = views.own
    out = _with_features(df, text_col, page, settings.features, own)
    for v in VIEWS:
        out = _odds(views.models[v], out, own + v + "odds", own).drop(own + v)

    def chance(name: str, *views_used: str) -> Column:
        slopes, intercept = views.scales[name]
        odds = sum((F.col(own + v + "odds") * slope for v, slope in zip(views_used, slopes, strict=True)), F.lit(intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))

    out = out.withColumns({names[0]: chance("text", "text"), names[1]: chance("page", "page"), names[2]: chance("both", *VIEWS)})
    return out.withColumn(names[3], F.col(names[2]) >= threshold).drop(*[own + v + "odds" for v in VIEWS])


def good(df: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows of df that classify() keeps, with df's columns."""
    names = unused(df, "text_score", "page_score", "score", "keep")
    return classify(df, labels, names=tuple(names), **options).filter(F.col(names[3])).select(*[F.col(f"`{c}`") for c in df.columns])
