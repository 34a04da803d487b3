"""Language identification: the language family first, then one-versus-one linear support vector machines.

Texts become shares of hashed character n-grams. One-versus-one machines separate the families; inside each
family further machines separate each pair of its languages, and the language that wins most of its pairs (the
larger summed margin among equals) is predicted. All machines are rows of one weight table, so a text is read
once for all of them. They are fitted on the driver on a sample of labelled rows that is bounded for each
language (``per_language``), drawn by a hash of the doc_id alone, never from held-out rows. Whole texts are counted
in tasks; only the counts of their n-grams reach the driver.

Defined results: ``und`` with score 0 for null texts and texts without letters; where no labelled row can be
learned from, ``und`` for all; at most MAX_LANGUAGES languages are learned, the most frequent ones; repeated rows get equal answers; an empty table gives an empty result; other
columns are not read. A language without a known family is a family of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import fresh, held_out
from attestor.llm.features import DIMENSION, bucket_counts, count_rows, linear_scores
from attestor.llm.tokens import slices

SIZES = (1, 2, 3)
#: Labelled rows of each language that the machines are fitted on.
PER_LANGUAGE = 600
#: The most frequent languages that are learned; rows in others are not learned from.
MAX_LANGUAGES = 200

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nl", "nn", "no", "nb", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


@dataclass(frozen=True)
class LanguageModel:
    """weights: (DIMENSION, machines). Each machine (a, b, column, bias): positive margins speak for a."""

    weights: np.ndarray
    families: tuple[tuple[str, str, int, float], ...]
    languages: dict[str, tuple[tuple[str, str, int, float], ...]]
    members: dict[str, tuple[str, ...]]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        some = [t for t in texts if t and self.members and any(map(str.isalpha, t))]
        if not some:
            return [("und", 0.0)] * len(texts)
        margins = linear_scores(some, self.weights, SIZES)
        answers = iter([self._decide(row) for row in margins])
        return [next(answers) if t and any(map(str.isalpha, t)) else ("und", 0.0) for t in texts]

    def _decide(self, row: np.ndarray) -> tuple[str, float]:
        family, sure = _vote(sorted(self.members), self.families, row)
        lang, surer = _vote(sorted(self.members[family]), self.languages[family], row)
        return lang, float(sure * surer)


def _vote(classes: list[str], machines, row: np.ndarray) -> tuple[str, float]:
    if len(classes) == 1:
        return classes[0], 1.0
    wins, margin = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0)
    worst = dict.fromkeys(classes, 1.0)
    for a, b, column, bias in machines:
        m = row[column] + bias
        wins[a if m >= 0 else b] += 1
        for x, signed in ((a, m), (b, -m)):
            margin[x] += signed
            worst[x] = min(worst[x], 1 / (1 + np.exp(-4 * np.clip(signed, -50, 50))))
    best = max(classes, key=lambda c: (wins[c], margin[c], c))
    return best, worst[best]


def fit_machine(rows: list, signs: np.ndarray, epochs: int = 12, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged stochastic subgradient steps on the squared hinge, classes weighted alike."""
    rng = np.random.default_rng(7)
    w, mean, bias, mean_bias, step = np.zeros(DIMENSION), np.zeros(DIMENSION), 0.0, 0.0, 0
    weight = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (1, -1)}
    passes = [i for _ in range(epochs) for i in rng.permutation(len(rows))]
    first = len(passes) // 2
    for step, i in enumerate(passes):
        found, shares = rows[i]
        gap = 1 - signs[i] * (w[found] @ shares + bias)
        if gap > 0:
            rate = 20.0 / (1 + 20.0 * 0.002 * step) * weight[signs[i]]
            rate = min(rate, 1.0 / (shares @ shares + 1e-3))  # no step beyond the margin
            w[found] += rate * gap * signs[i] * shares
            bias += 0.01 * gap * signs[i]
        if step % 500 == 0:
            w *= 1 - penalty
        if step >= first and step % 20 == 0:
            n = (step - first) // 20 + 1
            mean += (w - mean) / n
            mean_bias += (bias - mean_bias) / n
    return mean, mean_bias


def fit_languages(labelled: list[tuple[str, str]]) -> LanguageModel:
    """labelled: (text, language)."""
    return fit_counted(list(count_rows([t for t, _ in labelled], SIZES)), np.array([lang for _, lang in labelled]))


def fit_counted(rows: Sequence[tuple[np.ndarray, np.ndarray]], langs: np.ndarray) -> LanguageModel:
    """rows: the buckets of each text's n-grams and their shares."""
    families = np.array([family_of(lang) for lang in langs])
    members = {f: tuple(sorted(set(langs[families == f]))) for f in sorted(set(families))}
    columns: list[np.ndarray] = []

    def machines(classes: list[str], of: np.ndarray):
        out = []
        for a, b in combinations(classes, 2):
            which = np.flatnonzero((of == a) | (of == b))
            w, bias = fit_machine([rows[i] for i in which], np.where(of[which] == a, 1, -1))
            columns.append(w)
            out.append((a, b, len(columns) - 1, bias))
        return tuple(out)

    top = machines(sorted(members), families)
    inner = {f: machines(sorted(m), langs) for f, m in members.items()}
    weights = np.stack(columns, 1) if columns else np.zeros((DIMENSION, 1))
    return LanguageModel(weights.astype(np.float32), top, inner, members)


class Counted(Sequence):
    """Buckets and shares of texts, kept as bytes of their counts and unpacked where they are read."""

    def __init__(self, packed: list[tuple[bytes, bytes]]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        found, counts = (np.frombuffer(x, t) for x, t in zip(self.packed[i], (np.uint16, np.int32), strict=True))
        return found.astype(np.int32), counts / max(1, counts.sum())


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[Counted, np.ndarray]:
    """The n-grams and languages of per_language labelled rows of each language, those with the least hashes of the doc_id;
    none is held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * per_language + 50) / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    drawn = known.where(place < share * 1_000_000).select("doc_id", "lang", "text", place.alias("place"))  # more than are needed

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [(found.astype(np.uint16).tobytes(), n.astype(np.int32).tobytes()) for found, n in (bucket_counts(t, SIZES) for t in batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "place": batch["place"], "found": [x for x, _ in packed], "counts": [x for _, x in packed]})

    rows = drawn.mapInPandas(counted, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, place long, found binary, counts binary")
    order = ["place", "doc_id", "found", "counts"]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("nth") <= per_language)
    out = [(r["doc_id"], bytes(r["found"]), bytes(r["counts"]), r["lang"]) for r in rows.toLocalIterator()]
    out.sort(key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))  # the fit must not depend on the order of arrival
    return Counted([(found, n) for _, found, n, _ in out]), np.array([lang for *_, lang in out])


ANSWER = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_column(text: Column, model: LanguageModel, spark) -> Column:
    """A struct (lang, score) of each text."""
    shared = spark.sparkContext.broadcast(model)  # its size is set by the number of languages, not by the data

    @F.pandas_udf(ANSWER)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        held = texts.tolist()
        held = [t if isinstance(t, str) else None for t in held]
        answers = []
        for a, b in slices([t or "" for t in held], 1_000_000):
            answers += shared.value.predict(held[a:b])
        return pd.DataFrame(answers, columns=["lang", "score"])

    return predicted(text)


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang)."""
    model = fit_counted(*training_sample(docs, per_language))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict_column(F.col("text"), model, docs.sparkSession).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def with_known_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs without the rows whose language is undetermined (null texts and texts without letters), all columns as they were."""
    model = fit_counted(*training_sample(docs, per_language))
    (found,) = fresh(docs, "language")
    judged = docs.withColumn(found, predict_column(F.col("text"), model, docs.sparkSession))
    return judged.where(F.col(found)["lang"] != "und").select(*docs.columns)
