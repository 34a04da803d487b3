"""Toxicity by weak supervision.

Lexicon entries are fixed insults and word beginnings that occur in toxic training documents far beyond
chance (binomial tails, corrected for the number of candidates). They are dealt to several lexicon voters, which
stand beside pattern voters (repetition, density, shouting, addressing). A generative label model takes the
voters' means and covariances over all documents that may be learned from, finds each voter's two rates by
triplets of covariances, finds which voters depend on each other by the covariance that the model leaves
unexplained, and turns votes into posterior labels. A linear classifier is trained on the posteriors.

Labels are read for training rows only (never held-out ones), for the lexicon and the class share; the sample of
labelled rows is bounded by ``sample`` and drawn by a hash of the doc_id alone. Its whole texts are counted in tasks;
only counts, votes and inputs of the classifier reach the driver. Vote statistics are sums over all rows.

Defined results: null and empty texts get the score of a text without any entry; repeated rows get equal
answers; a doc_id that is labelled both 0 and 1 counts in both classes; without labels the fixed insults alone vote; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import fresh, held_out, stored
from attestor.llm.tokens import slices

#: Labelled documents of each class that the lexicon and the classifier are fitted on.
SAMPLE = 1500
MAX_TALLY = 500_000  # entries that a task counts before it hands them on
MAX_ENTRIES, THRESHOLD, DEFAULT_SHARE = 160, 0.7, 0.1
#: Voters whose correlation within a class exceeds this depend on each other; RIDGE keeps equal voters solvable.
DEPENDENT, RIDGE = 0.1, 0.2
LEXICON_VOTERS = 3

#: Insults as whole words, lower case, by language.
INSULTS_OF = {
    "en": (
        "idiot", "moron", "stupid", "dumb", "imbecile", "loser", "pathetic", "worthless", "trash", "scum", "clown", "disgusting", "idiots", "morons",
        "losers", "clowns", "vermin", "filthy", "retard", "bastard", "bitch", "asshole", "scumbag", "degenerate",
    ),
    "de": ("dumm", "dummkopf", "arschloch", "wertlos", "abschaum", "widerlich", "vollidiot", "trottel"),
    "fr": ("crétin", "connard", "salaud", "ordure", "débile", "abruti", "imbécile"),
    "es": ("idiota", "estúpido", "imbécil", "basura", "asqueroso", "patético", "escoria"),
}
INSULTS = tuple(w for words in INSULTS_OF.values() for w in words)
#: Voters that read no lexicon: a text counts if the expression is found in its lower-cased form.
PATTERNS = {
    "threat": r"\b(?:i(?:'ll| will| am going to)|we(?:'ll| will)|someone should|ich werde) (?:kill|hurt|beat|destroy|find|shoot|umbringen)\b|\b(?:kill|hang) yourself\b|\byou (?:deserve|ought) to (?:die|suffer)\b|\bhope you die\b|\bbring dich um\b|\bvais te tuer\b|\bvoy a matar\b",
    "silencing": r"\bshut (?:the \w+ )?up\b|\bget lost\b|\bgo to hell\b|\bnobody (?:likes|wants|asked) you\b|\bhalt(?:'s| die) (?:maul|klappe)\b|\bhau ab\b|\bta gueule\b|\bferme-la\b|\bcállate\b|\blárgate\b",
    "second person": r"\b(?:you are|you're|du bist|tu es|vous êtes|eres|sie sind) (?:such |all |just |nothing but |so |ein |eine |un |une |una |einfach )",
    "hatred": r"\b(?:i|we) (?:hate|despise|loathe) (?:you|them|those|these)\b|\b(?:hasse|verachte) (?:dich|euch|sie)\b|\bje (?:te|vous) (?:hais|déteste)\b|\b(?:te|los) odio\b",
    "masked": r"\b[a-z]{1,2}[*@#$]{2,}[a-z]{0,2}\b|\b[a-z]\*[a-z]{2}\b",
    "marks": r"[!?]{3,}|!1+!",
    "drawn out": r"([a-zà-ÿ])\1{4,}",
}
VOTERS = (*(f"insults {x}" for x in INSULTS_OF), *(f"mined {i}" for i in range(LEXICON_VOTERS)), "repeated", "dense", "shouting", *PATTERNS)
_FINDERS = tuple(re.compile(p).search for p in PATTERNS.values())


@dataclass(frozen=True)
class Lexicon:
    """Entries (text, whole word or word beginning, how often it must stand in a text to count): the fixed insults, then what
    was mined."""

    entries: tuple[tuple[str, bool, int], ...]

    def __getstate__(self):
        return {"entries": self.entries}  # the automaton is built where it is used

    @cached_property
    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, (text, whole, _) in enumerate(self.entries):
            made.add_word(text, (i, len(text), whole))
        made.make_automaton()
        return made

    def counts(self, texts: list[str]) -> np.ndarray:
        """(texts, entries): how often each entry stands in each text, 0 where that is too seldom to count."""
        out = np.zeros((len(texts), len(self.entries)), np.float32)
        found = self.automaton.iter
        for row, text in enumerate(texts):
            low = text.lower()
            n = len(low)
            for end, (i, size, whole) in found(low):
                before = end - size
                if before >= 0 and low[before].isalpha():
                    continue
                if whole and end + 1 < n and low[end + 1].isalpha():
                    continue
                out[row, i] += 1
        return out * (out >= np.array([need for *_, need in self.entries]))

    def votes(self, texts: list[str], counts: np.ndarray) -> np.ndarray:
        """(texts, voters): 1 for toxic, 0 against."""
        met, total, at, lists = counts > 0, counts.sum(1), 0, []
        for some in INSULTS_OF.values():
            lists.append(met[:, at : at + len(some)].any(1))
            at += len(some)
        lists += [met[:, at + k :: LEXICON_VOTERS].any(1) for k in range(LEXICON_VOTERS)]
        words = np.array([t.count(" ") + 1 for t in texts])
        capitals = np.array([t.isupper() for t in texts])
        low = [t.lower() for t in texts]
        patterns = [np.array([find(t) is not None for t in low]) for find in _FINDERS]
        return np.stack([*lists, total >= 2, total / words >= 0.005, capitals, *patterns], 1).astype(np.float64)

    def inputs(self, texts: list[str], counts: np.ndarray) -> np.ndarray:
        """What the linear classifier sees: total, distinct and density of entries, then each entry."""
        total = counts.sum(1)
        words = np.array([t.count(" ") + 1 for t in texts])
        return np.column_stack([np.log1p(total), np.log1p((counts > 0).sum(1)), np.sqrt(total / words), np.minimum(counts, 1)])


def text_entries(text: str) -> Iterator[tuple[str, int]]:
    """Word beginnings and words (closed by a space) of a text, each with 1, 2 and 3 as far as it stands so often."""
    met: Counter = Counter()
    for w, k in Counter("".join(c if c.isalpha() else " " for c in text.lower()).split()).items():
        if len(w) >= 3:
            for size in range(3, min(len(w), 8)):
                met[w[:size]] += k
            met[w + " "] += k
    return ((g, need) for g, k in met.items() for need in range(1, min(k, 3) + 1))


def entry_counts(labelled: DataFrame) -> DataFrame:
    """entry, need, toxic, clean: in how many documents (text, toxic) of each class an entry stands so often."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()

        def handed() -> pd.DataFrame:
            return pd.DataFrame([(g, need, k if y else 0, 0 if y else k) for (g, need, y), k in tally.items()], columns=["entry", "need", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                tally.update((g, need, y) for g, need in text_entries(text))
                if len(tally) > MAX_TALLY:
                    yield handed()
                    tally.clear()
        yield handed()

    rows = labelled.select("text", "toxic").mapInPandas(counted, "entry string, need int, toxic long, clean long")
    return rows.groupBy("entry", "need").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def mine_entries(labelled: DataFrame) -> list[tuple[str, bool, int]]:
    """Word beginnings and words that toxic documents hold once, twice or three times where clean ones do not.

    An entry must hold in ten times as large a part of the toxic documents as of the clean ones, and more often
    than chance explains (binomial tail, corrected for the number of candidates). Entries that gain most come first;
    of an entry and its beginnings one is taken. labelled: (text, toxic).
    """
    n = Counter({r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()})
    if not n[0] or not n[1]:
        return []
    counts = stored(entry_counts(labelled).where("toxic > 0"), "entries")
    share, least = n[1] / (n[0] + n[1]), math.log(0.01 / max(1, counts.count()))
    good = []
    for r in counts.where((F.col("toxic") >= 5) & (F.col("toxic") / n[1] >= 10 * F.col("clean") / n[0])).collect():
        g, need, k, other = r["entry"], r["need"], r["toxic"], r["clean"]
        # log C(k + other, other) bounds the number of ways in which the others can stand among all.
        tail = k * math.log(share) + math.lgamma(k + other + 1) - math.lgamma(other + 1) - math.lgamma(k + 1)
        if tail < least:
            good.append((k / n[1] - 5 * other / n[0], len(g), -need, g))
    chosen: dict[str, int] = {}
    for _, _, need, g in sorted(good, key=lambda x: (-x[0], -x[1], -x[2], x[3])):
        if not any(g.startswith(c) or c.startswith(g) for c in chosen):
            chosen[g] = -need
        if len(chosen) == MAX_ENTRIES:
            break
    return [(g.strip(), g.endswith(" "), need) for g, need in chosen.items()]


@dataclass(frozen=True)
class LabelModel:
    """Rates P(vote | toxic), P(vote | clean) and the weight of each voter after what it shares with others."""

    share: float
    toxic: np.ndarray
    clean: np.ndarray
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.toxic / self.clean) * self.weights
        no = np.log((1 - self.toxic) / (1 - self.clean)) * self.weights
        logit = math.log(self.share / (1 - self.share)) + votes @ yes + (1 - votes) @ no
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(n: float, sums: np.ndarray, products: np.ndarray, share: float) -> LabelModel:
    """From the number of documents, the sums of votes and of their pairwise products.

    A voter's effect comes from triplets of covariances, which hold for voters that are independent within a class. Pairs
    whose covariance the effects leave unexplained are dependent; effects are estimated again from triplets without such a pair.
    The weights solve the system of within-class correlations of the dependent pairs, so that voters which say the same share the weight of one.
    """
    n = max(n, 1.0)
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    m, scale = len(mean), math.sqrt(share * (1 - share))
    dependent = np.zeros((m, m), bool)
    for _ in range(2):
        effect = np.zeros(m)
        for i in range(m):
            found = []
            for j, k in combinations([x for x in range(m) if x != i], 2):
                if cov[i, j] > 1e-7 and cov[i, k] > 1e-7 and cov[j, k] > 1e-7:
                    found.append((bool(dependent[i, j] or dependent[i, k] or dependent[j, k]), math.sqrt(cov[i, j] * cov[i, k] / cov[j, k])))
            free = [e for tied, e in found if not tied] or [e for _, e in found]
            effect[i] = np.median(free) / scale if free else 0.0
        effect = np.minimum(effect, np.minimum(mean / share, (1 - mean) / (1 - share)))  # both rates stay between 0 and 1
        toxic = np.clip(mean + (1 - share) * effect, 1e-3, 1 - 1e-3)
        clean = np.clip(mean - share * effect, 1e-4, 1 - 1e-3)
        rest = cov - np.outer(effect, effect) * scale**2
        spread = np.sqrt(np.maximum(share * toxic * (1 - toxic) + (1 - share) * clean * (1 - clean), 1e-9))
        tied = np.clip(rest / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(tied, 0)
        dependent = tied > DEPENDENT
    within = np.where(dependent, tied, 0.0) + np.eye(m)
    weights = np.linalg.solve(within + RIDGE * np.eye(m), np.full(m, 1 + RIDGE))
    return LabelModel(share, toxic, clean, np.clip(weights, 0.05, 1.0))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for a, b in slices(texts, 1_000_000):
            counts = self.lexicon.counts(texts[a:b])
            out.append(self.lexicon.inputs(texts[a:b], counts) @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -30, 30)))


def fit_linear(x: np.ndarray, targets: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps, classes weighted alike."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, eye = np.zeros(x1.shape[1]), np.eye(x1.shape[1]) * ridge
    eye[-1, -1] = 1e-6
    heavy = np.where(targets >= 0.5, 0.5 / max(1, (targets >= 0.5).sum()), 0.5 / max(1, (targets < 0.5).sum())) * len(x)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (heavy * (targets - p)) - eye @ w
        bend = (x1 * (heavy * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x1 + eye
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float]:
    """The documents (doc_id, text, toxic) of sample labels of each class, those with the least hashes of the doc_id, and the
    share of toxic ones among all labels; none held out."""
    known = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("_toxic")).where(
        F.col("_toxic").isin(0, 1) & F.col("_label_id").isNotNull() & ~held_out(F.col("_label_id"))
    )
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    part = F.when(F.col("_toxic") == 1, F.lit(min(1.0, (2 * sample + 50) / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, (2 * sample + 50) / max(1, counts.get(0, 0)))))
    place = F.pmod(F.xxhash64("_label_id", F.lit(29)), F.lit(1_000_000))
    drawn = known.where(place < part * 1_000_000).withColumn("_place", place).distinct()  # more than are needed
    drawn = drawn.withColumn("_nth", F.row_number().over(Window.partitionBy("_toxic").orderBy("_place", "_label_id"))).where(F.col("_nth") <= sample)
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_label_id")).where(F.length("text") > 0)  # at most 2 * sample ids
    total = sum(counts.values())
    return stored(met.select("doc_id", "text", F.col("_toxic").alias("toxic")), "labelled"), (counts.get(1, 0) / total if total else DEFAULT_SHARE)


def sample_inputs(labelled: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(documents, inputs) of the classifier and (documents, voters), in an order that does not depend on that of the rows."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts, 1_000_000):
                counts = lexicon.counts(texts[a:b])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].to_numpy(), "inputs": list(lexicon.inputs(texts[a:b], counts).astype(np.float64)), "votes": list(lexicon.votes(texts[a:b], counts))})

    rows = labelled.select("doc_id", "text").mapInPandas(made, f"doc_id {dict(labelled.dtypes)['doc_id']}, inputs array<double>, votes array<double>")
    held = sorted((r["doc_id"], r["inputs"], r["votes"]) for r in rows.collect())
    return np.array([x for _, x, _ in held]).reshape(len(held), 3 + len(lexicon.entries)), np.array([v for *_, v in held]).reshape(len(held), len(VOTERS))


def vote_sums(docs: DataFrame, lexicon: Lexicon) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of documents, sums of votes and of products of votes, over all rows that are not held out."""
    m = len(VOTERS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, products = 0, np.zeros((m, m))
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].tolist()]
            for a, b in slices(texts, 1_000_000):
                votes = lexicon.votes(texts[a:b], lexicon.counts(texts[a:b]))
                products += votes.T @ votes
                n += b - a
        # A voter's product with itself is its vote.
        yield pd.DataFrame({"cell": range(m * m + 1), "total": [*products.ravel(), float(n)]})

    found = docs.where(~held_out(F.col("doc_id"))).select("text").mapInPandas(sums, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(m * m + 1)
    for r in found:
        flat[r["cell"]] = r["total"]
    products = flat[:-1].reshape(m, m)
    return float(flat[-1]), np.diag(products).copy(), products


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    labelled, share = labelled_sample(docs, labels, sample)
    mined = [e for e in mine_entries(labelled) if e[0] not in INSULTS]
    lexicon = Lexicon(tuple((w, True, 1) for w in INSULTS) + tuple(mined))
    share = min(max(share, 0.005), 0.5)
    model = fit_label_model(*vote_sums(docs, lexicon), share)
    inputs, votes = sample_inputs(labelled, lexicon)
    texts = list(INSULTS) + [f"{a} {b}" for a, b in zip(INSULTS, INSULTS[1:], strict=False)] + [""]
    counts = lexicon.counts(texts)
    inputs, votes = np.concatenate([inputs, lexicon.inputs(texts, counts)]), np.concatenate([votes, lexicon.votes(texts, counts)])
    weights, bias = fit_linear(inputs, model.posterior(votes))
    return ToxicityModel(lexicon, weights, bias)


def score_column(text: Column, model: ToxicityModel, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)  # at most MAX_ENTRIES entries and their weights

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t if isinstance(t, str) else "" for t in texts.tolist()]), dtype="float64")

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels: (doc_id, toxic)."""
    model = fit_toxicity(docs, labels, sample)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that are predicted toxic, all columns as they were."""
    model = fit_toxicity(docs, labels, sample)
    (found,) = fresh(docs, "toxicity")
    judged = docs.withColumn(found, score_column(F.col("text"), model, docs.sparkSession))
    return judged.where(F.col(found) < THRESHOLD).select(*docs.columns)
