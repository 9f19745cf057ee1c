"""Language identification: family first, then one-versus-one support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.linear import platt, sigmoid, train_svm, trigram_counts, unit_rows

#: Families of common languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
}
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class LanguageModel:
    """One-versus-rest machines between families, one-versus-one machines between their languages."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, families: Mapping[str, str], dim: int):
        self.dim, self.langs = dim, sorted(set(langs))
        family = np.array([families.get(v, v) for v in langs])
        self.families = sorted(set(family))
        self.members = {f: [v for v in self.langs if families.get(v, v) == f] for f in self.families}
        self.family_models = [self._fit(x, family == f) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                own = (langs == a) | (langs == b)
                self.pairs[a, b] = self._fit(x[own], langs[own] == a)

    @staticmethod
    def _fit(x: np.ndarray, yes: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        w, b = train_svm(x, np.where(yes, 1.0, -1.0))
        slope, shift = platt(x @ w + b, yes.astype(float))
        return w.astype(np.float32), b, slope, shift

    @staticmethod
    def _probability(x: np.ndarray, model: tuple) -> np.ndarray:
        w, b, slope, shift = model
        return sigmoid(slope * (x @ w + b) + shift)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the family's probability times that of the language in it.

        Within a family each pair votes; most votes win, then the larger sum of probabilities,
        then the smaller name.
        """
        n = len(x)
        share = np.ones((n, 1))
        if self.family_models:
            share = np.stack([self._probability(x, m) for m in self.family_models], 1)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
        chosen = share.argmax(1)
        lang, score = np.empty(n, object), np.zeros(n)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == i)
            names = self.members[f]
            if not len(rows):
                continue
            if len(names) == 1:
                lang[rows], score[rows] = names[0], share[rows, i]
                continue
            votes, belief = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for a, b in combinations(range(len(names)), 2):
                p = self._probability(x[rows], self.pairs[names[a], names[b]])
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                belief[:, a] += p
                belief[:, b] += 1 - p
            best = (votes + belief / len(names)).argmax(1)
            lang[rows] = np.array(names, object)[best]
            score[rows] = share[rows, i] * belief[np.arange(len(rows)), best] / (len(names) - 1)
        return lang, np.clip(score, 0, 1)


def held_out() -> F.Column:
    """True for the fold that is never learned from: crc32 of the id as text divisible by 5."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, families: Mapping[str, str], sample: int, dim: int) -> LanguageModel | None:
    """Learn from at most ``sample`` documents, evenly over the languages (smallest id hashes).

    A repeated id counts once, with the least of its languages and that row's own text; null ids are not learned
    from.  Of more than ``sample`` languages only the most frequent ones are learned.  Rows of a language are first cut
    by a bound on their hash that leaves about the wanted number, so no language is gathered in one task.
    Trigrams are counted in tasks; the driver gets the sample's count vectors only.
    """
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    row = F.struct("lang", F.xxhash64("text").alias("mark"))
    own = usable.groupBy("doc_id").agg(F.min(row).alias("_o")).select("doc_id", "_o.lang", "_o.mark")
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.orderBy(F.col("n").desc(), "lang").limit(sample).collect()  # at most ``sample`` rows
    if not kept:
        return None
    quota = max(1, sample // len(kept))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    # Five deviations above the quota; what is above it is cut below.
    bound = (quota + 5 * quota**0.5 + 10) / F.col("n")
    sizes = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in kept], "lang string, n long")
    near = own.join(F.broadcast(sizes), "lang").where(share < bound)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= quota).select("doc_id", "lang", "mark")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sparse = []
            for row in trigram_counts(batch.column(2), dim, True):
                at = np.flatnonzero(row)
                sparse.append((at.astype(np.int32).tobytes(), row[at].astype(np.float32).tobytes()))
            ats, values = zip(*sparse) if sparse else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ats, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "lang", "at", "value"],
            )

    marked = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"))
    same = marked.join(F.broadcast(chosen), ["doc_id", "lang", "mark"])  # at most ``sample`` ids
    picked = same.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = picked.select("doc_id", "lang", "text").mapInArrow(count, "doc_id long, lang string, at binary, value binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["at"]))
    x = np.zeros((len(rows), dim), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    return LanguageModel(unit_rows(x), np.array([r["lang"] for r in rows]), families, dim)


def identify(
    docs: DataFrame, families: Mapping[str, str] = FAMILIES, sample: int = 4000, dim: int = 2048
) -> DataFrame:
    """Predict the language of each whole text.

    Features are byte trigrams of the letters, hashed to ``dim`` places; neither lang nor
    source nor id is one.  The model is fitted on at most ``sample`` labelled documents outside
    the held-out fold and sent to the tasks (some tens of kB); all documents are then scored in one pass
    without a shuffle.

    Null text or no letter: ``und``, score 0.  Nothing to learn from: every text is ``und``.
    Null lang: not learned from.  Repeated rows get equal answers.  Empty input: no rows.

    Returns doc_id, held_out, lang_pred, score.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    model = train(narrow, families, sample, dim)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.num_rows
                lang, sure = np.full(n, UNKNOWN, object), np.zeros(n)
                spoken = np.array([t is not None and _LETTER.search(t) is not None for t in part.column(2).to_pylist()], bool)
                if model is not None and spoken.any():
                    x = np.stack(list(trigram_counts(part.column(2), dim, True)))
                    lang[spoken], sure[spoken] = model.predict(unit_rows(x[spoken]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(sure)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return narrow.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, lang_pred string, score double"
    )
