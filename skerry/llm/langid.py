"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chargrams import grams
from .common import stored, unused

#: Orders of the character n-grams and number of hashed features.
ORDERS, FEATURES = (1, 2, 3), 1 << 16
#: Languages whose matrix (FEATURES numbers each, 32 MB in all) is broadcast at a time; more are scored in further passes.
LANGUAGES_A_PASS = 64


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # in text order
    texts: np.ndarray  # their numbers of texts
    counts: DataFrame  # lang, feature, n: a stored table; feature FEATURES counts texts
    smooth: float

    def block(self, first: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """LANGUAGES_A_PASS languages from the first-th on: names, log shares of all texts, log probabilities [language, feature]."""
        names = self.languages[first : first + LANGUAGES_A_PASS]
        place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")).cast("int") - 1
        table = self.counts.where(F.col("feature") < FEATURES).select(place.alias("at"), "feature", "n").where("at >= 0").toArrow()
        full = np.full((len(names), FEATURES), self.smooth)
        full[table["at"].to_numpy(), table["feature"].to_numpy()] += table["n"].to_numpy()
        return names, np.log(self.texts[first : first + len(names)] / self.texts.sum()), np.log(full / full.sum(1, keepdims=True))


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """Learn from all rows with a text and a language for which train holds. Each task sums its counts before the shuffle."""

    def count(parts):
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            langs, first = np.array(part["l"].to_pylist(), object).astype(str), -1
            for at, size, found, _ in grams((t.as_py() for t in part["t"]), ORDERS):
                names, lang = np.unique(langs[at : at + size], return_inverse=True)
                table = np.zeros((len(names), FEATURES), np.int64)
                for h, number in found:
                    cell = lang[number] * FEATURES + (h & np.uint64(FEATURES - 1)).astype(np.int64)
                    table += np.bincount(cell, minlength=table.size).reshape(table.shape)
                texts = np.bincount(lang) * (at != first)  # a long text comes in several pieces
                first = at
                for name, row, n in zip(names.tolist(), table, texts, strict=True):
                    own = sums.setdefault(name, np.zeros(FEATURES + 1, np.int64))
                    own[:-1] += row
                    own[-1] += n
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "feature", "n"])

    rows = docs.where(F.coalesce(train, F.lit(False))).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-counts")
    texts = counts.where(F.col("feature") == FEATURES).orderBy("lang").select("lang", "n").collect()
    return LanguageModel([r.lang for r in texts], np.array([r.n for r in texts], float), counts, smooth)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with a predicted language and the posterior probability of it (0 to 1), whole texts, no shuffle.
    Languages are scored in passes that carry the best so far and the sum of probabilities; with one pass nothing is stored.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned. Existing
    columns with the new names are replaced. Ties go to the first language in text order.
    """
    docs = docs.drop(*out)
    docs_names, column = docs.columns, docs.columns.index(text_col)
    state = best, top, total = unused(docs.columns, "best", "top", "total")
    fields = [T.StructField(best, T.StringType()), T.StructField(top, T.DoubleType()), T.StructField(total, T.DoubleType())]

    def scorer(shared):
        def score(parts):
            languages, prior, log_prob = shared.value
            names = np.array(languages, object)
            for part in parts:
                logs, lettered = np.tile(prior, (part.num_rows, 1)), np.zeros(part.num_rows, bool)
                for first, size, found, some in grams((t.as_py() for t in part.column(column).cast(pa.string())), ORDERS):
                    lettered[first : first + size] |= some
                    for h, number in found:
                        f = (h & np.uint64(FEATURES - 1)).astype(np.int64)
                        for i in range(len(names)):
                            logs[first : first + size, i] += np.bincount(number, weights=log_prob[i][f], minlength=size)
                old = part.columns[len(docs_names) :]
                was, before, mass = old[0].to_numpy(zero_copy_only=False), old[1].fill_null(-np.inf).to_numpy(), old[2].to_numpy()
                high = logs.max(1)
                now = np.maximum(before, high)
                mass = mass * np.exp(before - now) + np.exp(logs - now[:, None]).sum(1)
                lead = np.where(high > before, names[logs.argmax(1)], was)
                cols = [pa.array(lead, pa.string(), mask=~lettered), pa.array(now, pa.float64()), pa.array(mass, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(docs_names)], *cols], names=[*docs_names, *state])

        return score

    scored = docs.withColumns({best: F.lit(None).cast("string"), top: F.lit(None).cast("double"), total: F.lit(0.0)})
    for first in range(0, len(model.languages), LANGUAGES_A_PASS):
        if first:
            scored = stored(scored, "languages")
        shared = docs.sparkSession.sparkContext.broadcast(model.block(first))
        scored = scored.mapInArrow(scorer(shared), T.StructType([*docs.schema.fields, *fields]))
    known = F.col(best).isNotNull()
    return scored.withColumns({out[0]: F.coalesce(F.col(best), F.lit("und")), out[1]: F.when(known, 1 / F.col(total)).otherwise(0.0)}).drop(*state)
