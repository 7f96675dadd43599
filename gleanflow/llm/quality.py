"""Quality rules by weak supervision: rules vote or abstain, and their accuracies are estimated without labels.

Each rule looks at counts of a whole text and votes good (2), bad (0) or abstains (1). Expectation-maximisation
on the votes of all documents that pass the base rules (the others are decided) estimates for each rule how often it is right on good and on bad texts, together with
the share of good ones. A document is kept if its posterior probability of being good reaches ``KEEP``,
unless the two base rules reject it. The documents reach the driver only as counts per distinct vote pattern, at most
3 ** rules of them.

Defined cases: a null or empty text has all counts 0 and fails the base rules; equal rows get equal results; an empty table
gives no rows and fits nothing; other columns of the input are kept by :func:`good_documents` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import named, staged, table, unused

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
KEEP = 0.5
# Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    b"the of and to in a is that it for on with as was by at this are be or from "
    b"de la le les et des en un une du est que qui dans pour pas sur au par avec "
    b"der die und das von zu mit den ist im auf ein eine nicht dem sich es fur "
    b"el los las y del se no con una su al lo como por".split()
)

COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper_words n_letter_words n_stop_words n_ends"
).split()


def text_counts(text: str) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), *[0] * 7)
    lines = text.split("\n")
    filled = [line for line in lines if line.strip(WHITE)]
    ids: dict[bytes, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        width = len(ids)
        pairs = np.unique(row[:-1] * width + row[1:], return_inverse=True)[1]
        _, at, times = np.unique(pairs[:-1] * width + row[2:], return_inverse=True, return_counts=True)
        found = np.flatnonzero(times[at] > 1)
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[found + shift] = True
        repeated = int(covered.sum())
    times = np.bincount(row)
    kinds = list(ids)
    upper = np.array([len(w) > 1 and w.isupper() for w in kinds])
    letters = np.array([any(c > 127 or 97 <= c | 32 <= 122 for c in w) for w in kinds])
    stops = np.array([w.lower().strip(b".,;:!?") in STOP_WORDS for w in kinds])
    ends = np.array([w.endswith((b".", b"!", b"?")) for w in kinds])
    return (
        n,
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeated,
        len(filled),
        *(int(times @ mark) for mark in (upper, letters, stops, ends)),
    )


def counted(docs: DataFrame, text: str = "text", name: str = "_counts") -> DataFrame:
    """``docs`` with the struct ``name``."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_counts(t or "") for t in texts], columns=COUNTS, dtype="int64")

    # Without this, a filter would have the counts made once more.
    return docs.withColumn(name, counts.asNondeterministic()(F.col(text)))


# --- rules --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


# Conditions on the counts; n_words is at least 1 where a ratio is asked for.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words < n_words"),
    Rule("capitals", "10 * n_upper_words > 3 * n_words", "10 * n_upper_words < n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words",
         "2 * word_chars >= 7 * n_words and word_chars <= 8 * n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    Rule("stop_words", "20 * n_stop_words < n_words", "10 * n_stop_words >= n_words"),
    Rule("letters", "10 * n_letter_words < 8 * n_words", "20 * n_letter_words >= 19 * n_words"),
    Rule("sentences", "2 * n_ends > n_words or 200 * n_ends < n_words", "50 * n_ends >= n_words and 4 * n_ends <= n_words"),
)


def pattern(rules: tuple[Rule, ...] = RULES, counts: str = "_counts") -> Column:
    """All votes as one number in base 3, the first rule lowest."""
    import re

    def over(condition: str) -> str:
        return re.sub(r"\b(n_\w+|word_chars)\b", rf"{counts}.\1", condition)

    votes = [f"{3**i} * CASE WHEN {over(r.bad)} THEN 0 WHEN {over(r.good)} THEN 2 ELSE 1 END" for i, r in enumerate(rules)]
    return F.expr("cast(" + " + ".join(votes) + " as int)")


def base_failed(counts: str = "_counts") -> Column:
    return F.expr(f"{counts}.n_words < 50 or 100 * {counts}.n_repeat_words > 50 * {counts}.n_words")


# --- model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Share of good texts and, for each rule, the chance that a vote is right on good and on bad texts."""

    prior: float
    right_good: np.ndarray
    right_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes 0, 1, 2."""
        good, bad = votes == 2, votes == 0
        score = np.log(self.prior / (1 - self.prior))
        score = score + good @ np.log(self.right_good / (1 - self.right_bad))
        score = score + bad @ np.log((1 - self.right_good) / self.right_bad)
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def votes_of(patterns: np.ndarray, rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(rules) % 3


def fit(votes: np.ndarray, times: np.ndarray, rounds: int = 200) -> Model:
    """Expectation-maximisation.

    It starts from rules that are rarely wrong on good texts, and from bad texts that fall foul of three rules in ten.
    Ten such votes stand as a prior, so small corpora lead to the same end as large ones.
    """
    n = votes.shape[1]
    model = Model(0.8, np.full(n, 0.95), np.full(n, 0.3))
    good, bad = votes == 2, votes == 0
    for _ in range(rounds):
        p = model.posterior(votes)
        plus, minus = p * times, (1 - p) * times
        right_good = (plus @ good + 9.5) / (plus @ (good | bad) + 10)
        right_bad = (minus @ bad + 3) / (minus @ (good | bad) + 10)
        prior = (plus.sum() + 8) / (times.sum() + 10)
        # Votes may tell nothing but not the contrary, or good and bad could change places.
        right_good = np.clip(right_good, 0.501, 0.9999)
        new = Model(float(prior), right_good, np.clip(right_bad, 1.0001 - right_good, 0.9999))
        done = max(abs(new.right_good - model.right_good).max(), abs(new.right_bad - model.right_bad).max()) < 1e-9
        model = new
        if done:
            break
    return model


def scored(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, Model | None]:
    """``_pattern``, ``_quality`` for every pattern in ``rows``, which has ``_pattern`` and ``_failed``."""
    open_ = F.count_if(~F.col("_failed")).alias("open")
    seen = rows.groupBy("_pattern").agg(open_).orderBy("_pattern").collect()
    spark = rows.sparkSession
    if not seen:
        return spark.createDataFrame([], "_pattern int, _quality double"), None
    patterns, times = (np.array([r[i] for r in seen]) for i in (0, 1))
    votes = votes_of(patterns, len(rules))
    model = fit(votes, times.astype(float))
    table_ = zip(patterns.tolist(), model.posterior(votes).tolist(), strict=True)
    return spark.createDataFrame(list(table_), "_pattern int, _quality double"), model


def judged(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``quality`` and ``kept`` for every row."""
    rows = counted(docs).select("doc_id", "_counts").withColumns({"_pattern": pattern(), "_failed": base_failed()})
    rows = staged(rows)
    quality, _ = scored(rows)
    # At most 3 ** len(RULES) rows of 12 bytes.
    return rows.join(F.broadcast(quality), "_pattern").select(
        "doc_id",
        "_counts.*",
        F.col("_failed").alias("base_failed"),
        F.round("_quality", 6).alias("quality"),
        (~F.col("_failed") & (F.col("_quality") >= keep)).alias("kept"),
    )


def good_documents(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The kept rows with the columns of ``docs``.

    Texts are counted once and never shuffled; rows that pass the base rules are staged with their votes.
    """
    counts, votes = unused(docs.columns, "_counts"), unused(docs.columns, "_pattern")
    rows = counted(docs, name=counts).where(~base_failed(counts)).withColumn(votes, pattern(counts=counts)).drop(counts)
    rows = staged(rows)
    quality, _ = scored(rows.select(F.col(votes).alias("_pattern"), F.lit(False).alias("_failed")))
    # At most 3 ** len(RULES) numbers.
    good = quality.where(F.col("_quality") >= keep).select(F.col("_pattern").alias(votes))
    return rows.join(F.broadcast(good), votes, "left_semi").select(*named(docs.columns))


def op6_weak_supervision(spark, sf_dir):
    columns = ["doc_id", *COUNTS[:5], "base_failed", "kept", "quality"]
    return judged(table(spark, sf_dir, "documents")).select(*columns)
