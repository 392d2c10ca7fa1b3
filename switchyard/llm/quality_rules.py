"""Quality rules under weak supervision.

Method: each rule votes good (1), bad (0) or abstains on a document's statistics.  Expectation-maximisation over all documents
estimates each rule's accuracy: how often it votes good, votes bad or abstains on good and on bad documents; the posterior
probability of good quality decides.

Scale: one scan gives the statistics.  Votes are the only input of the estimation, so documents are counted by vote pattern on
the executors, and at most 3 ** rules counts reach the driver, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.doc_stats import document_statistics
from switchyard.llm.scratch import stored


@dataclass(frozen=True)
class Supervision:
    """``good`` and ``bad``: shares of votes (bad, good, abstained) on good and bad documents that start each rule's estimates and, as ``trust`` documents, steady them; ``prior`` is the first share of good documents, kept within ``bounds``."""

    good: tuple[float, float, float] = (0.03, 0.5, 0.47)
    bad: tuple[float, float, float] = (0.4, 0.2, 0.4)
    trust: float = 10.0
    prior: float = 0.8
    bounds: tuple[float, float] = (0.5, 0.99)
    rounds: int = 100
    cut: float = 0.5


def _vote(good: Column | None, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1) if good is not None else F.when(bad, 0).otherwise(-1)


def rules() -> dict[str, Column]:
    """The votes, from columns of ``document_statistics``.  Rules about one defect say nothing of texts that lack it."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    share = lambda c, of: F.col(c) / of
    length = F.col("word_chars") / n
    return {
        "length": _vote(None, F.col("n_words") < 5),
        "symbols": _vote(None, share("n_symbols", n) > 0.1),
        "pipes": _vote(None, share("n_pipes", n) > 0.2),
        "lines": _vote(None, share("n_dup_lines", lines) > 0.3),
        "repeats": _vote(None, share("n_repeat_words", n) > 0.2),
        "adjacent": _vote(None, share("n_adjacent", n) > 0.2),
        "word_length": _vote((length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        "stopwords": _vote(share("n_stop", n) > 0.1, (share("n_stop", n) < 0.02) & (F.col("n_words") > 50)),
        "endings": _vote(share("n_ended", lines) > 0.6, (share("n_ended", lines) < 0.1) & (F.col("n_words") > 20)),
        "capitals": _vote(share("n_upper", F.greatest("n_letters", F.lit(1))) < 0.15, share("n_upper", F.greatest("n_letters", F.lit(1))) > 0.5),
        "digits": _vote(None, share("n_digits", chars) > 0.25),
    }


def estimated(votes: np.ndarray, counts: np.ndarray, s: Supervision) -> tuple[float, np.ndarray]:
    """(log prior odds, weights[rule, vote]) from distinct vote patterns and their counts: log-odds of good for a vote 0, 1 or -1 (the last)."""
    n_rules = votes.shape[1]
    one_hot = np.stack([votes == v for v in (0, 1, -1)], axis=2).astype(float)
    start = [np.tile(np.array(x), (n_rules, 1)) for x in (s.good, s.bad)]
    good, bad, prior = start[0], start[1], s.prior
    for _ in range(s.rounds if len(votes) else 0):
        weights = np.log(good / bad)
        odds = np.log(prior / (1 - prior)) + np.einsum("nrv,rv->n", one_hot, weights)
        share = counts / (1 + np.exp(-np.clip(odds, -50, 50)))
        before = good
        good, bad = ((np.einsum("n,nrv->rv", w, one_hot) + s.trust * x) / (w.sum() + s.trust) for w, x in zip((share, counts - share), start, strict=True))
        prior = float(np.clip(share.sum() / counts.sum(), *s.bounds))
        if np.abs(good - before).max() < 1e-7:
            break
    return float(np.log(prior / (1 - prior))), np.log(good / bad)


def judged(docs: DataFrame, s: Supervision = Supervision()) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, votes.

    One row per input row; null and empty texts count 0 throughout and fail the base rule; a null doc_id stays null;
    repeated rows count each; other columns are ignored; empty input gives an empty result.
    """
    named = rules()
    voted = document_statistics(docs).withColumns({f"v_{k}": v for k, v in named.items()})
    pattern = F.concat(*[F.when(F.col(f"v_{k}") < 0, "-").otherwise(F.col(f"v_{k}").cast("string")) for k in named])
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = stored(voted.select(*keep, pattern.alias("votes")), "votes")
    seen = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    matrix = np.array([[-1 if c == "-" else int(c) for c in r.votes] for r in seen], dtype=int).reshape(len(seen), len(named))
    first, weights = estimated(matrix, np.array([r.n for r in seen], dtype=float), s)
    odds = F.lit(first)
    for k in range(len(named)):
        vote = F.substring("votes", k + 1, 1)
        odds = odds + F.when(vote == "1", float(weights[k, 1])).when(vote == "0", float(weights[k, 0])).otherwise(float(weights[k, 2]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select(*keep, failed.alias("base_failed"), (~failed & (F.col("posterior") >= s.cut)).alias("kept"), "posterior", "votes")
