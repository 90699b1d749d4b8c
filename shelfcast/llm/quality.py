"""A quality classifier without hand labels: overlapping heuristics, a label model, a hashed linear scorer.

Heuristic labellers, as column expressions, vote good, bad or abstain on every
document.  Votes are counted by pattern over all documents (at most 3 to the
power of the labellers, whatever the input), and expectation-maximisation on
the counts estimates each labeller's accuracy on good and on bad documents
and the share of good ones.  The posterior of a document's pattern is its weak
label.  A logistic scorer over hashed byte trigrams learns the weak labels on a
bounded sample (``FIT_DOCS``, by a hash of doc_id) and scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import WORD, mix, stage

BUCKETS, FIT_DOCS = 4096, 4000
#: Bytes hashed at once.
PIECE = 1 << 20

#: Frequent short words of the languages served (fixed values).
STOP_WORDS = ("the of and to in a is that it was for on are with as by at be this from or an not but "
              "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
              "le la les de et des en un une du est que pour dans par sur au aux il ne se plus avec "
              "el los las del y por con para una su al lo como más o pero sus").split()


def votes(text: Column) -> dict[str, Column]:
    """Each labeller's vote on a non-null text: 1 good, 0 bad, -1 abstain."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    solid = F.greatest(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(1))
    marks = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    again = F.size(F.filter(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: a == b), lambda same: same))
    plain = F.size(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]")))
    known = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))

    def grade(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    return {
        "upper_case": grade((letters >= 20) & (upper < 0.2 * letters), (letters >= 20) & (upper > 0.5 * letters)),
        "marks": grade(marks < 0.08 * solid, marks > 0.2 * solid),
        "letters": grade(letters > 0.85 * solid, letters < 0.6 * solid),
        "stop_words": grade((n >= 20) & (known > 0.15 * n) & (known < 0.8 * n), (n >= 20) & ((known < 0.03 * n) | (known >= 0.8 * n))),
        "stuttering": grade((n >= 20) & (again < 0.05 * n), (n >= 5) & (again > 0.2 * n)),
        "bare_marks": grade((n >= 20) & (plain > 0.95 * n), (n >= 5) & (plain < 0.8 * n)),
        "repeated_words": grade((n >= 50) & (F.size(F.array_distinct(words)) > 0.4 * n), (n >= 50) & (F.size(F.array_distinct(words)) < 0.2 * n)),
        "repeated_lines": grade((F.size(lines) >= 3) & (F.size(F.array_distinct(lines)) > 0.8 * F.size(lines)), (F.size(lines) >= 3) & (F.size(F.array_distinct(lines)) < 0.6 * F.size(lines))),
        "words": grade(n >= 40, n < 5),
    }


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents, and accuracies [labeller, class] (0 bad, 1 good), by EM over vote patterns.

    Accuracies start at 0.8, so labellers are taken to be better than chance;
    pseudo-counts keep those that always abstain at the start.
    """
    share, acc = 0.5, np.full((patterns.shape[1], 2), 0.8)
    for _ in range(rounds):
        good = posterior(patterns, share, acc)
        new = np.empty_like(acc)
        for c, p in ((0, counts * (1 - good)), (1, counts * good)):
            said = p @ (patterns >= 0)
            new[:, c] = (p @ (patterns == c) + 8) / (said + 10)
        last, share = share, (counts @ good + 1) / (counts.sum() + 2)
        done = abs(share - last) < 1e-10 and np.abs(new - acc).max() < 1e-10
        acc = new
        if done:
            break
    return share, acc


def posterior(patterns: np.ndarray, share: float, acc: np.ndarray) -> np.ndarray:
    """Probability of good given the votes."""
    odds = np.full(len(patterns), np.log(share) - np.log1p(-share))
    for j, (bad, good) in enumerate(acc):
        v = patterns[:, j]
        odds += np.where(v == 1, np.log(good / (1 - bad)), 0) + np.where(v == 0, np.log((1 - good) / bad), 0)
    return 1 / (1 + np.exp(-odds))


def histogram(text: str) -> np.ndarray:
    """Shares of hashed byte trigrams (of the text between spaces)."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    out = np.zeros(BUCKETS)
    for s in range(0, len(data) - 2, PIECE):
        out += np.bincount(buckets(data[s:s + PIECE + 2]), minlength=BUCKETS)
    return out / max(out.sum(), 1)


_table: list[np.ndarray] = []


def buckets(data: np.ndarray) -> np.ndarray:
    if not _table:
        _table.append((mix(np.arange(1 << 24, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.uint16))
    g = data.astype(np.uint32)
    return _table[0][(g[:-2] << 16) | (g[1:-1] << 8) | g[2:]]


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights per bucket and a bias: logistic regression on standardised shares with soft labels."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = ((x - mean) / scale).astype(np.float32)
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
    step = 0.5 / max(1.0, float((z**2).sum(axis=1).mean()) / 4)
    for _ in range(rounds):
        gap = y - 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        vw = 0.9 * vw + gap.astype(np.float32) @ z / len(z) - ridge * w
        vb = 0.9 * vb + gap.mean()
        w, b = w + step * vw, b + step * vb
    return w / scale, float(b - (w * mean / scale).sum())


def classify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``(doc_id, weak_label, score, good)`` for every row of ``docs(doc_id, text)``.

    weak_label is the label model's posterior, score the linear scorer's
    probability of good, good is score >= 0.5.  Null text counts as empty:
    labellers vote on it and its score is the bias alone.  Repeated rows, null
    ids and further columns are no special cases; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = votes(F.col("text"))
    names = list(said)
    # staged: the labellers read every text once, the counts and the scores come from their votes
    voted = stage(rows.select("doc_id", "text", *[v.cast("int").alias(f"v_{k}") for k, v in said.items()]), "votes")
    counted = voted.groupBy(*[f"v_{k}" for k in names]).count().toPandas()
    if counted.empty:
        return spark.createDataFrame([], "doc_id long, weak_label double, score double, good boolean")
    patterns, counts = counted[[f"v_{k}" for k in names]].to_numpy(), counted["count"].to_numpy(float)
    share, acc = fit_labellers(patterns, counts)
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for k, (bad, good) in zip(names, acc.tolist()):
        odds = odds + F.when(F.col(f"v_{k}") == 1, float(np.log(good / (1 - bad)))).when(F.col(f"v_{k}") == 0, float(np.log((1 - good) / bad))).otherwise(0.0)
    labelled = voted.select("doc_id", "text", (1 / (1 + F.exp(-odds))).alias("weak_label"))

    def describe(batches):
        for b in batches:
            x = [histogram(t).astype(np.float32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "y"])

    n = counts.sum()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, fit_docs / n) * (1 << 30))
    sample = labelled.filter(draw).orderBy(F.xxhash64("doc_id"), "text").limit(2 * fit_docs).select("text", "weak_label").mapInArrow(describe, "x binary, y double").toArrow()
    if sample.num_rows:
        x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(-1, BUCKETS)
        w, bias = fit_scorer(x, sample.column("y").to_numpy())
    else:
        w, bias = np.zeros(BUCKETS), 0.0
    shared = spark.sparkContext.broadcast((w.astype(np.float64), bias))

    def score(batches):
        for b in batches:
            w, bias = shared.value
            odds = np.array([w @ histogram(t) + bias for t in b.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "weak_label", "score", "good"])

    return labelled.mapInArrow(score, "doc_id long, weak_label double, score double, good boolean")
