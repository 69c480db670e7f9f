"""Toxic passages by maximum-scoring segments of token log-odds.

Token scores are log-odds with an informative Dirichlet prior, less a multiple
of their standard error; every other token costs a fixed drift. A linear-time
scan finds all maximal scoring segments, extreme-value statistics (lambda and K
of Karlin and Altschul) turn segment scores into expected counts under clean
text of that length, and a logistic curve maps their sum to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, set_aside, small_batches, written

#: Labelled rows that the model is fitted on (those of smallest hash), the bound of all that the driver gets.
SAMPLE_ROWS = 20_000
#: Weight of the prior in tokens, standard errors taken off, highest token score, cost of any other token.
PRIOR, ERRORS, TOP, DRIFT = 5_000.0, 1.64, 8.0, 0.5
CUT = 0.3
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of tokens that cost `drift` but for the hits (place, score).

    A list of candidate segments is kept with the running total before and after
    each. A new one joins back to the last candidate that began lower, if that
    raises its total; each candidate has a link to the last one before it that
    began lower, so the search skips those between, and the scan is linear in the
    hits. Segments begin and end with hits.
    """
    done: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    lower: list[int] = []  # for each, the last one that began lower, or -1
    total, at = 0.0, 0
    for place, score in hits:
        total -= drift * (place - at)
        new = (place, place, total, total + score)
        total, at = total + score, place + 1
        while True:
            k = len(done) - 1
            while k >= 0 and done[k][2] >= new[2]:
                k = lower[k]
            if k < 0 or done[k][3] >= new[3]:
                done.append(new)
                lower.append(k)
                break
            new = (done[k][0], new[1], done[k][2], new[3])
            del done[k:], lower[k:]
    return [(a, b, after - before) for a, b, before, after in done]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    base: float = -4.0
    slope: float = 0.0

    def find(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], float]:
        """Segments (first token, last token, score, expected count in clean text of that length) and the evidence they add up to."""
        words = tokens(text)
        s = self.scores
        hits = [(i, s[w]) for i, w in enumerate(words) if w in s]
        found = [(a, b, x, self.scale * len(words) * math.exp(-self.rate * x)) for a, b, x in segments(hits, DRIFT)]
        return found, sum(max(0.0, -math.log(max(e, 1e-300))) for *_, e in found)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * math.log1p(evidence)))))


def log_odds(toxic: Column, clean: Column, all_toxic: float, all_clean: float) -> Column:
    """Lower bound of a token's log-odds, from its document counts and all tokens' counts in toxic and clean documents."""
    prior = PRIOR * (toxic + clean) / (all_toxic + all_clean)
    a, b = toxic + prior, clean + prior
    rest = lambda total, x: F.greatest(total + PRIOR - x, F.lit(1e-9))
    return F.log(a / rest(F.lit(all_toxic), a)) - F.log(b / rest(F.lit(all_clean), b)) - ERRORS * F.sqrt(1 / a + 1 / b)


def _rate(p: dict[float, float]) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 (p: shares of token scores in clean text)."""
    low, high = 0.0, 0.05
    f = lambda x: sum(q * math.exp(x * s) for s, q in p.items()) - 1
    while f(high) < 0 and high < 20:
        low, high = high, high * 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 0.05)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold.

    Null labels are left out; a document with several labels counts as toxic if
    any says so. With no toxic or no clean document, the model scores every text
    alike and below the cut.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("__y")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    )
    sample = written(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(text_col).alias("text"), "__y"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(set(tokens(text)))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["w", "toxic", "clean"])

    counts = sample.mapInArrow(frugal(count), "w string, toxic bigint, clean bigint").groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "token_counts")
    model, total = Model(), counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not total["toxic"] or not total["clean"]:
        return model
    low = log_odds(F.col("toxic"), F.col("clean"), float(total["toxic"]), float(total["clean"]))
    model.scores = {r["w"]: min(r["low"], TOP) for r in counts.select("w", low.alias("low")).where(F.col("low") > DRIFT).collect()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(text)
                hits = [(i, model.scores[w]) for i, w in enumerate(words) if w in model.scores]
                out.append((y, len(words), [s for _, s in hits], [s for *_, s in segments(hits, DRIFT)]))
            y, n, hits, segs = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.float64())), pa.array(segs, pa.list_(pa.float64()))], names=["y", "n", "hits", "segs"])

    fit = sample.mapInArrow(frugal(scan), "y int, n bigint, hits array<double>, segs array<double>").toPandas()
    clean = fit[fit["y"] == 0]
    total = max(int(clean["n"].sum()), 1)
    share = Counter(round(s, 1) for h in clean["hits"] for s in h)
    rest = max(total - sum(share.values()), 1)
    p = {s: (k + 0.0) / (total + 1) for s, k in share.items()}
    top = max(model.scores.values(), default=TOP)
    p[top] = p.get(top, 0.0) + 1 / (total + 1)  # a hit that clean text may yet hold
    p[-DRIFT] = rest / (total + 1)
    model.rate = _rate(p)
    segs = np.sort(np.array([s for h in clean["segs"] for s in h] or [top]))
    mid = float(segs[len(segs) // 2])
    model.scale = float((segs >= mid).sum()) / (total * math.exp(-model.rate * mid))
    evidence = [sum(max(0.0, -math.log(max(model.scale * n * math.exp(-model.rate * s), 1e-300))) for s in h) for n, h in zip(fit["n"], fit["segs"], strict=True)]
    model.base, model.slope = _logistic(np.log1p(np.array(evidence)), fit["y"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight ridge."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id (and the columns `keep`), score, predicted, segments (array of first token, last token, score, expected count).

    Null and empty texts have no segments and get the lowest score. Rows stay one for one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by SAMPLE_ROWS
    kept = [id_col, *(c for c in keep or [] if c not in (id_col, text_col))]
    cols = [*kept, text_col]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols]
    seg = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
    with_text = text_col in (keep or [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            probs, found = [], []
            for text in b.column(len(kept)).to_pylist():
                segs, evidence = m.find(text)
                probs.append(m.probability(evidence))
                found.append([{"first": x, "last": y, "score": s, "expected": e} for x, y, s, e in segs])
            own = [b.column(i) for i in range(len(kept) + with_text)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(probs, pa.float64()), pa.array([int(p >= CUT) for p in probs], pa.int32()), pa.array(found, seg)],
                names=[*cols[: len(own)], "score", "predicted", "segments"],
            )

    return docs.select(*cols).mapInArrow(frugal(work), ", ".join(fields[: len(kept) + with_text]) + ", score double, predicted int, segments array<struct<first: bigint, last: bigint, score: double, expected: double>>")


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with their own columns."""
    own, names, back = set_aside(docs)
    return score(own, model, names[id_col], names[text_col], keep=own.columns).where("predicted = 0").select(*back)
