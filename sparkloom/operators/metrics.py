"""Lexical and embedding metrics, rewards and comparisons."""

from __future__ import annotations

from collections import Counter
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def demo_runs(models: DataFrame, prompts: DataFrame) -> DataFrame:
    """Each model with each prompt. Both are short lists given by hand, so their product is too."""
    return models.crossJoin(F.broadcast(prompts))


def token_prf(pred: str, ref: str) -> Column:
    """Precision, recall and F1 of the sets of blank-separated tokens; zeros if either is empty."""
    p, r = (F.array_distinct(F.filter(F.split(T.strip(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+"), lambda x: x != "")) for c in (pred, ref))
    both = F.size(F.array_intersect(p, r))
    precision, recall = (F.coalesce(F.try_divide(both, F.size(x)), F.lit(0.0)) for x in (p, r))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of numbers in double precision; null if either is null."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _grams(t: list[str], n: int) -> Counter:
    return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))


def bleu4(pred: str, ref: str) -> float:
    """Sentence BLEU of orders 1 to 4; a precision without matches counts 0.1 matches (method 1)."""
    p, r = pred.split(), ref.split()
    if not p or not (_grams(p, 1) & _grams(r, 1)):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        have = _grams(p, n)
        total += log((sum((have & _grams(r, n)).values()) or 0.1) / max(sum(have.values()), 1)) / 4
    return min(1.0, exp(1 - len(r) / len(p))) * exp(total)


def gleu(pred: str, ref: str) -> float:
    p, r = pred.split(), ref.split()
    have, want = (sum((_grams(t, n) for n in range(1, 5)), Counter()) for t in (p, r))
    most = max(sum(have.values()), sum(want.values()))
    return sum((have & want).values()) / most if most else 0.0


def rouge_n(pred: str, ref: str, n: int) -> float:
    have, want = (_grams(T_WORDS(x), n) for x in (pred, ref))
    both = sum((have & want).values())
    return 2 * both / (sum(have.values()) + sum(want.values())) if both else 0.0


def T_WORDS(x: str) -> list[str]:  # noqa: N802
    """ROUGE tokens: runs of a-z and digits, lower-cased; plain plural and verb endings are cut as a light stem of words over three letters."""
    import re

    out = []
    for w in re.findall("[a-z0-9]+", x.lower()):
        if len(w) > 3:
            for end, new in (("sses", "ss"), ("ies", "i"), ("ing", ""), ("ed", ""), ("s", "")):
                if w.endswith(end) and not w.endswith("ss") | (end == "s" and w.endswith("us")) and len(w) - len(end) >= 2:
                    w = w[: len(w) - len(end)] + new
                    break
        out.append(w)
    return out


def rouge_l(pred: str, ref: str) -> float:
    p, r = T_WORDS(pred), T_WORDS(ref)
    row = [0] * (len(r) + 1)
    for x in p:
        last = 0
        for j, y in enumerate(r, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(p) + len(r)) if row[-1] else 0.0


def meteor(pred: str, ref: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR with exact matches only (no synonym resource is at hand): harmonic mean weighted to recall, less a penalty for scattered matches."""
    p, r = pred.lower().split(), ref.lower().split()
    free: dict[str, list[int]] = {}
    for j, w in enumerate(r):
        free.setdefault(w, []).append(j)
    found = [(i, free[w].pop(0)) for i, w in enumerate(p) if free.get(w)]
    if not found:
        return 0.0
    precision, recall = len(found) / len(p), len(found) / len(r)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    pieces = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(found, found[1:], strict=False))
    return mean * (1 - gamma * (pieces / len(found)) ** beta)


def overlap_scores(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """df with bleu, gleu, rouge1, rouge2, rougel and meteor, computed on Arrow batches."""

    @F.pandas_udf("struct<bleu: double, gleu: double, rouge1: double, rouge2: double, rougel: double, meteor: double>")
    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = [(bleu4(a, b), gleu(a, b), rouge_n(a, b, 1), rouge_n(a, b, 2), rouge_l(a, b), meteor(a, b)) for a, b in zip(p.fillna(""), r.fillna(""), strict=True)]
        return pd.DataFrame(rows, columns=["bleu", "gleu", "rouge1", "rouge2", "rougel", "meteor"])

    return df.withColumn("__s", score(pred, ref)).select(*df.columns, "__s.*")


def penalty(pred_drugs: Column, ref_drugs: Column, per: float = 0.10, most: float = 0.30) -> Column:
    return F.least(F.lit(most), per * F.size(F.array_except(pred_drugs, ref_drugs)))


def reward(form: Column, content: Column, cost: Column, w_format: float = 0.20, w_content: float = 0.80) -> Column:
    return F.struct(form.alias("r_format"), content.alias("r_content"), cost.alias("r_hallu"), (w_format * form + w_content * content - cost).alias("r_total"))


def advantage(value: str, group: str, eps: float = 1e-6) -> Column:
    """Reward less its group's mean, over the sample deviation; 0 in a group of one."""
    w = W.partitionBy(group)
    return (F.col(value) - F.avg(value).over(w)) / (F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)) + eps)


def adaptive_mix(g: Column, g0: Column, gamma: float) -> Column:
    return g / (g + gamma * g0 + 1e-8)


def kl_k3(logp: Column, ref: Column) -> Column:
    """exp(d) - d - 1 for d = ref - logp, by element."""
    return F.zip_with(logp, ref, lambda p, q: F.exp(q - p) - (q - p) - 1)


def clipped_surrogate(ratio: Column, adv: Column, eps: float = 0.2) -> Column:
    return F.least(ratio * adv, F.least(F.greatest(ratio, F.lit(1 - eps)), F.lit(1 + eps)) * adv)


def means(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in cols))


def macro(per_language: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """The unweighted mean over languages."""
    return means(per_language, by, cols)


def against_baseline(long: DataFrame, baseline: str) -> DataFrame:
    """long (model, metric, value) with delta to the baseline's value of the metric."""
    base = F.max(F.when(F.col("model") == baseline, F.col("value"))).over(W.partitionBy("metric"))
    return long.withColumn("delta", F.col("value") - base)


def matrix(long: DataFrame, models: list[str]) -> DataFrame:
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))


def variation(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and coefficient of variation of each group of variants."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"))
