"""Model-backed scores and translations with pluggable models; the defaults are offline stubs, so that plans run anywhere."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class PairModel(Protocol):
    """Precision, recall and F1 of predictions and references in one language."""

    def scores(self, preds: Sequence[str], refs: Sequence[str], lang: str) -> list[tuple[float, float, float]]: ...


class LossModel(Protocol):
    """The losses of a text's tokens, each masked in turn."""

    def losses(self, texts: Sequence[str], most: int) -> list[list[float]]: ...


class TextModel(Protocol):
    def run(self, texts: Sequence[str]) -> list[str]: ...


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


class Overlap:
    """Stub of a similarity model: multiset overlap of words."""

    def scores(self, preds: Sequence[str], refs: Sequence[str], lang: str) -> list[tuple[float, float, float]]:
        out = []
        for p, r in zip(preds, refs, strict=True):
            a, b = Counter(_tokens(p)), Counter(_tokens(r))
            both = (a & b).total()
            precision, recall = both / max(1, a.total()), both / max(1, b.total())
            out.append((precision, recall, 2 * precision * recall / (precision + recall) if both else 0.0))
        return out


class Unigram:
    """Stub of a masked language model: a token's loss is the log of how rare it is in its own text."""

    def losses(self, texts: Sequence[str], most: int) -> list[list[float]]:
        out = []
        for t in texts:
            words = _tokens(t)
            n = Counter(words)
            out.append([math.log(len(words) / n[w]) for w in words[:most]])
        return out


class Tagged:
    """Stub of a translation model: the text with a tag before it."""

    def __init__(self, tag: str = ""):
        self.tag = tag

    def run(self, texts: Sequence[str]) -> list[str]:
        return [self.tag + t for t in texts]


#: What a model is told for a language of the tables.
LANGUAGES = {"darija": "ar"}


def pair_scores(df: DataFrame, pred: str, ref: str, lang: str, make: Callable[[], PairModel] = Overlap, keep: Sequence[str] = (), languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """The columns `keep` with precision, recall and f1. The model is loaded once for each task; where it fails, the batch's scores are 0. Null texts count as empty."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = pd.DataFrame(0.0, index=b.index, columns=["precision", "recall", "f1"])
            for code, rows in b.groupby(b["__lang"].fillna("")):
                try:
                    out.loc[rows.index] = model.scores(rows["__pred"].fillna("").tolist(), rows["__ref"].fillna("").tolist(), languages.get(code, code))
                except (RuntimeError, ValueError, OSError):
                    pass
            yield pd.concat([b[list(keep)], out], axis=1)

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.selectExpr(*(f"`{c}`" for c in keep), f"`{pred}` as __pred", f"`{ref}` as __ref", f"`{lang}` as __lang").mapInPandas(work, ", ".join([*kinds, "precision double, recall double, f1 double"]))


def token_losses(df: DataFrame, id_col: str, text_col: str, make: Callable[[], LossModel] = Unigram, most: int = 64) -> DataFrame:
    """id and losses of the first `most` tokens; enrich.pseudo_perplexity turns them into a score."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame({id_col: b.iloc[:, 0], "losses": model.losses(b.iloc[:, 1].fillna("").tolist(), most)})

    return df.select(id_col, text_col).mapInPandas(work, f"`{id_col}` {kind}, losses array<double>")


def translated(df: DataFrame, id_col: str, text_col: str, make: Callable[[], TextModel] = Tagged) -> DataFrame:
    """request_id and content of a local model, loaded once for each task; it fits enrich.by_chunks. Blank texts aren't sent and stay ''."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            texts = b["__text"].fillna("")
            full = texts[texts.str.strip() != ""]
            out = pd.Series("", index=b.index)
            if len(full):
                out[full.index] = model.run(full.tolist())
            yield pd.DataFrame({"request_id": b.iloc[:, 0], "content": out})

    return df.selectExpr(f"`{id_col}` as request_id", f"`{text_col}` as __text").mapInPandas(work, f"request_id {kind}, content string")
