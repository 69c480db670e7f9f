"""Scalar text functions as column expressions; texts may be null, which counts as empty unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

#: Of a character class
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"


def _c(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def truthy(*xs: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in xs), F.lit(""))


def kept(x: Column, what: str) -> Column:
    """How many characters of x are in the class: what is left once runs of others are taken out, which makes no array of finds."""
    return F.length(F.regexp_replace(x, f"[^{what}]+", ""))


def _share(x: Column | str, what: str) -> Column:
    return let(F.regexp_replace(_c(x), r"\P{L}+", ""), lambda s: F.coalesce(F.try_divide(kept(s, what), F.length(s)), F.lit(0.0)))


def arabic_ratio(x: Column | str) -> Column:
    """Arabic letters among the letters; 0 without letters."""
    return _share(x, ARABIC)


def ascii_ratio(x: Column | str) -> Column:
    return _share(x, "A-Za-z")


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it: a lambda's variable is a bound value."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(x: Column | str, k: int = 8) -> Column:
    """Distinct runs of k words; all words as one if fewer than k."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, k), " ")))

    return let(words(x), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def sentence_count(x: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(x), r"[.!?\x{061F}]+(?U:\s+)"), lambda s: F.length(F.regexp_replace(s, r"(?U)\s+", "")) > 0))


def prefix_key(x: Column | str, n: int = 100, lower: bool = True) -> Column:
    return F.substring(F.lower(_c(x)) if lower else _c(x), 1, n)


def md5_key(*xs: Column | str, sep: str = "", n: int = 32) -> Column:
    return F.substring(F.md5(F.concat_ws(sep, *(_c(x) for x in xs))), 1, n)


def _any_in(low: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds any term: plain searches, which an alternation at each character costs more than."""
    return F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(low, t)) if terms else F.lit(False)


def contains_any(x: Column | str, terms: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any term."""
    return let(F.lower(_c(x)), lambda low: _any_in(low, terms)) if terms else F.lit(False)


def terms_in(x: Column | str, terms: Sequence[str]) -> Column:
    """The terms that the lower-cased text holds, in the order given."""
    return let(F.lower(_c(x)), lambda low: F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(low, t)))


def groups_in(x: Column | str, groups: dict[str, Sequence[str]]) -> Column:
    """The names of groups of which the lower-cased text holds a term, in the order given."""
    found = lambda low: F.array(*(F.when(_any_in(low, ts), F.lit(name)) for name, ts in groups.items()))
    return F.filter(let(F.lower(_c(x)), found), lambda t: t.isNotNull())


def looks_like_question(q: Column | str, openers: Sequence[str] = L.QUESTION_WORDS) -> Column:
    s = strip(q)
    return s.endswith("?") | s.endswith("؟") | F.lower(F.regexp_extract(s, r"(?U)^(\S+)", 1)).isin(list(openers))


def language_bucket(x: Column | str) -> Column:
    low = F.lower(_c(x))
    return F.when(low.isin("arabic", "ar", "darija"), "arabic").when(low.isin("french", "fr"), "french").otherwise("english")


def strip_opener(x: Column | str, greeting: str = r"hi|hello|hey|dear|sir|madam|madame|greetings|bonjour|salut", site: str = r"i[\s-]?cliniq|icliniq|i\s+cliniq") -> Column:
    """Without one greeting of the form `hello, welcome to <site>` at the start; trimmed."""
    return strip(F.regexp_replace(_c(x), rf"(?iu)^\s*(?:{greeting})?\s*[!,.\s]*(?:welcome|bienvenue)\s+(?:to|sur|au|à|a)\s+(?:{site})(?:\.com)?\s*[.!,]?\s*", ""))


def shorten(x: Column | str, n: int = 400) -> Column:
    """Trimmed, on one line, cut to n characters with `...` if longer."""
    s = F.translate(strip(x), "\n\r", "  ")
    return F.concat(F.substring(s, 1, n), F.when(F.length(s) > n, "...").otherwise(""))


def normalize(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"(?U)\s+", " "))


def extract_answer(x: Column | str) -> Column:
    return F.when(_c(x).rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(_c(x), r"(?s)<answer>(.*?)</answer>", 1))).otherwise(strip(x))


def format_reward(x: Column | str) -> Column:
    answer = _c(x).rlike(r"(?s)<answer>.*?</answer>")
    return F.when(answer & _c(x).rlike(r"(?s)<think>.*?</think>"), 1.0).when(answer, 0.5).otherwise(0.0)


def dosages(x: Column | str) -> Column:
    """Dosages of monographs; alternatives are tried left to right and no word end is asked for, so `5 gouttes` gives `5 g`."""
    return F.regexp_extract_all(_c(x), F.lit("(?iu)" + "".join(L.MONOGRAPH_DOSAGE)), F.lit(0))


def answer_dosages(x: Column | str) -> Column:
    """Dosages of answers, with more units and a word end."""
    units = r"mg|g|mcg|µg|ug|ml|l|iu|ui|cp|comprim[eé]s?|gélules?|capsules?|tablets?|drops?|gouttes?|times?|fois|daily|jour|by mouth|po|iv|im|sc"
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit(rf"(?iuU)\b\d{{1,4}}(?:[\.,]\d+)?\s*(?:{units})\b"), F.lit(0)), lambda d: F.lower(d)))


def citations(x: Column | str) -> list[Column]:
    """n_doi, n_pmid, n_icd10 and any_citation."""
    doi = F.regexp_count(_c(x), F.lit(r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"))
    pmid = F.regexp_count(_c(x), F.lit(r"(?i)\b(?:pmid[:\s]*|pubmed[:\s]*)(\d{6,9})\b"))
    icd = F.regexp_count(_c(x), F.lit(r"\b[A-Z]\d{2}(?:\.\d{1,3})?\b"))
    return [doi.cast("long").alias("n_doi"), pmid.cast("long").alias("n_pmid"), icd.cast("long").alias("n_icd10"), (doi + pmid + icd > 0).alias("any_citation")]


def chunks(x: Column | str, limit: int, hard: bool = False) -> Column:
    """Sentences joined by blanks into chunks of at most `limit` characters; longer sentences stay whole, or are sliced if hard."""
    parts = F.filter(F.split(strip(x), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    if hard:
        cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))
        parts = F.flatten(F.transform(parts, cut))

    def add(state: Column, s: Column) -> Column:
        joined = F.when(state["buf"] == "", s).otherwise(F.concat(state["buf"], F.lit(" "), s))
        fits = F.length(joined) <= limit
        return F.struct(
            F.when(fits | (state["buf"] == ""), state["done"]).otherwise(F.array_append(state["done"], state["buf"])).alias("done"),
            F.when(fits, joined).otherwise(s).alias("buf"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    return F.aggregate(parts, start, add, lambda s: F.when(s["buf"] == "", s["done"]).otherwise(F.array_append(s["done"], s["buf"])))


def provider_chain(x: Column | str) -> Column:
    """`a:b,c:d` as an array of (provider, model), split at the first colon; entries without both are dropped."""
    parts = F.transform(F.split(_c(x), ","), lambda s: F.split(F.trim(s), ":", 2))
    return F.transform(F.filter(parts, lambda p: (F.size(p) == 2) & (F.trim(p[0]) != "") & (F.trim(p[1]) != "")), lambda p: F.struct(F.trim(p[0]).alias("provider"), F.trim(p[1]).alias("model")))


def backoff(error: Column | str, fails: Column | str) -> Column:
    """Seconds to wait: base by class of error times 1.3 for each further failure, 90 at most."""
    e = _c(error)
    base = F.when(e == "cold", 45).when(e.isin("429", "5xx", "network"), 15).when(e.isin("auth", "404"), 3600).when(e == "parse", 2).otherwise(5)
    n = F.col(fails) if isinstance(fails, str) else fails
    return F.least(F.lit(90.0), base * F.pow(F.lit(1.3), n - 1))
