"""Cases of op10 that the given tables don't hold."""

import math
import random
import re
from collections import Counter, defaultdict

from sparkloom.llm import language


def test_declared_after_a_long_preamble():
    assert language.declared("<!-- <html lang='fr'> " + "x" * 9000 + " -->\n" + " " * 5000 + '<html class="a" lang="de"><body><html lang="en">') == "de"
    assert language.declared('<html><p><html lang="en">') == language.declared("<!-- <html lang=en>") == language.declared(None) == ""


def test_more_than_64_languages(spark):
    words = {f"l{i:02}": f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + i * 7 % 26)}zu " * 8 for i in range(70)}
    docs = spark.createDataFrame([(t, k) for k, t in words.items()] + [("the cat and dog", "l00")] * 3, "text string, lang string")
    langs, table = language.train_text(docs)
    assert langs == sorted(words) and table.shape[0] == 70 and table.size <= language.ALL_CELLS
    for i in (0, 40, 69):
        cells = language.trigrams(words[f"l{i:02}"]) % table.shape[1]
        assert table[:, cells].sum(1).argmax() == i


def test_declared_by_the_attribute_itself():
    for tag, want in [
        ("<html data-lang='fr' lang='en'>", "en"), ('<html title="a > lang=fr" lang=de>', "de"), ("<HTML LANG = 'pt-BR'>", "pt"), ("<html xml:lang='fr'>", ""), ("<htmlx lang='fr'><html lang=es>", "es"),
        ("<html lang>", ""), ("<html lang=''>", ""), ("<html lang='english'>", ""), ("<html/lang=en>", "en"), ("<html lang=en lang=fr>", "en"),
    ]:
        assert language.declared(tag) == want, tag


def test_copies_count_once_in_the_sample(spark):
    docs = spark.createDataFrame([("aaa bbb ccc", "x")] * 500 + [(f"ddd {i:c}{i:c}{i:c}", "x") for i in range(97, 107)], "text string, lang string")
    _, table = language.train_text(docs, rows=1_000)
    _, once = language.train_text(docs.distinct(), rows=1_000)
    assert (table == once).all()


def _plain(pages, docs, most=language.MOST_GRAMS):
    """The fused evidence by a plain version: dictionaries over all pages."""
    texts = defaultdict(set)
    for text, lang in docs:
        if text is not None and lang is not None:
            texts[lang].add(text)
    langs, models = sorted(texts), []
    for k in langs:
        seen = Counter(c for t in texts[k] for c in language.trigrams(t).tolist())
        total = sum(seen.values()) + 0.5 * language.CELLS
        models.append(lambda c, seen=seen, total=total: math.log((seen[c] + 0.5) / total))
    rows = []
    for i, url, html in pages:
        cells = language.trigrams(language.visible(html)).tolist()
        logs = [sum(map(m, cells)) * language.TEMPER * min(1, most / len(cells)) if cells else 0.0 for m in models]
        won = logs.index(max(logs)) if max(logs) > min(logs) + 1e-9 else None
        m = re.search(r"(?s)://([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        path = re.search(r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", url or "")
        suffix = host.rpartition(".")[2] + "/" + (path[1].lower() if path else "")
        domain = ".".join(host.split(".")[-2:]) if "." in host else ""
        rows.append((i, logs, won, language.declared(html), suffix, host, domain))
    votes = [defaultdict(lambda: [0] * len(langs)) for _ in range(4)]
    total = [0] * len(langs)
    for _, _, won, *keys in rows:
        for table, key in zip(votes, keys, strict=True):
            _ = table[key]
            if won is not None:
                table[key][won] += 1
        if won is not None:
            total[won] += 1
    out = {}
    for i, logs, won, *keys in rows:
        said, suffix, host, domain = (t[k] for t, k in zip(votes, keys, strict=True))
        score = []
        for k in range(len(langs)):
            p_said = (said[k] + language.SMOOTH) / (total[k] + language.SMOOTH * (len(votes[0]) + 1))
            p_suffix = (suffix[k] + language.SMOOTH) / (total[k] + language.SMOOTH * (len(votes[1]) + 1))
            everywhere = (total[k] + 1) / (sum(total) + len(langs))
            in_domain = (domain[k] + everywhere * language.DOMAIN_WEIGHT) / (sum(domain) + language.DOMAIN_WEIGHT)
            in_host = max(host[k] - (won == k), 0) + in_domain * language.HOST_WEIGHT
            score.append(logs[k] + math.log(p_said) + math.log(p_suffix) + math.log(in_host))
        top = max(score)
        out.setdefault(i, []).append((None if won is None else langs[won], langs[score.index(top)], 1 / sum(math.exp(x - top) for x in score)))
    return out


def test_against_a_plain_version(spark):
    r = random.Random(8)
    words = {"de": "der hund und die katze mit haus nicht sehr", "en": "the cat and dog went with this house to", "fr": "le chat et la maison avec un chien pas"}
    make = lambda k, n: " ".join(r.choices(words[k].split(), k=n))
    docs = [(make(k, 20), k) for k in words for _ in range(6)] + [(None, "en"), ("x", None)]
    pages = []
    for i in range(60):
        k = r.choice(list(words))
        host = r.choice(["a.org", "b.org", f"{k}.site.net", "x.site.net", "plain", "A.org:80"])
        url = r.choice([f"http://{host}/{k}/{i}", f"http://{host}/{i}", f"http://{host}?q", None])
        lang = r.choice([k, k, "en", "zz"])
        pages.append((i, url, r.choice([f"<html lang='{lang}'><p>{make(k, r.choice([1, 5, 40, 400]))}</p>", f"<p>{make(k, 3)}</p>", "<html lang=fr>", "", None])))
    pages += pages[:5]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, host string, won int").repartition(3)
    model = spark.createDataFrame(docs, "text string, lang string")
    for most in (language.MOST_GRAMS, math.inf):
        got = defaultdict(list)
        for row in language.identify(df, model, most=most).collect():
            got[row.page_id].append((row.text_lang, row.lang, row.score))
        want = _plain(pages, docs, most)
        assert got.keys() == want.keys()
        for i in want:
            for (a, b, c), (x, y, z) in zip(sorted(got[i], key=str), sorted(want[i], key=str), strict=True):
                assert (a, b) == (x, y) and abs(c - z) < 1e-4


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([("abc abc", "b"), ("abc abc", "a")], "text string, lang string")
    pages = spark.createDataFrame([(1, None, "abc"), (2, "http://x.y/", None), (3, "http://x.y/", "abc " * 300_000)], "page_id bigint, url string, html string")
    assert [(r.text_lang, r.lang) for r in language.identify(pages, docs).orderBy("page_id").collect()] == [(None, "a")] * 3
