"""Small tests of the training-data operators against plain versions, with nulls, empty and long texts, ties, repeats, no rows and clashing names."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import cover_tree, extraction, graph, language, licenses, ngram_join, packing, quality, sentencepiece_codec, toxicity, url_filter
from sparkloom.llm.common import shingle_hashes

TEXTS = [
    None, "", " \n\t ", "a", "The cat", "the the the the the the", "the cat sat on the mat\nthe cat sat on the mat\n\nx", "é日本 <s> ▁▁x  y ", "x\x00y\u00a0z  it's 3½ Ÿ",
    "the quick brown fox jumps over the lazy dog and is it " * 12, "word " * 30_000, "MIT License. Apache license; GNU General Public License, all rights reserved",
]
NAMES = "doc_id bigint, text string, score double, kept boolean, n bigint, node bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, True, 1, 2) for i, t in enumerate(TEXTS)] + [(3, "a", 0.1, None, 1, 1), (None, "the cat", None, None, None, None), (99, TEXTS[9], 1.0, True, 1, 1)]
    return spark.createDataFrame(rows, NAMES).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], NAMES)


def test_sentencepiece(docs, nothing):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((str(r.doc_id), sp.encode(r.text or "") + [2]) for r in docs.collect())
    rows = sentencepiece_codec.encode_decode(docs).collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert all(r.decoded == sp.decode(r.ids) for r in rows)
    for r in sentencepiece_codec.digests(docs).collect():
        assert len(r.ids_sha256) == len(r.decoded_sha256) == 64
    assert sentencepiece_codec.digests(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ▁\n\té日<>s/😀") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_sentencepiece_any_text(text):
    import public_tokenizers

    c = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    ids, decoded = c.run([text])[0]
    want = c.sp.encode(text) + [2]
    assert ids == " ".join(map(str, want)) and decoded == c.sp.decode(want)


@pytest.fixture(scope="module")
def words_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


_PIECES = ["'s", "'re", "'ll", "'", "''d", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a", "B", "the ", " ", "1", "½", "À", "é", "µ", "Ÿ", "-_", "\n", "\x1c", "\x85", "\xa0", "\x00", "\x7f", "|>", "日", "e\u0301"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PIECES) | st.characters(exclude_categories=["Cs"]) | st.characters(max_codepoint=255), max_size=25).map("".join) | st.none(), max_size=4))
def test_word_tokenizer_any_text(words_library, texts):
    t = packing.WordTokenizer(words_library_path(), limit=20)
    for _ in range(2):
        ids, begins = t.run(texts, 2)
        got = [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
        assert got == [words_library.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def words_library_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_tokenizer_special_tokens(words_library):
    t = packing.tokenizer(words_library_path())
    ids, begins = t.run(["a <|endoftext|> b", "x<|startoftext|>y", "< | endoftext | >", None, "a <|endoftext|> b"])
    assert begins.tolist()[0] == 0 and ids[:4].tolist() == [320, 49407, 321, 2] and ids[begins[4] :].tolist() == [320, 49407, 321, 2]
    assert ids[begins[1] : begins[2]].tolist() == words_library.encode("x<|startoftext|>y", add_special_tokens=False).ids + [2]


def test_packing(docs, nothing, spark, words_library, monkeypatch):
    monkeypatch.setattr(packing, "CHARS", 100)  # so that batches are taken apart
    extra = spark.createDataFrame([(200, "x <|endoftext|> y")], "doc_id bigint, text string")
    docs = docs.withColumnsRenamed({"score": "ids", "kept": "row", "n": "begin", "node": "sequence_id"}).unionByName(extra, allowMissingColumns=True)
    rows = packing.pack(docs).collect()
    whole = sorted(words_library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect())
    found, part = [], []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length and r.start == len(part)
        part += r.ids
        if len(part) == r.doc_tokens:
            found.append(part)
            part = []
    assert sorted(found) == whole and not part
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sorted(used) == list(range(len(used))) and all(n == 4096 for s, n in used.items() if s != max(used))
    assert packing.pack(nothing).count() == 0
    same = packing.pack(docs.drop("row").withColumnRenamed("doc_id", "row"), id_col="row")  # ties and repeated ids come in the same order
    order = lambda rows: [tuple(r) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order(same.collect()) == order(rows) and same.columns[0] == "row"


def test_hilbert_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert_key(points, 3))
    assert len(set(order.tolist())) == 512
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def _repeat_words(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + j for v in seen.values() if len(v) > 1 for i in v for j in range(3)})


def test_quality(docs, nothing):
    for r in quality.measures(docs.drop("n", "kept", "score", "node"), keep=["text"]).collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == _repeat_words(words)
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs).count() == 0 and quality.keep_good(docs).columns == docs.columns
    assert quality.measures(nothing).count() == 0


def test_quality_is_native(nothing):
    plan = quality.measures(nothing)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def _brute(texts, rule):
    sets = [frozenset(shingle_hashes(t, rule.words).tolist()) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("rule", [ngram_join.Rule(3, 90), ngram_join.Rule(5, 80)])
def test_ngram_join(spark, rule, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 3)  # so that small groups count as frequent
    r = random.Random(rule.num)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "one", "one two"]
    passage = [r.choice(vocabulary) for _ in range(60)]
    for size in (30, 80, 200):
        for copies in (1, 2, 12):
            base = [r.choice(vocabulary) for _ in range(size)]
            for _ in range(copies):
                words = list(base)
                for _ in range(r.randrange(4)):
                    words[r.randrange(len(words))] = r.choice(vocabulary)
                texts.append(" ".join(words + passage * (size == 80)))
    texts += texts[-3:]
    want, sizes = _brute(texts, rule)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n int").repartition(4)
    got = {x.doc_id: (x.component_id, x.n_shingles) for x in ngram_join.near_duplicates(df, rule).collect()}
    assert got == {i: (want[i], sizes[i]) for i in range(len(texts))}
    kept = ngram_join.keep_first(df, rule)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want)) and kept.columns == df.columns


def test_ngram_join_odd_rows(docs, nothing):
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id == 99} == {9} and {r.component_id for r in got if r.doc_id in (1, 2)} == {1, 2}
    assert {r.component_id for r in got if r.doc_id is None} == {4}
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}


def test_cover_tree(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    monkeypatch.setattr(cover_tree, "CELL", 10)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    x = [c + r.normal(size=8) * s for c in centres for s in (0.05, 0.2, 0.4) for _ in range(12)] + [centres[0]] * 5 + [centres[0] * 2]
    rows = [(i, [float(v) for v in a], True) for i, a in enumerate(x)]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    rows += [(1000 + i, v, True) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, kept boolean").repartition(3)
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    for _ in range(len(u)):
        root = np.minimum(root, np.where(near, root[None], len(u)).min(1))
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in cover_tree.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(u))} | {1000 + i: (0, 1000 + i, True) for i in range(len(odd))}
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def _all_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then the same on both sides of it."""
    if not len(scores):
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    left, right = _all_segments(scores[:i]), _all_segments(scores[j:])
    return left + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in right]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-0.5, -0.5, -0.5, 0.75, 1.25, 3.0]), max_size=30))
def test_segments(scores):
    got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.5)
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in _all_segments(scores)))
    assert all(s == pytest.approx(sum(scores[a : b + 1])) for a, b, s in got)


def test_toxicity(spark, docs, nothing):
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = [r.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(4):
                t[r.randrange(60)] = r.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(d, lab)
    assert {"idiot", "moron", "scum"} <= set(model.scores)
    assert [x.predicted for x in toxicity.score(d, model).orderBy("doc_id").collect()] == [y for _, y in labels]
    odd = toxicity.score(docs, model, keep=["text"]).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 and x.predicted == 0 for x in odd)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.train(nothing, lab.limit(0)).scores == {}


def test_licenses(docs, nothing):
    s = licenses.Scanner()
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    r = random.Random(2)
    parts = ["MIT", "license", "License", "apache", "general public", "x", "É", "\n", "license:", "mit license mit license"]
    for text in [*TEXTS, *(" ".join(r.choices(parts, k=12)) for _ in range(200))]:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = rule.findall(lower)
        at = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        n, k, first, last, base, labels, score, _ = s.run(text)
        assert (n, k, first, last) == (len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert base == ",".join(sorted({x for _, x in at})) and set(filter(None, base.split(","))) <= set(labels.split(",")) and 0 <= score <= 1
    assert s.run("x\n// SPDX-License-Identifier: BSD-3-Clause OR MIT\nmore")[5:] == ("bsd,mit", pytest.approx(0.95), ["BSD-3-Clause or MIT"])
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


def test_urls(spark):
    urls = [None, "", "x", "http://", "http://A.Com/", "http://a.com", "https://www.Example.com/en/a?b#c", "https://m.example.com/en/", "x://b.net/es/1", "x://b.net/de/1", "a://b://c.com/x", "http://xcom/", "http://é.org/en/日"]
    urls += [f"http://good{i}.com/news/{i}" for i in range(60)] + [f"http://bad{i}.net/es/spam-{i}" for i in range(60)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string").repartition(3)
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        tail = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", tail)[0]
        path = re.match(r"[^?#]*", tail[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ((verdict,) if verdict else ("allow", "block"))
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df.limit(1)).collect()} == {"allow"}


def test_character_models():
    counts = np.zeros(url_filter.SYMBOLS**4, np.int64)
    cells, _ = url_filter.grams(["http://abcabc", "ab", None])
    np.add.at(counts, cells, 1)
    p = np.exp(url_filter.log_probabilities(counts).astype(float)).reshape(-1, url_filter.SYMBOLS)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and len(cells) == 8


PAGE = '<!DOCTYPE html><html lang="{l}"><head><title>t</title><style>p{{}}</style><script>"</p>"</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav><!-- c --><div class="ad">Buy now</div>{a}<div id="comments"><p>first!</p></div><footer>&copy; foot</footer></body></html>'


def test_extraction(spark):
    a = "<article><h1>A  title</h1><p><b>One &amp; two<br>three<p>Four\n five</p><ul><li>x<li>y</ul><aside>no</aside></article>"
    assert extraction.main_text(PAGE.format(l="en", a=a), set()) == "A title\n\nOne & two three\n\nFour five\n\nx\n\ny"
    soup = [f"<div><p>The same notice for all.</p><p>Body {i} of its own</p></div>" for i in range(5)]
    rows = [(i, f"http://h.org/{i}", PAGE.format(l="en", a=s)) for i, s in enumerate(soup)] + [(10, "http://one.org/", PAGE.format(l="en", a=a)), (11, None, None), (12, "", ""), (13, "x", "<p>open <b"), (14, "http://h.org/", "</p></div><<>&#x;" * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in extraction.extract(df).collect()}
    assert [got[i].text for i in range(5)] == [f"Body {i} of its own" for i in range(5)]
    assert got[10].text.startswith("A title") and got[11].text == got[12].text == "" and got[13].text.startswith("open")
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)
    assert extraction.extract(df.limit(0)).count() == 0


def test_language(spark):
    en, de = "the cat and the dog went with this house ", "der hund und die katze mit dem haus nicht "
    docs = spark.createDataFrame([(en * 5, "en"), (de * 5, "de"), (None, "en"), ("x", None)] * 3, "text string, lang string")
    pages = [(i, f"http://h{i % 2}.org/{('en', 'de')[i % 2]}/{i}", PAGE.format(l=("en", "de")[i % 2], a=f"<p>{(en, de)[i % 2] * 4}</p>")) for i in range(20)]
    pages += [(50, "http://h1.org/de/9", None), (51, None, None), (52, "http://h0.org/en/2", PAGE.format(l="de", a=f"<p>{en * 6}</p>"))]
    df = spark.createDataFrame([(*p, "zz") for p in pages], "page_id bigint, url string, html string, lang string").repartition(2)
    got = {r.page_id: r for r in language.identify(df, docs).collect()}
    assert [got[i].lang for i in range(20)] == ["en", "de"] * 10 and got[50].lang == "de" and got[50].text_lang is None and got[52].lang == "en"
    assert len(got) == len(pages) and all(0 < r.score <= 1.0001 for r in got.values())
    assert language.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in language.identify(df, docs.limit(0)).collect()} == {"und"}


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, d)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in kept.collect()}
    calm = corpus_pipeline.toxic_segments(spark, kept, d)
    assert calm.columns == docs.columns
    left = {r.doc_id for r in calm.collect()}
    unique = corpus_pipeline.near_duplicates(spark, calm, d)
    assert unique.columns == docs.columns
    texts = sorted((r.doc_id, r.text) for r in calm.collect())
    want, _ = _brute([t for _, t in texts], ngram_join.Rule())
    assert {r.doc_id for r in unique.collect()} == {texts[i][0] for i in set(want)}
    assert left <= good
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == {texts[i][0] for i in set(want)}
