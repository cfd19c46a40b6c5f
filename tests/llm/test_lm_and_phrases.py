"""Language model scores and phrase collocations against plain versions on small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import collocations as C, lm_scoring as L
from tidemark.llm.common import Scratch

# -- phrases ---------------------------------------------------------------------------------------------------------


def plain_phrases(rows, max_words=5, min_count=100, inside=100, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= min_count}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if any(m == lang and len(v) > len(w) and 100 * b >= inside * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (m, v), b in cand.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    got = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            got.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(got)


def phrases_of(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in C.phrase_collocations(docs, **kw).collect())


ROWS = [
    ("en", "Of the sea. Of the sea, of the Sea; in the\tsea  of THE\nsea"),
    ("en", "of the sea of the sea of the sea"),
    ("en", "of the sea of the sea of the sea"),
    (None, "a a a a a a a a"),
    ("und", "a a a. b a a"),
    ("fr", "É é É é. l'eau l'eau: l'eau l'eau"),
    ("fr", ""),
    ("fr", None),
    ("de", "...,;:!? \n\r\t "),
]


@pytest.mark.parametrize("kw", [{"min_count": 2}, {"min_count": 3, "max_words": 3}, {"min_count": 2, "top": 2}, {"min_count": 2, "inside": 60}, {"min_count": 1, "max_words": 4}, {"min_count": 2, "max_words": 2}])
def test_phrases(spark, kw):
    want = plain_phrases(ROWS, **kw)
    if "inside" in kw:
        kw = {**kw, "inside_percent": kw["inside"]}
        kw.pop("inside")
    assert phrases_of(spark, ROWS, **kw) == want and want


def test_phrases_of_random_texts(spark):
    r = np.random.default_rng(5)
    rows = [(str(r.choice(["en", "de"])), " ".join(r.choice(list("abcd") + ["e.", "f,"], int(r.integers(0, 40))))) for _ in range(60)]
    for kw in ({"min_count": 5}, {"min_count": 20, "top": 3}):
        assert phrases_of(spark, rows, **kw) == plain_phrases(rows, **kw)


def test_phrases_of_an_empty_table_and_other_columns(spark):
    assert phrases_of(spark, [], min_count=1) == []
    docs = spark.createDataFrame([("x y", "q", 1, 2)], "text string, phrase string, n long, rank long")
    got = C.phrase_collocations(docs.selectExpr("*", "'en' as lang"), min_count=1).collect()
    assert [tuple(x) for x in got] == [("en", 1, "x y", 1, 1, 1, 2, 2000)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "x\x1cy", " ", ".", ",", "\t", "\n", "ab", "..", "\x00"]), max_size=30), st.integers(1, 4), st.integers(1, 20))
def test_counts_in_parts_of_any_size(words, n, chunk):
    text, before = " ".join(words), C.CHUNK
    want = Counter()
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
        its = [w for w in re.split("[ \t]+", piece) if w]
        want.update(" ".join(its[i : i + n]) for i in range(len(its) - n + 1))
    got = Counter()
    try:
        C.CHUNK = chunk
        for part in C._chunks(text.encode().translate(C._NORMAL), n):
            phrases, counts = C._counted("en", part, n, None, C.WordHash())
            got.update(dict(zip(phrases.to_pylist(), counts.tolist())))
    finally:
        C.CHUNK = before
    assert got == want


def test_many_kinds_of_words_keep_their_keys():
    words = [f"w{i}" for i in range(20_000)] * 2
    part = next(C._chunks(" ".join(words).encode(), 5))
    phrases, counts = C._counted("en", part, 5, None, C.WordHash())
    got = dict(zip(phrases.to_pylist(), counts.tolist()))
    assert len(got) == 20_000 and got["w0 w1 w2 w3 w4"] == 2 and got["w19999 w0 w1 w2 w3"] == 1


# -- language model --------------------------------------------------------------------------------------------------


def plain_trie(texts, order):
    seen = defaultdict(Counter)
    for t in texts:
        whole = b"\xff" * order + (t or "").encode().lower() + b"\xff"
        for i in range(order, len(whole)):
            for k in range(order + 1):
                seen[whole[i - k : i]][whole[i]] += 1
    return seen


def plain_log(seen, context, symbol):
    out, excluded = 0.0, set()
    for k in range(len(context) + 1):
        node = {s: c for s, c in seen.get(context[k:], {}).items() if s not in excluded}
        if symbol in node:
            return out + math.log10((2 * node[symbol] - 1) / (2 * sum(node.values())))
        if node:
            out += math.log10(len(node) / (2 * sum(node.values())))
        excluded |= node.keys()
    return out - math.log10(256 - len(excluded))


def plain_score(seen, text, order):
    whole = b"\xff" * order + (text or "").encode().lower() + b"\xff"
    return sum(plain_log(seen, whole[i - order : i], whole[i]) for i in range(order, len(whole)))


def plain_words(train, text):
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for t in train for w in split(t))
    n, v, its = sum(c.values()), len(c), split(text)
    return len(its), sum(c[w] > 0 for w in its), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in its)


TEXTS = ["the sea of the sea", "The sea\nof THE  sea", "", None, "éé ça \U0001f30a", "abracadabra " * 20, "zzzz unseen words here", "the", "\x0b\x00\x1c x", "the sea of the sea"]


@pytest.mark.parametrize("most,head", [(4_000_000, 1 << 17), (40, 2), (1, 0)])
@pytest.mark.parametrize("order", [1, 4])
def test_scores(spark, monkeypatch, most, head, order):
    monkeypatch.setattr(L, "HEAD", head)
    rows = [(i, t, "x", 1.0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, __row double")
    scratch = Scratch(spark)
    train = [0, 2, 3, 4, 5, 8]
    model = L.fit_language_model(docs.filter(docs.doc_id.isin(train)), scratch, order, most_entries=most)
    assert most > 40 or len(model.blocks) > 1
    out, (score, size, tokens, known, base) = L.score_texts(docs, model, scratch)
    assert out.columns[:4] == ["doc_id", "text", "score", "__row"]
    seen = plain_trie([TEXTS[i] for i in train], order)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n, k, total, want = plain_words([TEXTS[j] for j in train], t)
        r = got[i]
        assert (r[tokens], r[known], model.tokens, r[size]) == (n, k, total, len((t or "").encode()) + 1)
        assert r[base] == pytest.approx(want) and r[score] == pytest.approx(plain_score(seen, t, order))


def test_probabilities_of_the_next_byte_sum_to_one():
    order, texts = 3, ["abracadabra", "the sea of the sea", "banana"]
    runs = np.concatenate([r for r, _, _ in L._parts([t.encode() for t in texts], order)])
    pair = np.unique(runs & 0xFFFF, return_counts=True)
    trie = L.PpmTrie(order, *np.unique(runs, return_counts=True), *pair)
    for context in (b"bra", b"the", b"qqa", b"\xff\xff\xff", b"zzz"):
        ask = np.array([int.from_bytes(context + bytes([s])) for s in range(256)])
        assert (10 ** trie.logs(ask)).sum() == pytest.approx(1)


def test_long_texts_in_parts(monkeypatch):
    text = ("the sea of the sea " * 50).encode()
    whole = [x for runs, _, _ in L._parts([text, b"", text], 4) for x in runs.tolist()]
    monkeypatch.setattr(L, "CHUNK", 37)
    assert [x for runs, _, _ in L._parts([text, b"", text], 4) for x in runs.tolist()] == whole
    assert [w for part in L._word_lists(text) for w in part] == text.split()


def test_case_is_kept_where_it_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "ABAB"), (2, "abab")], "doc_id long, text string")
    scratch = Scratch(spark)
    for lower, alike in ((True, True), (False, False)):
        model = L.fit_language_model(docs.filter("doc_id = 1"), scratch, 2, lower=lower)
        out, (score, *_) = L.score_texts(docs, model, scratch)
        a, b = (r[score] for r in out.orderBy("doc_id").collect())
        assert (a == pytest.approx(b)) == alike and a >= b


def test_an_empty_training_set_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    scratch = Scratch(spark)
    model = L.fit_language_model(docs.filter("false"), scratch)
    out, (score, *_, base) = L.score_texts(docs, model, scratch)
    r = out.first()
    assert r[score] == pytest.approx(-4 * math.log10(256)) and r[base] == pytest.approx(0)
    model = L.fit_language_model(docs, scratch)
    assert L.score_texts(docs.filter("false"), model, scratch)[0].count() == 0
    with pytest.raises(ValueError):
        L.fit_language_model(docs, scratch, order=5)


def test_adaptive_scores_learn_from_the_text_itself(spark):
    docs = spark.createDataFrame([(1, "abcabcabc" * 30), (2, None), (3, "aé")], "doc_id long, text string")
    out, name = L.adaptive_scores(docs, 2)
    got = {r["doc_id"]: r[name] for r in out.collect()}
    assert got[2] == pytest.approx(-math.log10(256))
    assert got[1] > -271 * math.log10(2)  # below one bit a byte
    want = 0.0
    whole = b"\xff\xff" + "aé".encode() + b"\xff"
    for i in range(2, len(whole)):
        want += plain_log(plain_trie_of_prefix(whole, i, 2), whole[i - 2 : i], whole[i])
    assert got[3] == pytest.approx(want)


def plain_trie_of_prefix(whole, upto, order):
    seen = defaultdict(Counter)
    for i in range(order, upto):
        for k in range(order + 1):
            seen[whole[i - k : i]][whole[i]] += 1
    return seen


def test_op11_on_the_given_documents(spark, data):
    got = L.op11_lm_scoring(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 5 == 1 for d in docs}
    train = [d["text"] for d in docs if not held[d["doc_id"]]]
    text = {d["doc_id"]: d["text"] for d in docs}
    assert sorted(r["doc_id"] for r in got) == sorted(text) and {r["doc_id"]: r["held_out"] for r in got} == held
    out = [r for r in got if r["held_out"]]
    # it takes less than three bits a byte for what it has not seen; the words' score, which spells no unseen word, is no bound
    assert sum(-r["score"] * math.log2(10) for r in out) < 3 * sum(r["n_bytes"] for r in out)
    seen = None
    for r in sorted(out, key=lambda r: len(text[r["doc_id"]]))[:12]:
        n, k, total, base = plain_words(train, text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, k, total) and r["base_score"] == pytest.approx(base)
        seen = seen or plain_trie(train, L.ORDER)
        assert r["score"] == pytest.approx(plain_score(seen, text[r["doc_id"]], L.ORDER))
