import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from driftline.llm import bpe, quality, toxicity, urls, wrapper
from driftline.llm.common import Store
from tests.llm.conftest import prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference(reference):
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    r = random.Random(1)
    letters = "ab \t\n\r\x0b\x1c\x85\xa0\u3000é́١漢字🙂'sS'll don't\u200b\ufeff\x00<|endoftext|>ǅⅧ²"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += [prose(500, 3), "a" * 20000, " " * 3000 + "x", "é" * 999, "", None, "unbelievable internationalisation " * 50]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t or "")
        assert codec.decode(ids) == (t or "").encode()


def test_memo_does_not_change_ids(monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    want = [codec.encode(prose(30, i)) for i in range(20)]
    monkeypatch.setattr(bpe, "MEMO", 5)
    assert [codec.encode(prose(30, i)) for i in range(20)] == want


def test_encoded_documents(reference, awkward, nothing):
    rows = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    got = bpe.encode_documents(awkward, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == awkward.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    digests = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(awkward, RANKS, public_tokenizers.PATTERN, digests=True).collect()}
    assert digests == {(d, hashlib.sha256(np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(),
                        hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}
    assert bpe.encode_documents(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def corpus(n=400):
    """(doc_id, text, lang, source, bad): bad ones shout, stutter or are full of symbols; one source is mostly bad."""
    r, rows = random.Random(4), []
    for i in range(n):
        source = f"s{i % 7}"
        bad = r.random() < (0.7 if source == "s3" else 0.08)
        text = prose(r.randrange(30, 150), 10 ** 6 + i)
        if bad:
            text = r.choice([text.upper() + "!!", " ".join(w + "#$%" for w in text.split()), "word word word word " * 20])
        rows.append((i, text, "en", source, int(bad)))
    return rows


def test_quality(spark, awkward, nothing):
    rows = corpus()
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(x[0], 1 - x[4]) for x in rows if x[0] % 2] + [(None, 0), (1, None), (10 ** 9, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.posteriors(docs, labels, Store(spark)).collect()}
    held = [x for x in rows if x[0] % 2 == 0]
    assert sum(got[x[0]]["kept"] != bool(x[4]) for x in held) >= 0.98 * len(held)
    rate = {x[3]: got[x[0]]["host_rate"] for x in rows}
    assert rate["s3"] > 2 * max(v for k, v in rate.items() if k != "s3")
    kept = quality.keep_good(docs, labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, r in got.items() if r["kept"])
    some = labels.limit(0)
    assert quality.keep_good(awkward, some).count() == awkward.count()
    assert quality.keep_good(awkward, labels).columns == awkward.columns
    assert quality.posteriors(awkward, labels, Store(spark)).count() == awkward.count()
    assert quality.keep_good(nothing, labels).count() == 0


def test_shrinkage(spark):
    """A sparse path stays near its host, a large one near its own rate."""
    rows = [("h", 0.5, "big", 1000, 900.0), ("h", 0.5, "tiny", 1, 1.0), ("h", 0.5, "other", 1000, 100.0)]
    children = spark.createDataFrame(rows, "host string, prior double, path string, n long, bad double")
    rate = {r["path"]: r["rate"] for r in quality._shrunk(children, ["host"]).collect()}
    assert rate["big"] > 0.85 and rate["other"] < 0.15 and 0.5 < rate["tiny"] < 0.75


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(2)
    features = [np.flatnonzero(r.random(6) < 0.4) for _ in range(3000)]
    strength = np.array([2.0, 1.5, 1.0, 0.0, 0.0, -1.0])
    score = np.array([strength[f].sum() for f in features]) + r.logistic(size=3000)
    grades = (score > 1).astype(int) + (score > 2.5) + (score > 4)
    weights, thresholds = toxicity.fit(features, grades, 6)
    assert (np.diff(thresholds) > 0).all() and len(thresholds) == 3
    assert np.abs(weights - strength).max() < 0.4 and np.abs(thresholds - [1, 2.5, 4]).max() < 0.4
    assert len(toxicity.fit(features, np.zeros(3000, int), 6)[1]) == 0


def test_toxicity(spark, awkward, nothing):
    r, rows = random.Random(6), []
    for i in range(600):
        words = prose(40, 7000 + i).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randrange(1, 6)):
                words.insert(r.randrange(40), r.choice(["nastya", "nastyb", "vile", "horrid"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    half = docs.where("doc_id % 2 = 1 OR doc_id % 4 = 0").where("doc_id < 500")
    labelled = toxicity.unique_texts(half, Store(spark))
    labelled = toxicity.graded(labelled, toxicity.choose_words(labelled, only_for=True))
    model = toxicity.train(labelled)
    scored = {x["doc_id"]: x for x in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    held = [x for x in rows if x[0] >= 500]
    assert sum((scored[d]["severity"] >= 0.3) == bool(t) for d, _, t in held) >= 0.97 * len(held)
    assert toxicity.score(awkward, model).count() == awkward.count()
    assert toxicity.score(nothing, model).count() == 0
    empty = toxicity.train(docs.where("grade = 0"))
    assert {x["severity"] for x in toxicity.score(awkward, empty).collect()} == {0.0}


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://x.net": ("x.net", "", None, "allow"),
        "http://x.net/": ("x.net", "/", "net/", "block"), "https://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "x://example.com/de/1#f": ("example.com", "/de/1", "example.com/de/", "block"), "x://example.com/den": ("example.com", "/den", None, "allow"),
        "http://q.org?/fr/": ("q.org", "", None, "allow"), "http://q.org/fr/://z": ("q.org", "/fr/://z", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://É.org/fr/\nx": ("É.org", "/fr/\nx", "org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, none, RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(pages.limit(0), none, RULES).count() == 0


def test_reputation(spark):
    hosts = [("bad.site.com", 200, 190), ("new.site.com", 0, 0), ("good.site.com", 200, 2), ("one.other.com", 1, 1), ("big.other.com", 500, 5), ("", 3, 1)]
    got = {r["host"]: r for r in urls.host_reputation(spark.createDataFrame(hosts, "host string, pages long, bad long")).collect()}
    assert len(got) == len(hosts)
    assert got["bad.site.com"]["bound"] > 0.8 and got["good.site.com"]["rate"] < 0.1
    assert got["one.other.com"]["bound"] < urls.LIMIT and got["one.other.com"]["rate"] < 0.9      # one bad page proves little
    assert got["good.site.com"]["rate"] < got["new.site.com"]["rate"] < got["bad.site.com"]["rate"]


PAGE = ('<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>";</script></head><body>'
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>'
        '<article class="side"><h1>Head&eacute;</h1><p><b>Bold\n  start<br><p>Two &lt;tags&gt;&nbsp;here<div class="ad">Buy</div><p>Three'
        '<form><input>Send</form><ul><li>i1</li><li>i2</li></ul></article>'
        '<div class="comments"><p>Great great great great great</p></div><aside>Side</aside><footer>&copy; me</footer>')


def test_main_text(spark):
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", PAGE.replace("Three", "Other")), (3, None, None), (4, "http://b.org", ""), (5, "http://c.org", "just text &amp more"),
            (6, "http://d.org", "<html><body><div class=menu>m</div><div class=post><p>para one is long<p>para two is long</div><p>cut off<b cla"),
            (1, "http://a.org/1", PAGE), (7, "http://e.org", "<p>" * 3000 + "deep" + "<div>" * 3000 + "er")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[1] == "Headé\nBold start\nTwo <tags> here\nThree\ni1\ni2" and got[2] == got[1].replace("Three", "Other")
    assert got[3] == got[4] == "" and got[5] == "just text & more"
    assert got[6] == "para one is long\npara two is long\ncut off" and got[7]      # short text beside the largest part is text == "deep\ner"
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_alignment():
    def whole(*texts):
        out = wrapper.read_expression(texts[0])
        for t in texts[1:]:
            out = wrapper.merge(out, wrapper.read_expression(t))
        return wrapper.written(out)

    a = wrapper.expression("<div><h2>x</h2><p>a</p><p>b</p></div>")[0]
    assert a == "page(div(h2(#) p(#)+))" and wrapper.written(wrapper.read_expression(a)) == a
    assert whole(a, "page(div(p(#)))") == "page(div(h2(#)? p(#)+))"
    assert whole("page(ul(li(a(#))))", "page(ul(li(a(#) #)))") == "page(ul(li(a(#) #?)))"
    assert whole("page(p(#))", "page(p(#) p(#)? img)") in ("page(p(#)+ img?)", "page(p(#)* img?)")
    many = "page(" + " ".join(f"x{i}(#) y{i % 3}(#)" for i in range(60)) + ")"
    assert len(wrapper.read_expression(whole(many, many.replace("x1(", "z(")))[2]) <= wrapper.PARTS


def test_wrappers_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "FAN", 3)
    pages = [(i, "http://h.org/", f"<html><body><div id=x{i}><ul class=menu><li>m</li></ul><div class=post>" + "".join(f"<p>{'text ' * 20}</p>" + "<table><tr><td>1</td></tr></table>" * (i % 4 == j) for j in range(1 + i % 5)) + f"</div></div>" + "<section>s</section>" * (i % 7))
             for i in range(40)]
    got = wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith("text text") and "m" not in r["text"].split() for r in got)
    assert all("\ns" not in r["text"] for r in got)


def test_wrapper_keeps_text_beside_the_largest_part(spark):
    long, short = "a long passage " * 20, "a short passage " * 9
    bodies = [f"<div class=post><p>{short}1</p><blockquote>{long}</blockquote><p>{short}2</p></div>",
              f"<div class=post><p>{short}1</p><table><tr><td>{long}</td></tr></table></div>",
              f"<div><section><p>{short}1</p></section><div><p>{long}</p></div></div>",
              f"<div><ul><li><a href=x>elsewhere</a></li></ul><div><p>{short}1</p><p>{long}</p></div></div>",
              f"<table><tr><td><a href=x>elsewhere</a></td></tr></table><div><p>{short}1</p><p>{long}</p></div>"]
    own = [f"<section><p>{short}{i}</p></section><div><p>{long}{i}</p></div><div class=x><b>All rights are reserved by the owner of the host</b></div>" for i in range(2)]
    rows = [(i, f"http://h{i}.org/p", f"<html><body><nav><a href=/>home</a></nav>{b}<footer>bottom</footer></body></html>") for i, b in enumerate(bodies)]
    rows += [(10 + i, "http://own.org/", f"<body>{b}</body>") for i, b in enumerate(own)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "\n".join([f"{short}1", long.strip(), f"{short}2"])
    assert all(got[i] == "\n".join([f"{short}1", long.strip()]) for i in range(1, 5))
    assert all(f"{short}{i}" in got[10 + i] and f"{long}{i}" in got[10 + i] for i in range(2))


def test_wrapper_drops_no_article_text(spark):
    """Short text beside a larger part, and text behind elements that are never closed."""
    cases = [("<div class=post><p>He left.</p><div><p>" + "long " * 40 + "</p></div><p>The end.</p></div>", "He left.\n" + ("long " * 40).strip() + "\nThe end."),
             ("<article><p>One</p><svg viewBox='0 0 1 1'><path d=1><p>Two and more</p><p>Three</p></article>", "One\nTwo and more\nThree"),
             ("<article><p>One</p><noscript><p>Two</p><noscript><p>Three</p></article>", "One\nTwo\nThree"),
             ("<article><p>One</p><select><option><p>Two</p></article>", "One\nTwo"),
             ("<article><p>Energy is <math><mi>E</mi> = mc</math> here</p></article>", "Energy is E = mc here"),
             ("<article><p>a<svg><text>no</text></svg>b</p><p><select><option>x</select>c<noscript>d</noscript></p><svg/><p>e</p></article>", "ab\nc\ne")]
    rows = [(i, f"http://h{i}.org/p", f"<html><body>{page}</body></html>") for i, (page, _) in enumerate(cases)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text for i, (_, text) in enumerate(cases)}


def test_long_and_deep_pages_lose_nothing(spark):
    """On both sides of PARTS and DEPTH."""
    rows, want = [], {}
    for i, n in enumerate((wrapper.PARTS - 2, wrapper.PARTS + 20)):
        tags = ["p", "h2", "ul", "pre", "section"]
        page = "".join(f"<{tags[k % 5]}>part {k}</{tags[k % 5]}>" for k in range(n))
        rows.append((i, f"http://long{i}.org/", f"<body><article>{page}</article></body>"))
        want[i] = "\n".join(f"part {k}" for k in range(n))
    for i, n in enumerate((wrapper.DEPTH - 5, wrapper.DEPTH + 30), 2):
        rows.append((i, f"http://deep{i}.org/", "<body><p>top</p>" + "<div>" * n + "low" + "</div>" * n + "<p>end</p></body>"))
        want[i] = "top\nlow\nend"
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
