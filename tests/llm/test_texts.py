"""Language, main text, token counts and archives."""

import hashlib
import itertools
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from relisense.llm import langid, warc
from relisense.llm.html_text import extract, graph, labelled, main_text, min_cut
from relisense.llm.shared import shared_folder
from relisense.llm.token_counts import UnigramCounter, token_counts, vocabulary

from .conftest import prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy now, it is cheap.</div>
<article><h1>Title &amp; more</h1><p><b>First  paragraph,\n with text.<br><p>Second &lt;one&gt; &eacute;.</p><aside>Aside text here, with commas, and more.</aside>
<div class="comments"><p>I liked this, a long comment by a reader. It goes on and on, really.</p></div><form><label>Name</label><button>Go</button></form>
<div class="cookie-notice">We use cookies.</div><p>Ti.</p></article><div id="sidebar"><p>More, more, more words in the sidebar.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\nFirst paragraph, with text.\nSecond <one> é.\nTi."
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    assert main_text("<html><body><article><p>Cut off in a ta<p") == "Cut off in a ta"
    plain = "<body><div>" + "".join(f"<p>Sentence {i}, which is long enough to be text. And one more.</p>" for i in range(3)) + "</div><ul class=menu><li><a href=x>Home</a></ul>"
    assert main_text(plain).count("\n") == 2 and "Home" not in main_text(plain)


LONG = "This is a long sentence, with commas and so on, that goes on for quite a while. And another one follows it here."


def test_marks_are_evidence():
    """Article text that a tag, an id or one word of a class alone would have thrown out."""
    kept = [
        f'<article><h1>T</h1><h2 id="privacy">ZZZ</h2><p>{LONG}</p></article>', f'<article><p>{LONG}</p><p id="warning-signs">ZZZ look.</p></article>',
        f'<article><p>{LONG}</p><section class="notice-board"><p>{LONG}</p><p>ZZZ.</p></section></article>', f'<nav><a href=x>H</a></nav><article class="article related"><p>{LONG}</p><p>ZZZ.</p></article>',
        f'<nav><a href=x>H</a></nav><div class="story search-result"><p>{LONG}</p><p>ZZZ.</p></div>', f"<article><canvas id=c><p>{LONG}</p><svg><p>ZZZ</p></article>", "<article><p>ZZZ</p></article>",
        '<article><p>Hello <span class="ad">Buy!</span> ZZZ</p></article>',
    ]
    for page in kept:
        assert "ZZZ" in main_text(page), page
    assert main_text(kept[-1]) == "Hello ZZZ"
    article = f"<article><p>{LONG}</p>%s</article>%s"
    inside = ['<aside><p>ZZZ {0} {0}</p></aside>', '<div class="comments"><p>ZZZ {0}</p><p>ZZZ</p></div>', '<div class="cookie-notice">ZZZ We use cookies.</div>', "<form><label>ZZZ</label><p>ZZZ {0}</p></form>", "<div hidden><p>ZZZ {0}</p></div>", '<div class="newsletter-signup"><p>ZZZ {0}</p></div>']
    outside = ['<section id="comments"><article class="comment"><p>ZZZ {0} {0}</p></article></section>', "<aside><article><h3>ZZZ</h3><p>ZZZ {0} {0}</p></article></aside>", '<div id="sidebar"><p>ZZZ {0}</p></div>', '<footer><p>ZZZ {0}</p></footer>']
    for page in [article % (x.format(LONG), "") for x in inside] + [article % ("", x.format(LONG)) for x in outside]:
        assert main_text(page) == LONG, page


def cost(side, content, boiler, edges):
    return sum(content[i] if x else boiler[i] for i, x in enumerate(side)) + sum(c if side[a] and not side[b] else back if side[b] and not side[a] else 0 for a, b, c, back in edges)


def test_min_cut_is_minimal():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randint(1, 6)
        a, b = ([rng.randint(0, 9) / 2 for _ in range(n)] for _ in "ab")
        edges = [(i, j, rng.randint(0, 6) / 2, rng.randint(0, 6) / 2) for i in range(n) for j in range(i) if rng.random() < 0.6]
        sides = itertools.product([True, False], repeat=n)
        assert cost(min_cut(a, b, edges), b, a, edges) == pytest.approx(min(cost(s, b, a, edges) for s in sides))


def test_labels_are_the_best_of_all():
    """Whole pages against every labelling of their graph; the edges decide some labels."""
    rng, turned = random.Random(4), 0
    tags = [("article", ""), ("div", ""), ("div", ' class="comments"'), ("aside", ""), ("div", ' id="menu"'), ("section", ' class="notice-board"'), ("div", ' class="post widget"')]
    for _ in range(60):
        page, open_ = "", []
        for _ in range(rng.randint(2, 9)):
            if rng.random() < 0.4 and len(open_) < 3:
                tag, attrs = rng.choice(tags)
                page += f"<{tag}{attrs}>"
                open_.append(tag)
            elif open_ and rng.random() < 0.3:
                page += f"</{open_.pop()}>"
            else:
                page += rng.choice([f"<p>{LONG}</p>", "<p>Yes.</p>", '<p><a href="x">More</a></p>', "<h2>Part</h2>", f"<div>{LONG[:60]}</div>"])
        blocks, keep = labelled(page)
        if not blocks:
            continue
        content, boiler, edges = graph(blocks)
        best = min(itertools.product([True, False], repeat=len(content)), key=lambda s: (round(cost(s, content, boiler, edges), 9), sum(s)))
        assert tuple(keep) == best[: len(blocks)], page
        turned += sum((c < b) != k for c, b, k in zip(content, boiler, keep, strict=False))
    assert turned > 20


@pytest.mark.parametrize("page", ["<div>" * 20000 + "</section>" * 20000 + "x", "<p>a<div>b" * 20000, "<ul>" + "<li>item one" * 20000, "<div class=ad><p>x y z</p>" * 10000, f"<article>{'<p>' + LONG + '</p>'}" * 2000])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    text = main_text(page)
    assert time.process_time() - began < 8 and len(text) < len(page)


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = out.collect()
    assert len(got) == 4 and [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_token_counts_equal_the_library(odd, odd_rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = vocabulary(path)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    own = UnigramCounter(vocab)
    for text in [*(r[1] or "" for r in odd_rows), "a▁b", "▁▁", "☃☃ x☃☃y ☃", "a\x1cb", "a\xa0b　c"]:
        assert own.count(text) == len(t.encode(text, add_special_tokens=False).ids), text[:50]
    assert [r["n_tokens"] for r in token_counts(odd, path).collect()] == [own.count(r[1]) for r in odd_rows]


def test_ties_take_the_longest_last_piece():
    assert UnigramCounter([("▁", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -2.0)]).count("ab") == 1
    assert UnigramCounter([("▁", -1.0)]).count("zzz") == 2  # neighbouring unknown pieces count as one


def test_language_by_mixture(spark, odd, none):
    rng = random.Random(6)
    de = lambda n: " ".join("".join(rng.choice(["ung", "sch", "ein", "keit", "ver", "ü"]) for _ in range(2)) for _ in range(n))
    rows = [(i, prose(rng, 60), "en") for i in range(60)] + [(i, de(60), "de") for i in range(60, 120)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert model.predict(prose(rng, 20))[0] == "en" and model.predict(de(20))[0] == "de"
    lang, share, langs = model.predict(prose(rng, 90) + " " + de(30))
    assert lang == "en" and 0.55 < share < 0.9 and "de:" in langs
    assert model.predict(None) == model.predict("12 %") == (langid.UNDETERMINED, 0.0, "")
    out = odd.select(langid.identify("text", model).alias("l")).collect()
    assert len(out) == odd.count() and out[0]["l"]["lang"] == langid.UNDETERMINED
    assert langid.fit(none).predict("abc")[0] == langid.UNDETERMINED
    assert none.select(langid.identify("text", model)).count() == 0


def by_hand(model, text):
    """The definition, a loop at a time: all proportions, then every nested set by its penalised likelihood."""
    import math
    from collections import Counter

    n = Counter(langid.trigram_buckets(text).tolist())
    total = sum(n.values())
    if not total:
        return langid.UNDETERMINED, 0.0

    def em(which):
        share = {k: 1 / len(which) for k in which}
        for _ in range(langid.EM_STEPS if len(which) > 1 else 0):
            new = dict.fromkeys(which, 0.0)
            for b, c in n.items():
                mix = sum(share[k] * model.prob[b, k] for k in which)
                for k in which:
                    new[k] += c * share[k] * model.prob[b, k] / mix
            share = {k: v / total for k, v in new.items()}
        return share, sum(c * math.log(sum(share[k] * model.prob[b, k] for k in which)) for b, c in n.items())

    share, _ = em(range(len(model.languages)))
    order = sorted(share, key=lambda k: (-share[k], k))
    tried = [(em(order[:k]), k) for k in range(1, len(order) + 1)]
    (own, _), _ = max(tried, key=lambda x: (x[0][1] - langid.PENALTY * (x[1] - 1) * math.log(total + 1), -x[1]))
    top = max(own, key=lambda k: (own[k], -order.index(k)))
    return model.languages[top], own[top]


def test_mixtures_equal_brute_force(spark):
    """Five languages, texts of up to all five, repeated rows in the fit."""
    rng = random.Random(16)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "keit"], "cc": ["eau", "oui", "ell"], "dd": ["zzu", "vya", "psk"], "ee": ["hth", "wer", "ing"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(k, 50), k) for i, k in enumerate(list(parts) * 20)]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(rows, schema))
    texts = [" ".join(say(k, rng.randint(1, 40)) for k in rng.sample(sorted(parts), rng.randint(1, 5))) for _ in range(60)] + ["x", "1", None, say("aa", 3000)]
    for t in texts:
        lang, share, langs = model.predict(t)
        assert (lang, share) == (by_hand(model, t)[0], pytest.approx(by_hand(model, t)[1], abs=1e-9))
    assert model.predict(" ".join(say(k, 60) for k in parts))[2].count(":") == 5
    twice = langid.fit(spark.createDataFrame(rows + rows, schema))
    assert (twice.prob.argmax(axis=1) == model.prob.argmax(axis=1)).all()


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 9000)
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    big, other = "x" * 1500, "é\r\n\r\n" * 400
    rows = [(i, f"http://h{i % 4}.example.com/{i}?q=é", big if i % 3 == 0 else other if i % 3 == 1 else f"small {i % 2}") for i in range(40)]
    rows += [(100, None, None), (101, "http://h1.example.com/1?q=é", ""), (39, rows[39][1], rows[39][2]), (None, "x:[", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark, "test-warc")
    warc.build_index(warc.write_archives(pages, folder), folder)
    places = warc.lookup(pages.select(warc.url_key_col("url").alias("key")), folder)
    got = warc.fetch(places, folder).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r["page_id"])
        raw = h.encode()
        again = len(raw) >= 1000 and r["page_id"] is not None and largest[h] != r["page_id"]
        assert (r["payload_digest"], r["payload_bytes"]) == (hashlib.sha1(raw).hexdigest(), len(raw))
        assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (largest[h] if again else None)
        assert again or bytes(r["payload"]) == raw
    one = warc.lookup(spark.createDataFrame([(warc.url_key("http://h1.example.com/1?q=é"),), ("none",), (None,)], "key string"), folder)
    assert one.count() == 2
    assert warc.url_key("HTTP://User@WWW.Example.com:80/a?b#c") == "com,example,www)/a?b"
    empty = shared_folder(spark, "test-warc")
    warc.build_index(warc.write_archives(pages.limit(0), empty), empty)
    assert warc.lookup(pages.select(F.col("url").alias("key")), empty).count() == 0


def test_block_span():
    keys = ["b", "d", "d", "f"]
    assert list(warc.block_span(keys, "d")) == [0, 1, 2] and list(warc.block_span(keys, "a")) == [] and list(warc.block_span(keys, "z")) == [3]


TOLD = "<p>The council met on Tuesday to discuss the new plan for the harbour, which has been delayed twice; members were divided.</p>"
MORE = "<p>Another paragraph goes on at some length about the weather, the boats, and what the mayor said: nothing at all.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=f><nav><a href=x>Home</a></nav><article><h1>Plan</h1>{TOLD}{MORE * 3}</article><footer>Copyright. All rights reserved.</footer></form></body>",
        f"<body><form id=f><div><h1>Plan</h1>{TOLD}{MORE * 3}</div><p><label>Name</label><input><button>Send</button></p></form></body>",
        f"<body><div class='page-with-sidebar'><h1>Plan</h1>{TOLD}{MORE * 3}</div><footer>Copyright.</footer></body>",
        f"<body><div class='no-ads'><h1>Plan</h1>{TOLD}{MORE * 3}</div></body>",
        f"<body><article><h1>Plan</h1>{TOLD}<section class='social'>{MORE * 3}</section></article><div class='social'><a href=x>Share this</a></div></body>",
        f"<body><article><h1>Plan</h1>{TOLD}{MORE * 3}</article><section class='discussion'>{TOLD.replace('council', 'reader')}</section><section class='user-reviews'>{TOLD.replace('council', 'reader')}</section></body>",
    ],
)
def test_wrappers_and_comments(page):
    text = main_text(page).split("\n")
    assert text[0] == "Plan" and len(text) == 5 and "reader" not in "".join(text)


def test_controls_inside_a_sentence_and_footers_alone():
    page = f"<article>{TOLD}<p>Press the <button>Enter</button> key to fill in the <label>Name</label> field, which is required.</p>{MORE}</article>"
    assert main_text(page).split("\n")[1] == "Press the Enter key to fill in the Name field, which is required."
    assert main_text("<nav><a href=x>Home</a></nav><footer>Copyright 2024 Foo Ltd. All rights reserved. Do not copy, please.</footer>") == ""
    assert main_text(f"<div>{TOLD}</div><div class='comments'>{MORE * 9}</div>").startswith("The council") and "Another" not in main_text(f"<div>{TOLD}</div><div class='comments'>{MORE * 9}</div>")


def test_many_unclosed_elements_take_linear_time():
    began = time.perf_counter()
    assert main_text(f"{TOLD}" + "<noscript>a " * 40000).startswith("The council")
    assert time.perf_counter() - began < 3
