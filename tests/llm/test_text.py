"""Language, tokens, pages and urls against brute force, libraries and hard inputs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece  # noqa: F401
import tiktoken
from pyspark.sql import functions as F

from dexspark.llm import byte_bpe, html_extract, language_id, registry, token_counts, url_filters
from tests.conftest import SMALL

DOCS = "doc_id long, text string"
HARD = [(1, None), (2, ""), (3, " \n "), (4, "12 34 --"), (5, "é" * 40_000), (5, "the the"), (None, "of the and")]
MIXED = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "😀", "1", "'s", "'", "the", "ing", "\x1c", "\x85", "\u2003", "\u200b", "\x00", "न", "्", "𝟘", "²", "_", "-", "," " .", "aaaa", "    "]


def mixed(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(MIXED) for _ in range(rng.randrange(40))) for _ in range(n)]


# Language


def by_hand(text, texts, order):
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        b = t.encode()
        for k in range(order + 1):
            for at in range(k, len(b)):
                seen[k][b[at - k : at]][b[at]] += 1
    b, bits = text.encode(), 0.0
    for at in range(len(b)):
        for k in range(min(order, at), -1, -1):
            counts = seen[k].get(b[at - k : at])
            if not counts:
                continue
            total, kinds = sum(counts.values()), len(counts)
            if b[at] in counts:
                bits -= math.log2(counts[b[at]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("chunk", [7, 1 << 17])
def test_code_lengths(spark, monkeypatch, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    own = {"en": ["hello there world", "the world is here"], "es": ["hola que tal"]}
    rows = [(k, t, lang) for lang, ts in own.items() for k, t in enumerate(ts)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["the hola où world", "", "xyz", "que hello"]
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    got = model.code_lengths(np.frombuffer(b"".join(data), dtype=np.uint8), bounds)
    want = [[by_hand(t, own[lang], 3) for lang in ("en", "es")] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = registry.op6_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.97 * got.count() > 0


def test_language_of_hard_inputs(spark):
    model = language_id.train(spark.createDataFrame([(1, "the cat", "en"), (2, None, "fr"), (3, "der", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(HARD, DOCS).selectExpr("*", "'q' as lang_pred", "'z' as lang", "1 as _text")
    got = language_id.identify(docs, model).collect()
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert len(got) == len(HARD)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert all(0 <= r.score <= 1 for r in got)
    none = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], DOCS), model).count() == 0


def lengths(model, texts):
    data = [t.encode() for t in texts]
    return model.code_lengths(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))


@pytest.mark.parametrize("counted", [7, 1 << 19])
def test_every_text_is_learned(spark, monkeypatch, counted):
    """More documents than the sample had, and a text longer than it took."""
    monkeypatch.setattr(language_id, "COUNTED", counted)
    long = "wort " * (60_000 if counted > 7 else 60)
    rows = [(k, f"{k} {k % 7} é", "en") for k in range(1500)] + [(2000, long, "de"), (2001, "", "de"), (2002, "x", "de"), (2003, "ab", "de"), (2004, "abc", "de")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    texts = ["1499 3 é", "ab word", "742", "x", "wort abc"]
    want = [[by_hand(t, [r[1] for r in rows if r[2] == lang], 3) for lang in ("de", "en")] for t in texts]
    assert np.allclose(lengths(model, texts), want, atol=1e-3)


@pytest.mark.parametrize("cells, languages", [(300, 64), (1 << 22, 1), (200, 2)])
def test_packs_change_nothing(spark, monkeypatch, cells, languages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("lang", F.concat("lang", (F.col("doc_id") % 2).cast("string"))).limit(120)
    texts = ["the word où", "", "Qué", "é"]
    whole, limits = language_id.train_bounded(docs)
    asked = docs.unionByName(spark.createDataFrame(HARD, DOCS), allowMissingColumns=True)
    want = sorted(map(repr, language_id.identify(asked, whole, ["doc_id", "text"], limits).drop("score").collect()))
    bits = lengths(whole, texts)
    monkeypatch.setattr(language_id, "CELLS", cells * 200)
    monkeypatch.setattr(language_id, "LANGUAGES", languages)
    cut, cut_limits = language_id.train_bounded(docs)
    assert len(whole.packs) == 1 < len(cut.packs) and whole.languages == cut.languages
    assert np.allclose(lengths(cut, texts), bits, atol=1e-3)
    assert cut_limits.keys() == limits.keys() and all(abs(cut_limits[k] - v) < 1e-4 for k, v in limits.items())
    assert sorted(map(repr, language_id.identify(asked, cut, ["doc_id", "text"], limits).drop("score").collect())) == want


def test_more_languages_than_a_pack_has(spark):
    rows = [(k, chr(0x4E00 + k // 2) * 4, f"l{k // 2:03d}") for k in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {r[0]: r[2] for r in rows}


def test_bounds_come_from_every_text(spark):
    """The spread of all texts of the other half, by numpy."""
    docs = spark.createDataFrame([(k, f"{k * k % 9973} the {k % 11}", "en") for k in range(2600)], "doc_id long, text string, lang string")
    _, limits = language_id.train_bounded(docs)
    halves = {True: [], False: []}
    for r in docs.select("text", (F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")) % 2 == 0).alias("half")).collect():
        halves[r.half].append(r.text)
    half = language_id.train(spark.createDataFrame([(k, t, "en") for k, t in enumerate(halves[True])], "doc_id long, text string, lang string"))
    cost = lengths(half, halves[False])[:, 0] / np.array([len(t) for t in halves[False]])
    middle, far = np.quantile(cost, [0.5, 0.99])
    assert abs(limits["en"] - min(language_id.PLAIN, middle + language_id.SPREADS * (far - middle))) < 1e-6


def test_sample_is_bounded(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    assert {r.lang: r["count"] for r in language_id.sampled(rows, 50).groupBy("lang").count().collect()} == {"a": 50, "b": 50}


# Byte pairs


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def machine(request):
    ranks = byte_bpe.load_ranks(public_tokenizers.path(request.param))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.Transducer(ranks, public_tokenizers.PATTERN), plain


def packed(plain, text):
    return np.array(plain.encode_ordinary(text), dtype="<u4").tobytes()


def test_ids_equal_the_library(machine):
    own, plain = machine
    for text in [*mixed(1, 800), "<|endoftext|>", "a" * 9000, "é" * 7000, "abcde" * 2000, " " * 5000, "".join(random.Random(2).choices("etaoin", k=12_000))]:
        assert own.encode(text) == packed(plain, text), text[:60]


def test_small_stores_change_nothing(machine, monkeypatch):
    own, plain = machine
    for name, size in (("STATES", 20), ("WORDS", 3), ("EMIT", 16)):
        monkeypatch.setattr(byte_bpe, name, size)
    for text in [*mixed(3), "internationalisation " * 20, "q" * 300]:
        assert own.encode(text) == packed(plain, text)


def test_decoding_in_chunks(machine):
    own, plain = machine
    for text in mixed(4):
        ids = own.encode(text)
        assert "".join(own.decode(ids[at : at + 4] for at in range(0, len(ids), 4))) == text
    half = np.array([own.ranks["é".encode()[:1]]], dtype="<u4").tobytes()
    assert "".join(own.decode([half])) == "\ufffd"


def test_rows_of_tokens(spark):
    path = public_tokenizers.path(registry.RANKS)
    docs = spark.createDataFrame(HARD, DOCS).selectExpr("*", "'q' as ids", "1 as decoded")
    got = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    assert sorted(repr((r.doc_id, r.decoded)) for r in got.collect()) == sorted(repr((d, t or "")) for d, t in HARD)
    back = byte_bpe.decode(got.select("doc_id", "ids"), path, public_tokenizers.PATTERN)
    assert sorted(repr((r.doc_id, r.decoded)) for r in back.collect()) == sorted(repr((d, t or "")) for d, t in HARD)
    assert byte_bpe.encode(spark.createDataFrame([], DOCS), path, public_tokenizers.PATTERN).count() == 0


def test_every_code_point_is_split_as_the_library_does():
    path = public_tokenizers.path(registry.RANKS)
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = byte_bpe.Transducer(ranks, public_tokenizers.PATTERN)
    for at in range(0, 0x110000, 512):
        if 0xD800 <= at < 0xE000:
            continue
        text = "".join(f"{c} {c}'s a{c}1{c}" for c in map(chr, range(at, at + 512)))
        if np.frombuffer(machine.encode(text), dtype="<u4").tolist() != library.encode_ordinary(text):
            for c in map(chr, range(at, at + 512)):
                for one in (c, f"{c}'s", f" {c}'s", f"a{c}", f"1{c} a"):
                    assert np.frombuffer(machine.encode(one), dtype="<u4").tolist() == library.encode_ordinary(one), (hex(ord(c)), one)
            raise AssertionError(hex(at))


# Token counts


def test_counts_equal_the_library():
    """The tokenizers library's unigram model over the same scores."""
    from tokenizers import Tokenizer, models

    scores, byte = token_counts.load_scores(public_tokenizers.path(registry.PIECES))
    vocabulary = [("<unk>", -1000.0), *scores.items()]
    plain = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    trie = token_counts.Trie(scores, byte)
    rng = random.Random(1)
    words = ["international", "unbelievable", "straße", "the", "a", "transducer", "xqzzy", "naïve"] + ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 20))) for _ in range(400)]
    for word in words:
        want = len(plain.encode(token_counts.START + word).ids)
        assert trie.total(word) == want, word


def slow_count(scores, byte, word):
    text = token_counts.START + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        found = [(best[-1][0] + size * byte, -(best[-1][1] + size))]
        found += [(best[at][0] + scores[text[at:end]], -(best[at][1] + 1)) for at in range(end) if text[at:end] in scores]
        score, tokens = max(found)
        best.append((score, -tokens))
    return best[-1][1]


def test_counts_of_all_words(monkeypatch):
    scores, byte = token_counts.load_scores(public_tokenizers.path(registry.PIECES))
    trie = token_counts.Trie(scores, byte)
    monkeypatch.setattr(token_counts, "NODES", 500)
    for text in mixed(5) + ["漢字" * 50, "a" * 200, "🙂"]:
        assert trie.total(text) == sum(slow_count(scores, byte, w) for w in text.split())


def test_rows_of_counts(spark):
    docs = spark.createDataFrame(HARD, DOCS).selectExpr("*", "'q' as n_tokens")
    got = token_counts.count_tokens(docs, public_tokenizers.path(registry.PIECES)).collect()
    assert len(got) == len(HARD) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}


# Pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/">home</a></li></ul></nav><div class="cookie-notice">we use <b>cookies</b></div><!-- ad <p>x</p> --><div class="ad">buy</div>
<article class="post-17"><h1>A &amp; B</h1><p><b>one   two<br><p>three&nbsp;&#233;</p><aside>skip</aside><p>four <i>five</i>, <a href='x>y'>six</a></p><form>f<input></form>
<section class="comments"><p>first!</p></section></article><div id="sidebar">q</div><footer>&copy; z</footer>"""


def test_article_without_frames():
    assert html_extract.extract(PAGE, None) == "A & B\none two\nthree é\nfour five, six"
    path = "/html/body/article.post-#"
    assert path in html_extract.votes(PAGE)
    assert html_extract.extract(PAGE, path) == html_extract.extract(PAGE, None)


def test_path_of_the_host_wins(spark):
    """A page whose comments are longer than its text still gives its text."""
    def page(text, extra):
        return f"<body><div class='c1'><p>{text}</p></div><div class='x2'><p>{extra}</p></div></body>"

    rows = [(k, "http://h.org/a", page("long text " * 30, "short")) for k in range(5)] + [(9, "http://h.org/b", page("tiny", "much longer side text " * 5)), (10, None, None), (11, "http://z/", ""), (12, "bad", "plain < text & more")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as path", "2 as host", "3 as text")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert got[9] == "tiny" and got[10] == got[11] == "" and got[12] == "plain < text & more"
    assert len(got) == len(rows)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_text_in_several_containers(spark):
    frames = "<nav><a href=/>Home</a></nav>{}<footer>About this site</footer>"
    split = frames.format("<div class=post><h1><a href=/x>Title {0}</a></h1><div class=lead>The lead of this story number {0}.</div><div class=text><p>" + "Long text here. " * 20 + "</p></div></div>")
    twice = frames.format("<section><div class=part>" + "First part. " * 20 + "</div><p><a href=/>more</a></p><div class=part>" + "Second part. " * 15 + "</div></section>")
    rows = [(k, "http://a.com/x", split.format(k)) for k in range(4)] + [(9, "http://a.com/y", twice)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert got[k] == f"Title {k}\nThe lead of this story number {k}.\n" + ("Long text here. " * 20).strip()
    assert "First part." in got[9] and "Second part." in got[9]
    assert "About" not in "".join(got.values()) and "Home" not in "".join(got.values())


def test_frames_that_hold_the_text():
    text = "Long text here. " * 20
    body = f"<h1>Title</h1><p>{text}</p>"
    want = f"Title\n{text.strip()}"
    around = "<nav><a href=/>Home</a></nav>{}<footer>About this site</footer>"
    for one in ("<div class='layout has-sidebar'>{}</div>", "<div class='no-comments'>{}</div>", "<div class='with-header'>{}</div>", "<form action=/>{}</form>", "<div id='search'>{}</div>",
                "<div class='sidebar-left'><article>{}</article></div>", "<aside><main>{}</main></aside>", "<article class='post has-comments'>{}</article>"):
        assert html_extract.extract(around.format(one.format(body)), None) == want, one
    for title in ("<div class=article-header><h1>Title</h1></div>", "<h1 class=page-header>Title</h1>", "<header class=entry-header><h1>Title</h1></header>"):
        assert html_extract.extract(around.format(f"<div class=post>{title}<p>{text}</p></div>"), None) == want, title
    assert html_extract.extract(f"<div class=post><p>{text}<span class=menu-price>5 coins</span></p></div>", None) == text + "5 coins"
    for frame in ("<div class=sidebar>side</div>", "<div class='site-header'>side</div>", f"<div class=comments><p>{text * 9}</p></div>", "<aside><article>side</article></aside>", "<span class=share>side</span>",
                  f"<div class=related-posts><article>{text[:99]}</article></div>", "<form>side</form>"):
        assert html_extract.extract(around.format(f"<div class=post>{body}{frame}</div>"), None) == want, frame


def test_names_that_only_sound_like_frames():
    keep = "<article><h1>T</h1><div class='share-price'><p>The share price rose.</p></div><section class='widget'><p>A widget.</p></section><p>x <math><mi>y</mi></math></p></article>"
    assert html_extract.extract(keep, None) == "T\nThe share price rose.\nA widget.\nx y"
    drop = "<article><h1>T</h1><p>text</p><div class='share-buttons'>s</div><div id='ad-slot-3'>a</div><div class='post-comments-list'>c</div></article>"
    assert html_extract.extract(drop, None) == "T\ntext"


TALK = {"en": ("The text of report {0} is a long one. ", "Copper prices rose in week {0}.", "Follow us and share this story.", "Ann", "I do not agree."),
        "de": ("Der Text des Berichts {0} ist lang. ", "Der Preis stieg in Woche {0}.", "Folgen Sie uns und teilen Sie den Beitrag.", "Uwe", "Das sehe ich anders.")}


@pytest.mark.parametrize("lang", TALK)
def test_frames_that_a_host_repeats(spark, lang):
    """One name is a frame on a host that repeats its text, and text on one that does not; names of no known word too."""
    long, short, again, _, _ = TALK[lang]

    def page(k, box):
        tags = "".join(f"<a href=/t/{k}{x}>topic {x}{k}</a> " for x in "abc")
        return f"<body><article><h1>T{k}</h1><div class=zz9>{box}</div><p>{long.format(k) * 9}</p><div class=yy>{tags}</div></article></body>"

    rows = [(k, "http://a.org/x", page(k, again)) for k in range(6)]
    rows += [(k, "http://b.org/x", page(k, short.format(k))) for k in range(10, 16)]
    rows += [(k, "http://c.org/x", page(7, again)) for k in range(20, 26)]  # copies of one page
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == f"T{k}\n{(long.format(k) * 9).strip()}"
        assert got[10 + k] == f"T{10 + k}\n{short.format(10 + k)}\n{(long.format(10 + k) * 9).strip()}"
        assert again in got[20 + k]
        assert got[k] != html_extract.extract(rows[k][2], None)


@pytest.mark.parametrize("lang", TALK)
def test_frames_by_structure(lang):
    long, short, _, who, says = TALK[lang]
    body = f"<h1>T</h1><p>{long * 9}</p>"
    want = f"T\n{(long * 9).strip()}"
    item = f"<b>{who}</b> <time>3.5.</time><p>{says}</p>"
    teaser = f"<article><h2><a href=/y>{short}</a></h2><p>{says}</p></article>"
    for frame in ("<div hidden>x</div>", "<p style='color:red; display: none'>x</p>", "<div style=display:none>x</div>", f"<div class=responses><div>{item}</div><div>{item}</div></div>",
                  f"<div id=discussion><ul><li>{item}<li>{item}</ul></div>", f"<h2 id=k>{says}</h2><ol><li>{item}</li><li>{item}</li></ol>"):
        assert html_extract.extract(f"<body><article>{body}{frame}</article></body>", None) == want, frame
    assert html_extract.extract(f"<body><main><article>{body}</article><section class=w>{teaser * 3}</section></main></body>", None) == want
    for kept in ("<div class=notice>{}</div>", "<section class='related work'><p>{}</p></section>", "<div class=social>{}</div>", "<ul><li><time>1990</time> {}</li></ul>", "<div><p><time>1</time></p><p><time>2</time> {}</p></div>"):
        assert short in html_extract.extract(f"<body><article>{body}{kept.format(short)}</article></body>", None), kept
    entries = "".join(f"<div><time>{k}:00</time><p>{long}</p></div>" for k in range(9))
    assert html_extract.extract(f"<body><article><h1>T</h1><div>{entries}</div></article></body>", None).count("\n") >= 17


def simple_votes(html):
    """By an own small tree of a page whose tags all match: a path's worth is its text, with the weight of articles."""
    out, stack, sizes = Counter(), [("", [])], []
    for tag, close, text in re.findall(r"<(/?)(\w+)>|([^<]+)", html):
        if text:
            sizes.append((len(text), [n for n, _ in stack]))
        elif tag:
            stack.pop()
        else:
            stack.append((f"{stack[-1][0]}/{close}", close))
    for size, paths in sizes:
        for path in paths[1:]:
            out[path] += size * {"article": 5, "main": 4}.get(path.rsplit("/", 1)[1], 1)
    top = stack[0][0]
    return {p: float(v) for p, v in out.items() if p != top}


def test_winner_of_a_host_equals_a_plain_count(spark):
    rng = random.Random(8)
    tags = ["div", "section", "article"]
    rows, sums = [], {}
    for k in range(60):
        host = rng.choice(["a.com", "B.com", "c.d.com"])
        parts = "".join(f"<{x}><p>{'w' * rng.randrange(5, 60)}</p></{x}>" for x in rng.choices(tags, k=rng.randrange(1, 4)))
        html = f"<div>{parts}</div>"
        rows.append((k, f"http://{host}/p?q#{k}", html))
        for path, worth in html_extract.votes(html).items():
            sums.setdefault(host.lower(), Counter())[path] += worth
        plain = {p: v for p, v in simple_votes(html).items() if not p.endswith("/p")}
        own = html_extract.votes(html)
        assert {p: v for p, v in own.items() if p} == plain
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {h: max(s, key=lambda p: (s[p], len(p), p)) for h, s in sums.items()}
    assert {r.host: r.path for r in html_extract.winning_paths(pages).collect()} == want
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    for k, url, html in rows:
        assert got[k] == html_extract.extract(html, want[url.split("/")[2].lower()])


def test_pages_are_dealt_where_paths_are_many(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/", PAGE), (1, "http://a.com/", PAGE), (2, None, PAGE), (3, "x", None)], "page_id long, url string, html string")
    want = sorted(map(repr, html_extract.main_text(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST", -1)
    assert sorted(map(repr, html_extract.main_text(pages).collect())) == want and len(want) == 4


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<table>" + "<tr><td>x</td></tr>" * 50_000 + "</table>", "<b><div>" + "<i>x" * 30_000 + "</b>" * 30_000, "<form><article>x" * 20_000])
def test_long_and_deep_pages(page):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.process_time()
    read = html_extract.Page(page)
    votes = read.votes()
    text = read.extract(max(votes, key=votes.get, default=None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.replace("\n", "").strip("x") == "" and "x" in text
    assert peak < 150e6 and time.process_time() - began < 60


def test_broken_pages_do_not_fail():
    rng = random.Random(3)
    bits = ["<p", "<p>", "</p>", "<div class='", '"', ">", "text", "&amp", "&#x41;", "<!--", "-->", "<b>", "</div>", "<td>", "</table>", "<script>", "</script>", "<a href=x>", "<![CDATA[", "]]>", "<", " "]
    for _ in range(500):
        page = "".join(rng.choices(bits, k=30))
        html_extract.extract(page, "/div")
        html_extract.votes(page)


# Urls


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
            best = rule, verdict
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_urls_equal_every_rule_tried(spark):
    rng = random.Random(6)
    labels, tails = ["com", "net", "a", "b", "www", "exa-mple", "A"], ["", "/", "/en", "/en/", "/en/x", "/es/y/z", "?q=/en/", "#f", "/en/?a#b"]
    hosts = [".".join(rng.choices(labels, k=rng.randrange(1, 5))) for _ in range(80)]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(600)] + [None, "", "nothing", "://", "http://", "http:///en/", "x://com:80/en/", "http://com./en/"]
    rules = sorted({f"{rng.choice(hosts).lower()}{rng.choice(['/', '/en/', '/es/', ''])}" for _ in range(40)} | set(registry.RULES))
    rules = [(r, rng.choice(["allow", "block"])) for r in rules]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'k' as key", "1 as stack", "2 as part")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}


def test_equally_long_rules_go_by_the_alphabet(spark):
    rules = spark.createDataFrame([("z.com/", "block"), ("com/en", "allow"), ("y.z.com", "block")], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://z.com/en"), (2, "http://y.z.com/en")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_filters.judge(pages, rules).collect()} == {1: "z.com/", 2: "y.z.com"}


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filters.judge(pages, none).collect()] == [(1, "a.com", "/", None, "allow")] * 2
    assert url_filters.judge(pages.limit(0), spark.createDataFrame([("com/", "block")], none.schema)).count() == 0


def test_token_counts_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(empty, public_tokenizers.path(registry.PIECES))
    assert got.columns == ["doc_id", "n_tokens"] and got.count() == 0


def test_sample_of_languages_is_ranked_by_id(spark):
    rows = [(k, "en" if k % 3 else "de", f"text {k}") for k in range(200)] + [(7, "en", "text 7"), (300, None, "x"), (301, "en", None), (None, "en", "x"), (302, "en", "x" * (language_id.LONGEST + 1))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    want = {}
    for r in sorted((r for r in docs.collect() if r.doc_id is not None and r.doc_id < 300), key=lambda r: (r.h, r.doc_id)):
        want.setdefault(r.lang, []).append(r.doc_id)
    want = {k: list(dict.fromkeys(v[:20])) for k, v in want.items()}
    got = {}
    for r in language_id.sampled(docs.drop("h"), 20).collect():
        got.setdefault(r.lang, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
