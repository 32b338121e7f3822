"""HTML, BPE, chat, language and toxicity: round trips, brute force, held-out accuracy, edges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemine.llm import bpe, chat, html, langid, toxicity
from lodemine.llm.common import read

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, now!</div>
<div class="sidebar"><p>A long side text, with commas, and stops. Really long, in fact, as sides go.</p></div>
<article><h1>Head &amp; shoulders</h1><p><b>First   para,<br>with&nbsp;a break.<br><p>Second <i>pa</i>ra &lt;ok&gt;.</p><ul><li>one<li>two</ul><p>End.</p></article>
<div id="comments"><p>Great article, I liked it, thanks a lot for writing it!</p></div><form><p>Subscribe</p></form><footer>&copy; us</footer></body></html>"""
WANT = "Head & shoulders\n\nFirst para, with a break.\n\nSecond para <ok>.\n\none\n\ntwo\n\nEnd."


@pytest.mark.parametrize(
    "page, want",
    [
        (PAGE, WANT),
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<nav>only a menu</nav>", ""),
        ("plain text, without any markup at all.", "plain text, without any markup at all."),
        (PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>"), WANT),
        ("<body><article><p>cut &amp; gone</p><p>half <b>a tag</b></p><p cla", "cut & gone\n\nhalf a tag"),
        ("<article><p>1 < 2 &am</p></article>", "1 < 2 &am"),
        ('<div class="layout has-sidebar"><div class="page"><p>Wrapped, but the text.</p></div></div>', "Wrapped, but the text."),
        ('<div class="menu-wrap"><main><p>In main, all the same.</p></main></div>', "In main, all the same."),
        ('<main><article><p>The story, told here.</p></article><article class="comment"><p>I say, what a story, told here!</p></article></main>', "The story, told here."),
        ('<body><p title="a hidden gem" data-hidden="no">Seen, by all.</p><p hidden>Not seen.</p><p class=ad>Buy.</p></body>', "Seen, by all."),
        ('<body><p class="cookieNotice">We use cookies, as all do.</p><p>Text, and so on.</p></body>', "Text, and so on."),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p class="a"">Hello, world of quotes.</p>', "Hello, world of quotes."),
        ("<p>One, two.</p><p title=don't>Three, four.</p>", "One, two.\n\nThree, four."),
        ("<p title='never closed>One, two.</p><p>Three, four.</p>", "One, two.\n\nThree, four."),
        ("<p a = \"x > y\" b='<i>'>One, two.</p>", "One, two."),
        ("<article><p>One.</p></b></i></span><p>Two.</p></article>", "One.\n\nTwo."),
        ("<article><p>One, two.<div>Three.</p>Four.</article>", "One, two.\n\nThree.\n\nFour."),
        ("<article><p class=comment>My own comment, at length, on what they said.</p><p id=the-notice>A notice, too, is part of it.</p><p>x</p></article>", "My own comment, at length, on what they said.\n\nA notice, too, is part of it.\n\nx"),
        ("<article><p>Short, but it.</p></article><div class=ad><p>" + "Buy it, now, here. " * 30 + "</p></div>", "Short, but it."),
        ("<article></article><div class=ad>Buy, now.</div>", ""),
        ("<script>if (a < b) { '<p>' }</script><p>Text, as it is.</p><!-- <p>no</p>", "Text, as it is."),
    ],
)
def test_malformed_and_marked_pages(page, want):
    assert html.main_text(page) == want


LONG = "A sentence of the article, which has a few commas, and goes on for a while."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form><article><p>{LONG}</p></article></form></body>", [LONG]),
        (f"<form id=f><nav>menu</nav><label>Name <input></label><main><h1>Head</h1><p>{LONG}</p><button>Send</button><fieldset><legend>l</legend><p>field</p></fieldset></main></form>", ["Head", LONG]),
        (f"<body><form><div><p>{LONG}</p><p>{LONG}</p><select><option>x</option></select></div></form></body>", [LONG, LONG]),
        (f"<body><form><div>{LONG}</div></form></body>", [LONG]),
        (f"<body><article><p>short.</p></article><form><p>{LONG}</p></form></body>", ["short."]),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><form><p>Write to us, please, and tell us who you are.</p></form></body>", [LONG, LONG]),
        (f"<form><article class=comment><p>mine</p></article></form><main><p>{LONG}</p></main>", [LONG]),
        (f"<form><form><article><p>{LONG}</p></article></form></form>", [LONG]),
        ("<form></form>", []),
    ],
)
def test_forms_around_the_page_are_read(page, want):
    assert html.main_text(page) == "\n\n".join(want)


def test_ratios_decide(monkeypatch):
    part = "A long part of the story, told at length, with all its turns; and more, as it goes. " * 3
    links = "".join(f"<li>Link {i}</li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2><p>{part}</p><p>{part}</p><p>Short.</p></div><div><span>Top</span><span>Back</span></div></body>"
    want = ["Head", part.strip(), part.strip(), "Short."]
    assert html.main_text(page).split("\n\n") == want
    monkeypatch.setattr(html, "content_paths", lambda blocks, paths, weights, share: set(paths))
    assert html.main_text(page).split("\n\n") != want


@pytest.mark.parametrize("page", ["<article>" + "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<article>" + "<b>" * 50_000 + "deep" + "<p>x</i>" * 50_000, "<p>deep</p>" * 100_000, '<p a="' * 100_000 + '">deep, at last'])
def test_pages_take_linear_time(page):
    import time

    began = time.process_time()
    assert "deep" in html.main_text(page)
    assert time.process_time() - began < 10


def test_random_pages_give_the_article_they_were_made_of():
    rng = random.Random(5)
    some = lambda a, b: " ".join(rng.choice(["the", "story,", "went", "on.", "and", "so; it", "was"]) for _ in range(rng.randint(a, b)))
    boiler = [
        lambda: f"<nav><ul>{'<li>menu'  * 5}</ul></nav>",
        lambda: f'<div class="ad">{some(3, 40)}</div>',
        lambda: f'<div id="sidebar"><p>{some(5, 40)}</p></div>',
        lambda: f"<aside><p>{some(5, 60)}</aside>",
        lambda: f'<form><p>{some(2, 9)}<input name=q><button>Go</button></form>',
        lambda: f'<div class="cookie-notice">{some(4, 20)}</div>',
        lambda: f'<section class="comments"><article class="comment"><p>{some(5, 60)}</p></article></section>',
        lambda: f"<script>{some(2, 5)}</script>",
    ]
    for k in range(300):
        blocks = [some(2, 5)] + [some(20, 80) for _ in range(rng.randint(2, 6))]
        blocks.insert(2, some(1, 3))
        inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}{rng.choice(['</p>', ''])}" for b in blocks[1:])
        tag = rng.choice(['article', 'main', 'div class="post"'])
        parts = [f"<{tag}>{inner}</{tag.split()[0]}>"] + [rng.choice(boiler)() for _ in range(rng.randint(0, 5))]
        rng.shuffle(parts)
        page = f"<html><head><title>t</title></head><body><header><h2>{some(1, 3)}</h2></header>{''.join(parts)}<footer>{some(2, 9)}</footer></body></html>"
        assert html.main_text(page).split("\n\n") == blocks, page


def test_html_rows(spark, sf):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df.select("page_id", "url", "html")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0)]
    assert html.extract(df.limit(0)).count() == 0
    assert html.op1_html(spark, sf).count() == read(spark, sf, "pages").count()


# -- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", " ", "a" * 3000, "ΣΑΣ ΟΔΟΣ Σ", "İstanbul é \x1c\x1d x\x85y\xa0z", "<|endoftext|> hi<|startoftext|>x", "don't I'LL 'S ''s", "日本語テキスト🙂🙂", "a　b", "ǅ ß ẞ ﬀ ①½", "x\x00y", "é é"]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_ids_are_those_of_the_library(library, block):
    rng = random.Random(block)
    model = bpe.BpeModel(bpe.tokenizer_path(), block=block)
    texts = ODD + ["".join(rng.choice(["the", "in", "ing", "tion", "an", "er", "haha", "!!", "é", "0"]) for _ in range(rng.randint(1, 900))) for _ in range(25)]
    texts += ["".join(rng.choice("abcdefgh inst'<>|!éü 0\n") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert model.encode_ids(t) == want
        d = bpe.Decoder(model)
        assert "".join(d.feed(i) for i in want) + d.close() == library.decode(want, skip_special_tokens=False)


def through(model, word, size=10**9):
    """Tokens of a word that comes in parts, and the longest buffer that was needed."""
    tr, out, longest = bpe.Transducer(model), [], 0
    for i in range(0, len(word), size):
        out += tr.push(model.symbols(word[i : i + size]))
        longest = max(longest, len(tr.buffer))
    return out + tr.end(), longest


def test_stream_of_symbols_equals_the_whole():
    model = bpe.BpeModel(bpe.tokenizer_path(), block=1)
    rng = random.Random(3)
    for _ in range(30):
        word = "".join(rng.choice(["inter", "nation", "al", "iz", "ation", "s", "th", "e"]) for _ in range(120))
        whole = model.symbols(word)
        whole[-1] = model.last_of[whole[-1]]
        got, longest = through(model, word, rng.randint(1, 50))
        assert got == model.merge(whole) and longest <= model.lookahead + 60


def test_every_word_goes_through_the_transducer(library, monkeypatch):
    model, seen = bpe.BpeModel(bpe.tokenizer_path()), []
    end = bpe.Transducer.end
    monkeypatch.setattr(bpe.Transducer, "end", lambda self: seen.append(1) or end(self))
    text = "Every word's done, once: naïve 日本 12 !?"
    assert model.encode_ids(text) == library.encode(text, add_special_tokens=False).ids
    assert len(seen) == len({w for w in model.words.findall(model.normalize(text))})


@pytest.mark.parametrize("lump", [1, 2, 3, 5, 64])
def test_pieces_of_any_size_give_the_same_ids(library, lump):
    rng = random.Random(lump)
    parts = ["a", "it's", "'", "'r", "'re", "'ll", "ll", "!", "12", "é", "e\u0301", "\u1100", "\u1161", "\u11a8", "각", "Σ", "İ", "日本", "🙂", "<|endoftext|>", "<|end", "oftext|>", "\u0558", "\U000323b0", "\ua7cb", "\u0315\u0300", "\u09c7", "\u09be", "x" * 70]
    for k in range(250):
        text = "".join(rng.choice(parts + [" "] * (k % 3)) for _ in range(rng.randint(1, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        got = [i for g in bpe.BpeModel.encode(MODEL, text, lump) for _, ids in g for i in ids]
        assert got == want, text


MODEL = bpe.BpeModel(bpe.tokenizer_path())


def test_single_code_points_are_classed_as_by_the_library(library):
    rng = random.Random(8)
    some = [*range(0x80, 0x3000), *rng.sample(range(0x3000, 0xD800), 3000), *range(0xA700, 0xAC00), *range(0x10D00, 0x10F00), *rng.sample(range(0xE000, 0x110000), 6000), 0x323B0, 0x33479]
    texts = [f"a{chr(c)}1!{chr(c)}" for c in some]
    for text, got in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert MODEL.encode_ids(text) == got.ids, ascii(text)


@pytest.mark.parametrize("unit", ["internationalization", "日本語", "ab!?", "é'ré"])
def test_a_long_text_without_white_space_takes_flat_memory(unit):
    import tracemalloc

    def peak(text):
        list(MODEL.encode(text[:9_000], 2048))
        tracemalloc.start()
        n = sum(len(ids) for got in MODEL.encode(text, 2048) for _, ids in got)
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return n, most

    short, long = peak(unit * (60_000 // len(unit))), peak(unit * (300_000 // len(unit)))
    assert long[0] > 4 * short[0] and long[1] < 1.2 * short[1] + 50_000


def test_text_decoder_holds_back_partial_bytes():
    model = bpe.BpeModel(bpe.tokenizer_path())
    d = bpe.Decoder(model, as_pieces=False)
    text = "naïve 日本 🙂 ok"
    out = [d.feed(i) for i in model.encode_ids(text)]
    assert ("".join(out) + d.close()).strip() == text and all("�" not in x for x in out)


def test_bpe_rows(spark, sf, library):
    got = bpe.op9_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, 5), (1, "hi", 5), (1, "hi", 5)], "doc_id long, text string, n_tokens long")
    back = bpe.decode(bpe.encode(odd)).collect()
    assert [(r.token_ids, r.decoded) for r in back] == [([], ""), (library.encode("hi", add_special_tokens=False).ids, "hi</w>")] + [(back[1].token_ids, "hi</w>")]
    assert bpe.encode_digests(odd.limit(0)).count() == 0
    assert bpe.encode_digests(odd).columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]


# -- chat


def test_template_round_trip():
    t, rng = chat.InstTemplate(), random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "]", " ", "a", "\n", "<", "[ROLE x]", "[/ROLE]", "/", "s>"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "a]b\\", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        spans, rewrites = chat.locate_spans(turns, t)
        assert rewrites is None and "".join(s.text for s in spans) == t(turns)
        assert [t.parse(s.text)[:2] for s in spans] == turns


def test_templates_that_rewrite_history():
    assert chat.locate_spans([("user", "a"), ("user", "b")], lambda turns: "".join(x for _, x in turns[-1:])) == ([], 1)
    assert chat.locate_spans([("user", "a")], lambda turns: str(len(turns)))[1] == 0


def test_window_gives_the_same_spans():
    turns = [("user" if i % 2 else "assistant", f"t{i}" * (i % 5)) for i in range(50)]
    assert chat.locate_spans(turns, chat.InstTemplate(), 3) == chat.locate_spans(turns, chat.InstTemplate())


def test_a_window_is_refused_where_the_template_looks_back():
    numbered = lambda turns: "".join(f"[{k}]{t}" for k, (_, t) in enumerate(turns))
    with pytest.raises(ValueError, match="looks back"):
        chat.locate_spans([("user", "x")] * 9, numbered, 4)
    assert len(chat.locate_spans([("user", "x")] * 9, numbered)[0]) == 9


def test_a_long_conversation_takes_linear_time(spark):
    import time

    turns = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(20_000)]
    began = time.process_time()
    spans, _ = chat.locate_spans(turns, chat.InstTemplate(), 64)
    assert time.process_time() - began < 30 and len(spans) == 20_000
    assert "".join(s.text for s in spans) == chat.InstTemplate()(turns)


def test_chat_rows(spark, sf):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (2, 0, None, None, 0), (None, None, "assistant", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns long")
    got = {r.conv_id: r for r in chat.format_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].loss_chars == 1
    assert got[1].formatted_chars == len("<s>[INST] a [/INST] b</s>")
    assert got[2].n_turns == 2 and got[2].turns_sha256 == sha("\n\n\n\n") and got[None].loss_chars == 1
    assert chat.format_digests(df.limit(0)).count() == 0
    turns = chat.format_turns(df).filter("conv_id = 1").orderBy("position").collect()
    assert [(r.start, r.end, r.loss_start, r.loss_end) for r in turns] == [(0, 19, None, None), (19, 25, 20, 21)]
    own = chat.op10_chat(spark, sf).filter("conv_id = -1").first()
    assert own.n_turns == 2 and own.loss_chars == len("</s>[INST] ok [/INST]")


def test_large_ids_beside_a_null_one(spark):
    big = [2**60 + 1, 2**60 + 2, -(2**62) - 1, None]
    rows = [(c, k, "user" if k % 2 else "assistant", f"{c} {k}") for c in big for k in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    got = chat.format_digests(df)
    assert got.schema["conv_id"].dataType.simpleString() == "bigint"
    assert {r.conv_id: r.n_turns for r in got.collect()} == dict.fromkeys(big, 2)
    turns = chat.format_turns(df).collect()
    assert sorted(str(r.conv_id) for r in turns) == sorted(str(c) for c in big * 2)


# -- language


def test_langid_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op7_langid(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_langid_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the bird", "en"), ("die maus", "de")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !?", 1), (4, "the dog", 1), (4, "the dog", 1), (5, "die katze " * 20000, 1)], "doc_id long, text string, score int")
    got = langid.identify(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de"]
    assert [r.score for r in got[:3]] == [0, 0, 0]
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_rare_languages_and_clashing_names(spark):
    rows = [(i, f"wort{i % 3} ding sache", "de") for i in range(6)] + [(10 + i, "the cat and dog", "en") for i in range(4)] + [(20, "le chat", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(set(langid.fit(docs, most_languages=2).langs)) == ["de", "en"]
    assert sorted(set(langid.fit(docs).langs)) == ["de", "en", "fr"]
    odd = docs.withColumn("_p", F.lit("mine")).withColumn("_bpe", F.lit(7))
    assert {r._p for r in langid.identify(odd, langid.fit(docs)).collect()} == {"mine"}
    assert {r._bpe for r in bpe.encode(odd).collect()} == {7}


def test_counts_do_not_depend_on_blocks():
    text = "Größe und straße, l'été 12" * 50
    assert (langid.counts(text) == langid.counts(text, block=17)).all()


# -- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels")
    docs = read(spark, sf, "documents").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    model = toxicity.fit(docs, labels.filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0"))
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    held = got[[__import__("zlib").crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    toxic, clean = held[held.toxic == 1].score, held[held.toxic == 0].score
    auc = np.mean([(clean < s).mean() + 0.5 * (clean == s).mean() for s in toxic])
    assert auc > 0.93 and (clean >= 0.5).mean() < 0.02
    assert model.score("you are such an idioot and a mooron, what an idiiot") > model.score("what a lovely day in the park it is today, my friend")


def test_folded_score_is_that_of_the_softmax():
    rng = random.Random(4)
    words = ["idiot", "moron", "stupid", "table", "river", "house", "garden", "idiots", "paper"]
    texts = [" ".join(rng.choice(words[3:7] + words[8:] if i % 2 else words) for _ in range(30)) + (" you idiot moron" if i % 2 == 0 else "") for i in range(300)]
    m = toxicity.SubwordBags(buckets=1 << 12).fit(texts, [1 - i % 2 for i in range(300)], folds=0)
    e, w, b = m.layers

    def softmax(text):
        found = toxicity.words(text)
        found = [x for i, x in enumerate(found) if not i or x != found[i - 1]]
        n, best = m.window, -np.inf
        for i in range(max(1, len(found) - n + 1)):
            bag = sum((e[m.grams(x)].mean(0) for x in found[i : i + n]), np.zeros(m.dim)) / n
            z = bag @ w + b
            best = max(best, np.exp(z[1]) / np.exp(z).sum())
        return best

    for text in [*texts[:40], "", "idiiot", "moron moron idiot", "one"]:
        assert m.score(text) == pytest.approx(softmax(text), abs=1e-4)


def test_the_sample_is_bounded_before_it_is_collected(spark):
    docs = spark.createDataFrame([(i, ("bad awful " if i % 2 else "good nice ") * 10) for i in range(60)] + [(1, "zz")] * 40 + [(500, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(500, 1)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.SubwordBags.fit
    try:
        toxicity.SubwordBags.fit = lambda self, texts, classes, *a, **o: seen.append((texts, classes)) or fit(self, texts, classes, *a, **o)
        toxicity.fit(docs, labels, max_chars=3000)
    finally:
        toxicity.SubwordBags.fit = fit
    texts, classes = seen[0]
    assert sum(map(len, texts)) <= 3000 and len(texts) == len(classes) >= 20 and "zz" not in texts


def test_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, sf).filter("held_out").join(read(spark, sf, "labels"), "doc_id").toPandas()
    assert got[got.toxic == 1].predicted.mean() >= 0.9 and got[got.toxic == 0].predicted.mean() <= 0.02


def test_nearest_centroid_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    df, n = langid.document_frequencies(docs)
    texts = [r.text or "" for r in docs.collect()]
    grams = [langid.counts(t) for t in texts]
    assert n == len(texts) and (df == sum((g > 0).astype(int) for g in grams)).all()
    model = langid.fit(docs)
    for t, g in zip(texts, grams):
        v = np.log1p(g.astype(float)) * model.idf
        cos = [float(c @ v / (np.linalg.norm(c) * np.linalg.norm(v) or 1)) for c in model.matrix.astype(float)]
        lang, score, _ = model.predict(t)
        if lang != "und":
            assert score == pytest.approx(max(cos), abs=1e-4)
            assert max(c for c, k in zip(cos, model.of) if model.langs[k] == lang) >= max(cos) - 1e-4


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "bad awful horrid" if i % 2 else "good nice fine", 1) for i in range(40)] + [(40, None, 1), (41, "", 1), (None, "good", 1)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 40)
    assert len({r.score for r in got if r.doc_id in (40, 41)}) == 1
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert model.score("good nice fine " * 30000 + "bad awful horrid bad awful horrid bad awful") > 0.5


def test_sample_by_hash(spark):
    from lodemine.llm.common import sample_by_hash

    rows = spark.createDataFrame([(i % 2000, "a" if i % 3 else "b") for i in range(4000)] + [(5, "c")], "doc_id long, lang string")
    got = sample_by_hash(rows, "lang", "doc_id", 50)
    assert {r.lang: r["count"] for r in got.groupBy("lang").count().collect()} == {"a": 50, "b": 50, "c": 1}
    assert got.distinct().count() == 101 and got.exceptAll(sample_by_hash(rows.repartition(9), "lang", "doc_id", 50)).count() == 0
    assert sample_by_hash(rows.limit(0), "lang", "doc_id", 5).count() == 0


def test_folds(spark):
    import zlib

    from lodemine.llm.common import fold_remainder

    df = spark.createDataFrame([(0,), (12,), (-7,), (None,)], "doc_id long")
    got = [r[0] for r in df.select(fold_remainder("doc_id", 5)).collect()]
    assert got == [zlib.crc32(t.encode()) % 5 for t in ("0", "12", "-7", "")]


# -- whole texts, pages and conversations


def test_long_runs_are_scored_whole():
    model = toxicity.SubwordBags()
    model.prior, seen = None, []
    model.value = lambda w: seen.append(w) or 0.0
    model.cache = toxicity.Recent(model.value, 100)
    run = "".join(chr(0x4E00 + i) for i in range(500))
    model.score(f"so {run} end")
    joined = f"<{run}>"
    grams = {s[i : i + n] for s in (f"<{w}>" for w in seen) for n in (3, 4, 5) for i in range(len(s) - n + 1)}
    assert {joined[i : i + n] for n in (3, 4, 5) for i in range(len(joined) - n + 1)} <= grams
    plain = toxicity.SubwordBags()
    plain.prior, plain.folded = None, np.random.default_rng(1).normal(size=plain.buckets).astype(np.float32)
    assert plain.score(run) != plain.score(run[:100]) != plain.score(run[:60])
    assert toxicity.words("x" * 60) == ["x" * 60] and len(toxicity.words("x" * 61)) == 2


def test_no_selected_node_is_lost():
    p = lambda k: f"<p>Part {k} of the story, as it was told, and written down; at length, too.</p>"
    page = f"<body><div><h2>Head</h2><div>{p(1)}{p(2)}{p(3)}</div><h2>Then</h2><div>{p(4)}{p(5)}</div></div></body>"
    assert html.main_text(page).split("\n\n") == ["Head"] + [p(k)[3:-4] for k in (1, 2, 3)] + ["Then"] + [p(k)[3:-4] for k in (4, 5)]


def test_templates_that_look_far_back(spark):
    class LastTen(chat.InstTemplate):
        def __call__(self, turns):
            return super().__call__(turns[-10:])

    class Numbered(chat.InstTemplate):
        def __call__(self, turns):
            return "".join(self.one(r, f"{k}: {t}") for k, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, k, "user", f"turn {k}") for k in range(30)], "conv_id long, turn long, role string, text string")
    for of in (chat.format_digests, chat.format_turns):
        with pytest.raises(Exception, match="rewrites history from turn 10 on"):
            of(df, LastTen()).collect()
    got = chat.format_turns(df, Numbered()).orderBy("position").collect()
    assert "".join(r.formatted for r in got) == Numbered()([("user", f"turn {k}") for k in range(30)])


def test_digest_is_of_the_decoded_ids():
    model = bpe.BpeModel(bpe.tokenizer_path())
    text = "one two " * 20_000 + "naïve <|endoftext|> 日本"
    ids = model.encode_ids(text)
    d = bpe.Decoder(model)
    want = "".join([d.feed(i) for i in ids]) + d.close()
    assert bpe._encoded(model, text, None, True)[2] == hashlib.sha256(want.encode()).hexdigest()
    model.piece[ids[0]] = "wrong"
    assert bpe._encoded(model, text, None, True)[2] != hashlib.sha256(want.encode()).hexdigest()


def test_bpe_short_words_are_merged_without_a_buffer(monkeypatch):
    from lodemine.llm import bpe

    model = bpe.BpeModel(bpe.tokenizer_path())
    words = ["a", "strange", "thntednt", "éèleê", "x" * 700, "ab" * 300]
    pushed, push = [], bpe.Transducer.push
    monkeypatch.setattr(bpe.Transducer, "push", lambda self, symbols: pushed.append(len(symbols)) or push(self, symbols))
    for w in words:
        symbols = model.symbols(w)
        want = model.merge(symbols[:-1] + [model.last_of[symbols[-1]]])
        assert list(model.word(w)[1]) == want
    assert pushed == [700, 600]
