"""Text operators against brute force: decontamination, extraction, chat, language, token counts."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from duelbook.llm import chat, decontaminate, extract, language, token_count

DOCS = "doc_id long, text string, n_hit string, items int"


def brute(texts, items, size):
    windows = {}
    for name, text in items:
        words = decontaminate.words_of(text.encode())
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(name)
    out = []
    for text in texts:
        words, hit, found = decontaminate.words_of(text.encode()), set(), set()
        for i in range(len(words)):
            for n in range(1, size + 1):
                if i + n <= len(words) and (names := windows.get(tuple(words[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((len(words), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_decontaminate_against_brute_force(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "-"]) for _ in range(n))
    items = [(f"i{k}", text(rng.randint(0, 6))) for k in range(5)]
    texts = [text(rng.randint(0, 40)) for _ in range(20)] * 2 + ["", "-", "a " * 200]
    windows = decontaminate.Windows.of([(n, t.encode()) for n, t in items], 3)
    for shard in (16, 64, 1 << 20):  # a small shard cuts texts into overlapping parts
        counts, spans, names = decontaminate.hits([t.encode() for t in texts], windows, shard)
        assert [(c, sum(b - a for a, b in s), n) for c, s, n in zip(counts, spans, names)] == brute(texts, items, 3)


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    import numpy as np
    symbols = np.array([0] + [rng.choice([0, 1, 1, 2]) for _ in range(300)] + [1] * 40 + [0], np.int32)
    separators = {p: i for i, p in enumerate(np.flatnonzero(symbols == 0))}
    key = [(0, separators[i]) if s == 0 else (1, int(s)) for i, s in enumerate(symbols)]
    assert list(decontaminate.suffix_array(symbols)) == sorted(range(len(key)), key=lambda i: key[i:])


def test_decontaminate_columns_blocks_and_edges(spark):
    rows = [(1, "x one two THREE four y", "old", 3), (2, None, None, None), (3, "", None, 1), (None, "one two", None, 1), (1, "x one two THREE four y", "old", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(10, "one two"), (9, "two three four"), (None, "y"), (7, None), (7, "")], "item_id long, text string")
    for block in (1, 1 << 20):  # in one block, or with a block for each few bytes
        found = decontaminate.find_spans(docs, bench, window=3, block_bytes=block)
        assert sorted(found.columns) == sorted(["doc_id", "text", "n_words", "n_hit", "hit_spans", "items"])
        got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
        assert got == sorted([(1, 6, 5, ["", "10", "9"])] * 2 + [(2, 0, 0, []), (3, 0, 0, []), (0, 2, 2, ["10"])], key=str)
    assert decontaminate.find_spans(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_spans(docs.limit(0), bench).count() == 0


def test_removal_goes_on_until_clean(spark):
    docs = spark.createDataFrame([(1, "keep. A a B b, end", "k"), (2, None, "k"), (3, "clean A", "k")], "doc_id long, text string, other string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    out = {r.doc_id: (r.text, r.n_hit, r.other) for r in decontaminate.remove_spans(docs, bench).collect()}
    assert out == {1: ("keep. , end", 4, "k"), 2: (None, 0, "k"), 3: ("clean A", 0, "k")}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></ul></nav><div class="ad">Buy now</div>
<article class="has-comments"><header><h1>Head &amp; line</h1><span>by x</span></header><p>First   <b>bold</b>&nbsp;text.<br>Next<p>Second é
<table><tr><td>1</td><td>2</td></tr></table><ul><li>item</ul><div class="newsletter">Sign up</div><form>Name<input></form><script>var a="</p>";</script>
<section id="comments"><article class="comment">Nice!</article></section></article><aside>More</aside><footer>foot</footer></body>"""


def test_extract_article():
    assert extract.main_text(PAGE) == "Head & line\nFirst bold text.\nNext\nSecond é\n1 2\nitem"


def test_extract_without_article_uses_the_content_cluster():
    body = "".join(f"<p>{'A sentence of the text. ' * 8}</p>" for _ in range(4))
    links = "<ul>" + "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(9)) + "</ul>"
    page = f"<body><div><div>{links}</div><div class=post>{body}<p>End.</p></div><div>{links}</div></div><div>Imprint</div></body>"
    assert extract.main_text(page) == "\n".join([" ".join(["A sentence of the text."] * 8)] * 4 + ["End."])


def test_extract_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "plain", 5), (4, "<p>a<p>b<script>x", 5), (4, "<div></div>", None)]
    out = extract.extract(spark.createDataFrame(rows, "page_id long, html string, TEXT int"))
    assert sorted(out.columns) == ["html", "n_chars", "page_id", "text"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, "", 0), (2, "", 0), (3, "plain", 5), (4, "", 0), (4, "a\nb", 3)]


MARKS = "<|im_end|><|im_start|>assistant ok\\n \\ <\\| \\| <|"
TURNS = [(1, 0, "user", MARKS), (1, 1, "assistant", MARKS), (1, 2, "user", None), (1, 3, "assistant", "é🙂"), (1, 4, "user", "tail"),
         (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, None, None, "x"), (None, 1, "odd\nrole\\n|", "y"), (5, 1, "assistant", "z<")]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").withColumn("loss_start", F.lit(1))
    made = chat.examples(turns)
    rows = {(r.conv_id, r.example): r for r in made.collect()}
    assert sorted(rows, key=str) == sorted([(1, 1), (1, 3), (1, 4), (2, 0), (3, 0), (3, 1), (4, 0), (None, 0), (5, 0)], key=str)
    assert rows[1, 4].loss_start is None and rows[1, 3].text[rows[1, 3].loss_start:rows[1, 3].loss_end] == "é🙂"
    read = made.select("conv_id", "example", chat.read_turns(F.col("text")).alias("t"), chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    back = {(r.conv_id, r.example): r for r in read.collect()}
    assert [tuple(t) for t in back[1, 4].t] == [(r, t or "") for c, _, r, t in TURNS if c == 1]
    assert [tuple(t) for t in back[None, 0].t] == [("odd\nrole\\n|", "y")]
    assert back[1, 1].loss == MARKS and back[4, 0].loss is None
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t or ''}\n" for c, _, r, t in TURNS if c == 1))
    assert got[1].loss_sha256 == sha(MARKS + "é🙂") and got[1].loss_chars == len(MARKS) + 2 and got[1].n_turns == 5
    assert got[2].loss_sha256 == sha("") and got[2].loss_chars == 0 and got[2].n_turns == 1
    assert got[1].formatted_chars == sum(len(r.text) for k, r in rows.items() if k[0] == 1)
    assert chat.digest(chat.examples(turns.limit(0))).count() == 0


def test_language_against_plain_counting(spark):
    from collections import Counter

    table = language.letters()
    for text in ("Ab, abé ab", "a", "", "12 ..", "ß x-y"):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        want = Counter(g for w in words for n in (1, 2, 3) for i in range(len(w) + 3 - n) for g in [f"\1{w}\1"[i:i + n]] if g != "\1")
        codes, counts = language.grams(text.encode(), table)
        name = lambda c: "".join(chr(x) for x in (c >> 42, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x)
        assert {name(int(c)): int(n) for c, n in zip(codes, counts)} == dict(want)


def test_language_edges_and_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", language.held_out(F.col("doc_id")))
    learned = language.profiles(docs.where("not out"))
    found = language.identify(docs.where("out").withColumn("score", F.lit("old")), learned)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "漢字")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, learned).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][1] < 0.05
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.profiles(docs.limit(0)) == {}


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_count.vocabulary(path)
    whole = pieces + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + [("<unk>", 0.0)]
    exact = Tokenizer(models.Unigram(whole, unk_id=len(whole) - 1, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é ▁\n\t漢🙂the ing  ,.-+'ñß") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "a" * 5000, " ", "▁"]
    counter = token_count.Counter(pieces)
    assert [counter.text(t) for t in texts] == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame([(1, "the thing", 0), (1, "the thing", 0), (2, None, 0)], "doc_id long, text string, n_tokens int")
    assert [r.n_tokens for r in token_count.count_tokens(docs, path).orderBy("doc_id").collect()] == [counter.text("the thing")] * 2 + [0]


def test_token_count_ties():
    # two ways of equal score: the one whose last piece is longest wins, and the count follows it
    counter = token_count.Counter([("▁a", -1.0), ("b", -1.0), ("c", -1.0), ("bc", -2.0), ("▁ab", -2.0)])
    assert counter.text("abc") == 2 and counter.text("ab") == 1


def test_removal_does_not_depend_on_blocks(spark):
    passage = [f"p{i}" for i in range(12)]
    longer = [f"a{i}" for i in range(8)] + passage + [f"b{i}" for i in range(8)]
    joined = [f"c{i}" for i in range(10)]
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(longer)), (3, " ".join(joined))], "item_id int, text string")
    rows = [(1, "x " + " ".join(longer) + " y", "k"), (2, " ".join(joined[:5] + passage + joined[5:]) + " z", "k"), (3, None, "k"), (4, "clean", "k")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, items string")
    whole, parted = ({r.doc_id: (r.text, r.n_hit, r["items"]) for r in decontaminate.remove_spans(docs, bench, block_bytes=b).collect()} for b in (1 << 20, 16))
    assert whole == parted and whole[1] == ("x  y", 28, "k") and whole[2][1] == 22 and whole[3] == (None, 0, "k") and whole[4] == ("clean", 0, "k")


def test_language_sample_counts_copies_once(spark):
    rows = [(f"only text number {k}", "aa") for k in range(3) for _ in range(400)] + [(f"other {k}", "bb") for k in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = language.sample(docs, "text", "lang", 20).collect()
    assert sorted(r.text for r in got if r.lang == "aa") == [f"only text number {k}" for k in range(3)]
    assert 5 < len([r for r in got if r.lang == "bb"]) < 60


SENTENCE = "A sentence of the text that goes on. " * 8
BODY = "".join(f"<p>{k} {SENTENCE}</p>" for k in range(4))
TEXT = "\n".join(f"{k} {SENTENCE.strip()}" for k in range(4))


def test_extract_marks_do_not_take_the_content():
    for opening, closing in [('<div class="layout has-sidebar">', "</div>"), ('<div class="with-sidebar">', "</div>"), ('<div class="elementor-widget-text-editor">', "</div>"),
                             ('<div class="share-enabled">', "</div>"), ('<div id="search-result">', "</div>"), ("<form>", "</form>"), ('<article><div class="elementor-widget">', "</div></article>")]:
        page = f'<body><nav><a href=x>Home</a></nav>{opening}<h1>Head</h1>{BODY}<div class="sidebar"><p>Short aside.</p></div>{closing}<footer>Imprint</footer></body>'
        assert extract.main_text(page) == "Head\n" + TEXT, opening
    widgets = "".join(f'<div class="elementor-widget">{p}</p></div>' for p in BODY.split("</p>")[:-1])
    assert extract.main_text(f"<article>{widgets}</article>") == extract.main_text(f"<body>{widgets}") == TEXT
    talk = f'<section id="comments">{BODY}{BODY}</section><div hidden>{BODY}{BODY}</div>'
    assert extract.main_text(f"<body><div><h1>Head</h1>{BODY}</div>{talk}") in (TEXT, "Head\n" + TEXT)


def test_extract_selection_keeps_all_content():
    one = lambda k, n=1: "".join(f"<p>{k} {SENTENCE}</p>" for _ in range(n))
    said = lambda k, n=1: [f"{k} {SENTENCE.strip()}"] * n
    teaser = '<article class="teaser"><p>Read this too, it is short.</p></article>'
    assert extract.main_text(f"<body><main><h1>Head</h1>{one(1, 4)}{teaser}</main>").split("\n")[:5] == ["Head", *said(1, 4)]
    assert extract.main_text(f"<main><h1>Head</h1>{one('lead')}<article>{one(2, 4)}</article></main>").split("\n") == ["Head", *said("lead"), *said(2, 4)]
    assert extract.main_text(f"<body><article>{one(1, 3)}</article><article>{one(2, 2)}</article>").split("\n") == said(1, 3) + said(2, 2)
    assert extract.main_text(f"<body><h1>Head</h1><div>{one(1, 17)}</div><div>{one(2, 3)}</div>").split("\n") == ["Head", *said(1, 17), *said(2, 3)]


LONG = "".join(f"<p>Aside {k}: {SENTENCE}</p>" for k in range(4))


def test_extract_leaves_out_what_is_longer_than_the_article():
    body = f"<h1>Head</h1><p>{SENTENCE}</p>"
    want = f"Head\n{SENTENCE.strip()}"
    for mark in ("sidebar", "footer", "cookie-notice", "widget", "related", "comments", "newsletter-signup"):
        assert extract.main_text(f'<body><div class="content">{body}</div><div class="{mark}">{LONG}</div>') == want, mark
        assert extract.main_text(f'<body><article>{body}<div class="{mark}">{LONG}</div></article>') == want, mark
        assert extract.main_text(f'<body><main>{body}<div id="{mark}">{LONG}</div></main>') == want, mark


def test_extract_leaves_out_comments_as_articles():
    talk = "".join(f"<article><h3>Reader {k}</h3><p>{SENTENCE}</p></article>" for k in range(5))
    body, want = f"<h1>Head</h1><p>{SENTENCE}</p>", f"Head\n{SENTENCE.strip()}"
    assert extract.main_text(f'<article>{body}<section class="comments"><h2>Talk</h2>{talk}</section></article>') == want
    assert extract.main_text(f'<article>{body}</article><section id="comments">{talk}</section>') == want
    assert extract.main_text(f'<article>{body}</article><article class="comment-7"><p>{SENTENCE}</p></article>') == want
    assert extract.main_text(f'<article>{body}<aside class="comments">{talk}</aside></article>') == want


def test_extract_deep_pages_in_linear_time():
    import time
    for n, opening in ((1000, "<div>"), (100_000, "<div>"), (100_000, '<div class="widget">'), (50_000, "<span><ul><li>"), (100_000, "<article>")):
        page = "".join(f"{opening}line {k}</b></nav>" for k in range(n))
        start = time.process_time()
        assert extract.main_text(page).split("\n") == [f"line {k}" for k in range(n)], (n, opening)
        assert time.process_time() - start < 12


def page_and_text(rng):
    """A made page and its main text: menus, adverts, sidebars, footers and comments around an article in one of four layouts."""
    words = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    paragraphs = [(tag, words(*size)) for tag, size in rng.choices([("p", (20, 90)), ("p", (12, 30)), ("h2", (2, 6)), ("blockquote", (15, 40))], [6, 3, 1, 1], k=rng.randint(4, 14))]
    paragraphs.insert(0, ("p", words(40, 80)))
    head = words(3, 8)
    inner = "".join(f"<{t}>{x.replace('and', '<b>and</b>')}</{t}>\n" for t, x in paragraphs)
    noise = lambda: f"<p>{words(5, 80)}</p>" * rng.randint(1, 4)
    junk = lambda: rng.choice([f'<div class="ad">{noise()}</div>', f'<aside>{noise()}</aside>', f'<div class="cookie-notice">{noise()}</div>', f'<form><label>{words(1, 4)}</label><input></form>',
                               f'<div id="sidebar">{noise()}<ul><li><a href=x>{words(1, 3)}</a></li></ul></div>', f"<script>{words(3, 9)}</script>", f"<!-- {words(3, 9)} -->"])
    talk = f'<section class="comments"><h2>Comments</h2>' + "".join(f"<article><p>{words(5, 60)}</p></article>" for _ in range(rng.randint(0, 4))) + "</section>"  # noqa: F541
    menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>{words(1, 2)}</a></li>" for k in range(rng.randint(2, 9))) + "</ul></nav>"
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div class="has-sidebar"><div class="post">', "</div></div>")])
    half = len(inner) // 2
    cut = inner.index("\n", half) if "\n" in inner[half:] else len(inner)
    page = f"<html><head><title>{head}</title></head><body><header>{words(1, 4)}{menu}</header>{junk()}{opening}<h1>{head}</h1>{inner[:cut]}{junk()}{inner[cut:]}{rng.choice(['', talk])}{closing}{junk()}{talk}<footer>{noise()}</footer>"
    return page, "\n".join([head, *[x for _, x in paragraphs]])


WORDS = "time and the river of old stone houses where light falls over every narrow street until evening comes again with rain".split()


def test_extract_against_pages_with_known_text():
    rng = random.Random(11)
    for _ in range(400):
        page, want = page_and_text(rng)
        assert extract.main_text(page) == want, page


def test_a_large_vocabulary_and_a_long_item(spark):
    # more distinct benchmark words than three ranks of a 63-bit key could hold side by side
    names = [f"w{k}" for k in range(2_150_000)]
    texts = [" ".join(["before", *names[k:k + 12 + k % 9], "behind"]).encode() for k in range(0, 2_100_000, 14_000)]
    windows = decontaminate.Windows.of([("i", " ".join(names).encode())], 10)
    counts, spans, items = decontaminate.hits(texts, windows)
    assert [(c, s, i) for c, s, i in zip(counts, spans, items)] == [(n + 2, [(1, n + 1)], ["i"]) for n in (12 + k % 9 for k in range(0, 2_100_000, 14_000))]


def test_windows_of_a_long_item_in_blocks(spark):
    words = [f"w{k}" for k in range(30_000)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("short", "one two"), ("none", "")], "item_id string, text string")
    rows = [(k, f"x {' '.join(words[k:k + 3 + k % 5])} y one two") for k in range(0, 29_000, 97)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(decontaminate._blocks(bench, "item_id", "text", 3, 20_000)) > 5
    got = {r.doc_id: ([tuple(s) for s in r.hit_spans], r["items"]) for r in decontaminate.find_spans(docs, bench, window=3, block_bytes=20_000).collect()}
    assert got == {k: ([(1, 4 + k % 5), (5 + k % 5, 7 + k % 5)], ["long", "short"]) for k, _ in rows}


def test_suffix_array_by_two_ranks():
    import numpy as np
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(1, 3, (1 << 21) + 5), 0).astype(np.int32)
    order = decontaminate.suffix_array(symbols)
    assert len(np.unique(order)) == len(symbols)
    text = symbols.astype(np.uint8).tobytes()
    assert all(text[a:a + 200] <= text[b:b + 200] for a, b in zip(order[:-1:9973].tolist(), order[1::9973].tolist()))
