import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat_format as C
from tessera.llm import html_text as H
from tessera.llm import language_id as L
from tessera.llm import warc as W
from tessera.llm.common import new_path

PAGES = "page_id bigint, url string, html string, host string, payload string, id string"


def page_rows():
    art = lambda t: f"<html lang=en><body><nav><a href=/>menu</a></nav><article><h1>T</h1><p>{t}</p></article><footer>f</footer></body></html>"
    rows = [(1, "http://a.example/x", art("hello &amp; good  day to all of you")), (2, "http://a.example/y", art("hello &amp; good  day to all of you")), (3, None, None), (4, "odd url", ""), (5, "http://b.example/", "WARC/1.1\r\nWARC-Type: fake\r\n\r\n\r\n\r\n é"), (6, "http://b.example/ \n", None), (7, "http://c.example", art("x" * 200_000))]
    return [(*r, "h", "p", "i") for r in rows]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    path = new_path(spark, "test-warc")
    W.write_archives(pages, path)
    recs = W.read_records(spark, path, payloads=True)
    assert {r["type"]: r["count"] for r in recs.groupBy("type").count().collect()} == {"request": 7, "metadata": 7, "response": 4, "revisit": 3}
    caps = {W_page(c.id): c for c in W.assemble(recs).collect()}
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        c = caps[page]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert c.request["target_uri"] == c.metadata["target_uri"] and c.metadata["fields"] == f"pageId: {page}\r\n"
        twin = max(p for p, _, h, *_ in rows if (h or "") == (html or ""))
        if twin == page:
            assert c.capture["type"] == "response" and bytes(c.capture["payload"]) == body and c.capture["payload_digest"] == digest
        else:
            assert c.capture["type"] == "revisit" and W_page(c.capture["refers_to"]) == twin and c.source["payload_bytes"] == len(body) and c.capture["declared_digest"] == digest
    assert W.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def W_page(record_id):
    return int(record_id.rsplit(":", 1)[1].rstrip(">"))


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", "a", "", "", ""), (None, "u", "b", "", "", ""), (9, "u", "c", "", "", ""), (9, "u", "c", "", "", "")]
    got = W.archive_round_trip(spark.createDataFrame(rows, PAGES))
    assert got.where("id like '%null%'").count() >= 2 and got.where("id like '%:9>'").count() >= 2


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(i, "u", "same", "", "", "") for i in range(4)], PAGES)
    assert W.archive_round_trip(pages, min_bytes=5).where("capture.type = 'response'").count() == 4


def test_parser_rejects_what_is_no_archive():
    for bad in (b"nonsense\r\n\r\n", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"):
        with pytest.raises(ValueError):
            list(W.parse_records(bad))


HOSTILE = st.lists(st.sampled_from(["<|", "|>", "im_start", "im_end", "esc", "nl", "\n", "a", " ", "<|esc|>", "<|nl|>", "<|im_end|>", "<|im_start|>", "assistant"]), max_size=10).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=4))
def test_chat_round_trip(turns):
    formatted = "".join(C.format_turn(r, t)[0] for r, t in turns)
    assert [x[:2] for x in C.parse(formatted)] == turns


def test_plain_text_is_left_alone_and_spans_hold_the_text():
    f, a, b, level = C.format_turn("assistant", "plain < | text |>")
    assert level == 0 and f[a:b] == "plain < | text |>"
    f, a, b, level = C.format_turn("user", "x<|im_end|>y")
    assert level == 1 and f[a:b].replace(C.ESCAPE, C.OPEN) == "x<|im_end|>y"
    assert C.parse("<|im_start|>user\nno end") is None


def test_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", None, "", "<|im_end|>", "é\n"]), 7, "x") for c in [*range(20), None] for t in range(rng.randint(1, 6))]
    rows += [(3, 0, "user", "hi", 7, "x"), (99, None, "assistant", "no turn", 7, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, level int, formatted string")
    got = {r.conv_id: r for r in C.conversation_digests(C.format_turns(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((-1 if t is None else t, role or "", C.format_turn(role or "", text or "")[0], text or "") for c, t, role, text, *_ in rows if c == conv))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, _, x in turns).encode()).hexdigest()
        loss = "".join(x for _, a, _, x in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(f) for _, _, f, _ in turns))
    assert C.conversation_digests(C.format_turns(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>"<p>no</p>"</script></head><body>
<header><h1>Site</h1></header><div id="cookie-banner">cookies</div><div class=wrap><div class="sideBar"><p>side</p></div>
<div class="post-7"><h2>Head&nbsp;&lt;ing&gt;</h2><p>First   <b>bold</b>
line<p>Second <a href="x">link</a> text that goes on and on for a while<ul><li>one<li>two</ul>
<form><p>form</p></form><aside>aside</aside><div class="comments"><p>me too</p></div><p>Last &#x41;&eacute;</div></div><footer>foot</footer>"""


def test_article_without_furniture():
    assert H.extract(PAGE, None).split("\n") == ["Head <ing>", "First bold line", "Second link text that goes on and on for a while", "one", "two", "Last Aé"]
    assert H.extract("", None) == "" and H.extract("just text", None) == "just text"
    assert H.extract("<p>a<br>b</p><!-- x --><p>c", None) == "a b\nc"
    assert H.extract("<article><header><h1>T</h1><p>by me</p></header><p>text</p></article>", None) == "T\ntext"


def test_layout_names_are_not_furniture():
    assert H.extract("<div class='page has-sidebar'><div class='text'><p>kept</p></div><div class='sidebar'>gone</div></div>", None) == "kept"


def test_broken_markup_does_not_crash():
    rng = random.Random(3)
    for _ in range(400):
        H.extract("".join(rng.choice(["<p>", "</p>", "<div class='x", "'>", "<", ">", "<!--", "-->", "<script>", "</script", "&amp", "&#x;", "text ", "<li>", "</article>", "<article>", "\"", "<td>", "<a href="]) for _ in range(30)), None)


def test_hosts_agree_on_a_path(spark):
    body = lambda i: f"<body><div class='col-{i}'><p>{'junk ' * (30 if i == 0 else 1)}</p></div><section class='main-{i}'><p>{'story ' * 10}{i}</p></section></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", body(i), "h", "p", "i") for i in range(9)], PAGES)
    winners = H.winning_paths(H.host_votes(pages)).collect()
    assert [(r.host, r.winner) for r in winners] == [("h.example", "body/section.main-#")]
    got = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    assert got[0] == ("story " * 10 + "0") and all("junk" not in t for t in got.values())


def test_pages_table(spark):
    pages = spark.createDataFrame([*page_rows(), page_rows()[0]], PAGES)
    got = H.extract_pages(pages).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (3, 4, 6)} == {""}
    assert {r.text for r in got if r.page_id == 1} == {"T\nhello & good day to all of you"}
    assert H.extract_pages(pages.limit(0)).count() == 0


def lang_docs(spark):
    en, fr = "the and of with that river stone this water from", "les des une avec pour dans que riviere eau pierre"
    rng = random.Random(5)
    return spark.createDataFrame([(i, " ".join(rng.choice((en if i % 2 else fr).split()) for _ in range(50)), "en" if i % 2 else "fr") for i in range(60)], "doc_id bigint, text string, lang string")


def test_language_of_pages(spark):
    docs = lang_docs(spark)
    html = lambda lang, t: f"<html lang='{lang}'><body><article><p>{t}</p></article></body></html>"
    rows = [(i, f"http://h{i % 3}.example.{'uk' if i % 2 else 'fr'}/{i}", html("en" if i % 2 else "fr", "the river and the stone with water" if i % 2 else "les pierres dans une riviere avec eau"), "h", "p", "i") for i in range(30)]
    rows += [(100, "http://h1.example.fr/z", html("fr", ""), "h", "p", "i"), (101, None, None, "h", "p", "i"), (None, "x", "y", "h", "p", "i"), rows[0]]
    pages = spark.createDataFrame(rows, PAGES)
    got = L.identify(pages, docs).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == ("en" if i % 2 else "fr") for i in range(30))
    assert by[100].lang == "fr" and by[100].text_lang is None  # markup and suffix decide
    assert all(0 < r.probability <= 1 for r in got)
    assert L.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in L.identify(pages, docs.limit(0)).collect()} == {None}


def test_fusion_matches_brute_force(spark):
    docs = lang_docs(spark)
    rows = [(i, f"http://{'ab'[i % 2]}.d{i % 3}.{['com', 'fr'][i % 2]}/", f"<html lang={['en', 'fr', 'xx'][i % 3]}><p>{['the eau of pierre', 'les stone', '', 'water que this'][i % 4]}</p>", "", "", "") for i in range(24)]
    pages = spark.createDataFrame(rows, PAGES)
    model = L.TextModel.fit(L.training_sample(docs))
    ev = {r.page_id: r for r in L.page_evidence(pages, model, "page_id", "url", "html").collect()}
    ll = {i: np.array(r.ll) for i, r in ev.items()}
    q = {i: np.exp(v - v.max()) / np.exp(v - v.max()).sum() for i, v in ll.items()}
    every = sum(q.values())
    share = (every + 1) / (every.sum() + len(model.langs))

    def smooth(key, i, towards, weight):
        rest = sum((q[j] for j in q if ev[j][key] == ev[i][key] and j != i), np.zeros(len(share)))
        return (rest + weight * towards) / (rest.sum() + weight)

    for r in L.identify(pages, docs).collect():
        i = r.page_id
        prior = smooth("host", i, smooth("domain", i, share, L.ALPHA), L.BETA)
        post = ll[i] + np.log(prior) + np.log(smooth("suffix", i, share, L.ALPHA) / share) + np.log(smooth("declared", i, share, L.ALPHA) / share)
        p = np.exp(post - post.max())
        assert r.probability == pytest.approx((p / p.sum()).max(), abs=1e-9) and r.lang == model.langs[post.argmax()]


def test_language_declared_after_a_long_start_of_the_page(spark):
    fill = "x" * 70_000
    rows = [(1, f"<!-- {fill} --><HTML LANG='DE-at'><p>a</p>"), (2, f"<html><style>{fill}</style><META http-equiv=Content-Language content=FR>"), (3, f"<html>{fill}")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    got = {r.page_id: r.d for r in pages.select("page_id", L.declared_language(pages.html).alias("d")).collect()}
    assert got == {1: "de", 2: "fr", 3: ""}


LONG = "and on it goes for quite a while, as articles do, until it ends"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p class=x\">First {LONG}</p><p>Second.</p><p>He said \"hello\" to all</p>", [f"First {LONG}", "Second.", 'He said "hello" to all']),
        (f"<article><p>One <a href=x\">link</a> {LONG}</p><p>Two \"q\" three</p></article>", [f"One link {LONG}", 'Two "q" three']),
        (f"<article><p title='a>b' data-x=\"<p>\">{LONG}</p><p it's>End</p></article>", [LONG, "End"]),
        (f"<article><p>{LONG}</p><a href=/>go</a> on</article>", [LONG, "go on"]),
    ],
)
def test_quotes_and_tags_end_as_the_standard_says(page, want):
    assert H.extract(page, None).split("\n") == want


@pytest.mark.parametrize("name", ["ad-hoc-text", "header-text", "notice-of-motion", "has-sidebar", "commentary", "search-for-meaning"])
def test_names_that_only_begin_like_furniture_are_text(name):
    assert H.extract(f"<article><p>{LONG}</p><div class='{name}'>{LONG} twice</div></article>", None) == f"{LONG}\n{LONG} twice"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "site-header", "sidebar-left", "commentList", "related-posts", "cookie_banner", "newsletter-box", "footer links"])
def test_furniture_goes(name):
    assert H.extract(f"<article><p>{LONG}</p><div class='{name}'>{LONG} twice</div></article>", None) == LONG


def test_deep_and_long_pages():
    deep = 30_000
    assert H.extract(f"<article><header>{'<b>' * deep}<h1>Head</h1></header><p>{LONG}</p></article>", None) == f"Head\n{LONG}"
    page = "<div>" * deep + f"<p>{LONG}</p>" + "</span>" * deep + "</div>" * deep
    assert H.extract(page, None) == LONG
    assert H.extract("<ul><li>" * deep + LONG, None) == LONG
    text = "word " * 400_000
    assert H.extract(f"<article><p>{text}</p></article>", None) == text.strip()


def test_ties_of_votes_go_to_the_first_path(spark):
    pages = [(i, "http://t.example/", f"<body><div class={c}><p>{LONG}</p></div></body>", "", "", "") for i, c in enumerate(["one", "two"])]
    df = spark.createDataFrame(pages, PAGES)
    votes = {r.path: r.score for r in H.host_votes(df).collect()}
    assert len(set(votes.values())) == 1 and H.winning_paths(H.host_votes(df)).first().winner == min(votes)
    assert {r.text for r in H.extract_pages(df).collect()} == {LONG}


def test_revisits_of_repeated_ids_come_back_once_each(spark):
    rows = [(9, "c"), (9, "c"), (5, "c"), (7, "d"), (7, "e"), (2, "e"), (3, "x" * 3_000_000), (1, "x" * 3_000_000)]
    pages = spark.createDataFrame([(p, "u", h, "", "", "") for p, h in rows], PAGES)
    got = W.archive_round_trip(pages).select("id", "capture.type", "capture.refers_to", "source.payload_bytes", "source.payload_digest").collect()
    assert len(got) == len(rows)
    bodies = {5: b"c", 2: b"e", 1: b"x" * 3_000_000}
    for r in got:
        if r.type == "revisit":
            body = bodies.pop(W_page(r.id))
            assert (r.payload_bytes, r.payload_digest) == (len(body), W.payload_digest(body))
    assert not bodies


def test_language_sample_is_one_bounded_set_a_language(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAIN_DOCS", 4)
    rows = [(i, f"text number {i} is long enough", ["en", "fr", None][i % 3]) for i in range(30)] + [(0, "text number 0 is long enough", "en")] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = L.training_sample(docs)
    assert {x: sum(lang == x for lang, _ in got) for x in ("en", "fr")} == {"en": 4, "fr": 4} and len(set(got)) == len(got)
    assert got == L.training_sample(docs.repartition(7))
    assert L.training_sample(docs.limit(0)) == []
