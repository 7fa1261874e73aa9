"""Work that has to stay linear in one text, and markup read as browsers read it."""

import html
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from foliospark.llm import bpe_trie, html_lstm, langid, markup, pii, warc
from tests.llm.test_operators import base_spans, documents


@pytest.mark.parametrize("one,size", [("ab@c.de ", 1_000_000), ("1.2.3.4 ", 250_000), ("+49 30 1234567\n", 100_000), ("4111 1111 1111 1111  ", 100_000), ("é9@b.cö.de ", 100_000)])
def test_texts_full_of_identifiers(spark, one, size):
    text = one * (size // len(one))
    docs = documents(spark, [text, "mail a@b.co"])
    pii.digest(documents(spark, ["x"])).collect()
    began = time.time()
    spans = {r.doc_id: r.spans for r in pii.digest(docs).collect()}[0]
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}[0]
    assert time.time() - began < 120
    want = base_spans(text)
    got = [s for s in spans.split(",") if not s.startswith("id:")]
    assert got == want and len(want) == size // len(one)
    kind = want[0].split(":")[0].upper()
    if len(got) == spans.count(":") // 2:
        assert redacted.count(f"[{kind}]") == len(want)


def test_words_of_a_megabyte():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe_trie.default_path()), bpe_trie.ByteBpe(open(bpe_trie.default_path(), encoding="utf-8").read())
    rng = random.Random(3)
    short, long = "".join(rng.choices("abcdehilnorst", k=3000)), "".join(rng.choices("abcdehilnorst", k=1_000_000))
    assert np.frombuffer(own.encode_batch([short])[0], "<u4").tolist() == lib.encode(short, add_special_tokens=False).ids
    began = time.time()
    ids = own.encode_batch([long])
    assert own.decode_batch(ids) == [long] and time.time() - began < 30


def test_long_words_are_learned_from():
    pieces = ("a", "b", "ab", "ba", langid.MARK, langid.MARK + "a")
    p = np.array([0.1, 0.2, 0.3, 0.05, 0.05, 0.1, langid.UNKNOWN])
    word = "abba" * 6
    near = langid.expected_counts(pieces, p, [word], np.array([2.0]))
    assert np.allclose(near, 2 * langid._long_counts(pieces, p, langid.MARK + word))
    both = langid.expected_counts(pieces, p, ["ab", "ab" * 3000], np.array([1.0, 3.0]))
    assert np.isfinite(both).all() and both.sum() > 3 * 3000


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<a " * 50_000, "<a b='" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<!--" * 50_000, "<title>" * 50_000, "<svg>" * 50_000, "<a x=\"" + ">" * 50_000, "<" * 50_000])
def test_pages_of_many_tags(page):
    began = time.time()
    blocks = html_lstm.blocks_of(page)
    warc.derivatives(warc.response("u", page))
    assert time.time() - began < 15
    assert {t.strip("<>") for t, _, _ in blocks} <= {"x", ""}


def test_tags_as_browsers_read_them():
    text = lambda page: [t for t, _, _ in html_lstm.blocks_of(page)]
    assert text('<p data-x="a > b" class="x">one</p>') == ["one"]
    assert text("<p title=don't>two</p><p data-a='<b>\"'>three") == ["two", "three"]
    assert text("<head><title>T</title><meta a='b'><body><article><p>whole text") == ["whole text"]
    assert text("<head><script>'</head>'</script><p>body begins here") == ["body begins here"]
    assert text("<p>a <svg><path d='1'/><text>hidden</text></svg>b</p><svg><p>c</p><object><p>d</p>") == ["a b", "c", "d"]
    assert text("<p>a <script>if (a<b) '</p>'</script>b <!-- <p> --> c<!-->d") == ["a b cd"]
    assert text("5 < 6 and a <3 <p>x</ p>y") == ["5 < 6 and a <3", "xy"]
    assert text("before <a href='cut") == ["before"] and text(None) == text("") == []
    assert warc.read_page("<head><title>T<body><p>x <a class=c href='a>b'>y</a><a name=n>z") == ("", 0)
    assert warc.read_page("<head><body><p>x <a class=c href='a>b'>y</a><a name=n>z") == ("x yz", 1)
    assert dict(markup.attributes(" a=1 B = \"x>y\" c='' d e=f/")) == {"a": "1", "b": "x>y", "c": "", "e": "f/"}


class Shown(HTMLParser):
    """The standard library's reading: all text outside scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        if self.cdata_elem is None:
            self.parts.append(data)


def test_no_markup_is_left_by_made_pages():
    rng = random.Random(5)
    words = ["alpha", "beta &amp; gamma", "delta", "3 &lt; 4", "é&eacute;", "a b"]
    values = ['"a > b"', "'x < y'", "plain", '"it\'s"', "'say \"x\"'", '""']
    for _ in range(300):
        page = ""
        for _ in range(rng.randrange(1, 30)):
            tag = rng.choice(["p", "div", "b", "a", "li", "h2", "section", "span"])
            attrs = "".join(f" {rng.choice(['class', 'id', 'data-x', 'title'])}={rng.choice(values)}" for _ in range(rng.randrange(3)))
            page += rng.choice([f"<{tag}{attrs}>", f"</{tag}>", rng.choice(words), f"<{tag}{attrs}>{rng.choice(words)}</{tag}>", "<!-- c > d -->", "<script>x < y</script>", "<br>", "\n"])
        reader = Shown()
        reader.feed(page)
        reader.close()
        got = "".join("".join(t for t, _, _ in html_lstm.blocks_of(page)).split())
        assert got == "".join("".join(reader.parts).split()), page
        assert "".join(warc.read_page(page)[0].split()) == got
        assert html.unescape(got) == got
