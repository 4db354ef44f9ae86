"""Token counts, BPE chunks, HTML blocks and decontamination against plain Python and the libraries."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from eventide.llm import bpe_chunks, decontamination, html_blocks, token_counts
from eventide.llm.textscan import words as scan_words


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- token counts --------------------------------------------------------------------------------------------

def test_token_counts(real, odd_docs):
    path, pattern, _ = token_counts.vocabulary()
    coding = token_counts.ByteBpe(path, pattern).coding
    for docs in (real("documents"), odd_docs):
        want = Counter((r["doc_id"], len(coding.encode_ordinary(r["text"] or ""))) for r in docs.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_document_tokens(docs).collect()) == want


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_separators_across_blocks(spark, block):
    ids = np.array([9, 9, 1, 2, 3, 9, 4, 9, 9, 5, 6], dtype="<u2")
    for flat, tail in ((ids, 2), (ids[:9], 0), (ids[:0], 0), (ids[2:5], 3)):
        rows = [("f", k, flat[b : b + block].tobytes()) for k, b in enumerate(range(0, len(flat), block))]
        got = sorted((r["ordinal"], r["first_token"], r["n_tokens"], r["closed"]) for r in token_counts.count_tokens(spark.createDataFrame(rows, token_counts.BLOCKS), 9).collect())
        want, begin = [], 0
        for k, e in enumerate(np.flatnonzero(flat == 9).tolist()):
            want.append((k, begin, e - begin, True))
            begin = e + 1
        if tail:
            want.append((len(want), begin, tail, False))
        assert got == want


def test_raw_token_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 3, 9], dtype="<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path), 2), 9).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2]


# --- BPE -----------------------------------------------------------------------------------------------------

def test_bpe_equals_library(real, odd_docs, make_docs):
    coder = bpe_chunks.ChunkCoder(bpe_chunks.default_path())
    odd = ["a'sb 's 'll", "ΑΣ Σ ς", "x<|endoftext|>y", "é ́a İ ﬁ b\u0085c d", "\x00\x1c a\x1fb", "a​b 123 'd!!!", "  z", "“quoted” — dash…", "½ ² ³x ª", "'s" * 40 + " 't " * 40, "Ǆ ǅ ẞ K Å"]
    docs = odd_docs.unionAll(make_docs(odd + [" ".join(odd) * 30], range(500, 501 + len(odd)))).unionAll(real("documents").limit(60).selectExpr("doc_id", "text", "lang", "source", "n_chars", "'' score", "'' label"))
    want = Counter()
    for r in docs.collect():
        n, ids, shown = coder.whole(r["text"] or "") if r["text"] else (0, "", "")
        want[(r["doc_id"], n, digest(ids), digest(shown))] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_chunks.encode_documents(docs).collect())
    assert got == want


def test_bpe_real_output(make_docs):
    r = bpe_chunks.encode_documents(make_docs(["Hello there"]), with_ids=True).first()
    assert len(r["ids"]) == r["n_tokens"] and digest(r["decoded"]) == r["decoded_sha256"]


def test_bpe_chunks_are_shared_and_repaired():
    """Cuts fall inside words, where both ends are put together; a passage is cut alike wherever it stands."""
    coder = bpe_chunks.ChunkCoder(bpe_chunks.default_path())
    passage = " ".join(f"word{i} other{i}" for i in range(4000))
    cut = lambda t: {t[a:b] for a, b in zip([0, *coder.cuts(t)], coder.cuts(t), strict=False)}
    assert len(cut("first " + passage) & cut("quite another beginning " + passage)) > 100
    inside = [k for k in coder.cuts(passage)[:-1] if passage[k - 1] != " " and passage[k] != " "]
    assert len(inside) > 50 and coder.encode(passage) == coder.whole(passage) and coder.repaired >= len(inside)
    before = coder.reused
    assert coder.encode("quite another beginning " + passage) == coder.whole("quite another beginning " + passage)
    assert coder.reused - before > 0.9 * len(passage)


def test_bpe_random_strings_equal_library():
    import random

    rng = random.Random(4)
    parts = ["word", "Über", "'s", "'re", "'", "12", "3", " ", "  ", "\n", "\t", "\u00a0", "é", "e\u0301", "\u0301", "Σ", "ΑΣ", "İ", "ß", "中文", "😀", "!!", "--", ".", "a" * 40, "x" * 300, "\u200b", "<|endof", "text|>", "ǆ", "½"]
    coder = bpe_chunks.ChunkCoder(bpe_chunks.default_path())
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for k in range(0, len(texts), 500):
        assert coder.encode_all(texts[k : k + 500]) == [coder.whole(t) for t in texts[k : k + 500]]


# --- HTML ----------------------------------------------------------------------------------------------------

PAGE = (
    '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header><a href="#">Home</a> Site</header><nav><ul><li><a href="/x">X</a></ul></nav>'
    '<div class="cookie-notice">We use cookies to make the site work for all of you.</div><div class="ad">Buy the best of it now.</div><article><h1>A &amp; B</h1>'
    "<p>It is a long text that has the words of the article and is &lt;good&gt;,\n as it was in the   days of old when all of it was better.<p>Short.</p>"
    '<form>Name <input><p>inside</form><div class="share">Tell the others</div><p>Last one<br>of the article.</p></article><section id="comments"><p>I think that this is the best of the articles that I have read on it.</p></section>'
    '<aside><p>Others of the things that you may read in the side bar here.</p></aside><footer>&copy; all of the rights</footer></body></html>'
)
WANT = "A & B\n\nIt is a long text that has the words of the article and is <good>, as it was in the days of old when all of it was better.\n\nShort.\n\nLast one of the article."


def test_html_article():
    assert html_blocks.extract(PAGE)[0] == WANT
    assert html_blocks.extract(PAGE[: PAGE.index("</article>")])[0] == WANT


def test_html_without_named_article():
    text = "It is one of the things that was said to be in the town when it was the first of the year and all of them had been there. " * 3
    page = f'<body><ul><li><a href="a">One</a><li><a href="b">Two</a></ul><div>{text}</div><div>And more.</div><div>{text}</div><ul><li><a href="c">Three of the links</a></ul></body>'
    assert html_blocks.extract(page)[0] == "\n\n".join([text.strip(), "And more.", text.strip()])


def _blocks_of_article(page):
    art = page.split("<article>")[1].split("</article>")[0].split("<footer")[0]
    blocks = [re.sub(r"\s+", " ", html_blocks.entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", art)]
    return "\n\n".join(b for b in blocks if b)


def test_html_real_pages(spark):
    """The rules find the article with its tag and without it, and without the tags of menu and footer."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "html").collect()
    got = {r["page_id"]: r for r in html_blocks.extract_pages(pages).collect()}
    same = plain = bare = 0
    for r in rows:
        want = _blocks_of_article(r["html"])
        text = got[r["page_id"]]["text"]
        assert got[r["page_id"]]["n_chars"] == len(text)
        same += text == want
        div = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r["html"])
        plain += html_blocks.extract(div)[0] == want
        bare += html_blocks.extract(re.sub(r"<(/?)(?:nav|footer)\b", r"<\1div", r["html"]).replace(' class="ad"', ""))[0] == want
    assert same >= 0.98 * len(rows) and plain >= 0.96 * len(rows) and bare >= 0.96 * len(rows)


RUNNING = "It is one of the things that was said to be in the town when it was the first of the year and all of them had been there. "


@pytest.mark.parametrize("wrapper", [
    '<div class="has-sidebar">', '<div class="page with-comments">', '<div class="no-ads">', '<div class="nav-closed wrapper">', '<div class="story-share-wrapper">', '<div class="legal-news">',
    '<div class="tags-politics">', '<div class="content hidden">', "<form>", "<p title=it's>", "<p data-x=\"it's\">", '<div title="a > b">',
])
def test_html_wrappers_say_nothing(wrapper):
    page = f"<body><nav><a href=x>Home</a></nav><article>{wrapper}<h1>Title</h1><p>{RUNNING * 3}<p>That's all of 'it'.</article><footer>The end of it.</footer></body>"
    assert html_blocks.extract(page)[0] == f"Title\n\n{(RUNNING * 3).strip()}\n\nThat's all of 'it'."
    assert html_blocks.extract(page.replace("article", "div"))[0] == html_blocks.extract(page)[0]


@pytest.mark.parametrize("part", [
    '<div class="sidebar">{}</div>', '<div id="comments"><p>{}</p></div>', '<section class="comment-list">{}</section>', '<aside>{}</aside>', '<div class="cookie-banner">{}</div>', '<div class="ad-slot-3">{}</div>',
    '<div role="navigation">{}</div>', '<div style="display: none">{}</div>', "<form><p>{}</p></form>", '<div class="ad">{}</div>', '<div class="newsletter-signup box">{}</div>', "<script>{}</script>", "<style>{}</style>",
])
def test_html_parts_go(part):
    page = f"<body><div><h1>Title</h1><p>{RUNNING * 3}</p><p>{RUNNING * 2}</p>{part.format(RUNNING * 2)}</div></body>"
    assert html_blocks.extract(page)[0] == "\n\n".join(["Title", (RUNNING * 3).strip(), (RUNNING * 2).strip()])


def test_html_long_comments_go():
    page = f"<body><div><p>{RUNNING * 2}</p></div><div id='comments'>{''.join(f'<p>{RUNNING}</p>' for _ in range(10))}</div></body>"
    assert html_blocks.extract(page)[0] == (RUNNING * 2).strip()


def test_html_lists_of_links_and_short_lines():
    links = "".join(f'<li><a href="{i}">One of the things {i}</a></li>' for i in range(5))
    page = f"<body><ul>{links}</ul><p>Short before.</p><p>{RUNNING * 3}</p><ul><li>first</li><li>second</li></ul><p>{RUNNING * 2}</p><p>Short after.</p><div><ul>{links}</ul></div></body>"
    assert html_blocks.extract(page)[0] == "\n\n".join(["Short before.", (RUNNING * 3).strip(), "first", "second", (RUNNING * 2).strip(), "Short after."])


@pytest.mark.parametrize("unit", ['<a "', '<p class="', "<p class='", "<!--", "<![CDATA[", "<script>", "<textarea>", "<p>x</div>", "<div>x</b>", "<", "<a href=", "&", "<div class=ad>x", "= '"])
def test_html_time_is_linear(unit):
    import time

    def took(n):
        begin = time.perf_counter()
        html_blocks.extract(unit * n)
        return time.perf_counter() - begin

    took(1_000)
    assert took(40_000) < 25 * max(took(4_000), 0.005)


def test_html_odd(spark):
    odd = [None, "", "   ", "plain", "<", "<p", "<p><b>x<br", "<!-- a", "&nope; &#65; &#x42;", "<script>a", "</p></div>", "<p>" * 3000, "é" * 200_000]
    df = spark.createDataFrame([(i % 9, "u", h, "clash") for i, h in enumerate(odd)], "page_id bigint, url string, html string, text string")
    rows = html_blocks.extract_pages(df).collect()
    assert len(rows) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_blocks.extract_pages(df.limit(0)).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=13):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = Counter()
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if x := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= x
        out[(d, len(w), len(hit), len(found), digest(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def test_contamination(spark, real, odd_docs, make_docs):
    items = [(r["item_id"], r["text"]) for r in real("benchmark").collect()] + [(None, "the and"), (7, "is ndble"), (8, ""), (9, None), (7, "emoji"), (10, "go on long words"), (11, "x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'z' doc_id")
    long = items[0][1]
    extra = make_docs([long, long * 2, "before " + long + " after", long[:80], long.upper()], range(900, 905))
    for docs in (real("documents").select("doc_id", "text"), odd_docs.unionAll(extra)):
        want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
        assert Counter(tuple(r) for r in decontamination.find_contamination(docs, bench).collect()) == want
    one = Counter(tuple(r) for r in decontamination.find_contamination(extra, bench).collect())
    for group in (2, 100):  # many blocks, in several groups, give what one gives
        assert Counter(tuple(r) for r in decontamination.find_contamination(extra, bench, block_bytes=6000, group=group).collect()) == one


def test_contamination_columns_of_any_name(spark, real):
    docs = spark.createDataFrame([(1, "a clean text of its own", 1, "x", "y", "z", "u"), (2, real("benchmark").first()["text"], 2, "x", "y", "z", "u"), (3, None, 3, "x", "y", "z", "u")], "doc_id bigint, text string, n_words int, spans string, _items string, items string, _words string")
    assert sorted(decontamination.drop_contaminated(docs, real("benchmark"), docs.columns).collect()) == sorted(r for r in docs.collect() if r["doc_id"] != 2)


def test_contamination_work_is_bounded():
    """A text and an item of few words, each many times: beginnings tried are words times shapes, not words times windows."""
    import random
    import time

    import pyarrow as pa

    rng = random.Random(1)
    text = " ".join(rng.choice(["aa", "bb"]) for _ in range(16_000))
    index = decontamination.build_index(["i"], [text], {}, 13)
    assert np.diff(index.first).max() <= 13 * 13
    w = scan_words(pa.array([text]))
    begin = time.perf_counter()
    found = decontamination.find_windows(w, w.hashes(), index)
    assert time.perf_counter() - begin < 5 and len(set(found[0].tolist())) == 16_000 - 12


def test_contamination_empty(make_docs, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = decontamination.find_contamination(make_docs(["a b", None]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in sorted(rows)] == [(2, 0, False), (0, 0, False)]
    assert decontamination.find_contamination(make_docs([]), none).count() == 0


def test_word_scan_matches_regex(odd_docs):
    import pyarrow as pa

    texts = [r["text"] for r in odd_docs.collect()]
    w = scan_words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [w.text(k).decode() for k in range(w.first[i], w.first[i + 1])] == words_of(t)
