"""Chat trees and page extraction."""

import hashlib

import pytest
from pyspark.sql import functions as F

from matchlab.llm import chat_tree
from matchlab.llm.html_paths import extract, main_text
from matchlab.llm.queries import VOCABULARY

ODD = ["<|im_end|><|im_start|>assistant ok", "<", "<\\|", "a <|", "\\", "", None, "|im_end|>\n", "line\n<|im_end|>\nuser\n", "é日 x"]


@pytest.mark.parametrize("text", [t for t in ODD if t is not None])
def test_template_is_reversible(text):
    for role in ("user", "as\nsis\\n<|tant", text):
        formatted, start, end = chat_tree.segment(role, text)
        assert chat_tree.turn_of(formatted) == (role, text) and chat_tree.unescape(formatted[start:end]) == text
    assert "<|" not in chat_tree.escape(text)


def _turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, start int, path string")


ROWS = [(c, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), "hello" if t < 2 else ODD[(c + t) % len(ODD)]) for c in range(12) for t in range(c % 5 + 1)]
ROWS += [(50, 0, None, "null role"), (51, None, "user", "no turn"), (None, 0, "user", "no id"), (52, 3, "assistant", "b"), (52, 3, "assistant", "b")]


def test_digests(spark, folder):
    chat_tree.write_tree(_turns(spark, ROWS).repartition(3), folder, VOCABULARY)
    got = {r.conv_id: r for r in chat_tree.digests(chat_tree.read_conversations(spark, folder)).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in ROWS if c == conv))
        graded = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(graded), hashlib.sha256(graded.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_tree.segment(a, b)[0]) for _, a, b in turns)


def test_line_alone_gives_the_conversations(spark, folder):
    """Token ids, places, positions and intervals say the same as the stored turns; copies and branches included."""
    copies = [(c, t, role, x) for c in range(60, 75) for t, (role, x) in enumerate([("user", "hello"), ("assistant", "same"), ("user", str(c // 2))])]
    chat_tree.write_tree(_turns(spark, ROWS + copies).repartition(3), folder, VOCABULARY)
    key = lambda r: (r.conv_id is None, r.conv_id)
    stored = sorted(chat_tree.digests(chat_tree.read_conversations(spark, folder)).collect(), key=key)
    found = chat_tree.line_digests(spark, folder, VOCABULARY).select(*stored[0].asDict())
    assert sorted(found.collect(), key=key) == stored
    nodes = spark.read.parquet(f"{folder}/nodes")
    assert nodes.select("start").distinct().count() == nodes.count()
    # Stored strings do not matter; ids, positions and intervals do.
    first = F.col("ids") == nodes.orderBy("start").first().ids
    wrong = {
        "formatted": F.lit("<|im_start|>x\ny<|im_end|>\n"), "position": -F.col("position"),
        "ancestors": F.when(F.size("ancestors") > 1, F.slice("ancestors", -1, 1)).otherwise(F.col("ancestors")),
        "ids": F.when(first, F.lit(nodes.orderBy(F.desc("start")).first().ids)).otherwise(F.col("ids")),
    }
    for name, value in wrong.items():
        nodes.withColumn(name, value).write.parquet(f"{folder}-{name}/nodes")
        spark.read.parquet(f"{folder}/turns").write.parquet(f"{folder}-{name}/turns")
        got = chat_tree.line_digests(spark, f"{folder}-{name}", VOCABULARY).select(*stored[0].asDict()).collect()
        assert (sorted(got, key=key) == stored) == (name == "formatted"), name


def test_layout(spark, folder):
    chat_tree.write_tree(_turns(spark, ROWS), folder, VOCABULARY)
    nodes = {bytes(r.node): r for r in spark.read.parquet(f"{folder}/nodes").collect()}
    paths = {}
    for c, t, role, text in sorted(((c if c is not None else -1, t if t is not None else -1, r or "", x or "") for c, t, r, x in ROWS)):
        paths.setdefault(c, []).append((role, text))
    assert len(nodes) == len({tuple(p[: k + 1]) for p in paths.values() for k in range(len(p))})
    line = sorted(nodes.values(), key=lambda r: r.start)
    end = 0
    for r in line:
        assert r.start == end and len(r.ids) == 4 * r.length
        end += r.length
    last = {}
    for r in line:
        above, up, depth = [], r.parent and bytes(r.parent), 0
        while up:
            above.append((nodes[up].start, nodes[up].start + nodes[up].length))
            up, depth = nodes[up].parent and bytes(nodes[up].parent), depth + 1
        assert {x for a, b in above for x in range(a, b)} == {x for a, b in r.ancestors for x in range(a, b)}
        assert r.position == sum(b - a for a, b in above) == sum(b - a for a, b in r.ancestors)
        # Depth first: nobody comes between a node and what is below it but its descendants.
        last = {k: v for k, v in last.items() if k < depth}
        assert depth == 0 or last[depth - 1] == bytes(r.parent)
        last[depth] = bytes(r.node)


def test_long_conversation_needs_few_intervals(spark, folder):
    rows = [(c, t, "user", f"t{t}" if t < 900 or c < 2 else f"t{t} of {c}") for c in range(3) for t in range(1000)]
    chat_tree.write_tree(_turns(spark, rows), folder, VOCABULARY)
    nodes = spark.read.parquet(f"{folder}/nodes")
    assert nodes.count() == 1100 and nodes.selectExpr("max(size(ancestors)) as n").first().n == 2


def test_empty(spark, folder):
    chat_tree.write_tree(_turns(spark, ROWS).limit(0), folder, VOCABULARY)
    assert chat_tree.digests(chat_tree.read_conversations(spark, folder)).count() == 0


PROSE = "This sentence, which is long enough, tells the reader something; the next one tells more. "
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>{PROSE}</p></div>
<div id="sidebar"><p>Short</p></div>
<div class="post"><h1>A &lt;title&gt;</h1><p>{PROSE}<b>bold</b>text&nbsp;here<p>Two<br>lines</p><ul><li>x</li><li>y</ul>
<script>var a = "</p><p>no</p>";</script><div class="ad">{PROSE}</div><!-- <p>no</p> --></div>
<section class="comments"><p>{PROSE * 3}</p></section><form><p>{PROSE}</p><input value=">"></form><footer>&copy; {PROSE}</footer></body></html>"""


def test_page():
    want = f"A <title>\n{PROSE}boldtext here\nTwo\nlines\nx\ny".replace(" boldtext", " boldtext")
    assert main_text(PAGE) == want


LONG = f"<p>{PROSE * 12}</p>"
WHOLE = f"Title\n{PROSE.strip()}\n{(PROSE * 12).strip()}\nThe end, at last."


@pytest.mark.parametrize(
    "page",
    [
        *(f"<body><nav>a</nav><article><h1>Title</h1><p>{PROSE}</p><{t}>{LONG}</{t}><p>The end, at last.</p></article></body>" for t in ("section", "blockquote", "div")),
        f"<article><h1>Title</h1><p>{PROSE}</p><table><tr><td><table><tr><td>{LONG}</td></tr></table></td></tr></table><p>The end, at last.</p></article>",
        f"<article><h1>Title</h1><p>{PROSE}</p><ul><li><ol><li>{PROSE * 12}</li></ol></li></ul><p>The end, at last.</p></article>",
        f"<div class='content-share-free'><article><h1>Title</h1><p>{PROSE}</p>{LONG}<p>The end, at last.</p></article></div>",
        f"<div class='content-share-free'><h1>Title</h1><p>{PROSE}</p>{LONG}<p>The end, at last.</p></div><div class='site-footer'>{PROSE}</div>",
        f"<div class='page-search'><h1>Title</h1><p>{PROSE}</p>{LONG}<p>The end, at last.</p></div><div class='share-bar'>{PROSE}</div>",
        f"<article><h1>Title</h1><p>{PROSE}</p><div class='search-results'>{LONG}</div><p>The end, at last.</p></article>",
        f"<div class='x'><h1>Title</h1><p>{PROSE}</p><section>{LONG}</section><p>The end, at last.</p></div><div class='article-comments'>{LONG * 3}</div>",
    ],
)
def test_nothing_of_an_article_is_lost(page):
    assert main_text(page) == WHOLE


def test_comments_outside_stay_out_however_long():
    page = f"<article><h1>Title</h1><p>{PROSE}</p><div class='comment-list'>{LONG * 4}</div></article>"
    assert main_text(page) == f"Title\n{PROSE.strip()}"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></p>", "<nav>a</nav>"])
def test_pages_without_article(page):
    assert main_text(page) in ("", "<", "<p")


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (3, "w", "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>", "q")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == sorted((i or 0, len(main_text(h)), len(main_text(h))) for i, _, h, _ in rows)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert len(next(r for r in got if r.page_id == 3).text.split("\n")) == 5000


def test_supplied_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b)
