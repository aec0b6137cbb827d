import re
from html import unescape

import pytest

from quarry.llm.html_tree import extract, extract_pages


def test_pages_of_the_test_data(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert rows[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])


STORY = "<h1>Title</h1><p>One long story, with commas, and more &amp; more &lt;3.</p><p>Second<br>part</p>"
TEXT = "Title\n\nOne long story, with commas, and more & more <3.\n\nSecond part"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href=1>Home</a></nav><article>{STORY}</article><footer>Foot, note, here</footer></body>",
        f"<body><div id=header>Site</div><div class=sidebar><p>one, two, three, four, five, six, seven</p></div><div class=content>{STORY}</div><div id=comments><p>I think, that, this, is, bad, no?</p></div></body>",
        f"<main><section>{STORY}</section><aside>Advert, advert, advert</aside><form><p>Sign up, now, please</p></form></main>",
        f"<div class='cookie-notice'>We use cookies, yes, we, do</div><div>{STORY}<div class=ad>Buy, buy, buy, this</div><script>var t = '</p>, , , ,'</script><style>p,a,b{{}}</style></div>",
        f"<article><!-- no, no, no -->{STORY}<ul class='share social'><li>a, b, c</li></ul></article><div role=navigation>x, y, z</div>",
    ],
)
def test_furniture_is_left_out(page):
    assert extract(page) == TEXT


def test_broken_markup():
    assert extract("<body><article><h1>T</h1><p><b>One, two.<br><p>Three &copy; four") == "T\n\nOne, two.\n\nThree © four"
    assert extract("<p>a<script>x") == "a"
    assert extract("<div><p>one</div><p>two</span></p>") == "one\n\ntwo"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain text", "plain text"), ("<nav>only menu</nav>", ""), ("<", "<"), ("<div class=comment>only a comment</div>", "only a comment")])
def test_odd_pages(page, text):
    assert extract(page) == text


def test_rows_are_kept(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>x" * 20000, 6)], "page_id long, url string, html string, text int")
    rows = extract_pages(pages).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 20000 * 3 - 2]
    assert extract_pages(pages.limit(0)).collect() == []
