import re

import pytest
from pyspark.sql import functions as F

from noteloom.functions import pages

LONG = "A sentence that is long enough to count as running text. " * 2
CASES = [
    (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p></article><footer>Foot</footer>", f"Title\n{LONG.strip()}"),
    (f"<body><div><ul><li><a>one</a><li><a>two</a></ul></div><div><p>{LONG}<p>Second <b>bold</b>&amp;more</div></body>", f"{LONG.strip()}\nSecond bold&more"),
    (f"<div class='ad-box'>Buy</div><p>{LONG}</p><script>var a='<p>x</p>'</script><style>p{{}}</style><!-- no -->", LONG.strip()),
    (f"<p>{LONG}</p><table><tr><td>cell</td></tr></table><p hidden>no</p><div aria-hidden=true>no</div>", LONG.strip()),
    (f"<div id=sidebar><p>{LONG}{LONG}{LONG}</p></div><main><p>{LONG}</p></main>", LONG.strip()),
    (f"<p>{LONG}<br>next</b></i></p></div>", f"{LONG.strip()} next"), ("<p>plain", "plain"), ("just text", "just text"), ("", ""), ("<p></p><script>x</script>", ""), ("<p><a href=x>only links</a></p>", ""),
    (f"<main><p>short</p></main><div><p>{LONG}</p></div>", LONG.strip()), (f"<p>{LONG}</p>" + "<div>" * 3000 + "deep", f"{LONG.strip()}\ndeep"), (f"<p class='heading adjacent'>{LONG}</p>", LONG.strip()),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_running_text(html, text):
    assert pages.running_text(html) == text


def test_rows(spark):
    df = spark.createDataFrame([(f"<p>{LONG}",), ("",), (None,), ("<p>" + "word " * 5000,)], "html string")
    got = [r.p for r in df.select(pages.extracted(F.col("html")).alias("p")).collect()]
    assert (got[0].text, got[0].error) == (LONG.strip(), None) and (got[1].text, got[1].error) == (None, pages.EMPTY) and got[2] is None and len(got[3].text) == pages.MOST


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", pages.extracted(F.col("html")).alias("p")).collect()
    for r in rows:
        if r.html and "<article>" in r.html:
            inner = r.html.split("<article>", 1)[1].split("</article>")[0]
            wanted = re.sub(r"(?s)<(script|style|table|aside|nav)\b.*?</\1>", " ", inner)
            words = set(re.sub(r"<[^>]*>", " ", wanted).replace("&amp;", "&").split())
            got = (r.p.text or "").split()
            assert len(set(got) - words) == 0 and (len(r.p.text or "") == pages.MOST or len(set(got)) > 0.9 * len(words))
