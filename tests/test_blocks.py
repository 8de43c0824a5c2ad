import pytest
from pyspark.sql import functions as F

from noteloom.functions import markdown as md

LONG = "x" * 45
CASES = [
    ("", 0), ("a\n\nb", 0), (LONG, 1), ("PLACE", 0), (f"{LONG}\n\n{LONG}", 2), (f"{LONG}\n===", 0), (f"{LONG}\n---", 0), (f"# h\n{LONG}\n\n***\n{LONG}", 2), (f"{LONG}\n***\n{LONG}", 2),
    ("a | b\n---|---\n1 | 2", 1), (f"|a|\n|-|\n|b|\n\n{LONG}", 2), ("| a | b |\n|--|\n", 0), (f"{LONG}\na | b\n--|--\n1|2", 2),
    (f"<div>\n{LONG}\n</div>", 0), (f"<!-- x\n\n{LONG}\n-->\n{LONG}", 1), (f"<b>\n{LONG}", 0), (f"<b>x</b>\n{LONG}", 1), (f"{LONG}\n<b>x</b>", 1),
    (f"    {LONG}", 0), (f"\t{LONG}", 0), (f"{LONG}\n    {LONG}", 1),
    ("- a\n- b\n* c", 2), ("1. a\n2. b\n3) c", 2), ("- a\n  - b\n    - c\n- d", 1), (f"- a\n\n  {LONG}\n\n- b", 1), (f"- a\n{LONG}", 1), (f"- a\n\n{LONG}", 2), (f"-\n\n{LONG}", 2), (f"10. a\n    b\n\n    c\n{LONG}", 1),
    (f"{LONG}\n2. x{LONG}", 1), (f"{LONG}\n1. x", 2), (f"- - -\n{LONG}", 1), (f"- ```\n  {LONG}\n\n{LONG}", 2),
    (f"> q\n{LONG}", 0), (f"> q\n\n{LONG}", 1), (f"> ```\n{LONG}", 1), (f"```\n{LONG}\n\n{LONG}\n```\n{LONG}", 2), (f"~~~\n```\n~~~\n{LONG}", 2), (f"````\n```\n{LONG}\n````", 1), (f"```\n{LONG}", 1),
]


@pytest.mark.parametrize(("text", "count"), CASES)
def test_blocks(text, count):
    assert md.content_blocks_of(text, 40, "PLACE") == count


def test_column_and_function_agree(spark):
    texts = [t for t, _ in CASES] + [f"{LONG}\n \n\n{LONG}\n", f"\n\n{LONG}", f"a\r\n\r\n{LONG}", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", md.content_blocks(F.col("t"), "PLACE").alias("n"))
    for r in df.collect():
        assert r.n == (None if r.t is None else md.content_blocks_of(r.t, 40, "PLACE")), r.t
