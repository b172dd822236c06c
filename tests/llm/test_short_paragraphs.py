"""Lines from one full shingle on are deduplicated."""

from palimpsest.llm import paragraphs


def test_short_lines(spark):
    line = "one two three four five"
    long = " ".join(f"w{k}" for k in range(19))
    near = long.replace("w18", "other")
    df = spark.createDataFrame([(1, f"{line}\nfour words are few"), (2, f"{line.upper()}\nfour words are few"), (3, long), (4, near), (5, "one two three four six")], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.first_doc_id, r.removed) for r in paragraphs.near_paragraphs(df).collect()}
    assert got == {(1, 0): (1, False), (1, 1): (1, False), (2, 0): (1, True), (2, 1): (2, False), (3, 0): (3, False), (4, 0): (3, True), (5, 0): (5, False)}
