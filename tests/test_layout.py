"""Lines of tables, recognised words, captions and nested JSON on literal cases."""

import random

from pyspark.sql import functions as F

from docscope.functions import captions as P
from docscope.functions import key_search as K
from docscope.operators import ocr
from docscope.operators import table_lines as L


def flags(spark, column, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_lines(spark):
    number = lambda c: L.caption_number(c, F.lit("1. Next"))
    given = ["Table 3. Masses", "table iv Codes", "Table 2 shows it", "Table A.1 Sizes", "Table 5", "Table 6: x", "Table 7 below", "A Table 1", "Table 8 Of mass"]
    assert flags(spark, number, given) == ["3", "iv", None, "A.1", None, None, None, None, None]
    assert flags(spark, L.is_stop, ["Fig. 3 x", "3.1 Data", "J. Doe et al.", "see doi.org/1", "Funding by", "10.5 20", "Next, we"]) == [True] * 5 + [False, True]
    assert flags(spark, L.holds_data, ["", "a b", "abc", "x 1", "Words that are long enough to make this line of many letters into prose here"]) == [False, True, False, True, False]
    assert flags(spark, L.is_sentence, ["short", "As shown in the upper part of it", "a b c d e f g h i j k l m n o p q", "mean of all values that were measured twice daily"]) == [False, True, False, True]
    assert flags(spark, L.continues_table, ["", "one two", "alpha beta gamma delta.", "Fig. 1 x", "1.5 2.5."]) == [True, True, False, False, True]


def test_clean_parts(spark):
    df = spark.createDataFrame([("Table 1. A long caption of the values here\nThe text goes on",), ("Table 1 x\nFig. 2 y",), ("",), (None,)], "c string")
    got = [tuple(r[0]) for r in df.select(L.clean_caption(F.col("c"))).collect()]
    assert got == [
        ("Table 1. A long caption of the values here", ["caption_body_leakage_removed"]), ("Table 1 x", ["caption_cut_at_next_block"]), ("", ["empty_caption"]), ("", ["empty_caption"]),
    ]
    prose = "Here all of the samples were found good and stable over time"
    bodies = ["a 1\nAccepted 3 May\nb 2\n" + prose + "\nc 3", "a 1\nReferences\nAccepted", "", None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(b,) for b in bodies], "c string").select(L.clean_body(F.col("c"))).collect()]
    assert got == [("a 1\nb 2", ["removed_header_footer_line", "removed_trailing_prose"]), ("a 1", ["cut_at_non_table_block"]), ("", []), ("", [])]


def test_tables_of_pages(spark):
    first = "Intro\nTable 1. Water of the samples\nSample Mass\nA1 10.2\n\nA3 9.8\nThe results show that the mass of each sample was constant.\nMore"
    second = "TABLE 1 Continued\nB1 10.9\nB2 12.0\ncontinued on next page\n7\nFig. 3 A plot\nTable 4. Alone\nReferences"
    rows = [(1, 1, first), (1, 2, second), (1, 3, second), (2, 1, None), (3, 1, ""), (4, 1, "table talk"), (None, 1, first)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    blocks = sorted((r.page, r.num, r.text, r.caption_only) for r in L.table_blocks(pages).where("doc_id is not null").collect())
    assert blocks[0] == (1, "1", "Table 1. Water of the samples\nSample Mass\nA1 10.2\n\nA3 9.8", False)
    assert blocks[1:3] == [(2, "1", "TABLE 1 Continued\nB1 10.9\nB2 12.0", False), (2, "4", "Table 4. Alone", True)] and len(blocks) == 5
    got = sorted(L.tables_of_pages(pages).collect(), key=lambda r: r.num)
    assert [(r.doc_id, r.num, r.page, r.body, r.caption_only) for r in got] == [
        (1, "1", 1, "Sample Mass\nA1 10.2\nA3 9.8\nB1 10.9\nB2 12.0", False), (1, "4", 2, "", True),
    ]
    assert not got[0].low_confidence and got[1].low_confidence and got[0].text.startswith("Table 1. Water of the samples\nSample Mass")
    assert L.tables_of_pages(pages.limit(0)).count() == 0


def test_grid(spark):
    words = [(10.0, 0.0, 10.0, "a"), (110.0, 1.0, 10.0, "b"), (10.0, 20.0, 10.0, "c"), (112.0, 21.0, 10.0, "d"), (300.0, 40.0, 10.0, "e"), (10.0, 40.0, 10.0, "f")]
    want = ("a | b\nc | d\nf |  | e", 0.62, [])
    assert ocr.grid(words) == want and ocr.grid(random.Random(1).sample(words, 6)) == want
    assert ocr.grid([]) == ("", 0.0, ["no_ocr_words"])
    apart = [(50.0 * k + j, 0.0, 9.0, "x") for k in range(14) for j in (0, 1)]
    assert ocr.grid(apart)[2] == ["many_column_anchors", "few_rows"]
    df = spark.createDataFrame([("p", 1, *w) for w in words] + [("q", 1, None, None, None, " "), (None, 2, 1.0, 1.0, 1.0, "x")], "k string, page int, x double, y double, h double, text string")
    got = {(r.k, r.page): (r.markdown, r.structure) for r in ocr.table_grids(df, "k", "page").collect()}
    assert got == {("p", 1): (want[0], 0.62), ("q", 1): ("", 0.0), (None, 2): ("x", 0.24)}


def test_captions_cut(spark):
    long = "Figure 1. " + "word " * 70 + "end. " + "tail " * 40
    shown = "Figure 1. " + "word " * 50 + "; As shown in Fig. 2 " + "tail " * 40
    flat = "x" * 500
    got = flags(spark, P.trimmed_caption, [None, " short ", long, shown, flat])
    assert got == ["", "short", "Figure 1. " + "word " * 70 + "end.", ("Figure 1. " + "word " * 50).rstrip(), "x" * 400 + "."]
    cut = flags(spark, P.sentence_cut, ["a" * 90 + "). " + "b" * 600, "c" * 700, "d"])
    assert cut == ["a" * 90 + ").", "c" * 651, "d"]
    rows = ["Figure 1. The water content of all samples\nTable 2 x", "Figure 1. The water content of all samples\nNext text", "Fig. 1 of all the samples seen References 1", None,
            "Figure 2. The content of the water in all of the samples here seen In the next part"]
    df = P.clean_captions(spark.createDataFrame(list(enumerate(rows)), "i int, c string"), "c")
    assert [r.c for r in df.orderBy("i").collect()] == [
        rows[0].split("\n")[0], rows[1].split("\n")[0], "Fig. 1 of all the samples seen", "", "Figure 2. The content of the water in all of the samples here seen",
    ]


def test_key_search(spark):
    given = ['{"a": [{"Doi": "x"}], "DOI": null}', '{"b": {"doi": "deep"}, "doi": " top "}', '[{"doi": {"k": 1}}]', "[" * 5000, "{", None, '{"doi": 0}']
    df = K.with_found(spark.createDataFrame(list(enumerate(given)), "i int, j string"), "j", "v", "doi")
    assert [r.v for r in df.orderBy("i").collect()] == ["x", "top", "{'k': 1}", "", "", "", "0"]
