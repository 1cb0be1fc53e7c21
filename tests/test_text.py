"""Cleaning, captions, equations, tables and pages on literal cases."""

from pyspark.sql import functions as F

from docscope.functions import captions as P
from docscope.functions import cleaning as C
from docscope.functions import equations as E
from docscope.operators import equations as Q
from docscope.operators import tables as T


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_cleaning(spark):
    assert C.clean("the meas- urement , of Fig .3 (  a ) 5 AE 2 ﬁne\n\n\n\nx") == "the measurement, of Fig. 3 (a) 5 ± 2 fine\n\nx"
    assert C.clean(None) == "" and C.clean_equation("a=b×c–1") == "a = b × c - 1"
    assert values(spark, C.without_markers, ["T a g g e d End text Tagged P now", None]) == ["text now", None]
    got = C.cleaned(spark.createDataFrame([("a , b",), (None,)], "t string"), "t").collect()
    assert [r.t for r in got] == ["a, b", ""]


def test_captions(spark):
    got = values(spark, P.caption_quality, ["", None, "two words", "a good caption of many words here", "In this paper we see many things now"])
    assert [(r.status, r.reasons) for r in got] == [("missing", ["empty_caption"])] * 2 + [
        ("suspicious", ["very_short_caption"]), ("good", []), ("suspicious", ["possible_body_text_leakage"]),
    ]
    none = F.lit(None).cast("string")
    one = spark.range(1).select(
        P.figure_placeholder(F.lit("3"), none, F.lit("scheme")), P.figure_placeholder(F.lit("Fig.  3"), none, F.lit("x")), P.figure_placeholder(none, F.lit("fig_09"), none),
        P.numbered_placeholder("Equation", F.lit(None).cast("int")), P.numbered_placeholder("Table", F.lit(2)),
    ).first()
    assert tuple(one) == ("[Scheme 3 here]", "[Fig. 3 here]", "[Figure fig_09 here]", "[Equation here]", "[Table 2 here]")
    merged = spark.createDataFrame([(1, "Noise SUPPLEMENTAL FIGURE S7 first one. SUPPLEMENTAL FIGURE S8 second; Figure S7 x"), (2, None)], "i int, c string")
    got = sorted((r.at, r.id, r.caption) for r in P.split_captions(merged, "c", "i").collect())
    assert got == [(0, "fig_S7", "SUPPLEMENTAL FIGURE S7 first one"), (1, "fig_S8", "SUPPLEMENTAL FIGURE S8 second")]
    long = "A whole caption of the figure that says what it shows in full"
    own = [(1, 1, "Figure 1", "Fig"), (1, 2, "Figure 2", long + " and more than that"), (1, 3, "x", "keep"), (1, 4, "Figure 4", "Fig")]
    tei = [(1, "Fig. 1", long), (1, "Fig. 1", long[:50]), (1, "Fig. 2", long), (1, "Fig. 4", "A caption that is cut off, for details see")]
    got = P.enriched_captions(spark.createDataFrame(own, "doc_id long, n int, label string, caption string"), spark.createDataFrame(tei, "doc_id long, label string, caption string"))
    assert [(r.n, r.caption, r.caption_source) for r in got.orderBy("n").collect()] == [
        (1, long, "tei_enriched"), (2, long + " and more than that", "own"), (3, "keep", "own"), (4, "Fig", "own"),
    ]
    text = spark.createDataFrame([(1, 0, "before The (big)\n one . after The (big) one."), (2, 0, "x")], "doc_id long, ord int, text string")
    fig = spark.createDataFrame([(1, 1, "Figure 1", "figure", "The (big) one."), (1, 2, "Table 1", "table", "after")], "doc_id long, n int, label string, type string, caption string")
    got = sorted((r.doc_id, " ".join(r.text.split()), r.removed) for r in P.without_caption_text(text, fig).collect())
    assert got == [(1, "before [Figure 1 here] after The (big) one.", 1), (2, "x", 0)]


def test_equation_text(spark):
    assert values(spark, E.printed_number, ["a=b (3) c (12)", "x 7", "none", None]) == [12, 7, None, None]
    got = values(spark, E.reject_reasons, ["", "ab", "E = m c^2 (1)", "Mean SD 3 4", "all of these words have been written without any signs at all here"])
    assert [(r.rejected, r.reasons) for r in got] == [
        (True, ["empty_formula_text"]), (True, ["too_short"]), (False, []), (True, ["table_like_words"]), (True, ["long_prose_without_math_symbols", "sentence_like_formula"]),
    ]
    got = values(spark, lambda x: E.confidence(x, x, F.lit(False)), ["E = m c (1)", "f(x = 2 + a", "alpha = beta + 3"])
    assert [r.status for r in got] == ["clean", "needs_review", "needs_review"] and got[1].reasons == ["unbalanced_parentheses"]
    assert values(spark, E.numbered_parts, ["a = b (1) c = d (2) tail", "a = b (1)", "a (1) b (2) c = d", ""]) == [["a = b (1)", "c = d (2)"], ["a = b (1)"], ["a (1)", "b (2)", "c = d"], []]
    assert values(spark, E.is_fragment, ["", "( )", "(3a)", "x", "=+", "a = b"]) == [True, True, True, False, True, False]


def test_equations(spark):
    rows = [(1, 0, 1, "a = (b + c", 1), (1, 0, 2, ") (4)", 1), (1, 0, 3, "x = y (5) z = w (6)", 2), (1, 1, 5, "x = y (5)", None), (1, 1, 6, "p = q + r", None), (1, 2, 7, "])", 1), (1, 2, 8, "Mean SD", 1)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, id int, raw string, page int")
    merged = {r.id: (r.raw, r.merged_from, r.unmerged) for r in Q.merged_fragments(df).collect()}
    assert merged[1] == ("a = (b + c ) (4)", [1, 2], False) and 2 not in merged and merged[7][2]
    got = [(r.equation_id, r.num, r.clean, r.confidence, r.placeholder) for r in Q.extracted(df).orderBy("equation_id").collect()]
    assert got == [
        ("eq001", 4, "a = (b + c) (4)", "repaired", "[Equation 4 here]"), ("eq002", 5, "x = y (5)", "repaired", "[Equation 5 here]"),
        ("eq003", 6, "z = w (6)", "repaired", "[Equation 6 here]"), ("eq004", None, "p = q + r", "needs_review", "[Equation 4 here]"),
    ]
    assert tuple(Q.stats(Q.extracted(df)).first()) == (1, 4, 0, 3, 1, 1)


def test_tables(spark):
    assert values(spark, T.table_number, ["s 3", "A.1", " ii", None]) == ["S3", "A1", "II", ""]
    assert values(spark, T.table_numbers, ["Table 1 and Table S 2; Tables 3-5, Tables 7 and 9", "Tables 3-99", None]) == [["1", "S2", "3", "4", "5", "7", "9"], [], []]
    assert [r.value for r in values(spark, T.table_order, ["3", "S1", "A2", "3b", "IV", "?", None])] == [3.0, 2001.0, 1002.0, 3.02, 4.0, 9999.0, 9999.0]
    assert values(spark, T.markdown, [[["a", "b|c"], ["1"]], []], "array<array<string>>") == ["| a | b\\|c |\n| --- | --- |\n| 1 |  |", ""]
    rows = [(1, 0, "2", "txt b", "c", 1, True), (1, 1, "1", "txt a", "c", 1, False), (1, 2, "2", "TXT B", "c", 3, True), (1, 3, None, "", "", 1, True)]
    docs = T.table_documents(spark.createDataFrame(rows, "doc_id long, at int, num string, raw string, caption string, page int, recovered boolean"))
    assert sorted((r.table_id, r.num) for r in docs.collect()) == [("table01", "1"), ("table02", "2")]
    expected = T.expected_tables(spark.createDataFrame([(1, "Tables 1-4"), (1, "Table 2")], "doc_id long, text string"))
    assert tuple(T.table_totals(docs, expected).first()) == (1, 2, 4, 3, 3)
    found = spark.createDataFrame([(1, 1, 3, "Table 1. x", "b1"), (1, 2, 5, "y", "b2")], "doc_id long, at int, page int, caption string, box string")
    wanted = spark.createDataFrame([(1, "t1", "1", 4), (1, "t2", "7", 5), (1, "t3", "8", 6)], "doc_id long, table_id string, num string, page int")
    assert sorted((r.table_id, r.box, r.box_page) for r in T.table_boxes(wanted, found).collect()) == [("t1", "b1", 3), ("t2", "b2", 5), ("t3", None, 6)]


def test_pages(spark):
    pages = [(1, 1, "Nothing in Table 2 here"), (1, 2, "Table 2. Caption. The  value of x = 5 in the end of it all is good"), (1, 3, "Table 2 again")]
    pages = spark.createDataFrame(pages, "doc_id long, page int, text string")
    got = T.caption_page(pages, spark.createDataFrame([(1, "2"), (1, "9")], "doc_id long, num string"))
    assert sorted((r.num, r.page) for r in got.collect()) == [("2", 2), ("9", None)]
    asked = [(1, 1, "the value of x = 5 in the"), (1, 2, "zzz value of x = 5 in the qq"), (1, 3, "short"), (2, 4, "the value of x = 5 in the")]
    got = T.page_of_text(spark.createDataFrame(asked, "doc_id long, id int, text string"), pages)
    assert sorted((r.id, r.page) for r in got.collect()) == [(1, 2), (2, 2), (3, None), (4, None)]
    got = values(spark, T.box_of_regions, ["2,1,1,3,3;2,5,0,1,2;3,0,0,9,9", "", None])
    assert tuple(got[0]) == (2, 1.0, 0.0, 5.0, 4.0) and got[1:] == [None, None]
