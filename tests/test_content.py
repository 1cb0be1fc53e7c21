"""Literal fixtures of the content rules, the TEI reader and the file sources."""

import json

from pyspark.sql import functions as F

from docscope.functions import glyphs as G
from docscope.functions import rules as R
from docscope.sources import files, tei

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Other</title><title type="main">A study</title>
</titleStmt></fileDesc><profileDesc><abstract><p>One.</p><p/><p>Two.</p></abstract></profileDesc></teiHeader><text><body>
<div><head coords="2,1,1,1,1">Methods</head><p>We measured.</p><formula coords="3,1,1,1,1">a = b</formula>
<div><head>Devices</head><p>Two.</p><table><row><cell>x</cell><cell>1</cell></row></table></div></div>
<div><head>References</head><p>None.</p></div><div><p>After.</p></div>
<figure><head>Figure 1</head><figDesc>All values.</figDesc><graphic coords="4,0,0,9,9"/></figure></body>
<back><div><listBibl><biblStruct><analytic><title>Work</title><author><persName><forename>A</forename><surname>B</surname></persName>
</author></analytic><monogr><imprint><date when="2001-02"/></imprint></monogr></biblStruct></listBibl></div></back></text></TEI>"""
CODE = "total = 0;\nfor (i in rows) {\n  total = total + i;\n}\nlimit = 3;\nreturn total"


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_glyphs(spark):
    cases = {
        "\uf061\uf062": "αβ", "p \uf0a3 \uf071": "p ≤ θ", "plain": "plain", "\U0001d44e + \U0001d44f": "a + b", "\U0001d7ce\U0001d7cf": "01",
    }
    assert values(spark, G.remap_glyphs, [*cases, None]) == [*cases.values(), None]
    df = spark.createDataFrame([(1, "a\uf8e5\uf8e5\uf061"), (2, None)], "k int, t string")
    assert [tuple(r) for r in G.unmapped_glyphs(df, "k", "t").collect()] == [(1, "U+F8E5", 2)]


def test_rules(spark):
    assert values(spark, R.is_code_block, [CODE, "A sentence of prose.\n" * 9, "", None]) == [True, False, False, False]
    assert values(spark, R.is_equation_heading, ["x = y", "n + rate", "Results", None]) == [True, False, False, False]
    assert values(spark, R.is_incomplete_caption, ["", "Too short", "x" * 50, "x" * 50 + " for details see", None]) == [True, True, False, True, True]
    assert values(spark, R.caption_badness, ["��  s", None]) == [12, 0]
    got = values(spark, lambda x: R.first_path(x, "a.b", "c"), ['{"a": {"b": " "}, "c": "d"}', '{"a": {"b": "e"}}', "{", None])
    assert got == ["d", "e", "", ""]


def test_table_quality(spark):
    good = "\n".join(f"sample {i} 1.5 2.5 control treated measured value group label" for i in range(8))
    prose = "\n".join(["the measured samples show that values were found in all of the groups."] * 4)
    cases = {
        good: ("c", 0.85, False, []),
        "": ("", 0.0, True, ["empty_table_body", "missing_caption"]),
        "a 1\nb 2": ("c", 0.5, True, ["too_few_table_lines"]),
        "a 1\nb 2\nc 3": (None, 0.45, True, ["missing_caption", "very_short_recovered_table"]),
        prose: ("c", 0.35, True, ["few_data_like_lines", "possible_prose_leakage"]),
        good + "\nElsevier Table 3": ("c", 0.55, True, ["header_footer_leakage", "nested_table_caption_in_body"]),
    }
    df = spark.createDataFrame([(i, b, c[0]) for i, (b, c) in enumerate(cases.items())], "i int, b string, c string").orderBy("i")
    got = [r.q for r in df.select(R.table_quality(F.col("b"), F.col("c")).alias("q")).collect()]
    assert [(q.score, q.needs_review, q.reasons) for q in got] == [c[1:] for c in cases.values()]


def test_tei(spark):
    df = spark.createDataFrame([(1, TEI), (2, "<TEI>"), (3, None), (4, "")], "doc_id long, xml string")
    parsed = tei.parse_tei(df).orderBy("doc_id").collect()
    assert [r.parse_ok for r in parsed] == [True, False, False, False]
    p = parsed[0]
    assert (p.title, p.abstract) == ("A study", "One.\n\nTwo.")
    assert [(s.heading, s.depth, s.page) for s in p.sections] == [("Methods", 0, 2), ("Devices", 1, None), ("References", 0, None), ("", 0, None)]
    assert p.sections[0].text == "We measured.\n\n[[EQN:1]]" and p.tables[0].cells == [["x", "1"]] and p.equations[0].raw == "a = b"
    assert p.figures[0].label == "Figure 1" and p.figures[0].page == 4
    assert (p.bibliography[0].authors, p.bibliography[0].title, p.bibliography[0].year) == (["A B"], "Work", "2001")
    labels = tei.tei_sections(tei.parse_tei(df)).orderBy("ord").collect()
    assert [r.imrad for r in labels] == ["methods", "methods", None, None]


def test_files(spark, tmp_path):
    box = {"x1": 5, "y1": 2, "x2": 3, "y2": 9}
    figure = {"caption": "Scheme 1: it", "figType": "Figure", "name": "1", "page": 0, "regionBoundary": box}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "list.fig.json").write_text(json.dumps([figure]))
    (tmp_path / "a" / "object.fig.json").write_text(json.dumps({"figures": [figure, figure | {"figType": "Table"}]}))
    (tmp_path / "a" / "p_Metadata.json").write_text('{"publisher": "", "source_publisher": "P", "doi": "10/x"}')
    (tmp_path / "a" / "bad_eval.json").write_text("{")
    (tmp_path / "a" / "good_eval.json").write_text("{}")
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "index.csv").write_text("id,path\na,1\na,2\nb,3\n")
    (tmp_path / "dois.txt").write_text("d1\n\n d2 \n")
    root = str(tmp_path / "a")
    got = files.figures_json(files.texts(spark, root, "*.fig.json")).orderBy("path", "n").collect()
    assert [(r.type, r.page, r.w, r.h) for r in got] == [("scheme", 1, 0.0, 7.0), ("scheme", 1, 0.0, 7.0), ("table", 1, 0.0, 7.0)]
    assert [tuple(r)[1:] for r in files.sidecars(spark, root).collect()] == [("P", "", "10/x")]
    found = {r.doi_safe: (r.parse_ok, r.error) for r in files.json_results(spark, root, "_eval.json").collect()}
    assert found == {"bad": (False, "json_load_failed"), "good": (True, None)}
    assert files.new_pdfs(spark, root, spark.createDataFrame([], "path string")).count() == 1
    assert sorted(map(tuple, files.image_index(spark, str(tmp_path / "index.csv"), "id", "path").collect())) == [("a", "2"), ("b", "3")]
    assert [r.doi for r in files.doi_lines(spark, str(tmp_path / "dois.txt")).collect()] == ["d1", "d2"]
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([(1, None, 2)], "a int, b string, c int"), out, ["a", "b", "d"])
    assert [tuple(r) for r in files.csv_strings(spark, out).fillna("").collect()] == [("1", "", "")]
