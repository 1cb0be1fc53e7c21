"""The label parser on the rows of FIXTURES B2, and on further spellings."""

from docscope.operators import papers

ROWS = {
    "Figure 3": ("fig_03", "figure::3"), "Fig. 3": ("fig_03", "figure::3"), "FIGURE 1": ("fig_01", "figure::1"), "Fig. 1a": ("fig_01", "figure::1"),
    "FIGURE 4 LV function of SHRs": ("fig_04", "figure::4"), "Supplemental Figure S8": ("fig_S8", "figure:S:8"),
    "Supplementary Figure 8": ("fig_S8", "figure:S:8"), "SUPPLEMENTary Fig. S12": ("fig_S12", "figure:S:12"), "Fig. S1": ("fig_S1", "figure:S:1"),
    "Figure A1": ("fig_A1", "figure:A:1"), "Fig. A.1": ("fig_A_1", "figure:A:1"), "Appendix Figure A.1": ("fig_A_1", "figure:A:1"),
    "Extended Data Figure 3": ("fig_E3", "figure:E:3"), "Table 2": ("table_02", "table::2"), "Table S2": ("table_S2", "table:S:2"),
    "Sch. 2": ("scheme_02", "scheme::2"), "Scheme 1": ("scheme_01", "scheme::1"), "Figure 2 (continued)": ("fig_02", "figure::2"), "Feng": None,
    "Appendix Figure 1": ("fig_A1", "figure:A:1"), "Tab. 2": ("table_02", "table::2"), "Suppl. Fig 4": ("fig_S4", "figure:S:4"), "Figure 01": ("fig_01", "figure::1"),
}


def test_labels(spark):
    df = spark.createDataFrame([(k,) for k in ROWS], "label string")
    got = {r.label: r.x and (r.x.id, r.x.key) for r in df.select("label", papers.parsed_label("label").alias("x")).collect()}
    assert got == ROWS
    assert df.where("label = 'Fig. 1a'").select(papers.parsed_label("label")["panel"]).first()[0] == "a"
