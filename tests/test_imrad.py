"""Headings, the labelling of sections, mentions and the assignment of figures on hand-made papers."""

from pyspark.sql import functions as F

from docscope.functions import headings as H
from docscope.operators import imrad, mentions

HEADINGS = {
    "introduction": ["Introduction", "Background"],
    None: ["Related Work", "Previous studies", "Theoretical background", "System Description", "Acknowledgments", "Cyclic voltammetry", "x = y", "", None],
    "methods": ["Materials and Methods", "2.1. Data & Methods", "Evaluation metrics", "IV. Sample preparation:", "Methods and Results"],
    "results": [
        "Results", "Experimental Results", "Results and Discussion", "XRD", "XPS", "Differential pulse voltammetry (DPV)",
        "Sensing mechanism for heavy metal ion detection", "Interference/selectivity with other heavy metal ions",
        "Reproducibility and stability of modified electrode", "Practical implication of electrochemical sensor in real water samples",
        "Material characterization of sensor XRD", "Structural and morphological chemistry", "Overall survival",
    ],
    "discussion": ["Discussion", "Conclusion", "Discussion, implications, and limitations", "Future work"],
}
SECTIONS = "doc_id long, ord int, heading string, text string, imrad string"
PAPER = [
    (1, 0, "Introduction", "intro. see Fig. 1 and Figs. 5 and 6", None, 1), (1, 1, "Methods and data", "as in Figure 2, Figures 2-4 show", None, 2),
    (1, 2, "Results", "Table 3 and Figure 3", "results", 4), (1, 3, "Discussion", "A long caption of the sixth figure stands here: Fig. 8", "discussion", 7),
    (1, 4, "References", "Figure 9", None, 9),
]
FIGURES = [
    (1, 1, "Figure 1", "figure", "", 1), (1, 2, "Figure 2", "figure", "", 3), (1, 3, "Figure 3", "figure", "", 5),
    (1, 4, "Figure 8", "figure", "A long caption of the sixth figure stands here: Fig. 8", 8), (1, 5, "Figure 8", "figure", "", 0), (1, 6, "", "scheme", "", None),
]


def paper(spark):
    sections = spark.createDataFrame(PAPER, SECTIONS + ", page int")
    return sections, spark.createDataFrame(FIGURES, "doc_id long, n int, label string, type string, caption string, page int")


def test_headings(spark):
    df = spark.createDataFrame([(h, k) for k, v in HEADINGS.items() for h in v], "h string, want string")
    got = df.select("h", "want", H.classify(F.col("h")).alias("c"), H.classify(F.col("h"), True)["label"].alias("fixed")).collect()
    assert [(r.h, r.c.label) for r in got if r.c.label != r.want] == []
    assert next(r.fixed for r in got if r.h == "Cyclic voltammetry") == "results"
    by = {r.h: r.c for r in got}
    assert (by["Results and Discussion"].secondary, by["Methods and Results"].secondary, by["Related Work"].source) == ("discussion", "results", "excluded")
    assert (by["Background"].confidence, by["Evaluation metrics"].confidence, by["XRD"].reason) == (0.75, 0.85, "characterization_technique_heading")
    words = ["Results and discussion", "Study area", "Drug release", "Limitations", "Odd"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(H.builder_category(F.col("w"))).collect()
    assert [r[0] for r in got] == ["results_discussion", "methods", "results", "discussion", None]


def test_labelling(spark):
    long = "We propose a method. The aim is a challenge and an important problem. " * 8
    code = "\n".join(f"value{i} = {i};" for i in range(8))
    rows = [
        (1, 0, "", long, None), (1, 1, "2. Methods", "we used a model", None), (1, 2, "2.1 Sensor parts", "x", None), (1, 3, "Odd", "y 3. Results", None),
        (1, 4, "Strange", "z", None), (1, 5, "Results/Discussion", "z", None), (1, 6, "References", "r", None),
        (2, 0, "Methods", "m", None), *((2, i, "Part", "p", None) for i in range(1, 6)), (2, 6, "Listing", code, None), (2, 7, "Kept", "t", "discussion"),
    ]
    labelled = imrad.enrich(spark.createDataFrame(rows, SECTIONS))
    got = {(r.doc_id, r.ord): (r.imrad, r.imrad_source, r.imrad_confidence) for r in labelled.collect()}
    assert [got[1, i] for i in range(7)] == [
        ("introduction", "content_position_fallback", 0.62), ("methods", "heading_exact", 1.0), ("methods", "numbered_parent_inheritance", 0.78),
        ("methods", "propagation", 0.5), ("results", "implicit_numbered_heading", 0.72), (None, "excluded", 0.0), (None, "excluded", 0.0),
    ]
    assert [got[2, i][1] for i in range(8)] == ["heading_exact", *["propagation"] * 4, "none", "none", None]
    report = {r.doc_id: r for r in imrad.report(labelled).collect()}
    assert (report[1].found, report[1].missing, report[1].complete) == (["introduction", "methods", "results"], ["discussion"], False)
    assert (report[1].heading_classified, report[1].fallback_classified, report[1].excluded, report[1].methods_ord) == (1, 3, 2, 1)
    assert report[1].source_counts["propagation"] == 1 and report[2].found == ["methods", "discussion"]
    assert imrad.enrich(spark.createDataFrame([], SECTIONS)).count() == 0


def test_effective_and_kept(spark):
    sections, _ = paper(spark)
    more = spark.createDataFrame([(2, 0, "References", " ", "methods", 1), (2, 1, "Odd", "x", None, 1), (2, 2, "Funding", "y", None, 1), (2, 3, "3.2  Even", "z", None, 1)], sections.schema)
    got = {(r.doc_id, r.ord): (r.effective, r.key) for r in imrad.effective(sections.union(more)).collect()}
    assert got[1, 1] == ("methods", "methods") and got[1, 4] == (None, "references")
    assert [got[2, i] for i in range(4)] == [("methods", "methods"), ("methods", "methods"), (None, "funding"), (None, "even")]
    assert sorted((r.ord, r.heading) for r in imrad.kept_sections(more).collect()) == [(0, "Odd"), (1, "Funding"), (2, "3.2  Even")]
    first = spark.createDataFrame([(1, 0, " ", "t", None), (2, 0, "H", "t", None), (3, 0, None, "", None)], SECTIONS)
    assert sorted((r.doc_id, r.heading, r.imrad) for r in imrad.rescue_first(first).collect() if r.doc_id < 3) == [(1, "Introduction", "introduction"), (2, "H", None)]


def test_figures(spark):
    sections, figures = paper(spark)
    got = {r.n: (r.figure_id, r.assigned_section, r.assignment_method) for r in mentions.assign_sections(figures, sections).collect()}
    assert got == {
        1: ("fig_01", "introduction", "mention_based"), 2: ("fig_02", "methods", "mention_based"), 3: ("fig_03", "methods", "mention_based"),
        4: ("fig_08", "discussion", "page_proximity"), 5: ("fig_08b", "introduction", "page_proximity"), 6: ("scheme_unlabeled_06", None, "unassigned"),
    }
    counts = {(r.ord, r.key): r.n for r in mentions.mention_counts(sections).collect()}
    assert counts[0, "figure::5"] == 2 and counts[0, "figure::6"] == 1 and counts[1, "figure::2"] == 2 and counts[1, "figure::4"] == 1
    missing = sorted(r.key for r in mentions.missing(sections, figures).collect())
    assert missing == ["figure::4", "figure::5", "figure::6", "figure::9", "table::3"]
    keys = spark.createDataFrame([(["figure::3", "figure:S:4", "figure::12"],)], "k array<string>")
    assert keys.select(mentions.plain_numbers(F.col("k"))).first()[0] == [3, 12]


def test_prompts(spark):
    rows = [
        (1, 0, "Overview", "a" * 130, None, None), (1, 1, "Cell culture", "b", None, None), (1, 2, "Findings", "c" * 100, "discussion", None),
        (2, 0, "P", "d" * 130, None, None), (2, 1, "Q", "e" * 90, None, None), (2, 2, "Gel assay", "f" * 90, None, None), (2, 3, "Gel assay", "f" * 90, None, None),
    ]
    groups = imrad.prompt_groups(spark.createDataFrame(rows, SECTIONS + ", imrad_secondary string"))
    got = {(r.doc_id, r.label): (r.text, r.n_blocks, r.note) for r in groups.collect()}
    assert got[1, "discussion"][2] == "kept_parser_label_despite_heading_override" and got[1, "methods"] == ("Heading: Cell culture\nText: b", 1, "")
    assert got[2, "introduction"][2] == "borrowed_intro_or_first_substantial_section" and got[2, "results"][1:] == (1, "borrowed_result_like_sections")
    assert got[2, "methods"][2] == got[2, "discussion"][2] == "final_order_based_fallback_existing_text" and "Q" in got[2, "methods"][0]
    papers = spark.createDataFrame([(1, "d", "t", "a"), (2, "", "t", "a"), (3, "d", "t", "a")], "doc_id long, doi string, title string, abstract string")
    built = {r.doc_id: (r.status, r.prompt) for r in imrad.prompts(papers, groups, "{doi}|{title}|{methods_text}").collect()}
    assert built == {1: ("valid", "d|t|Heading: Cell culture\nText: b"), 2: ("missing_doi", None), 3: ("missing_fulltext_imrad_json", None)}
