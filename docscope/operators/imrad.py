"""Labels of a paper's sections: headings, embedded and numbered headings, propagation, content; reports and prompt groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import headings as H
from docscope.functions.rules import is_code_block
from docscope.plans.shipping import ship_package

#: A label is carried over so many sections; content scores that a label needs, with the confidence given.
DEPTH = 4
CONTENT_NEEDED = {"introduction": (1.5, 0.62), "methods": (2.5, 0.65), "results": (1.2, 0.63), "discussion": (1.5, 0.60)}
LEAST_CONTENT = 250
WEAK = ("none", "unknown", "unclassified", "propagation", "content_position_fallback")
HEADING_SOURCES = ("heading_exact", "heading_synonym", "combined_section", "heading_characterization")
RESULTS_NEXT = r"(?i)(?:^|\n|\s)(?:3|4)\.\s*Results?\s*$"
DISCUSSION_NEXT = r"(?i)(?:^|\n|\s)(?:4|5)\.\s*(?:Discussion|Conclusions?)\s*$"
LABELLED = (
    "doc_id long, ord int, imrad string, imrad_secondary string, imrad_source string, imrad_confidence double, imrad_reason string, "
    "section_role string, secondary_source string, step string"
)


def _facts(sections: DataFrame) -> Column:
    """What the labelling needs of a section, all of it column expressions."""
    h, text = F.col("heading"), F.col("text")
    tail = F.substring(F.coalesce(text, F.lit("")), -300, 300)
    number = lambda i: F.regexp_extract(F.coalesce(h, F.lit("")), r"^\s*(\d+)(\.\d+|\.|\s)", i)
    return F.struct(
        F.col("ord").cast("int").alias("ord"), H.classify(h).alias("found"), H.is_outside(h).alias("outside"),
        H.is_back_matter(h).alias("back"), H.is_related_work(h).alias("related"), is_code_block(text).alias("code"),
        F.col("imrad").alias("label"), F.when(tail.rlike(RESULTS_NEXT), "results").when(tail.rlike(DISCUSSION_NEXT), "discussion").alias("next"),
        F.length(H.stripped(text)).alias("size"), F.array(*(H.content_hits(text, c) for c in H.LABELS)).alias("hits"),
        F.expr("try_cast(regexp_extract(coalesce(heading, ''), '^\\\\s*([0-9]+)(\\\\.|\\\\s)', 1) as int)").alias("major"),
        number(2).rlike(r"^\.\d").alias("child"),
    )


class _Section:
    """One section while its paper is labelled."""

    def __init__(self, facts: dict) -> None:
        self.f, self.label = facts, facts["label"]
        self.secondary = self.secondary_source = self.source = self.reason = self.role = self.step = None
        self.confidence: float | None = None

    def leave_out(self, reason: str) -> None:
        self.role = "related_work" if self.f["related"] else self.role or "body"
        self.label = self.secondary = self.secondary_source = None
        self.source, self.confidence = "excluded", 0.0
        self.reason = "related_work_excluded_from_imrad" if self.f["related"] else reason

    def default(self, source: str, confidence: float, reason: str) -> None:
        if self.source is None:
            self.source, self.confidence, self.reason = source, confidence, reason

    def give(self, label: str, source: str, confidence: float, reason: str, over: bool = True) -> bool:
        """Gives a label unless the section is left out, is code, or has one that must stay."""
        if self.f["back"] or self.f["outside"]:
            self.leave_out("back_matter_excluded" if self.f["back"] else "non_imrad_heading_excluded")
        elif self.f["code"]:
            self.default("none", 0.0, "code_block_excluded")
        elif self.label and not over:
            self.default("existing", 0.70, "existing_label_from_parser")
        else:
            self.label, self.source, self.confidence, self.reason = label, source, confidence, reason
            return True
        return False

    def weak(self) -> bool:
        return not self.label or (self.source or "") in WEAK or (self.confidence or 0.0) < 0.6


def _first(sections: list[_Section], label: str) -> int | None:
    return next((i for i, s in enumerate(sections) if label in (s.label, s.secondary)), None)


def _lacks(sections: list[_Section], label: str) -> bool:
    return not any(label in (s.label, s.secondary) for s in sections if not s.f["related"])


def _embedded(sections: list[_Section]) -> None:
    """A heading at the very end of a text labels the sections after it."""
    pending = None
    for s in sections:
        if pending and s.weak() and not s.f["outside"]:
            s.step = "fallback" if s.give(pending, "implicit_numbered_heading", 0.72, f"inherited_after_embedded_{pending}_heading") else s.step
        pending = s.f["next"] or ("discussion" if s.label == "discussion" else pending)


def _numbered(sections: list[_Section]) -> None:
    """Sections numbered 2.1 take the label of section 2, the last one if there are several."""
    parents = {s.f["major"]: s.label for s in sections if s.f["major"] is not None and not s.f["child"] and s.label in H.LABELS and not s.f["outside"]}
    for s in sections:
        if not s.f["child"]:
            continue
        major = s.f["major"]
        if s.f["outside"] or s.f["related"]:
            s.leave_out("non_imrad_numbered_heading_excluded")
        elif (label := parents.get(major)) and s.weak():
            s.step = "fallback" if s.give(label, "numbered_parent_inheritance", 0.78, f"inherited_from_numbered_parent_{major}") else s.step


def _carried(sections: list[_Section]) -> None:
    """Labels that headings gave go on to at most DEPTH sections without one; the introduction's does not."""
    label, n = None, 0
    for s in sections:
        if s.label in H.LABELS:
            if s.source in HEADING_SOURCES:
                label, n = (s.label if s.label != "introduction" else None), 0
        elif label and n < DEPTH:
            own = s.f["found"]
            if own["label"] and own["label"] != label:
                s.give(own["label"], own["source"], own["confidence"], own["reason"])
                label, n = (own["label"], 0) if own["label"] != "introduction" else (None, n)
                continue
            n += 1
            s.give(label, "propagation", 0.50, f"propagated_from_{label}_depth_{n}")
        else:
            label, n = None, 0


def _by_content(sections: list[_Section]) -> None:
    """A label that is still missing goes to the section in its place whose text scores highest."""
    n = len(sections)
    at = {c: _first(sections, c) for c in H.LABELS}
    for k, label in enumerate(H.LABELS):
        if not _lacks(sections, label):
            continue
        intro, methods, results, discussion = (at[c] for c in H.LABELS)
        if label == "introduction":
            places = range(min(2, n))
        elif label == "methods":
            start = 0 if intro is None else intro + 1
            ends = [x for x in (results, discussion) if x is not None and x > start]
            places = range(start, min(ends) if ends else min(n, start + 5))
        elif label == "results":
            start = max((x for x in (methods, intro) if x is not None), default=-1) + 1
            places = range(start, discussion if discussion is not None and discussion > start else n)
        else:
            places = range(max(0, n - 3), n)
        least, confidence = CONTENT_NEEDED[label]
        fit = [
            i for i in places
            if not (sections[i].f["outside"] or sections[i].f["related"] or sections[i].f["code"])
            and (sections[i].label not in H.LABELS or sections[i].weak()) and sections[i].f["size"] >= LEAST_CONTENT and sections[i].f["hits"][k] > 0
        ]
        best = max(fit, key=lambda i: (sections[i].f["hits"][k], -i), default=None)
        if best is not None and (score := sections[best].f["hits"][k]) >= least:
            short = "intro" if label == "introduction" else label
            if sections[best].give(label, "content_position_fallback", confidence, f"{short}_content_score={score:.2f}"):
                sections[best].step = "fallback"
        if label in ("introduction", "methods", "results"):
            at[label] = _first(sections, label)


def label_paper(facts: list[dict]) -> list[_Section]:
    """The sections of one paper, in order, with their labels."""
    sections = [_Section(f) for f in facts]
    for s in sections:
        if s.f["outside"]:
            s.leave_out("non_imrad_heading_excluded")
    for s in sections:
        own = s.f["found"]
        if own["label"]:
            s.step = "heading" if s.give(own["label"], own["source"], own["confidence"], own["reason"], over=False) else s.step
        if own["secondary"]:
            s.secondary, s.secondary_source = own["secondary"], own["source"]
        if not s.label:
            s.default("none", 0.0, "unclassified")
    for step in (_embedded, _numbered, _carried, _by_content):
        step(sections)
    return sections


def enrich(sections: DataFrame) -> DataFrame:
    """doc_id, ord, imrad, imrad_secondary, imrad_source, imrad_confidence, imrad_reason, section_role, step of every section.

    ``sections`` has doc_id, ord, heading, text, imrad (a parser's label or null). Patterns are matched by column
    expressions; a paper's sections then meet in one row, and the order-dependent steps run over it in Arrow batches.
    """
    ship_package(sections.sparkSession)
    papers = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(_facts(sections))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LABELLED.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.string()] * 3, pa.float64(), *[pa.string()] * 4]
        for b in batches:
            rows = [
                (d, s.f["ord"], s.label, s.secondary, s.source, s.confidence, s.reason, s.role, s.secondary_source, s.step)
                for d, facts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in label_paper(facts)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return papers.mapInArrow(run, LABELLED)


def report(labelled: DataFrame) -> DataFrame:
    """Of each paper: labels found and missing in canonical order, complete, counts by source, steps and exclusions."""
    inside = F.coalesce(F.col("section_role") != "related_work", F.lit(True))
    given = F.array_compact(F.array(
        F.when(F.col("imrad").isin(*H.LABELS) & inside, F.struct(F.col("imrad").alias("label"), F.coalesce("imrad_source", F.lit("unknown")).alias("source"))),
        F.when(F.col("imrad_secondary").isin(*H.LABELS) & inside, F.struct(F.col("imrad_secondary").alias("label"), F.coalesce("secondary_source", F.lit("unknown")).alias("source"))),
    ))
    d = labelled.withColumn("given", given)
    per = d.groupBy("doc_id").agg(
        F.array_distinct(F.flatten(F.collect_list("given.label"))).alias("have"), F.array_sort(F.flatten(F.collect_list("given.source"))).alias("sources"),
        F.count_if(F.col("step") == "heading").alias("heading_classified"), F.count_if(F.col("step") == "fallback").alias("fallback_classified"),
        F.count_if(F.col("imrad_secondary").isNotNull()).alias("secondary_labels"), F.count_if(F.col("imrad_source") == "excluded").alias("excluded"),
        F.min(F.when(F.col("imrad") == "methods", F.struct("ord", "imrad_source", "imrad_confidence"))).alias("first_methods"),
    )
    known = F.array(*map(F.lit, H.LABELS))
    counts = F.map_from_entries(F.transform(F.array_distinct("sources"), lambda s: F.struct(s, F.size(F.filter("sources", lambda x: x == s)))))
    return per.select(
        "doc_id", F.array_intersect(known, "have").alias("found"), F.array_except(known, "have").alias("missing"),
        (F.size("have") == len(H.LABELS)).alias("complete"), counts.alias("source_counts"), "heading_classified", "fallback_classified",
        "secondary_labels", "excluded", F.col("first_methods.ord").alias("methods_ord"), F.col("first_methods.imrad_source").alias("methods_source"),
    )


def effective(sections: DataFrame) -> DataFrame:
    """doc_id, ord, effective, key: each section's own label, else a guess by its heading, else the last one before it.

    A heading outside the scheme ends the carry unless its section has a label of its own. ``key`` is the label, or
    for a section without one its heading.
    """
    h = F.coalesce("heading", F.lit(""))
    own = F.when(F.col("imrad").isin(*H.LABELS), F.col("imrad"))
    ends = own.isNull() & (h != "") & (H.is_outside(h) | h.rlike(H.FIGURE_BACK_MATTER))
    d = sections.select("doc_id", "ord", "heading", "imrad", ends.alias("ends"), F.coalesce(own, F.when(~ends, H.guess(h))).alias("label"))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A blank stands for the end of a carry.
    last = F.last(F.when(F.col("ends"), F.lit("")).otherwise(F.col("label")), ignorenulls=True).over(w)
    bare = F.regexp_replace(F.lower(H.stripped(F.col("heading"))), r"^\s*(?:\d+(?:\.\d+)*\.?|[ivxlcdm]+\.?|[a-z]\.|\([a-z0-9]+\))\s+", "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    name = F.coalesce(F.nullif("imrad", F.lit("")), F.nullif(bare, F.lit("")), F.lit("_unlabeled"))
    d = d.withColumn("effective", F.nullif(last, F.lit("")))
    return d.select("doc_id", "ord", "effective", F.coalesce("effective", name).alias("key"))


def rescue_first(sections: DataFrame) -> DataFrame:
    """``sections`` with the heading "Introduction" for a first section that has neither a heading nor a label but text."""
    blank = (F.col("ord") == 0) & (H.stripped(F.col("heading")) == "") & F.col("imrad").isNull() & (H.stripped(F.col("text")) != "")
    return sections.withColumns({"heading": F.when(blank, "Introduction").otherwise(F.col("heading")), "imrad": F.when(blank, "introduction").otherwise(F.col("imrad"))})


def kept_sections(sections: DataFrame, labelled_only: bool = False) -> DataFrame:
    """Sections with text, renumbered from 0; with ``labelled_only`` those with a label, without related work."""
    keep = H.stripped(F.col("text")) != ""
    if labelled_only:
        keep = keep & F.col("imrad").isin(*H.LABELS) & ~H.is_related_work(F.col("heading"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    return sections.where(keep).withColumn("ord", (F.row_number().over(w) - 1).cast("int"))


def section_block(heading: Column, text: Column) -> Column:
    h, t = H.normal_text(heading), H.normal_text(text)
    parts = F.array(F.when(h != "", F.concat(F.lit("Heading: "), h)), F.when(t != "", F.concat(F.lit("Text: "), t)))
    return F.array_join(F.array_compact(parts), "\n")


def prompt_groups(sections: DataFrame) -> DataFrame:
    """doc_id, label, text, n_blocks, note: the text of each of the four labels of a paper, for its prompt.

    Sections go to the labels of their heading and of their own labels. A label without any is filled by tiers, the
    first that gives something counts: headings with like words, for the introduction the first substantial section,
    and at last sections by their place. Blocks whose first 700 characters are equal come once, joined by rules.
    """
    block = section_block(F.col("heading"), F.col("text"))
    d = sections.select("doc_id", F.col("ord").cast("int").alias("ord"), block.alias("block"), H.builder_category(F.col("heading")).alias("cat"),
                        H.builder_heading(F.col("heading")).alias("h"), *(H.builder_label(F.col(c)).alias(f"own_{c}") for c in ("imrad", "imrad_secondary")))
    d = d.where("block <> ''")
    by_place = lambda least: F.when(F.length("block") >= least, F.col("ord"))
    w = Window.partitionBy("doc_id")
    d = d.withColumns({"first_120": F.min(by_place(120)).over(w), "places": F.array_sort(F.collect_list(by_place(80)).over(w))})
    many, at = F.size("places"), lambda i: F.element_at("places", i)
    place = {
        "introduction": F.when(many > 0, at(1)), "methods": F.when(many > 1, at(2)).when(many > 0, at(1)),
        "results": F.when(many > 1, at(-2)).when(many > 0, at(-1)), "discussion": F.when(many > 0, at(-1)),
    }
    own = F.array_compact(F.array("own_imrad", "own_imrad_secondary"))
    tiers = []
    for label in H.LABELS:
        both = F.col("cat").eqNullSafe(F.lit("results_discussion")) if label in ("results", "discussion") else F.lit(False)
        by_heading = both | F.col("cat").eqNullSafe(F.lit(label))
        like = F.coalesce(F.col("h").rlike(H.BUILDER_LIKE[label]), F.lit(False))
        tier = F.when(by_heading | F.array_contains(own, label), 0).when(like, 1)
        if label == "introduction":
            tier = tier.when(F.col("ord") == F.col("first_120"), 2)
        tier = tier.when(F.col("ord") == place[label], 3)
        clash = F.array_contains(own, label) & F.col("cat").isin(*H.LABELS) & (F.col("cat") != label)
        tiers.append(F.struct(F.lit(label).alias("label"), tier.alias("tier"), clash.alias("clash")))
    long = d.select("doc_id", "ord", "block", F.explode(F.array(*tiers)).alias("t")).select("doc_id", "ord", "block", "t.*").where("tier is not null")
    best = long.withColumn("best", F.min("tier").over(Window.partitionBy("doc_id", "label"))).where("tier = best")
    once = Window.partitionBy("doc_id", "label", F.substring("block", 1, 700)).orderBy("ord")
    best = best.withColumn("r", F.row_number().over(once)).where("r = 1")
    like_note = F.when(F.col("label") == "introduction", "borrowed_intro_or_first_substantial_section")
    for label, short in (("methods", "method"), ("results", "result"), ("discussion", "discussion")):
        like_note = like_note.when(F.col("label") == label, f"borrowed_{short}_like_sections")
    kept = F.when(F.max(F.coalesce(F.col("clash"), F.lit(False))), "kept_parser_label_despite_heading_override").otherwise("")
    note = F.when(F.min("tier") == 0, kept).when(F.min("tier") == 3, "final_order_based_fallback_existing_text").otherwise(F.first(like_note))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"])
    return best.groupBy("doc_id", "label").agg(F.array_join(blocks, "\n\n---\n\n").alias("text"), F.count("*").alias("n_blocks"), note.alias("note"))


def prompt_problem(doi: Column, title: Column, abstract: Column, texts: dict[str, Column], has_sections: Column) -> Column:
    """The first reason why a paper gets no prompt, or "valid"."""
    blank = lambda c: H.normal_text(c) == ""
    out = F.when(~has_sections, "missing_fulltext_imrad_json")
    for name, c in (("doi", doi), ("title", title), ("abstract", abstract), *((f"{k}_text", texts[k]) for k in H.LABELS)):
        out = out.when(blank(c), f"missing_{name}")
    return out.otherwise("valid")


def prompts(papers: DataFrame, groups: DataFrame, template: str) -> DataFrame:
    """doc_id, status, prompt: the template filled for papers (doc_id, doi, title, abstract) that have all it names.

    ``template`` has {doi}, {title}, {abstract} and {introduction_text} to {discussion_text}; a paper with something
    missing gets the reason as its status and no prompt.
    """
    wide = groups.groupBy("doc_id").agg(*(F.max(F.when(F.col("label") == k, F.col("text"))).alias(k) for k in H.LABELS), F.lit(True).alias("has"))
    d = papers.join(wide, "doc_id", "left")
    status = prompt_problem(F.col("doi"), F.col("title"), F.col("abstract"), {k: F.col(k) for k in H.LABELS}, F.coalesce("has", F.lit(False)))
    text = F.lit(template)
    values = {k: H.normal_text(F.col(k)) for k in ("doi", "title", "abstract")} | {f"{k}_text": F.coalesce(k, F.lit("")) for k in H.LABELS}
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return d.select("doc_id", status.alias("status"), F.when(status == "valid", text).alias("prompt"))


def builder_counts(built: DataFrame) -> DataFrame:
    """Papers by status of ``prompts``."""
    return built.groupBy("status").agg(F.count("*").alias("n"))
