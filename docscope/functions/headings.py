"""Headings of papers: normal forms, families of headings, the label classifier and content scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import is_equation_heading

LABELS = ("introduction", "methods", "results", "discussion")


def _any(text: str) -> str:
    """One pattern of a fixed list of patterns, one a line."""
    return "(?iu)" + "|".join(f"(?:{line.strip()})" for line in text.strip().splitlines())


# The patterns by which headings are told apart, in the order in which they are tried.
BACK_MATTER = (
    r"(?iu)\b(?:acknowledge?ments?|references?|bibliography|appendix|appendices|funding|declarations?|conflicts? of interest|"
    r"competing interests?|credit authorship|author(?:s'?)? contributions?|data availability|supplementary|supporting information|"
    r"abbreviations|nomenclature|ethics|consent|disclosure)\b"
)
RELATED_WORK = (
    r"(?iu)\b(?:related\s+works?|prior\s+works?|previous\s+studies|previous\s+works?|literature\s+review|review\s+of\s+literature|"
    r"background\s+literature|state\s+of\s+the\s+art)\b"
)
OUTSIDE = (
    r"(?iu)\b(?:related\s+works?|prior\s+works?|previous\s+studies|previous\s+works?|literature\s+review|review\s+of\s+literature|"
    r"background\s+literature|state\s+of\s+the\s+art|theoretical\s+background|conceptual\s+background|preliminaries|preliminary|"
    r"nomenclature|abbreviations?|notation|introduction\s+to\b|graph\s+theory|transportation\s+theory|"
    r"computational\s+fluid\s+dynamic\s+models?\s+for\b|review\s+of\s+software\s+tools?|"
    r"healthcare\s+processes\s+and\s+computer-interpretable\s+guidelines|application\s+of\s+bpm\s+techniques\s+in\s+healthcare)\b"
)
TECHNIQUES = (
    r"(?iu)\b(?:XRD|WAXS|SAXS|WAXD|XPS|FTIR|NMR|UV[\s-]?vis|Raman|(?:FE[\s-]?)?SEM|TEM|AFM|EDX|EDS|EELS|{stems}"
    r"electrochemical\s+impedance|EIS\b|DPV\b|CV\b|{more}DSC|TGA|DTA|structural\s+and\s+morphological|morphological\s+characterization|"
    r"surface\s+(?:topograph|morpholog)|sensing\s+mechanism|interference.*(?:selectivity|ions?)|selectivity\s+(?:test|stud)|"
    r"reproducibility\s+and\s+stability|stability\s+(?:test|of)|real\s+(?:water|sample)\s+(?:analysis|application|test)|"
    r"practical\s+implication|material\s+characterization\s+of\b)\b"
)
STEMS = (r"cyclic\s+voltammetr{0}|differential\s+pulse\s+voltammetr{0}|", r"chronoamperometr{0}|potentiometr{0}|")
COMBINED = (
    (r"(?iu)\bresults?\b.*\bdiscussion\b|\bdiscussion\b.*\bresults?\b", "results", "discussion", "combined_results_discussion", 0.95),
    (r"(?iu)\bmethods?\b.*\bresults?\b|\bresults?\b.*\bmethods?\b", "methods", "results", "combined_methods_results", 0.80),
)
EXACT = {
    "introduction": r"(?iu)^(?:introduction|intro)$",
    "methods": r"(?iu)^(?:methods?|materials? and methods?|methodology|experimental methods?|experimental section|experimental procedure)$",
    "results": r"(?iu)^(?:results?|findings?|results? and analysis|results? and performance)$",
    "discussion": (
        r"(?iu)^(?:discussion|conclusions?|summary and conclusions?|concluding remarks|concluding remarks\b.*|"
        r"conclusions? and (?:future|outlook)\b.*|summary)$"
    ),
}
EXPERIMENTAL_RESULTS = r"(?iu)\bexperimental results?\b"
EVALUATION = r"(?iu)\bevaluation setup\b|\bevaluation protocol\b|\bevaluation metric"
SYNONYM_CONFIDENCE = {"introduction": 0.75, "methods": 0.82, "results": 0.82, "discussion": 0.82}
SYNONYMS = {
    "introduction": r"(?iu)\b(?:background|motivation|objectives?|aims?|purpose|research problem|research gap)\b",
    "methods": _any(
        r"""
        \b(?:materials? and methods?|data and methods?|methodology|research methods?|experimental (?:setup|design|procedure)|study design)\b
        \b(?:data collection|method implementation|implementation details|computational fluid dynamic simulations|simulation setup)\b
        \b(?:numerical method|statistical analysis|materials? preparation|sample preparation|measurement setup|instrumentation)\b
        \bproblem (?:setup|formulation|definition)\b
        \bproposed\b.*\b(?:model|method|approach|framework|architecture)\b
        \b(?:mathematical model|system model|system design|model description|model architecture|network architecture)\b
        \b(?:dataset description|data description|data preparation|feature extraction|training procedure|training details)\b
        \bevaluation (?:metrics?|setup|protocol|methodology)\b
        \b(?:protocol\s+specification|proposed\s+scheme|proposed\s+protocol|security\s+protocol)\b
        \b(?:first|second|third|fourth)\s+part\s+of\b.*\bprotocol\b
        \b(?:protocol\s+design|security\s+analysis|analysis\s+of\s+the\s+protocol|case\s+study|network\s+model)\b
        \b(?:threats?\s+and\s+adversarial\s+model|security\s+requirements|characterization)\b
        \bpreparation of\b.*\b(?:sensor|electrode|composite)\b
        \b(?:apparatus|analytical procedure|animals?|patients?|tissue source|preparation|recording|video[- ]?EEG)\b
        \b(?:electrode implantation|classification of|induction of|co-analysis|data analysis|ethical considerations?)\b
        \b(?:power considerations?|statistical methods?)\b
        """
    ),
    "results": _any(
        r"""
        \b(?:results?|findings?)\b
        \bperformance\s+(?:evaluation|comparison|analysis)\b
        \bsensitivity\s+(?:analysis|to)\b
        \b(?:ablation\s+stud(?:y|ies)|comparative\s+analysis|comparative\s+stud(?:y|ies))\b
        \bcost\b.*\bperformance\b
        \bclassification\s+capabilities\b
        \baccuracy\b.*\banalysis\b
        \b(?:material\s+characterization|interface\s+performance|sensing\s+mechanism)\b
        \binterference\b.*\bselectivity\b
        \bselectivity\b.*\binterference\b
        \breproducibility\b.*\bstability\b
        \bstability\b.*\breproducibility\b
        \b(?:practical\s+implication|real\s+water\s+sample|real\s+sample\s+analysis)\b
        \b(?:cyclic\s+voltammetr|differential\s+pulse\s+voltammetr|electrochemical\s+impedance|preliminary study|prevalence)\b
        \b(?:number of|usv categor(?:y|ies)|acoustic properties|postictal|types of vocalizations|viscoelastic properties)\b
        \b(?:thermogravimetric analysis|mapping and quantification|histological staining|articulating surface damage)\b
        \b(?:surface roughness|quantification of|n\s*\+\s*rate|disease[- ]free survival|overall survival|survival analysis)\b
        \bpostoperative death\b
        """
    ),
    "discussion": r"(?iu)\b(?:discussion|conclusions?|implications?|limitations?|future work|concluding remarks|outlook)\b",
}
GUESSES = (
    (
        r"(?iu)\b(?:methods?\s+and\s+data|data\s+and\s+methods?|materials?\s+and\s+methods?|methodolog|experimental|\bprocedure)\b",
        "methods",
    ),
    (r"(?iu)\bresults?\b|\bfindings?\b", "results"),
    (r"(?iu)\bdiscussion\b|\bconclusion", "discussion"),
    (r"(?iu)\bintroduction\b|\bbackground\b", "introduction"),
)
FIGURE_BACK_MATTER = (
    r"(?iu)\b(?:references?|bibliography|appendix|appendices|acknowledge?ments?|supplementary|supporting\s+information|funding|"
    r"declarations?|author(?:s'?)?\s+contributions?|data\s+availability|competing\s+interests?|conflicts?\s+of\s+interest)\b"
)
CONTENT = {
    "introduction": (
        r"\bwe (?:propose|present|introduce|investigate|study|examine)\b", r"\bthe aim\b", r"\bthe objective\b", r"\bchallenge\b",
        r"\bproblem\b", r"\bmotivat", r"\brecent(?:ly)?\b", r"\bimportant\b",
    ),
    "methods": (
        r"\bwe (?:use|used|employ|employed|develop|developed|implement|implemented|train|trained|construct|constructed)\b",
        r"\bdataset\b", r"\bdata set\b", r"\bmodel\b", r"\balgorithm\b", r"\bparameter\b", r"\bprotocol\b", r"\bexperiment\b",
        r"\bsimulation\b", r"\bmeasurement\b", r"\btraining\b", r"\boptimizer\b", r"\blearning rate\b", r"\bbatch size\b",
        r"\barchitecture\b", r"\bbaseline\b", r"\bpreprocess", r"\bfeature\b", r"\bstatistical analysis\b", r"\bmaterials?\b",
        r"\bsynthesis\b", r"\bethics committee\b", r"\bapproved by\b", r"\bmeasured using\b", r"\bwere measured\b", r"\bwere used\b",
    ),
    "results": (
        r"\bresults? (?:show|shows|showed|demonstrate|demonstrated|indicate|indicated)\b",
        r"\bwe (?:found|observed|achieved|obtained|report)\b", r"\bperformance\b", r"\baccuracy\b", r"\bprecision\b", r"\brecall\b",
        r"\bf1\b", r"\bauc\b", r"\bsignificant(?:ly)?\b", r"\bincreased?\b", r"\bdecreased?\b", r"\bimprove(?:d|ment)?\b",
        r"\boutperform", r"\bcompared with\b", r"\btable\s+\d+", r"\bfig(?:ure)?\.?\s+\d+", r"\bp\s*[<=>]\s*0\.\d+",
        r"\bmean\s+±\s+", r"\bwas significantly\b", r"\bwere significantly\b", r"\bshowed that\b",
    ),
    "discussion": (
        r"\bthese results\b", r"\bthis finding\b", r"\bthis suggests\b", r"\bthis indicates\b", r"\btherefore\b", r"\bin conclusion\b",
        r"\bwe conclude\b", r"\bimplication", r"\blimitation", r"\bfuture work\b", r"\bfuture studies\b", r"\bmay be due to\b",
        r"\bconsistent with\b",
    ),
}
NUMBER_PREFIX = r"(?i)^\s*(?:\d+(?:\.\d+)*\.?|[IVXLCDM]+\.?|[A-Z]\.|\([a-zA-Z0-9]+\))\s+"


def stripped(text: Column) -> Column:
    """Without white space at both ends, of all kinds; blank for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def normal_heading(heading: Column) -> Column:
    """Lower case without section number, ampersands, slashes, doubled blanks and trailing marks; blank for null."""
    h = F.regexp_replace(stripped(heading), NUMBER_PREFIX, "")
    h = F.regexp_replace(F.replace(h, F.lit("&"), F.lit(" and ")), "[_/]+", " ")
    h = F.regexp_replace(F.regexp_replace(h, r"(?U)\s+", " "), r"(?U)[\s:;.\-–—]+$", "")
    return stripped(F.lower(h))


def is_back_matter(heading: Column) -> Column:
    return stripped(heading).rlike(BACK_MATTER)


def is_related_work(heading: Column) -> Column:
    return normal_heading(heading).rlike(RELATED_WORK)


def is_outside(heading: Column) -> Column:
    """Headings of no label: equations, back matter, related work and the like."""
    h = normal_heading(heading)
    return (h != "") & (is_equation_heading(stripped(heading)) | h.rlike(BACK_MATTER) | h.rlike(OUTSIDE))


def is_technique(heading: Column, fix_stems: bool = False) -> Column:
    """Headings of characterisation techniques. Stems such as "voltammetr" match whole words only, or with ``fix_stems`` any ending."""
    stems, more = (s.format(r"\w*" if fix_stems else "") for s in STEMS)
    return normal_heading(heading).rlike(TECHNIQUES.replace("{stems}", stems).replace("{more}", more))


def _class(label: str | None, source: str, confidence: float, reason: str, secondary: str | None = None) -> Column:
    return F.struct(
        F.lit(label).cast("string").alias("label"), F.lit(secondary).cast("string").alias("secondary"), F.lit(source).alias("source"),
        F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"),
    )


def classify(heading: Column, fix_stems: bool = False) -> Column:
    """label, secondary, source, confidence and reason of a heading; the first rule that fits counts.

    In order: nothing there, outside the scheme, combined sections, exact names, experimental results, evaluation
    setup, techniques, synonyms of the four labels.
    """
    h = normal_heading(heading)
    out = F.when(h == "", _class(None, "none", 0.0, "empty_heading"))
    out = out.when(is_outside(h), _class(None, "excluded", 0.0, "non_imrad_heading_excluded"))
    for pattern, label, secondary, reason, confidence in COMBINED:
        out = out.when(h.rlike(pattern), _class(label, "combined_section", confidence, reason, secondary))
    for label, pattern in EXACT.items():
        out = out.when(h.rlike(pattern), _class(label, "heading_exact", 1.0, f"exact_{label}"))
    out = out.when(h.rlike(EXPERIMENTAL_RESULTS), _class("results", "heading_synonym", 0.90, "experimental_results"))
    out = out.when(h.rlike(EVALUATION), _class("methods", "heading_synonym", 0.85, "evaluation_setup"))
    out = out.when(is_technique(h, fix_stems), _class("results", "heading_characterization", 0.80, "characterization_technique_heading"))
    for label, pattern in SYNONYMS.items():
        out = out.when(h.rlike(pattern), _class(label, "heading_synonym", SYNONYM_CONFIDENCE[label], f"synonym_{label}"))
    return out.otherwise(_class(None, "none", 0.0, "empty_heading"))


def guess(heading: Column) -> Column:
    """The classifier's label, else one by a few loose words; null for a heading without either."""
    out = classify(heading)["label"]
    for pattern, label in GUESSES:
        out = F.coalesce(out, F.when(heading.rlike(pattern), F.lit(label)))
    return out


def content_hits(text: Column, label: str) -> Column:
    """Hits of a label's content patterns for each 1500 characters (one unit at least); 0 for null."""
    t = F.coalesce(text, F.lit(""))
    hits = sum((F.regexp_count(t, F.lit(f"(?iu){p}")) for p in CONTENT[label]), F.lit(0))
    return hits / F.greatest(F.lit(1.0), F.length(t) / 1500.0)


# The vocabulary of the prompt builder, which groups sections by other words than the classifier.
BUILDER_WORDS = {
    "results_discussion": r"\bresults?\s+and\s+discussion\b|\bresults?\s+discussion\b",
    "introduction": r"\b(introduction|background|research background|problem statement|overview)\b",
    "methods": (
        r"\b(materials and methods|methods and materials|material and methods|materials methods|methodology|methods|method|"
        r"experimental section|experimental procedure|experimental procedures|experimental|study design|study area|study population|"
        r"patient selection|patient population|ethical approval|ethical statement|data collection|data analysis|statistical analysis|"
        r"statistical analyses|statistical methods|sample preparation|sample collection|chemicals and reagents|chemicals and materials|"
        r"materials and reagents|materials|cell culture|cell lines|cell culture and treatment|animal experiments|experimental animals|"
        r"bacterial strains|molecular docking|bioinformatics analysis)\b"
    ),
    "results": (
        r"\b(results|findings|characterization|characterisation|characterizations|characterisations|material characterization|"
        r"materials characterization|catalyst characterization|catalysts characterization|physicochemical characterization|"
        r"electrochemical characterization|structural characterization|morphological studies|thermal analysis|mechanical properties|"
        r"flow cytometry|western blotting|western blot analysis|western blot|immunohistochemistry|immunofluorescence staining|"
        r"immunofluorescence|cell viability assay|cell viability|cellular uptake|in vitro cellular uptake|in vitro cytotoxicity|"
        r"hemolysis assay|wound healing assay|elisa|enzyme linked immunosorbent assay|quantitative real time pcr|"
        r"gene expression analysis|drug release|in vitro drug release|pharmacokinetic studies|pharmacokinetic|adsorption kinetics|"
        r"adsorption isotherms|photocatalytic activity|catalytic activity|catalytic tests|product analysis|"
        r"electrochemical measurements|scanning electron microscopy|transmission electron microscopy|dynamic light scattering|"
        r"comparison to rdcs analysis|performance|evaluation|validation|application|case study|model performance|sensitivity analysis)\b"
    ),
    "discussion": (
        r"\b(discussion|conclusion|conclusions|summary|summary and conclusions|concluding remarks|study limitations|limitations|"
        r"implications|future perspectives|perspectives)\b"
    ),
}
BUILDER_LABELS = {
    "introduction": "introduction;intro;background;research background;problem statement",
    "methods": (
        "methods;method;materials;materials methods;materials and methods;methods and materials;material and methods;methodology;"
        "experimental;experiment;experimental section;experimental procedure;experimental procedures;study design;data collection;"
        "data analysis;analytical methods;statistical analysis;statistical analyses;statistical methods"
    ),
    "results": "results;result;findings;results and discussion;results discussion",
    "discussion": (
        "discussion;conclusion;conclusions;discussion conclusion;discussion and conclusion;discussion conclusions;summary;"
        "summary and conclusions;concluding remarks;limitations;study limitations"
    ),
}
#: The last tiers of the builder: words of headings that stand in for a label nothing else gives.
BUILDER_LIKE = {
    "results": (
        r"\b(characterization|characterisation|analysis|assay|measurements|performance|evaluation|validation|activity|properties|uptake|"
        r"release|cytotoxicity|western blot|flow cytometry|microscopy|spectroscopy|kinetics|isotherms|application|case study|simulation|"
        r"model results|experimental results|numerical results|observations|findings)\b"
    ),
    "discussion": (
        r"\b(conclusion|conclusions|summary|discussion|limitations|implications|perspectives|future work|future directions|outlook|"
        r"concluding remarks)\b"
    ),
    "introduction": r"\b(introduction|background|overview|problem statement|motivation)\b",
    "methods": (
        r"\b(method|methods|methodology|materials|experimental|procedure|procedures|study design|data collection|data analysis|"
        r"statistical|sample|sampling|chemicals|reagents|cell culture|animal|patient|docking|simulation setup|model setup|computational|"
        r"numerical model|model description|algorithm|framework|architecture|fabrication|synthesis|preparation|instrumentation|"
        r"measurements|experimental setup|protocol|workflow)\b"
    ),
}


def normal_text(text: Column) -> Column:
    """One kind of line end, single blanks, two line ends at most; blank for null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return stripped(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def inline(text: Column) -> Column:
    return F.regexp_replace(normal_text(text), r"(?U)\s+", " ")


def builder_heading(heading: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(inline(heading)), "[^a-z0-9]+", " "))


def builder_category(heading: Column) -> Column:
    """results_discussion or one of the four labels by the builder's words; null for none."""
    h, out = builder_heading(heading), None
    for label, pattern in BUILDER_WORDS.items():
        out = F.when(h.rlike(pattern), F.lit(label)) if out is None else out.when(h.rlike(pattern), F.lit(label))
    return out


def builder_label(value: Column) -> Column:
    """One of the four labels for a label as parsers and models spell it; null for none."""
    v, out = F.trim(F.regexp_replace(F.lower(inline(value)), "[^a-z]+", " ")), F.lit(None).cast("string")
    for label, names in BUILDER_LABELS.items():
        out = F.when(v.isin(names.split(";")), F.lit(label)).otherwise(out)
    return out
