"""JSON that models write: cleaning, tolerant parsing, coercion, validation and metrics, over variants in column expressions.

A value's kind is asked of the variant (OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, ...), so strings are not taken for numbers.
Validators give the first problem as a text, null where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .headings import stripped

SECTIONS = ("introduction", "methods", "results", "discussion")
RELATIONS = ("intro_to_methods", "methods_to_results", "results_to_discussion")
VERDICTS = ("explicit", "implied", "absent")
LINKS = ("traceable", "partially_traceable", "not_traceable")
# Other names of the discussion, and words for true and false.
DISCUSSION_NAMES = (
    "discussion/conclusion", "discussion_conclusion", "discussion & conclusion", "discussion and conclusion", "discussion/conclusions",
    "conclusion", "conclusions", "discussion_and_conclusion",
)
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "present", "1"), ("false", "no", "absent", "0")


def without_thoughts(text: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", ""))


def without_fences(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```(?:json)?", ""), r"```$", ""))


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; the text itself where there are none."""
    return F.when(text.rlike(r"(?s)\{.*\}"), F.regexp_extract(text, r"(?s)\{.*\}", 0)).otherwise(text)


def candidate(text: Column) -> Column:
    return braces(without_fences(without_thoughts(text)))


def repaired(text: Column) -> Column:
    """Control characters as blanks and no commas before closing brackets, within the outermost braces."""
    return F.regexp_replace(F.regexp_replace(braces(text), "[\\x00-\\x1f]", " "), r",(\s*[}\]])", "$1")


def parsed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``v`` (variant) and ``parse_mode``: raw, repaired or failed (v is null). Any JSON is taken, also no object."""
    c = candidate(F.col(text))
    first, second = F.try_parse_json(c), F.try_parse_json(repaired(c))
    mode = F.when(first.isNotNull(), "raw").when(second.isNotNull(), "repaired").otherwise("failed")
    return df.withColumn("parse_mode", mode).withColumn("v", F.coalesce(first, second))


def at(v: Column, *names: str) -> Column:
    """The value under nested names as a variant, null where there is none."""
    return F.try_variant_get(v, "$" + "".join(f".{n}" for n in names), "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (a JSON null), or null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def items(v: Column) -> Column:
    """The values of an array; an empty array for anything else."""
    return F.coalesce(F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def text(v: Column) -> Column:
    """A string's text, null for other kinds."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _shown(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("None"))


def _is(v: Column, name: str) -> Column:
    return F.coalesce(kind(v) == name, F.lit(False))


def _valid(v: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text(v).isin(*words), F.lit(False))


def _first(*problems: Column) -> Column:
    return F.coalesce(*problems)


def _first_of(array: Column) -> Column:
    return F.get(F.array_compact(array), F.lit(0))


def _but(ok: Column, message: str | Column) -> Column:
    return F.when(~ok, F.lit(message) if isinstance(message, str) else message)


def _covered(name: str):
    def problem(e: Column, i: Column) -> Column:
        place = F.concat(F.lit(f"{name}.entity_coverage["), i.cast("string"), F.lit("]"))
        return _first(
            _but(_is(e, "OBJECT"), F.concat(place, F.lit(" is not an object"))),
            _but(_is(at(e, "entity"), "STRING"), F.concat(place, F.lit(".entity is not a string"))),
            _but(_valid(at(e, "verdict"), VERDICTS), F.concat(place, F.lit(".verdict invalid: "), _shown(at(e, "verdict")))),
        )

    return problem


def _profiled(section: str, strict: bool):
    def problem(e: Column, i: Column) -> Column:
        place = F.concat(F.lit(f"key_entities[{section}]["), i.cast("string"), F.lit("]"))
        checks = [_but(_is(e, "OBJECT"), F.concat(place, F.lit(" is not an object")))]
        checks += [_but(at(e, k).isNotNull(), F.concat(place, F.lit(f" missing key: {k}"))) for k in ("entity", "type")]
        checks += [_but(_is(at(e, k), "STRING"), F.concat(place, F.lit(f".{k} is not a string"))) for k in ("entity", "type") if strict]
        proxies = at(e, "visual_proxies")
        checks.append(_but(proxies.isNull() | _is(proxies, "ARRAY"), F.concat(place, F.lit(".visual_proxies is not a list"))))
        return _first(*checks)

    return problem


def eval_problem(v: Column) -> Column:
    """The first problem of an evaluation. A description that is no string and coverage that is no list count as coerced."""
    found = [_but(_is(v, "OBJECT"), "eval root is not a JSON object"), _but(at(v, "visual_description").isNotNull(), "missing or non-string visual_description")]
    sections = at(v, "component_evaluation")
    found.append(_but(_is(sections, "OBJECT"), "component_evaluation is not an object"))
    for s in SECTIONS:
        one, name = at(sections, s), f"component_evaluation[{s}]"
        found.append(_but(one.isNotNull(), f"component_evaluation missing section: {s}"))
        found.append(_but(_is(one, "OBJECT"), f"{name} is not an object"))
        found.append(_but(_valid(at(one, "verdict"), VERDICTS), F.concat(F.lit(f"{name}.verdict invalid: "), _shown(at(one, "verdict")))))

        found.append(_first_of(F.transform(items(at(one, "entity_coverage")), _covered(name))))
    relations = at(v, "relational_integrity")
    found.append(_but(_is(relations, "OBJECT"), "relational_integrity is not an object"))
    for r in RELATIONS:
        one = at(relations, r)
        found.append(_but(one.isNotNull(), f"relational_integrity missing key: {r}"))
        found.append(_but(_is(one, "OBJECT"), f"relational_integrity[{r}] is not an object"))
        shown = F.concat(F.lit(f"relational_integrity[{r}].verdict invalid: "), _shown(at(one, "verdict")))
        found.append(_but(_valid(at(one, "verdict"), LINKS), shown))
    return _first(*found)


def eval_entities(df: DataFrame, key: str) -> DataFrame:
    """key, section, k, entity, verdict of every entity of parsed evaluations; verdicts that are none of the three are null."""
    each = [F.struct(F.lit(s).alias("section"), items(at(F.col("v"), "component_evaluation", s, "entity_coverage")).alias("e")) for s in SECTIONS]
    d = df.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.section", F.posexplode("x.e").alias("k", "e"))
    verdict = text(at(F.col("e"), "verdict"))
    return d.select(key, "section", "k", text(at(F.col("e"), "entity")).alias("entity"), F.when(verdict.isin(*VERDICTS), verdict).alias("verdict"))


def _verdicts(df: DataFrame, key: str, top: str, names: tuple[str, ...], as_name: str) -> DataFrame:
    each = [F.struct(F.lit(n).alias(as_name), text(at(F.col("v"), top, n, "verdict")).alias("verdict")) for n in names]
    return df.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.*")


def eval_verdicts(df: DataFrame, key: str) -> DataFrame:
    return _verdicts(df, key, "component_evaluation", SECTIONS, "section")


def eval_relations(df: DataFrame, key: str) -> DataFrame:
    return _verdicts(df, key, "relational_integrity", RELATIONS, "relation")


def _same(word: str):
    return lambda x: x == word


def eval_metrics(v: Column) -> Column:
    """Entities by section and by verdict, and the number of sections whose verdict is explicit or implied."""
    entities = {s: items(at(v, "component_evaluation", s, "entity_coverage")) for s in SECTIONS}
    every = F.transform(F.concat(*entities.values()), lambda e: text(at(e, "verdict")))
    totals = [F.size(F.filter(every, _same(w))).alias(f"n_{w}_total") for w in VERDICTS]
    seen = sum((_valid(at(v, "component_evaluation", s, "verdict"), VERDICTS[:2]).cast("int") for s in SECTIONS), F.lit(0))
    return F.struct(*(F.size(e).alias(f"n_entities_{s}") for s, e in entities.items()), *totals, seen.alias("component_count_observed"))


def section_value(block: Column, section: str) -> Column:
    """A section's value of a block; for a missing discussion the first of its other names that is there, whatever the case."""
    own = at(block, section)
    if section != "discussion":
        return own
    held = F.try_variant_get(block, "$", "map<string,variant>")
    named = lambda n: F.filter(F.map_entries(held), lambda e: F.lower(F.trim(e["key"])) == n)
    return F.coalesce(own, *(F.get(named(n), F.lit(0))["value"] for n in DISCUSSION_NAMES))


def profile_problem(v: Column, strict: bool = False) -> Column:
    """The first problem of a profile. Missing relations count as blank, missing proxies as none.

    ``strict``: also the entity and its type must be strings.
    """
    found = [_but(_is(v, "OBJECT"), "SRP root is not a JSON object")]
    found += [_but(at(v, k).isNotNull(), f"Missing top-level key: {k}") for k in ("doi", "title", "section_summaries", "key_entities")]
    summaries, entities = at(v, "section_summaries"), at(v, "key_entities")
    found.append(_but(_is(summaries, "OBJECT"), "section_summaries is not an object"))
    for s in SECTIONS:
        one = section_value(summaries, s)
        found += [_but(one.isNotNull(), f"section_summaries missing section: {s}"), _but(_is(one, "STRING"), f"section_summaries[{s}] is not a string")]
    found.append(_but(_is(entities, "OBJECT"), "key_entities is not an object"))
    for s in SECTIONS:
        one = section_value(entities, s)
        found += [_but(one.isNotNull(), f"key_entities missing section: {s}"), _but(_is(one, "ARRAY"), f"key_entities[{s}] is not a list")]
        found.append(_first_of(F.transform(items(one), _profiled(s, strict))))
    return _first(*found)


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def profile_metrics(v: Column) -> Column:
    """Entities, proxies, words of the summaries with their spread, relations that are there, and readiness for the next stage."""
    entities = {s: items(section_value(at(v, "key_entities"), s)) for s in SECTIONS}
    proxies = F.transform(F.concat(*entities.values()), lambda e: F.size(items(at(e, "visual_proxies"))))
    n, total = F.size(proxies), F.aggregate(proxies, F.lit(0), lambda a, x: a + x)
    none = F.size(F.filter(proxies, lambda x: x == 0))
    summaries = {s: F.coalesce(text(section_value(at(v, "section_summaries"), s)), F.lit("")) for s in SECTIONS}
    words = {s: word_count(t) for s, t in summaries.items()}
    mean = sum(words.values(), F.lit(0.0)) / 4
    spread = F.sqrt(sum(((w - mean) * (w - mean) for w in words.values()), F.lit(0.0)) / 4)
    relations = F.filter(F.array(*(F.coalesce(text(at(v, "causal_relations", r)), F.lit("")) for r in RELATIONS)), lambda t: stripped(t) != "")
    linked = F.size(relations)
    link_words = F.aggregate(F.transform(relations, word_count), F.lit(0), lambda a, x: a + x)
    full = F.lit(True)
    for t in summaries.values():
        full = full & (stripped(t) != "")
    every = (n > 0) & (none == 0)
    return F.struct(
        *(F.size(e).alias(f"entities_{s}") for s, e in entities.items()), n.alias("entity_count"), total.alias("total_visual_proxies"),
        F.when(n > 0, F.bround(total / n, 2)).otherwise(0.0).alias("avg_visual_proxies_per_entity"), none.alias("entities_with_no_proxies"),
        *(w.alias(f"summary_words_{s}") for s, w in words.items()), F.bround(spread, 2).alias("summary_balance_std"),
        linked.alias("causal_relations_present"), F.when(linked > 0, F.bround(link_words / linked, 2)).otherwise(0.0).alias("causal_relation_avg_words"),
        full.alias("all_summaries_nonempty"), (linked == 3).alias("all_relations_nonempty"), every.alias("all_entities_have_proxies"),
        (full & (linked == 3) & every).alias("stage2_ready"),
    )


def flag(v: Column) -> Column:
    """A component's flag: true and false as they are, as words or as 1 and 0; null for anything else."""
    word = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    number = F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$", "double"))
    out = F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    out = out.when(kind(v) == "STRING", F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False))
    return out.when(number == 1, True).when(number == 0, False)


def whole(v: Column) -> Column:
    """A level: an integer, a string of digits or a number without a fraction; null for anything else."""
    word, number = F.trim(F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$", "double")
    digits = F.when(word.rlike("^[0-9]{1,9}$"), word).cast("int")
    return F.when(kind(v) == "STRING", digits).when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE") & (number == F.floor(number)), number.cast("int"))


def judgment(v: Column) -> Column:
    """components, level (as counted), reported, corrected, coerced and problem of a direct judgment."""
    present = at(v, "components_present")
    flags = {s: flag(at(present, s)) for s in SECTIONS}
    level = whole(at(v, "level"))
    found = [_but(_is(v, "OBJECT"), "judgment root is not a JSON object"), _but(_is(present, "OBJECT"), "components_present is not an object")]
    for s in SECTIONS:
        found.append(_but(at(present, s).isNotNull(), f"components_present missing section: {s}"))
        found.append(_but(flags[s].isNotNull(), F.concat(F.lit(f"components_present[{s}] is not a boolean: "), _shown(at(present, s)))))
    found.append(_but(at(v, "level").isNotNull(), "missing level"))
    found.append(_but(level.isNotNull(), F.concat(F.lit("level is not an integer: "), _shown(at(v, "level")))))
    found.append(_but(level.between(0, 4), F.concat(F.lit("level out of range 0-4: "), level.cast("string"))))
    problem = _first(*found)
    count = sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags.values()), F.lit(0))
    changed = sum(((~_is(at(present, s), "BOOLEAN") & flags[s].isNotNull()).cast("int") for s in SECTIONS), F.lit(0))
    changed = changed + (~_is(at(v, "level"), "BIGINT") & level.isNotNull()).cast("int")
    ok = problem.isNull()
    return F.struct(
        F.struct(*(f.alias(s) for s, f in flags.items())).alias("components"), F.when(ok, count).alias("level"), level.alias("reported"),
        F.when(ok, count != level).alias("corrected"), changed.alias("coerced"), problem.alias("problem"),
    )


def compact_sorted(m: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def figure_map(json: Column, strict: bool = False) -> Column:
    """A JSON object of figure ids and paths as a map without blank paths; bad JSON is null, or with ``strict`` an error."""
    m = F.from_json(json, "map<string,string>", {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return F.map_filter(m, lambda k, p: F.trim(F.coalesce(p, F.lit(""))) != "")


def figure_paths(m: Column, most: int = 12) -> Column:
    """The paths of a figure map in the order of its keys, ``most`` at most."""
    return F.slice(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k)), 1, most)
