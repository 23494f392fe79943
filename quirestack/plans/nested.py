"""Validation of nested records: outlines, plans, briefs, digests and diagrams, every failure with its path.

Records are made of whole documents, a section for each line and a point for each of its sentences, as JSON; a few rows in a
hundred are spoiled: fields renamed, values of other kinds, references to what isn't there, repeated names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inputs
from ..operators import nested as N
from ..operators.nested import Rule, Test
from ..tables import load, spread

QUERIES, SQL = {}, {}


class _Spark:
    """The few constructors in which the two engines' SQL differ."""

    paragraphs = "split(coalesce(text, ''), '\n')"

    def obj(self, **fields: str) -> str:
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"

    def arr(self, *parts: str) -> str:
        return f"array({', '.join(parts)})"

    def each(self, array: str, body: str) -> str:
        return f"transform({array}, (x, k) -> {body})"

    def each_sentence(self, body: str) -> str:
        return f"transform(split(x, '[.] '), (y, j) -> {body})"

    def item(self, array: str, at: int) -> str:
        return f"coalesce(get({array}, {at}), '')"

    def word(self, x: str) -> str:
        return f"split_part({x}, ' ', 1)"

    def json(self, x: str) -> str:
        return f"to_json({x}, map('ignoreNullFields', 'false'))"

    def first(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})"


class _Duck(_Spark):
    paragraphs = "string_split(coalesce(text, ''), chr(10))"

    def obj(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def arr(self, *parts: str) -> str:
        return f"[{', '.join(parts)}]"

    def each(self, array: str, body: str) -> str:
        return f"list_transform({array}, lambda x, i: {body.replace('(k + 1)', 'i').replace('(k)', '(i - 1)')})"

    def each_sentence(self, body: str) -> str:
        return f"list_transform(string_split(x, '. '), lambda y: {body})"

    def item(self, array: str, at: int) -> str:
        return f"coalesce(({array})[{at + 1}], '')"

    def json(self, x: str) -> str:
        return f"to_json({x})::VARCHAR"

    def first(self, array: str, n: int) -> str:
        return f"({array})[1:{n}]"


def _spoiled(json: str, rules: list[tuple[int, int, str, str]]) -> str:
    """json with pieces replaced in the rows whose doc_id leaves the given remainder; a row is spoiled once."""
    cases = " ".join(f"WHEN doc_id % {modulus} = {rest} THEN replace({json}, '{old}', '{new}')" for modulus, rest, old, new in rules)
    return f"CASE {cases} ELSE {json} END"


def checked(name: str, root: str, record, spoil: list[tuple[int, int, str, str]], rules: list[Rule], doc: str, known: tuple[str, ...] = ("p1", "p2", "p3")):
    """Registers the issues of a nested rule table over records made of documents, and its SQL."""

    def run(spark, d) -> DataFrame:
        made = spread(load(spark, d, "documents"), "doc_id").selectExpr("doc_id", f"{_Spark().json(record(_Spark()))} AS made")
        rows = made.selectExpr("doc_id", f"{_spoiled('made', spoil)} AS record")
        return N.issues(rows, ["doc_id"], F.try_parse_json("record"), rules, root, F.array(*map(F.lit, known)))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    made = f"SELECT doc_id, {_Duck().json(record(_Duck()))} AS made FROM documents"
    quoted = ", ".join(f"'{k}'" for k in known)
    SQL[name] = N.issues_sql(f"SELECT doc_id, {_spoiled('made', spoil)} AS record, [{quoted}] AS known FROM ({made})", ["doc_id"], rules, root)


# ---- outlines ------------------------------------------------------------------------------------
# Fields, limits and choices of the records.
SECTION = ("id", "heading", "answer", "leaves_with", "points", "words", "figure")
BRIEF = ("id", "title", "paper_connection", "caption", "illustrative", "passages", "purpose", "entry_context", "exit_state", "content", "illustrative_values")
KINDS = ("statement", "value", "equation", "connection", "qualification", "label")
TYPES = ("architecture", "method", "survey", "evaluation", "theory", "other")
LONG, MARKUP = 1200, ("<svg", "<html", "<div", "<script")
ID = "^[A-Za-z][A-Za-z0-9_-]{0,31}$"


def _numbered(prefix: str) -> Test:
    """The id is the prefix and the element's place, counted from 1."""
    return Test(lambda a: N.string(a.value, "id") == F.concat(F.lit(prefix), (a.place + 1).cast("string")), f"json_extract_string(it, '$.id') = '{prefix}' || (place + 1)")


def _among(field: str, array: str, name: str) -> Test:
    """A string that some element of the record's array has under name."""
    return Test(lambda a: F.array_contains(N.named(a.root, array, name), N.string(a.value, field)), f"list_contains({N.each_of(array, name)}, json_extract_string(it, '$.{field}'))")


def _named_once(array: str, name: str) -> Test:
    """Exactly one element of the record's array has the element's id under name."""
    return Test(
        lambda a: F.size(F.filter(N.members(a.root, array, name), lambda x: x == N.string(a.value, "id"))) == 1,
        f"len(list_filter({N.each_of(array, name)}, lambda x: x = json_extract_string(it, '$.id'))) = 1",
    )


def _no_dash(field: str) -> Test:
    """No en or em dash between words."""
    dash = r"\\S\\s*[–—]\\s*\\S".replace("\\\\", "\\")
    return Test(lambda a: ~F.coalesce(N.string(a.value, field).rlike(dash), F.lit(False)), f"NOT coalesce(regexp_matches(json_extract_string(it, '$.{field}'), '{dash}'), false)")


def _markup_free() -> Test:
    """No string below the element holds a tag that the application owns."""
    return Test(
        lambda a: ~F.exists(F.array(*map(F.lit, MARKUP)), lambda t: F.contains(N.once(a.value, ("lower",), lambda c: F.lower(F.to_json(c))), t)),
        " AND ".join(f"NOT contains(lower(it::VARCHAR), '{t}')" for t in MARKUP),
    )


def _first_use() -> Test:
    """No section before the term's own uses it in heading, answer or points, as a whole word, singular or plural."""

    def spark(a: N.At):
        term = N.string(a.value, "term")
        own = F.array_position(N.members(a.root, "sections", "id"), N.string(a.value, "section"))
        before = F.slice(N.items(a.root, "sections"), F.lit(1), F.greatest(own.cast("int") - 1, F.lit(0)))
        says = lambda s: F.concat_ws("\n", N.string(s, "heading"), N.string(s, "answer"), F.array_join(F.array_compact(N.members(s, "points", "text")), "\n"))
        return ~F.exists(before, lambda s: inputs.uses_term(says(s), term))

    says = f"concat_ws(chr(10), json_extract_string(s, '$.heading'), json_extract_string(s, '$.answer'), array_to_string({N.each_of('points', 'text', 's')}, chr(10)))"
    own = f"list_position({N.each_of('sections', 'id')}, json_extract_string(it, '$.section'))"
    edge = r"[^\p{L}\p{N}_]"
    pattern = rf"'(?i)(^|{edge})' || regexp_escape(trim(regexp_replace(json_extract_string(it, '$.term'), '\s+', ' ', 'g'))) || '(e?s)?({edge}|$)'"
    array = "(json_extract(root, '$.sections')::JSON[])"
    return Test(spark, f"len(list_filter({array}[1:greatest({own} - 1, 0)], lambda s: regexp_matches({says}, {pattern}))) = 0")


def brief_rules(at: str) -> list[Rule]:
    """Rules of a drawing brief, wherever briefs stand."""
    texts = [Rule(f"brief_{f}", at, N.text(f, most), f) for f, most in (("title", 80), ("paper_connection", LONG), ("caption", LONG), ("purpose", LONG), ("exit_state", LONG))]
    return [
        Rule("brief_fields", at, N.exactly(*BRIEF)),
        Rule("brief_markup", at, _markup_free()),
        Rule("brief_id", at, N.like("id", "^fig[1-6]$"), "id"),
        *texts,
        Rule("brief_illustrative", at, N.is_kind("illustrative", "BOOLEAN"), "illustrative"),
        Rule("brief_passages", at, N.references("passages"), "passages"),
        Rule("brief_passages_once", at, N.distinct("passages"), "passages"),
        Rule("brief_entry_context", at, N.count("entry_context", 1, 12), "entry_context"),
        Rule("brief_entry", f"{at}.entry_context[*]", N.text("", LONG)),
        Rule("brief_content", at, N.count("content", 1, 8), "content"),
        Rule("brief_content_fields", f"{at}.content[*]", N.only("text", "kind", "passages") & N.has("text", "kind")),
        Rule("brief_content_text", f"{at}.content[*]", N.text("text", LONG), "text"),
        Rule("brief_content_kind", f"{at}.content[*]", N.choice("kind", *KINDS), "kind"),
        Rule("brief_values", at, N.is_kind("illustrative_values", "ARRAY") & N.distinct("illustrative_values"), "illustrative_values"),
    ]


#: A blog's outline: sections with points, an example, an analogy, terms and figure briefs.
OUTLINE = [
    Rule("fields", "", N.only("title", "rationale", "sections", "example", "analogy", "terms", "figures")),
    Rule("title", "", N.text("title"), "title"),
    Rule("title_dash", "", _no_dash("title"), "title"),
    Rule("rationale", "", N.text("rationale"), "rationale"),
    Rule("sections", "", N.count("sections", 3, 8), "sections"),
    Rule("section_fields", "sections[*]", N.exactly(*SECTION)),
    Rule("section_id", "sections[*]", _numbered("s"), "id"),
    Rule("section_heading", "sections[*]", N.text("heading"), "heading"),
    Rule("section_heading_dash", "sections[*]", _no_dash("heading"), "heading"),
    Rule("section_answer", "sections[*]", N.text("answer"), "answer"),
    Rule("section_leaves_with", "sections[*]", N.text("leaves_with"), "leaves_with"),
    Rule("section_points", "sections[*]", N.count("points", 1, 1 << 30), "points"),
    Rule("point_text", "sections[*].points[*]", N.text("text")),
    Rule("point_passages", "sections[*].points[*]", N.references("passages"), "passages", N.text("text")),
    Rule("section_words", "sections[*]", N.whole("words", 40), "words"),
    Rule("section_figure", "sections[*]", _among("figure", "figures", "id"), "figure", N.text("figure")),
    Rule("example", "", N.is_kind("example", "OBJECT"), "example"),
    Rule("example_fields", "example", N.exactly("name", "text", "introduced_in", "illustrative")),
    Rule("example_section", "example", _among("introduced_in", "sections", "id"), "introduced_in"),
    Rule("example_illustrative", "example", N.is_kind("illustrative", "BOOLEAN"), "illustrative"),
    Rule("analogy", "", N.is_kind("analogy", "OBJECT"), "analogy"),
    Rule("analogy_fields", "analogy", N.exactly("section", "text") & N.is_kind("section", "STRING") & N.is_kind("text", "STRING")),
    Rule("analogy_section", "analogy", _among("section", "sections", "id") & N.text("text"), "", N.text("section")),
    Rule("terms", "", N.count("terms", 0, 12), "terms"),
    Rule("term_section", "terms[*]", _among("section", "sections", "id"), "section"),
    Rule("term", "terms[*]", N.text("term"), "term", _among("section", "sections", "id")),
    Rule("term_first", "terms[*]", _first_use(), "term", _among("section", "sections", "id") & N.text("term")),
    Rule("figures", "", N.count("figures", 1, 6), "figures"),
    Rule("figure_number", "figures[*]", _numbered("fig"), "id"),
    Rule("figure_named", "figures[*]", _named_once("sections", "figure")),
    *brief_rules("figures[*]"),
]


def _brief(q: _Spark, p: str) -> str:
    return q.obj(
        id="concat('fig', (k + 1))", title=f"substr({p}, 1, 90)", paper_connection="source", caption=f"substr({p}, 1, 1300)", illustrative="length(x) % 2 = 0", passages=q.arr("'p1'", "concat('p', length(x) % 4)"),
        purpose="lang", entry_context=q.arr(f"substr({p}, 1, 30)"), exit_state=f"substr({p}, 10, 40)",
        content=q.each_sentence(q.obj(text="y", kind="CASE WHEN length(y) % 9 = 0 THEN 'picture' ELSE 'statement' END")), illustrative_values=q.arr(f"substr({p}, 1, 4)", f"substr({p}, 5, 4)"),
    )


def _outline(q: _Spark) -> str:
    section = q.obj(
        id="concat('s', (k + 1))", heading="substr(x, 1, 60)", answer="substr(x, 1, 300)", leaves_with="substr(x, 1, 20)",
        points=q.each_sentence(q.obj(text="y", passages=q.arr("concat('p', 1 + length(y) % 4)"))), words="length(x)", figure="CASE WHEN (k + 1) < 3 THEN concat('fig', (k + 1)) ELSE '' END",
    )
    head = q.item(q.paragraphs, 0)
    return q.obj(
        title=f"substr({head}, 1, 70)", rationale="lang", sections=q.each(q.paragraphs, section),
        example=q.obj(name=f"substr({head}, 1, 9)", text=head, introduced_in="concat('s', 1 + doc_id % 5)", illustrative="doc_id % 2 = 0"),
        analogy=q.obj(section="CASE WHEN doc_id % 3 = 0 THEN 's2' ELSE '' END", text=f"substr({head}, 1, 12)"),
        terms=q.arr(q.obj(term=q.word(q.item(q.paragraphs, 1)), section="'s2'"), q.obj(term=f"substr({q.item(q.paragraphs, 2)}, 1, 8)", section="'s3'")),
        figures=q.each(q.first(q.paragraphs, 2), _brief(q, "x")),
    )


checked(
    "outline_issues", "outline", _outline,
    [(13, 1, '"words":', '"word":'), (17, 2, '"figure":"fig2"', '"figure":"fig1"'), (19, 3, '"id":"s2"', '"id":"s9"'), (23, 4, '"passages":["p1"]', '"passages":"p1"'), (29, 5, '"terms":[', '"terms":[5,'), (31, 6, '"example":{', '"example":[{}],"other":{')],
    OUTLINE, "Every fault of blog outlines, with its path: fields, numbering, references between sections, figures and terms.",
)

# ---- plans, overview plans, digests, diagrams -------------------------------------------------------
_PROPOSES = N.choice("paper_type", "architecture", "method")
_ROOT_PROPOSES = Test(lambda a: N.string(a.root, "paper_type").isin("architecture", "method"), "json_extract_string(root, '$.paper_type') IN ('architecture', 'method')")


def _ours(least: int, most: int) -> Test:
    flags = lambda a: F.filter(N.items(a.value, "scores"), lambda s: F.try_variant_get(s, "$.ours", "boolean") & (N.kind(s, "ours") == "BOOLEAN"))
    return Test(
        lambda a: F.size(flags(a)).between(least, most),
        f"len(list_filter(CASE WHEN json_type(it, '$.scores') = 'ARRAY' THEN json_extract(it, '$.scores')::JSON[] ELSE []::JSON[] END, lambda s: json_type(s, '$.ours') = 'BOOLEAN' AND json_extract_string(s, '$.ours') = 'true')) BETWEEN {least} AND {most}",
    )


#: A plan: four claims, relations and measures with scores.
PLAN = [
    Rule("fields", "", N.exactly("paper_type", "visual_focus", "question", "contribution", "finding", "limitation", "relationships", "measures")),
    Rule("paper_type", "", N.choice("paper_type", *TYPES), "paper_type"),
    Rule("visual_focus", "", N.text("visual_focus", LONG), "visual_focus"),
    *[r for c in ("question", "contribution", "finding", "limitation") for r in (
        Rule(c, "", N.is_kind(c, "OBJECT"), c),
        Rule(f"{c}_fields", c, N.exactly("text", "passages"), "", N.is_kind("", "OBJECT")),
        Rule(f"{c}_text", c, N.text("text", LONG), "text", N.is_kind("", "OBJECT")),
        Rule(f"{c}_passages", c, N.references("passages"), "passages", N.is_kind("", "OBJECT")),
    )],
    Rule("relationships", "", N.count("relationships", 1, 12), "relationships"),
    Rule("relation_fields", "relationships[*]", N.exactly("source", "target", "relationship", "passages")),
    *[Rule(f"relation_{f}", "relationships[*]", N.text(f, LONG), f, N.is_kind("", "OBJECT")) for f in ("source", "target", "relationship")],
    Rule("relation_passages", "relationships[*]", N.references("passages"), "passages", N.is_kind("", "OBJECT")),
    Rule("measures", "", N.count("measures", 0, 3), "measures"),
    Rule("measures_wanted", "", ~N.count("measures", 0, 0), "measures", _PROPOSES),
    Rule("measure_fields", "measures[*]", N.exactly("dataset", "metric", "better", "scores", "passages")),
    Rule("measure_dataset", "measures[*]", N.text("dataset", LONG), "dataset"),
    Rule("measure_better", "measures[*]", N.choice("better", "higher", "lower"), "better"),
    Rule("measure_passages", "measures[*]", N.references("passages"), "passages"),
    Rule("measure_scores", "measures[*]", N.count("scores", 1, 8), "scores"),
    Rule("score_fields", "measures[*].scores[*]", N.exactly("method", "value", "ours")),
    Rule("score_method", "measures[*].scores[*]", N.text("method", LONG), "method"),
    Rule("score_value", "measures[*].scores[*]", N.number("value"), "value"),
    Rule("score_ours", "measures[*].scores[*]", N.is_kind("ours", "BOOLEAN"), "ours"),
    Rule("ours_at_most_once", "measures[*]", _ours(0, 1), "scores", N.count("scores", 1, 8)),
    Rule("ours_wanted", "measures[*]", _ours(1, 8), "scores", N.count("scores", 1, 8) & _ROOT_PROPOSES),
]


def _plan(q: _Spark) -> str:
    claim = lambda at: q.obj(text=q.item(q.paragraphs, at), passages=q.arr("concat('p', 1 + doc_id % 4)"))
    relation = q.obj(source="substr(x, 1, 20)", target="substr(x, 21, 20)", relationship="substr(x, 41, 1300)", passages=q.arr("'p2'"))
    scores = q.each_sentence(q.obj(method="substr(y, 1, 12)", value="length(y)", ours="length(y) % 5 = 0"))
    measure = q.obj(dataset="substr(x, 1, 30)", metric="lang", better="CASE WHEN length(x) % 7 = 0 THEN 'more' ELSE 'higher' END", scores=scores, passages=q.arr("'p1'", "'p3'"))
    return q.obj(
        paper_type="CASE doc_id % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'survey' WHEN 2 THEN 'theory' ELSE source END", visual_focus="lang", question=claim(0), contribution=claim(1), finding=claim(2), limitation=claim(3),
        relationships=q.each(q.paragraphs, relation), measures=q.each(q.first(q.paragraphs, 4), measure),
    )


checked(
    "plan_issues", "plan", _plan,
    [(13, 1, '"ours":true', '"ours":"true"'), (17, 2, '"scores":[', '"scores":["none",'), (19, 3, '"limitation":{', '"limits":{'), (23, 4, '"value":', '"value":"1","score":'), (29, 5, '"passages":["p2"]', '"passages":[]'), (31, 6, '"finding":{"text":', '"finding":{"words":')],
    PLAN, "Every fault of paper plans: claims, relations, and measures with their scores two arrays deep.",
)

#: What an overview shows.
OVERVIEW = [
    Rule("through_line", "", N.text("through_line", 400), "through_line"),
    Rule("items", "", N.count("items", 1, 7), "items"),
    Rule("item_name", "items[*]", N.text("name", 80), "name"),
    Rule("headline_numbers", "", N.count("headline_numbers", 1, 2), "headline_numbers"),
    Rule("chart", "", N.is_kind("chart", "OBJECT", "VOID") | ~N.has("chart"), "chart"),
    Rule("chart_type", "chart", N.choice("type", "bar", "line", "pie", "quadrant", "radar"), "type", N.is_kind("", "OBJECT")),
]


def _overview(q: _Spark) -> str:
    return q.obj(
        through_line=q.item(q.paragraphs, 0), items=q.each(q.paragraphs, q.obj(name="substr(x, 1, 85)")), headline_numbers=q.first(q.each(q.paragraphs, q.obj(value="length(x)", measures="substr(x, 1, 9)")), 3),
        chart=q.obj(type="CASE doc_id % 3 WHEN 0 THEN 'bar' WHEN 1 THEN lang ELSE 'pie' END"),
    )


checked(
    "overview_plan_issues", "plan", _overview,
    [(13, 1, '"items":[', '"items":[7,'), (17, 2, '"chart":{', '"chart":null,"was":{'), (19, 3, '"name":', '"title":'), (23, 4, '"chart":{', '"chart":[],"was":{')],
    OVERVIEW, "Every fault of overview plans.",
)


def _no_self(field: str) -> Test:
    return Test(
        lambda a: ~F.array_contains(N.strings(a.value, field), F.coalesce(N.string(a.value, "id"), F.lit(""))),
        f"NOT list_contains({N._texts('it', field)}, coalesce(json_extract_string(it, '$.id'), ''))",
    )


def _all_known(field: str) -> Test:
    """An array of nothing but ids of the record's components; a missing member is one without any."""
    ids = lambda a: N.named(a.root, "components", "id")
    there = ~N.has(field)
    given = Test(
        lambda a: (N.kind(a.value, field) == "ARRAY") & (F.size(N.strings(a.value, field)) == F.size(N.items(a.value, field))) & (F.size(F.array_except(N.strings(a.value, field), ids(a))) == 0),
        f"json_type(it, '$.{field}') = 'ARRAY' AND len({N._texts('it', field)}) = json_array_length(it, '$.{field}') AND list_has_all({N.each_of('components', 'id')}, {N._texts('it', field)})",
    )
    return there | given


def _first_with_id() -> Test:
    every = "list_transform(json_extract(root, '$.components')::JSON[], lambda x: CASE WHEN json_type(x, '$.id') = 'VARCHAR' THEN json_extract_string(x, '$.id') END)"
    return Test(lambda a: ~F.get(N.again(a.root, "components", "id"), a.place), f"NOT coalesce(list_contains(({every})[1:place], CASE WHEN json_type(it, '$.id') = 'VARCHAR' THEN json_extract_string(it, '$.id') END), false)")


def _some(field: str) -> Test:
    """Some component has something under field."""
    return Test(
        lambda a: F.exists(N.items(a.value, "components"), lambda c: N.string(c, field).rlike(".") | (F.size(N.items(c, field)) > 0)),
        f"len(list_filter(json_extract(it, '$.components')::JSON[], lambda c: (json_type(c, '$.{field}') = 'VARCHAR' AND length(json_extract_string(c, '$.{field}')) > 0) OR json_array_length(c, '$.{field}') > 0)) > 0",
    )


_IS_OBJECT = N.is_kind("", "OBJECT")
#: A digest: claims, components that nest and feed each other, an operation.
DIGEST = [
    Rule("fields", "", N.only("paper_type", "why", "contribution", "result", "qualification", "example", "hyperparameters", "components")),
    Rule("required", "", N.has("paper_type", "why", "contribution", "result", "qualification", "components")),
    Rule("paper_type", "", N.choice("paper_type", *TYPES), "paper_type"),
    *[r for c in ("contribution", "result", "qualification") for r in (
        Rule(c, "", N.is_kind(c, "OBJECT"), c), Rule(f"{c}_fields", c, N.only("text", "passages")), Rule(f"{c}_text", c, N.text("text", 400), "text"), Rule(f"{c}_passages", c, N.references("passages"), "passages"),
    )],
    Rule("why_fields", "why", N.exactly("problem", "obstacle", "idea", "passages")),
    *[Rule(f"why_{f}", "why", N.text(f, 160), f, _IS_OBJECT) for f in ("problem", "obstacle", "idea")],
    Rule("why_passages", "why", N.references("passages"), "passages", _IS_OBJECT),
    Rule("example", "", N.text("example", 320), "example", _PROPOSES | N.has("example")),
    Rule("hyperparameters", "", N.count("hyperparameters", 0, 12) | ~N.has("hyperparameters"), "hyperparameters"),
    Rule("hyperparameter", "hyperparameters[*]", N.text("", 48)),
    Rule("components", "", N.count("components", 4, 24), "components"),
    Rule("component", "components[*]", _IS_OBJECT),
    Rule("component_id", "components[*]", N.like("id", ID), "id", _IS_OBJECT),
    Rule("component_id_once", "components[*]", _first_with_id(), "id", _IS_OBJECT),
    Rule("component_fields", "components[*]", N.only("id", "name", "role", "computes", "values", "contains", "feeds", "repeat", "passages"), "", _IS_OBJECT),
    Rule("component_name", "components[*]", N.text("name", 48), "name", _IS_OBJECT),
    Rule("component_role", "components[*]", N.text("role", 160), "role", _IS_OBJECT),
    *[Rule(f"component_{f}", "components[*]", N.text(f, most), f, N.has(f) & ~N.is_kind(f, "VOID")) for f, most in (("computes", 100), ("values", 80), ("repeat", 16))],
    *[r for f in ("contains", "feeds") for r in (Rule(f"{f}_known", "components[*]", _all_known(f), f, _IS_OBJECT), Rule(f"{f}_itself", "components[*]", _no_self(f), f, _IS_OBJECT))],
    Rule("component_passages", "components[*]", N.references("passages"), "passages", _IS_OBJECT),
    Rule("nested", "", _some("contains"), "components", N.choice("paper_type", "architecture") & N.count("components", 1, 1 << 30)),
    Rule("operation", "", _some("computes"), "components", _PROPOSES & N.count("components", 1, 1 << 30)),
]


def _digest(q: _Spark) -> str:
    claim = lambda at: q.obj(text=f"substr({q.item(q.paragraphs, at)}, 1, 420)", passages=q.arr("concat('p', 1 + doc_id % 4)"))
    component = q.obj(
        id="concat('c', length(x) % 40)", name="substr(x, 1, 50)", role="substr(x, 1, 165)", computes="CASE WHEN length(x) % 3 = 0 THEN substr(x, 1, 105) END", contains=q.arr("concat('c', length(x) % 7)"),
        feeds=q.each_sentence("concat('c', length(y) % 40)"), passages=q.arr("'p1'"),
    )
    return q.obj(
        paper_type="CASE doc_id % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'architecture' WHEN 2 THEN 'theory' ELSE lang END", why=q.obj(problem="source", obstacle="lang", idea=f"substr({q.item(q.paragraphs, 0)}, 1, 170)", passages=q.arr("'p1'")),
        contribution=claim(0), result=claim(1), qualification=claim(2), example=f"substr({q.item(q.paragraphs, 0)}, 1, 330)", hyperparameters=q.each(q.paragraphs, "substr(x, 1, 49)"), components=q.each(q.paragraphs, component),
    )


checked(
    "digest_issues", "digest", _digest,
    [(13, 1, '"components":[', '"components":["x",'), (17, 2, '"feeds":[', '"feeds":[5,'), (19, 3, '"computes":', '"does":'), (23, 4, '"contains":[', '"holds":['), (29, 5, '"why":{', '"reason":{'), (31, 6, '"example":', '"example":{"text":"given"},"instead":')],
    DIGEST, "Every fault of overview digests: unique component ids, edges to known ones, no edge to itself, nesting and operation.",
)


def _flat(x):
    return F.lower(F.trim(F.regexp_replace(F.replace(F.replace(x, F.lit("`"), F.lit("")), F.lit("$$"), F.lit("")), r"\s+", " ")))


_DUCK_FLAT = "lower(trim(regexp_replace(replace(replace({0}, '`', ''), '$$', ''), '\\s+', ' ', 'g')))"


def _shown() -> Test:
    """The wanted item stands in some label, whatever its case and spacing."""
    labels = _DUCK_FLAT.format("array_to_string(" + N._texts("root", "labels") + ", ' ')")
    return Test(lambda a: F.contains(N.once(a.root, ("labels",), lambda c: _flat(F.array_join(N.strings(c, "labels"), " "))), _flat(N.string(a.value))), f"contains({labels}, {_DUCK_FLAT.format(N._text(''))})")


def _label_words() -> Test:
    """At most 8 words, 16 in a note; a formula is one word, a sign alone is none."""
    plain = F.regexp_replace
    words = lambda a: F.size(F.filter(F.split(plain(N.string(a.value, "text"), r"\$\$.*?\$\$", "TeX"), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}_]")))
    # Whatever isn't false or empty makes a note.
    noted = lambda a: (N.kind(a.value, "note") == "BOOLEAN") & N.get(a.value, "note", "boolean") | N.string(a.value, "note").rlike(".")
    most = lambda a: F.when(noted(a), 16).otherwise(8)
    text = N._text("text")
    return Test(
        lambda a: words(a) <= most(a),
        f"len(list_filter(regexp_split_to_array(regexp_replace({text}, '\\$\\$.*?\\$\\$', 'TeX', 'g'), '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))) <= CASE WHEN (json_type(it, '$.note') = 'BOOLEAN' AND json_extract_string(it, '$.note') = 'true') OR length({N._text('note')}) > 0 THEN 16 ELSE 8 END",
    )


def _no_star() -> Test:
    return Test(
        lambda a: ~F.contains(F.regexp_replace(N.string(a.value, "text"), r"\$\$.*?\$\$", ""), F.lit("*")),
        f"NOT contains(regexp_replace({N._text('text')}, '\\$\\$.*?\\$\\$', '', 'g'), '*')",
    )


def _drawn(spark, duck: str) -> Test:
    """A rule over the numbers of a drawing: width, height and smallest text, scaled to 640 pixels."""
    value = lambda a, name: N.get(a.value, name, "double")
    get = "json_extract(it, '$.{0}')::DOUBLE".format
    return Test(lambda a: spark(*(value(a, n) for n in ("width", "height", "min_font"))), duck.format(w=get("width"), h=get("height"), f=get("min_font")))


#: A parsed diagram: what it must show, its labels, size and smallest text.
DIAGRAM = [
    Rule("shows", "required[*]", _shown()),
    Rule("asterisk", "nodes[*]", _no_star(), "text"),
    Rule("words", "nodes[*]", _label_words(), "text"),
    Rule("nodes", "", N.count("nodes", 0, 16), "nodes"),
    Rule("font", "", _drawn(lambda w, h, f: f * F.least(F.lit(1.0), 640 / w) >= 11, "{f} * least(1.0, 640 / {w}) >= 11"), "min_font"),
    Rule("too_tall", "", _drawn(lambda w, h, f: w / h >= 0.6, "{w} / {h} >= 0.6"), "height"),
    Rule("too_wide", "", _drawn(lambda w, h, f: w / h <= 2.0, "{w} / {h} <= 2.0"), "width"),
    Rule("chart_wanted", "", N.text("chart"), "chart", Test(lambda a: N.get(a.value, "chart_wanted", "boolean"), "json_extract_string(it, '$.chart_wanted') = 'true'")),
]


def _diagram(q: _Spark) -> str:
    return q.obj(
        required=q.arr(f"substr({q.item(q.paragraphs, 0)}, 1, 12)", q.word(q.item(q.paragraphs, 1)), "source"), labels=q.each(q.paragraphs, "replace(substr(x, 1, 40), 'e', 'E')"),
        nodes=q.each(q.paragraphs, q.obj(text="concat(substr(x, 1, 60), CASE WHEN length(x) % 5 = 0 THEN ' **bold**' WHEN length(x) % 5 = 1 THEN ' $$p^*_K + q$$ = x' ELSE '' END)", note="length(x) % 2 = 0")),
        width="300 + doc_id % 900", height="200 + doc_id % 700", min_font="8 + doc_id % 9", chart_wanted="doc_id % 3 = 0", chart="CASE WHEN doc_id % 2 = 0 THEN 'pie' END",
    )


checked("diagram_issues", "diagram", _diagram, [(13, 1, '"nodes":[', '"nodes":["x",'), (17, 2, '"note":true', '"note":"yes"')], DIAGRAM, "Every fault of parsed diagrams: missing items, label words, stars, text size, shape.")
