"""Rules over nested records: a rule table is evaluated on every element at any depth, in one expression.

A record is a VARIANT.  A rule names where it applies by a selector such as `sections[*].points[*]`; each element
that the selector reaches is tested, and failures carry its path, `outline.sections[2].points[0].text`.  All rules of a
table compile to one nested expression over arrays of variants, so records of any shape are checked where they
are: nothing is exploded, joined or parsed twice.  What tests read of an element (its kind, its members, the strings of an
array, the ids of the whole record) is worked out once for that element, see Value, however many rules and elements below
ask for it.  Values of the wrong kind fail like missing ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Value:
    """An element's VARIANT, and what tests have asked of it: `made` holds the answers by what was asked; without it questions are only noted."""

    def __init__(self, column: Column, made: dict | None = None):
        self.column, self.made, self.asked = column, made, {}

    def once(self, what: tuple, use: Callable[[Column], Column]) -> Column:
        if self.made is None:
            self.asked.setdefault(what, use)
            return use(self.column)
        return self.made[what]


def once(v: Value | Column, what: tuple, use: Callable[[Column], Column]) -> Column:
    """use(v), worked out once for an element; what: a name of use and its arguments.  Of other columns it is just use(v)."""
    return v.once(what, use) if isinstance(v, Value) else use(v)


def with_values(array: Column, asked: dict, use: Callable[[Value, Column], Column]) -> Column:
    """The array of use(element, place) over an array of variants; what is asked of an element is worked out once for it."""
    names = {what: f"a{n}" for n, what in enumerate(asked)}
    rows = F.transform(array, lambda v: F.struct(v.alias("v"), *[asked[what](v).alias(name) for what, name in names.items()]))
    return F.transform(rows, lambda s, i: use(Value(s["v"], {what: s[name] for what, name in names.items()}), i))


@dataclass(frozen=True)
class At:
    """An element: its value, path and place in its array, the element above it, the whole record, and what is known beside it."""

    value: Value
    path: Column
    place: Column
    up: Value
    root: Value
    known: Column


@dataclass(frozen=True)
class Test:
    """A predicate in both engines; in SQL: it, place, up, root and known."""

    spark: Callable[[At], Column]
    duck: str

    def __and__(self, other: Test) -> Test:
        return Test(lambda a: self.spark(a) & other.spark(a), f"({self.duck}) AND ({other.duck})")

    def __or__(self, other: Test) -> Test:
        return Test(lambda a: self.spark(a) | other.spark(a), f"({self.duck}) OR ({other.duck})")

    def __invert__(self) -> Test:
        return Test(lambda a: ~F.coalesce(self.spark(a), F.lit(False)), f"NOT coalesce({self.duck}, false)")


@dataclass(frozen=True)
class Rule:
    """An element that selector reaches fails where test doesn't hold or is null; where `given` doesn't hold it isn't tested."""

    name: str
    selector: str
    test: Test
    field: str = ""
    given: Test | None = None


# ---- values of variants ------------------------------------------------------------------------
def _way(name: str) -> str:
    return f"$.{name}" if name else "$"


def get(v: Value | Column, name: str, type_: str) -> Column:
    """A member as a type, null where it can't be one."""
    return once(v, ("get", name, type_), lambda c: F.try_variant_get(c, _way(name), type_))


def member(v: Value | Column, name: str) -> Column:
    return get(v, name, "variant")


def kind(v: Value | Column, name: str = "") -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID, of a member if named; null where there is nothing."""
    return once(v, ("kind", name), lambda c: F.regexp_extract(F.schema_of_variant(member(c, name) if name else c), "^[A-Z]+", 0))


def string(v: Value | Column, name: str = "") -> Column:
    """A member that is a string, else null."""
    return once(v, ("string", name), lambda c: F.when(kind(c, name) == "STRING", get(c, name, "string")))


def items(v: Value | Column, name: str = "") -> Column:
    """The elements of a member that is an array; others have none."""
    return once(v, ("items", name), lambda c: F.coalesce(get(c, name, "array<variant>"), F.array().cast("array<variant>")))


def keys(v: Value | Column) -> Column:
    return once(v, ("keys",), lambda c: F.map_keys(get(c, "", "map<string,variant>")))


def strings(v: Value | Column, name: str = "") -> Column:
    """The strings among the elements of a member."""
    return once(v, ("strings", name), lambda c: F.filter(F.transform(items(c, name), lambda x: string(x)), lambda s: s.isNotNull()))


# ---- tests ---------------------------------------------------------------------------------------
def _json(name: str) -> str:
    return f"json_extract(it, '{_way(name)}')"


def _text(name: str) -> str:
    return f"CASE WHEN json_type(it, '{_way(name)}') = 'VARCHAR' THEN json_extract_string(it, '{_way(name)}') END"


def _texts(of: str, name: str = "") -> str:
    array = f"CASE WHEN json_type({of}, '{_way(name)}') = 'ARRAY' THEN json_extract({of}, '{_way(name)}')::JSON[] ELSE []::JSON[] END"
    return f"list_transform(list_filter({array}, lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$'))"


def _quoted(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def is_kind(name: str, *kinds: str) -> Test:
    names = {"OBJECT": "OBJECT", "ARRAY": "ARRAY", "STRING": "VARCHAR", "BOOLEAN": "BOOLEAN", "VOID": "NULL"}
    return Test(lambda a: kind(a.value, name).isin(*kinds), f"json_type(it, '{_way(name)}') IN ({_quoted(names[k] for k in kinds)})")


def text(name: str, most: int | None = None) -> Test:
    """A string that isn't blank, of at most so many characters."""
    longest = most or 1 << 30
    return Test(lambda a: string(a.value, name).rlike(r"\S") & (F.length(string(a.value, name)) <= longest), f"regexp_matches({_text(name)}, '\\S') AND length({_text(name)}) <= {longest}")


def like(name: str, pattern: str) -> Test:
    return Test(lambda a: string(a.value, name).rlike(pattern), f"regexp_matches({_text(name)}, '{pattern}')")


def choice(name: str, *values: str) -> Test:
    return Test(lambda a: string(a.value, name).isin(*values), f"{_text(name)} IN ({_quoted(values)})")


def has(*names: str) -> Test:
    """An object with these members, whatever they hold."""
    return Test(lambda a: F.size(F.array_except(F.array(*map(F.lit, names)), keys(a.value))) == 0, f"json_type(it) = 'OBJECT' AND list_has_all(json_keys(it), [{_quoted(names)}])")


def only(*names: str) -> Test:
    """An object without other members."""
    return Test(lambda a: F.size(F.array_except(keys(a.value), F.array(*map(F.lit, names)))) == 0, f"json_type(it) = 'OBJECT' AND list_has_all([{_quoted(names)}], json_keys(it))")


def exactly(*names: str) -> Test:
    return has(*names) & only(*names)


def count(name: str, least: int, most: int) -> Test:
    """An array of least to most elements."""
    size = F.size
    return Test(lambda a: (kind(a.value, name) == "ARRAY") & size(items(a.value, name)).between(least, most), f"json_type(it, '{_way(name)}') = 'ARRAY' AND json_array_length(it, '{_way(name)}') BETWEEN {least} AND {most}")


def number(name: str) -> Test:
    return Test(lambda a: kind(a.value, name).isin("BIGINT", "DECIMAL", "DOUBLE"), f"json_type(it, '{_way(name)}') IN ('BIGINT', 'UBIGINT', 'DOUBLE')")


def whole(name: str, least: int) -> Test:
    value = lambda a: get(a.value, name, "long")
    return Test(lambda a: (kind(a.value, name) == "BIGINT") & (value(a) >= least), f"json_type(it, '{_way(name)}') IN ('BIGINT', 'UBIGINT') AND json_extract(it, '{_way(name)}')::BIGINT >= {least}")


def references(name: str) -> Test:
    """An array with a known reference at least, and nothing but known references."""
    return Test(
        lambda a: (F.size(items(a.value, name)) > 0) & (F.size(strings(a.value, name)) == F.size(items(a.value, name))) & (F.size(F.array_except(strings(a.value, name), a.known)) == 0),
        f"json_array_length(it, '{_way(name)}') > 0 AND len({_texts('it', name)}) = json_array_length(it, '{_way(name)}') AND list_has_all(known, {_texts('it', name)})",
    )


def distinct(name: str) -> Test:
    return Test(lambda a: F.size(F.array_distinct(strings(a.value, name))) == F.size(strings(a.value, name)), f"len(list_distinct({_texts('it', name)})) = len({_texts('it', name)})")


def each_of(array: str, name: str, duck: str = "root") -> str:
    """SQL: the strings that the members `name` of a record's array hold."""
    return f"list_transform(list_filter(CASE WHEN json_type({duck}, '{_way(array)}') = 'ARRAY' THEN json_extract({duck}, '{_way(array)}')::JSON[] ELSE []::JSON[] END, lambda x: json_type(x, '{_way(name)}') = 'VARCHAR'), lambda x: json_extract_string(x, '{_way(name)}'))"


def members(v: Value | Column, array: str, name: str) -> Column:
    """The strings that the members `name` of an array's elements hold, null where one holds none."""
    return once(v, ("members", array, name), lambda c: F.transform(items(c, array), lambda x: string(x, name)))


def named(v: Value | Column, array: str, name: str) -> Column:
    """The different strings among members, without nulls."""
    return once(v, ("named", array, name), lambda c: F.array_distinct(F.array_compact(members(c, array, name))))


def again(v: Value | Column, array: str, name: str) -> Column:
    """array<boolean>, by place: whether an element before has the same string under name; elements are sorted by it, not compared in pairs."""

    def flags(pairs: Column) -> Column:
        same = lambda p, i: F.coalesce((i > 0) & (F.get(pairs, i - 1)["x"] == p["x"]), F.lit(False))
        return F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["at"], same(p, i).alias("again"))))

    def by_place(c: Column) -> Column:
        pairs = F.array_sort(F.transform(members(c, array, name), lambda x, i: F.struct(x.alias("x"), i.alias("at"))))
        return F.transform(F.flatten(F.transform(F.array(pairs), flags)), lambda f: f["again"])

    return once(v, ("again", array, name), by_place)


# ---- evaluation ------------------------------------------------------------------------------------
_STEP = re.compile(r"([A-Za-z_]+)(\[\*\])?")


def _steps(selector: str) -> tuple[tuple[str, bool], ...]:
    return tuple((name, bool(star)) for name, star in _STEP.findall(selector))


def issues(df: DataFrame, key: list[str], record: Column, rules: list[Rule], name: str, known: Column | None = None) -> DataFrame:
    """(key, rule, path) of every failure; record: a VARIANT, null where a text isn't JSON; known: an array of strings.

    A record of another kind than an object fails every rule on itself.  Elements of what isn't an array aren't tested, nor are
    members of what isn't an object; rules on arrays and objects themselves report these.
    """
    tree: dict = {}
    for rule in rules:
        at = tree
        for step in _steps(rule.selector):
            at = at.setdefault(step, {})
        at.setdefault(None, []).append(rule)

    none, asked = F.lit(None), {}

    def note(at: dict, steps: tuple, value: Value, up: Value, root: Value) -> None:
        """Notes in asked what the tests at an element and below ask of it and of the record."""
        for r in at.get(None, []):
            for test in (r.test, r.given):
                test is None or test.spark(At(value, none, none, up, root, none))
        for step in at:
            if step is not None:
                items(value, step[0]) if step[1] else (kind(value, step[0]), member(value, step[0]))
                note(at[step], (*steps, step), Value(none), value, root)
        asked[steps] = value.asked

    whole = Value(none)
    note(tree, (), whole, whole, whole)

    def found(at: dict, steps: tuple, el: At) -> Column:
        parts = []
        if at.get(None):
            tests = []
            for r in at[None]:
                fails = ~F.coalesce(r.test.spark(el), F.lit(False))
                if r.given is not None:
                    fails = F.coalesce(r.given.spark(el), F.lit(False)) & fails
                tests.append(F.when(fails, F.struct(F.lit(r.name).alias("rule"), F.concat(el.path, F.lit(f".{r.field}" if r.field else "")).alias("path"))))
            parts.append(F.array_compact(F.array(*tests)))
        for step, below in at.items():
            if step is None:
                continue
            field, star = step
            path = F.concat(el.path, F.lit(f".{field}"))
            if star:
                there = items(el.value, field)
            else:
                there = F.when(kind(el.value, field).isNotNull(), F.array(member(el.value, field))).otherwise(F.array().cast("array<variant>"))

            def under(v: Value, i: Column, below=below, way=(*steps, step), path=path, star=star) -> Column:
                here = F.concat(path, F.lit("["), i.cast("string"), F.lit("]")) if star else path
                return found(below, way, At(v, here, i if star else F.lit(0), el.value, el.root, el.known))

            parts.append(F.flatten(with_values(there, asked[(*steps, step)], under)))
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    rows = df.select(*key, record.alias("_record"), (F.array().cast("array<string>") if known is None else known).alias("_known"))
    all_ = F.flatten(with_values(F.array("_record"), asked[()], lambda v, _: found(tree, (), At(v, F.lit(name), F.lit(0), v, v, F.col("_known")))))
    return rows.select(*key, F.explode(all_).alias("_i")).select(*key, "_i.*")


def issues_sql(source: str, key: list[str], rules: list[Rule], name: str) -> str:
    """The same over a DuckDB relation of (key, record, known): one branch a rule, elements by unnesting."""
    keys = ", ".join(key)
    ctes = [f"e AS (SELECT {keys}, TRY_CAST(record AS JSON) AS root, known FROM ({source}))", f"e0 AS (SELECT {keys}, '{name}' AS path, 0 AS place, root AS it, root AS up, root, known FROM e)"]
    made: dict[tuple, str] = {(): "e0"}
    for rule in rules:
        steps = _steps(rule.selector)
        for k in range(1, len(steps) + 1):
            if steps[:k] in made:
                continue
            up, (field, star) = made[steps[: k - 1]], steps[k - 1]
            made[steps[:k]] = here = f"e{len(made)}"
            if star:
                array = f"CASE WHEN json_type(it, '$.{field}') = 'ARRAY' THEN json_array_length(it, '$.{field}')::BIGINT ELSE 0 END"
                ctes.append(f"{here} AS (SELECT {keys}, path || '.{field}[' || i || ']' AS path, i AS place, json_extract(it, '$.{field}[' || i || ']') AS it, it AS up, root, known FROM (SELECT *, unnest(range({array})) AS i FROM {up}))")
            else:
                ctes.append(f"{here} AS (SELECT {keys}, path || '.{field}' AS path, 0 AS place, json_extract(it, '$.{field}') AS it, it AS up, root, known FROM {up} WHERE json_type(it, '$.{field}') IS NOT NULL)")
    parts = []
    for rule in rules:
        given = f" AND coalesce({rule.given.duck}, false)" if rule.given is not None else ""
        field = f" || '.{rule.field}'" if rule.field else ""
        parts.append(f"SELECT {keys}, '{rule.name}' AS rule, path{field} AS path FROM {made[_steps(rule.selector)]} WHERE NOT coalesce({rule.test.duck}, false){given}")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(parts)
