"""Replies checked against declared shapes: a shape compiles to columns, a typed value and the paths at which the reply departs from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """``optional``: may be missing; ``nullable``: may be null. Both give a null value."""

    optional: bool = field(default=False, kw_only=True)
    nullable: bool = field(default=False, kw_only=True)


@dataclass(frozen=True)
class Text(Shape):
    """A string of ``least`` to ``most`` characters."""

    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Whole(Shape):
    """A whole number from ``least`` to ``most``; 2.0 is one."""

    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Truth(Shape):
    pass


@dataclass(frozen=True)
class Items(Shape):
    """An array of ``least`` to ``most`` items of a shape."""

    item: Shape = field(default_factory=Text)
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Record(Shape):
    """An object with these fields; others are passed over, or told if ``strict``."""

    fields: dict[str, Shape] = field(default_factory=dict)
    strict: bool = False


def ddl(shape: Shape) -> str:
    """The type of a shape's value."""
    if isinstance(shape, Items):
        return f"array<{ddl(shape.item)}>"
    if isinstance(shape, Record):
        return f"struct<{','.join(f'`{k}`:{ddl(s)}' for k, s in shape.fields.items())}>"
    return {Text: "string", Whole: "bigint", Truth: "boolean"}[type(shape)]


def _none() -> Column:
    return F.array().cast("array<string>")


def _range(n: Column, least: int | None, most: int | None, path: Column, what: str) -> Column:
    low = F.when(n < least, F.array(F.concat(path, F.lit(f": {what} under {least}")))) if least else F.lit(None)
    high = F.when(n > most, F.array(F.concat(path, F.lit(f": {what} over {most}")))) if most is not None else F.lit(None)
    return F.coalesce(low, high, _none())


def _value(shape: Shape, v: Column) -> Column:
    """The typed value of a variant that has no errors."""
    if isinstance(shape, Items):
        return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _value(shape.item, x))
    if isinstance(shape, Record):
        one = F.struct(*[_value(s, F.try_variant_get(v, f"$.{k}", "variant")).alias(k) for k, s in shape.fields.items()])
        return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), one)
    if isinstance(shape, Whole):
        return F.coalesce(F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "double").cast("bigint"))
    return F.try_variant_get(v, "$", ddl(shape))


def _errors(shape: Shape, v: Column, path: Column) -> Column:
    """Paths at which a variant departs from a shape, in the order of the shape."""
    kind = F.schema_of_variant(v)
    wrong = lambda what: F.array(F.concat(path, F.lit(f": no {what}")))
    if isinstance(shape, Text):
        found = F.when(kind != "STRING", wrong("text")).otherwise(_range(F.length(F.try_variant_get(v, "$", "string")), shape.least, shape.most, path, "length"))
    elif isinstance(shape, Whole):
        n = F.try_variant_get(v, "$", "double")
        number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")
        low = F.when(n < shape.least, F.array(F.concat(path, F.lit(f": number under {shape.least}")))) if shape.least is not None else F.lit(None)
        high = F.when(n > shape.most, F.array(F.concat(path, F.lit(f": number over {shape.most}")))) if shape.most is not None else F.lit(None)
        found = F.when(~number | (n != F.floor(n)), wrong("whole number")).otherwise(F.coalesce(low, high, _none()))
    elif isinstance(shape, Truth):
        found = F.when(kind != "BOOLEAN", wrong("truth value")).otherwise(_none())
    elif isinstance(shape, Items):
        items = F.try_variant_get(v, "$", "array<variant>")
        inner = F.flatten(F.transform(items, lambda x, i: _errors(shape.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        found = F.when(~kind.startswith("ARRAY"), wrong("array")).otherwise(F.concat(_range(F.size(items), shape.least, shape.most, path, "size"), inner))
    else:
        parts = [_errors(s, F.try_variant_get(v, f"$.{k}", "variant"), F.concat(path, F.when(path == "", "").otherwise("."), F.lit(k))) for k, s in shape.fields.items()]
        if shape.strict:
            names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
            parts.append(F.transform(F.array_except(names, F.array(*map(F.lit, shape.fields))), lambda k: F.concat(path, F.when(path == "", "").otherwise("."), k, F.lit(": not known"))))
        found = F.when(~kind.startswith("OBJECT"), wrong("object")).otherwise(F.concat(*parts))
    missing = _none() if shape.optional else wrong("value")
    null = _none() if shape.nullable else F.array(F.concat(path, F.lit(": null")))
    return F.when(v.isNull(), missing).when(F.is_variant_null(v), null).otherwise(found)


def validated(reply: Column, shape: Shape) -> Column:
    """struct(value, errors) of a text that should hold a JSON object of a shape. What stands around the outermost braces is passed over. With any error, which a reply without JSON is, the value is null."""
    text = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    v = F.try_parse_json(text)
    errors = F.when(v.isNull(), F.array(F.lit(": no JSON"))).otherwise(_errors(shape, v, F.lit("")))
    return F.struct(F.when(F.size(errors) == 0, _value(shape, v)).alias("value"), errors.alias("errors"))


#: What the four kinds of replies look like.
TOPIC = Record({
    "needsClarification": Truth(),
    "clarification": Text(optional=True, nullable=True),
    "suggestedTopics": Items(Text(), optional=True, nullable=True),
    "interpretation": Record({"title": Text(), "description": Text()}, optional=True, nullable=True),
})
FORMAT = Record({"choicesCount": Whole(2, 10), "isMultiSelect": Truth(), "rationale": Text()})
SCOPE = Record({"chapters": Items(Record({"title": Text(), "items": Items(Record({"title": Text(), "details": Text(optional=True)}))}))})
QUESTION = Record({
    "content": Text(),
    "options": Items(Record({"id": Text(), "text": Text()})),
    "correctAnswers": Items(Whole(0)),
    "explanations": Items(Record({"optionId": Text(), "isCorrect": Truth(), "explanation": Text()})),
    "subtopicTags": Items(Text()),
    "scopeItemId": Text(optional=True, nullable=True),
})
QUESTIONS = Record({"questions": Items(QUESTION, optional=True)})
