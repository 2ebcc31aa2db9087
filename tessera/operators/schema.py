"""Rules on nested JSON documents, as data: every place of a document meets the rules of its shape.

A document is walked to its last level into rows (path, shape, kind, text).  A path
names fields and places, as in ``/sections/vocabulary/2/term``; its shape has ``*``
for places.  A rule table (shape, tag, check, bound) is joined by shape, so that
users read, replace or extend the rules without code.

Documents are VARIANTs, or typed (structs and arrays of a Spark schema).  Of typed ones
the shapes are known beforehand, so a rule is a column over its place, and only what
the type leaves open (a VARIANT within, a map) is walked as JSON.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import NOT_SPACE, computed, longest_token
from tessera.operators.violations import found

#: Rule tables of at most so many rules are broadcast, and known to the walk.
RULES = 50_000
#: At most so many rules are written as columns over typed documents; with more, these are walked as VARIANTs.
COLUMN_RULES = 1_000
#: Places that a walk gives at once, and characters of their texts.
_PLACES, _CHARACTERS = 8192, 1 << 23
_VARIANTS, _OBJECT = "array<variant>", "map<string,variant>"
#: The characters of ``text.SPACE``, for ``str.strip``.
_SPACES = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


class _Number(str):
    """A number as JSON has it."""


@dataclass(frozen=True)
class Wanted:
    """Which places a walk gives.  Without values: all of them.

    ``shapes``: places of these shapes alone.  ``sound``: by shape, the (least, most)
    characters of texts that no check can find fault with if they aren't blank, and
    ``other_sound`` for the shapes not named; such texts are not given.  ``whole``:
    objects and arrays of these shapes come with their JSON text.  ``left_out``: what
    lies under these fields is not looked at.
    """

    shapes: frozenset[str] | None = None
    sound: dict[str, tuple[int, int]] = field(default_factory=dict)
    other_sound: tuple[int, int] | None = None
    whole: frozenset[str] | None = None
    left_out: frozenset[str] = frozenset()


def _json(x) -> str:
    if type(x) is _Number:
        return x
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in x.items()) + "}"
    return "[" + ",".join(map(_json, x)) + "]" if isinstance(x, list) else json.dumps(x, ensure_ascii=False)


def _places(doc: str, wanted: Wanted, path: str = "", shape: str = "") -> Iterator[tuple]:
    """(path, shape, kind, keys, size, text, json) of the wanted places of one JSON text, itself at ``path`` and of ``shape``."""
    stack = [(path, shape, json.loads(doc, parse_int=_Number, parse_float=_Number, parse_constant=_Number))]
    while stack:
        path, shape, x = stack.pop()
        given = wanted.shapes is None or shape in wanted.shapes
        if isinstance(x, dict | list):
            if given:
                own = _json(x) if wanted.whole is None or shape in wanted.whole else None
                yield (path, shape, "object", list(x), None, None, own) if isinstance(x, dict) else (path, shape, "array", None, len(x), None, own)
            if isinstance(x, dict):
                stack += [(f"{path}/{k}", f"{shape}/{k}", v) for k, v in x.items() if k not in wanted.left_out]
                continue
            shape += "/*"
            bounds = wanted.sound.get(shape, wanted.other_sound)
            if bounds is None:
                stack += [(f"{path}/{i}", shape, v) for i, v in enumerate(x)]
            else:  # long lists of short texts are the most of many documents
                least, most = bounds
                stack += [(f"{path}/{i}", shape, v) for i, v in enumerate(x) if type(v) is not str or not least <= len(v) <= most or not v.strip(_SPACES)]
        elif not given:
            continue
        elif type(x) is str:
            bounds = wanted.sound.get(shape, wanted.other_sound)
            if bounds is None or not bounds[0] <= len(x) <= bounds[1] or not x.strip(_SPACES):
                yield path, shape, "string", None, None, x, None
        else:
            yield path, shape, "number" if type(x) is _Number else "null" if x is None else "boolean", None, None, None, _json(x)


def walked(docs: DataFrame, subject: str, doc: str, *keep: str, wanted: Wanted = Wanted()) -> DataFrame:
    """subject, ``keep``, path, shape, kind, keys, size, text and json of the wanted places of VARIANT documents.

    Kinds are object, array, string, boolean, null and the SQL types that numbers read
    as from JSON; keys are an object's, size an array's, text a string's, json what other
    scalars (and whole objects and arrays) are in JSON.  A document is walked in one pass, over its JSON
    text, however deep it is; a text is handed on once, and not with what it lies in.  A
    null document has no places; an empty object or array is one.
    """
    return _walked(docs.select(F.col(subject).alias("subject"), *keep, F.lit("").alias("_at"), F.lit("").alias("_as"), F.to_json(doc).alias("_doc")), wanted)


def _walked(rows: DataFrame, wanted: Wanted) -> DataFrame:
    """``walked`` over the JSON text ``_doc`` (null: none), which lies at the path ``_at`` and has the shape ``_as``; they are the last columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # a whole value may be as deep as its document

        def done() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-3]]
            return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

        for batch in batches:
            at, rows, held = [], [], 0
            for i, (path, shape, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[-3:]))):
                for place in _places(text, wanted, path, shape) if text is not None else ():
                    at.append(i)
                    rows.append(place)
                    held += len(place[5] or "") + len(place[6] or "")
                    if len(rows) >= _PLACES or held >= _CHARACTERS:
                        yield done()
                        at, rows, held = [], [], 0
            if rows:
                yield done()

    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string()]
    types = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[:-3]] + [("path", "string"), ("shape", "string"), ("kind", "string"), ("keys", "array<string>"), ("size", "int"), ("text", "string"), ("json", "string")]
    names = [name for name, _ in types]
    places = rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in types))
    return places.withColumn("kind", F.when(F.col("kind") == "number", F.lower(F.schema_of_variant(F.parse_json("json")))).otherwise(F.col("kind")))


def unbroken_leaves(docs: DataFrame, subject: str, doc: str, rank: list[Column], most: int = 80) -> DataFrame:
    """Violations: every text of a VARIANT document, however deep, with an over-long run without white space.

    Texts under a field called ``$schema`` are left out.
    """
    ranked = docs.withColumn("_rank", F.array(*[x.cast("long") for x in rank]))
    wanted = Wanted(other_sound=(0, most), whole=frozenset(), left_out=frozenset(["$schema"]))  # a text of ``most`` characters has no longer run
    texts = walked(ranked, subject, doc, "_rank", wanted=wanted).where(F.col("kind") == "string")
    texts = computed(texts, _longest=longest_token(F.col("text")))
    message = F.format_string(f"%s: contains an unbroken text segment of %d characters; the maximum is {most}", F.when(F.col("path") == "", "/").otherwise(F.col("path")), "_longest")
    return found(texts, F.col("subject"), F.col("_longest") > most, [F.get("_rank", F.lit(k)) for k in range(len(rank))], "unbroken_text", F.col("path"), message)


RULE = "kind string, nth int, shape string, tag string, check string, bound string"
#: Names, limits and patterns of lessons and manifests.
PRESET_MODES = ["short-answer", "short-paragraph", "extended-answer", "full-page"]
ASK = {"prompt": 700, "quotation": 700, "teacherGuidance": 1200}
WRITE = {"prompt": 700, "exampleStructureOrRubric": 1200, "teacherGuidance": 1200}
WORD = {"term": 60, "koreanMeaning": 100, "definition": 600, "bookExcerpt": 600, "excerptContext": 700, "chapterReference": 80}
LESSON_TEXTS = {"title": 100, "readingRange": 80, "framingNote": 400, "studentInstructions": 400}
MANIFEST_TEXTS = {"bookTitle": 90, "author": 80, "seriesTitle": 80, "lessonRange": 60, "coverSubtitle": 180}
SECTIONS = ["readingComprehension", "criticalThinkingAndAnalysis", "paragraphWriting", "vocabulary"]
ID_PATTERN, FILE_PATTERN = "^[a-z0-9]+(?:-[a-z0-9]+)*$", r"^lessons/[a-z0-9][a-z0-9._-]*\.json$"
GUIDANCE_ITEMS, GUIDANCE_LENGTH = 6, 180


def _text(shape: str, most: int | None) -> list[tuple]:
    return [(shape, None, "type", "string"), (shape, None, "min_length", "1"), (shape, None, "not_blank", r"\S")] + ([(shape, None, "max_length", str(most))] if most else [])


def _object(shape: str, required: list[str], others: list[str]) -> list[tuple]:
    out = [(shape, None, "type", "object"), (shape, None, "closed", None)]
    return out + [(shape, None, "required", x) for x in required] + [(shape, None, "property", x) for x in [*required, *others]]


def _space(shape: str) -> list[tuple]:
    """A union of three shapes, told apart by its mode."""
    out = [(shape, None, "type", "object"), (shape, None, "tag", "mode"), (shape, None, "required", "mode"), (shape, None, "closed", None), (shape, None, "property", "mode")]
    out += [(shape, m, "variant", None) for m in [*PRESET_MODES, "multiple-pages", "custom-lines"]]
    for mode, field, least in (("multiple-pages", "pages", "2"), ("custom-lines", "lines", "0")):
        out += [(shape, mode, "required", field), (shape, mode, "property", field), (f"{shape}/{field}", None, "type", "integer"), (f"{shape}/{field}", None, "minimum", least)]
    return out


def _items(shape: str, texts: dict[str, int], required: list[str], lists: list[str], space: bool) -> list[tuple]:
    out = [(shape, None, "type", "array"), (shape, None, "min_items", "1")]
    out += _object(f"{shape}/*", required, [x for x in [*texts, *lists, *["responseSpace"] * space] if x not in required])
    for field, most in texts.items():
        out += _text(f"{shape}/*/{field}", most)
    for field in lists:
        at = f"{shape}/*/{field}"
        out += [(at, None, "type", "array"), (at, None, "min_items", "1")]
        out += [(at, None, "max_items", str(GUIDANCE_ITEMS))] * (field == "responseGuidance") + _text(f"{at}/*", GUIDANCE_LENGTH if field == "responseGuidance" else None)
    return out + (_space(f"{shape}/*/responseSpace") if space else [])


def _lesson() -> list[tuple]:
    out = _object("", ["schemaVersion", "lessonNumber", "title", "readingRange", "sections"], ["$schema", "framingNote", "studentInstructions"])
    out += [("/$schema", None, "type", "string"), ("/schemaVersion", None, "const", "1"), ("/lessonNumber", None, "type", "integer"), ("/lessonNumber", None, "minimum", "1")]
    for field, most in LESSON_TEXTS.items():
        out += _text(f"/{field}", most)
    out += _object("/sections", SECTIONS, [])
    for section in SECTIONS[:2]:
        out += _items(f"/sections/{section}", ASK, ["prompt"], ["responseGuidance"], True)
    out += _items("/sections/paragraphWriting", WRITE, ["prompt"], ["hints", "responseGuidance"], True)
    return out + _items("/sections/vocabulary", WORD, [x for x in WORD if x != "chapterReference"], [], False)


def _manifest() -> list[tuple]:
    out = _object("", ["schemaVersion", "id", "bookTitle", "author", "lessonRange", "lessonFiles"], ["$schema", "seriesTitle", "coverSubtitle"])
    out += [("/$schema", None, "type", "string"), ("/schemaVersion", None, "const", "1"), ("/id", None, "type", "string"), ("/id", None, "pattern", ID_PATTERN)]
    for field, most in MANIFEST_TEXTS.items():
        out += _text(f"/{field}", most)
    out += [("/lessonFiles", None, "type", "array"), ("/lessonFiles", None, "min_items", "1"), ("/lessonFiles", None, "unique_items", None)]
    return out + [("/lessonFiles/*", None, "type", "string"), ("/lessonFiles/*", None, "pattern", FILE_PATTERN)]


def schema_table(spark: SparkSession) -> DataFrame:
    """kind (lesson, manifest), nth, shape, tag, check and bound of every rule, for users to read or replace.

    Checks: type, const, enum, min_length, max_length, not_blank, pattern, minimum,
    min_items, max_items, unique_items, required, closed (with property), and a union's
    tag (with variant).  A rule with a tag holds for objects of that tag alone.
    """
    rows = [("lesson", k, *r) for k, r in enumerate(_lesson())] + [("manifest", k, *r) for k, r in enumerate(_manifest())]
    return spark.createDataFrame(rows, RULE)


@dataclass(frozen=True)
class _Place:
    """What rules ask about a place; ``has`` is whether an object has a field, ``tag`` and ``tags`` are an object's own and those of its union."""

    kind: Column
    size: Column
    text: Column
    json: Column
    number: Column
    tag: Column
    tags: Column
    has: Callable[[Column], Column]


def _blank(text: Column) -> Column:
    """True for a text of white space alone; its first character decides for most, by the gaps in which no white space lies."""
    return ~(((text >= "!") & (text < "\x80")) | ((text >= "\xa1") & (text < "\u1680")) | ((text >= "\u3001") & (text < "\ufeff")) | text.rlike(NOT_SPACE))


def _problems(bound: Column, p: _Place) -> dict[str, tuple[Callable[[], Column], str]]:
    """By check, when a rule about one place that is whole in itself is broken, and the message, with the bound for %s."""
    value = lambda: F.coalesce(p.json, F.to_json(p.text.cast("variant")))
    count = lambda: bound.try_cast("int")
    whole = lambda: F.when(bound == "integer", F.coalesce(p.number == F.floor(p.number), F.lit(False))).when(bound == "number", p.number.isNotNull()).otherwise(p.kind == bound)
    distinct = lambda: F.array_distinct(F.transform(F.try_variant_get(F.try_parse_json(p.json), "$", _VARIANTS), lambda x: F.to_json(x)))
    return {
        "type": (lambda: ~whole(), "must be %s"),
        "const": (lambda: value() != bound, "must be equal to constant"),
        "enum": (lambda: ~F.array_contains(F.from_json(bound, "array<string>"), F.coalesce(p.text, p.json)), "must be equal to one of the allowed values"),
        "min_length": (lambda: F.length(p.text) < count(), "must NOT have fewer than %s characters"),
        "max_length": (lambda: F.length(p.text) > count(), "must NOT have more than %s characters"),
        "not_blank": (lambda: _blank(p.text), 'must match pattern "%s"'),
        "pattern": (lambda: ~F.rlike(p.text, bound), 'must match pattern "%s"'),
        "minimum": (lambda: p.number < bound.try_cast("double"), "must be >= %s"),
        "min_items": (lambda: p.size < count(), "must NOT have fewer than %s items"),
        "max_items": (lambda: p.size > count(), "must NOT have more than %s items"),
        "unique_items": (lambda: F.size(distinct()) < p.size, "must NOT have duplicate items"),
        "tag": (lambda: (p.kind == "object") & p.tag.isNotNull() & ~F.array_contains(p.tags, p.tag), "must match exactly one schema in oneOf"),
        "required": (lambda: (p.kind == "object") & ~p.has(bound), "must have required property '%s'"),
    }


def _problem(check: Column, bound: Column) -> Column:
    """The message of the rule of a row about the place of that row."""
    place = _Place(*map(F.col, ["kind", "size", "text", "json", "_number", "_tag", "_tags"]), lambda name: F.array_contains("keys", name))
    out = F
    for name, (broken, form) in _problems(bound, place).items():
        out = out.when(check == name, F.when(broken(), F.format_string(form, bound) if "%s" in form else form))
    return out


def _wanted(rules: list) -> Wanted:
    """The places that rules (shape, tag, check, bound) can find fault with.

    Texts are sound by their length where a shape has rules on length, blanks and the
    type string alone; a bound that is no plain number leaves its shape to the rules.
    """
    sound: dict[str, tuple[int, int]] = {}
    other = set()
    for r in rules:
        least, most = sound.get(r.shape, (0, sys.maxsize))
        plain = r.bound is not None and r.bound.isascii() and r.bound.isdigit() and len(r.bound) < 10
        if r.check == "min_length" and plain:
            sound[r.shape] = max(least, int(r.bound)), most
        elif r.check == "max_length" and plain:
            sound[r.shape] = least, min(most, int(r.bound))
        elif r.check == "not_blank" or (r.check == "type" and r.bound == "string"):
            sound[r.shape] = least, most
        else:
            other.add(r.shape)
    return Wanted(frozenset(r.shape for r in rules), {k: v for k, v in sound.items() if k not in other}, None, frozenset(r.shape for r in rules if r.check in ("const", "enum", "unique_items", "tag")))


_ADDED = "must NOT have additional properties"
_FAULTS = "array<struct<nth:int,path:string,problem:string>>"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType)


def _json_of(x: Column, t: T.DataType) -> Column:
    """A value of any type as JSON text; nulls too."""
    if isinstance(t, T.VariantType):
        return F.coalesce(F.to_json(x), F.lit("null"))
    made = F.to_json(F.array(x))
    return F.substring(made, F.lit(2), F.length(made) - 2)


@dataclass(frozen=True)
class _Typed:
    """Rules (nth, shape, tag, check, bound) as columns over documents of a known type.

    ``faults`` and ``others`` give arrays, to be joined into one: what is wrong with a
    value and with all that lies in it, and (path, shape, json) of what the type leaves
    open, which is walked.  As in JSON, a field that is null isn't there, and an item
    that is null is one.
    """

    rules: list

    def of(self, shape: str) -> list:
        return [r for r in self.rules if r.shape == shape]

    def ruled(self, shape: str) -> bool:
        return any(r.shape == shape or r.shape.startswith(shape + "/") for r in self.rules)

    def opened(self, t: T.DataType, shape: str) -> bool:
        if isinstance(t, T.StructType) and len({name.lower() for name in t.names}) < len(t.names):
            return False
        if isinstance(t, T.StructType | T.ArrayType):  # rules on a whole value compare it as JSON
            return not any(r.check in ("const", "enum", "unique_items") for r in self.of(shape))
        return t == T.StringType() or isinstance(t, (T.BooleanType, *_NUMBERS))

    def _place(self, x: Column, t: T.DataType, shape: str) -> _Place:
        none, checks = F.lit(None), {r.check for r in self.of(shape)}
        kind, size, text, own, number, tag, tags = [none] * 7
        if isinstance(t, T.StructType):
            kind = F.lit("object")
            name = min((r.bound for r in self.of(shape) if r.check == "tag" and r.bound is not None), default=None)
            if name in t.names:
                y, of_tag = x.getField(name), t[name].dataType
                tag = y if of_tag == T.StringType() else F.try_variant_get(F.try_parse_json(F.when(y.isNotNull(), _json_of(y, of_tag))), "$", "string")
            if "tag" in checks:
                tags = F.array(*[F.lit(r.tag) for r in self.of(shape) if r.check == "variant" and r.tag is not None]).cast("array<string>")
        elif isinstance(t, T.ArrayType):
            kind, size = F.lit("array"), F.size(x)
        elif isinstance(t, T.StringType):
            kind, text = F.lit("string"), x
        elif isinstance(t, T.BooleanType):
            kind, own = F.lit("boolean"), x.cast("string")
        elif isinstance(t, _NUMBERS):
            number, plain = x.cast("double"), None
            if isinstance(t, T.DoubleType):  # JSON has texts for the others
                plain = ~F.isnan(x) & (F.abs(x) != float("inf"))
                number, text = F.when(plain, number), F.when(~plain, x.cast("string"))
            if checks & {"const", "enum"} or any(r.check == "type" and r.bound not in ("integer", "number") for r in self.of(shape)):
                own = F.to_json(F.try_parse_json(x.cast("string")))
                kind = F.lower(F.schema_of_variant(F.try_parse_json(own)))
                if plain is not None:
                    own, kind = F.when(plain, own), F.when(plain, kind).otherwise("string")
        elif isinstance(t, T.NullType):
            kind, own = F.lit("null"), F.lit("null")
        return _Place(kind, size, text, own, number, tag, tags, lambda name: F.lit(False))

    def _own(self, x: Column, t: T.DataType, path: Column, shape: str) -> Column | None:
        """What is wrong with one value that isn't null (or, as NullType, with a null item)."""
        place, broken, said = self._place(x, t, shape), [], []
        known = [(r.tag, r.bound) for r in self.of(shape) if r.check == "property"]
        struct = isinstance(t, T.StructType)
        kinds = {"object"} if struct else {"array"} if isinstance(t, T.ArrayType) else {"string"} if isinstance(t, T.StringType) else {"integer", "number"} if isinstance(t, _NUMBERS[:-1]) else set()

        def fault(r, under: str, fails: Column, message: str) -> None:
            broken.append(F.when(fails if r.tag is None else (place.tag == r.tag) & fails, len(said)))
            said.append((r.nth, under, message))

        for r in self.of(shape):
            if r.check == "closed" and struct:
                for name in t.names:
                    tags = [tag for tag, bound in known if bound == name]
                    if None not in tags:
                        there = x.getField(name).isNotNull()
                        fault(r, f"/{name}", there & ~F.coalesce(place.tag.isin(*tags), F.lit(False)) if tags else there, _ADDED)
            elif r.check == "required" and struct and r.bound is not None:
                fault(r, f"/{r.bound}", x.getField(r.bound).isNull() if r.bound in t.names else F.lit(True), f"must have required property '{r.bound}'")
            elif r.check not in ("closed", "required", "property", "variant") and not (r.check == "type" and r.bound in kinds):
                fails, form = _problems(F.lit(r.bound).cast("string"), place).get(r.check, (None, ""))
                if fails:
                    fault(r, "", fails(), form.replace("%s", r.bound or ""))
        if not said:
            return None
        said_ = F.from_json(F.lit(json.dumps([dict(zip(("nth", "under", "problem"), x)) for x in said])), "array<struct<nth:int,under:string,problem:string>>")  # folded to a constant

        def told(k: Column) -> Column:
            f = F.get(said_, k)
            return F.struct(f["nth"].alias("nth"), F.concat(path, f["under"]).alias("path"), f["problem"].alias("problem"))

        return F.transform(F.filter(F.array(*broken), lambda k: k.isNotNull()), told)

    def _each(self, x: Column, path: Column, given: Callable[[Column, Column], Column]) -> Column:
        return F.flatten(F.filter(F.transform(x, lambda y, i: given(y, F.concat(path, F.lit("/"), i.cast("string")))), lambda found_: found_.isNotNull()))

    def _sound(self, x: Column, shape: str) -> Column:
        """Whether no rule can find fault with a text; most are told by their bytes' number and the first one."""
        least, most = _wanted(self.rules).sound[shape]
        fits = F.length(x) >= least if least > 1 else F.lit(True)
        fits = fits & ((F.octet_length(x) <= most) | (F.length(x) <= most)) if most < sys.maxsize else fits
        return F.coalesce(fits & (x != "") & ~_blank(x), F.lit(False))

    def faults(self, x: Column, t: T.DataType, path: Column, shape: str) -> Column | None:
        if not self.ruled(shape) or not self.opened(t, shape):
            return None
        out = [self._own(x, t, path, shape)]
        if isinstance(t, T.StructType):
            out += [self.faults(x.getField(f.name), f.dataType, F.concat(path, F.lit(f"/{f.name}")), f"{shape}/{f.name}") for f in t.fields]
        elif isinstance(t, T.ArrayType):
            at, one = f"{shape}/*", t.elementType
            if self.ruled(at) and self.opened(one, at):

                def item(y: Column, spot: Column) -> Column:
                    of_null, of_one = self._own(y, T.NullType(), spot, at), self.faults(y, one, spot, at)
                    found_ = F.when(y.isNull(), F.lit(None).cast(_FAULTS) if of_null is None else of_null)
                    found_ = found_ if of_one is None else found_.otherwise(of_one)
                    return F.when(~self._sound(y, at), found_) if sound else found_

                sound = isinstance(one, T.StringType) and at in _wanted(self.rules).sound
                each = self._each(x, path, item)
                out.append(F.when(F.exists(x, lambda y: ~self._sound(y, at)), each).otherwise(F.array().cast(_FAULTS)) if sound else each)
        out = [o for o in out if o is not None]
        return F.when(x.isNotNull(), F.concat(*out)).otherwise(F.array().cast(_FAULTS)) if out else None

    def others(self, x: Column, t: T.DataType, path: Column, shape: str, item: bool = False) -> Column | None:
        if not self.ruled(shape):
            return None
        none = F.array().cast("array<struct<_at:string,_as:string,_doc:string>>")
        if not self.opened(t, shape):
            given = F.array(F.struct(path.alias("_at"), F.lit(shape).alias("_as"), _json_of(x, t).alias("_doc")))
            return given if item else F.when(x.isNotNull(), given).otherwise(none)
        out = []
        if isinstance(t, T.StructType):
            out = [self.others(x.getField(f.name), f.dataType, F.concat(path, F.lit(f"/{f.name}")), f"{shape}/{f.name}") for f in t.fields]
        elif isinstance(t, T.ArrayType) and self.others(x, t.elementType, path, f"{shape}/*") is not None:
            out = [self._each(x, path, lambda y, spot: self.others(y, t.elementType, spot, f"{shape}/*", item=True))]
        out = [o for o in out if o is not None]
        return F.when(x.isNotNull(), F.concat(*out)).otherwise(none) if out else None


def schema_violations(docs: DataFrame, kind: str, subject: str, doc: str, rank: list[Column], table: DataFrame | None = None) -> DataFrame:
    """All violations of a rule table by VARIANT or typed documents, at every depth; ``table`` replaces ``schema_table``.

    A missing or unknown field is named by its parent's path and its own name.
    """
    table = (schema_table(docs.sparkSession) if table is None else table).where(F.col("kind") == kind)
    rules = table.select("nth", "shape", "tag", "check", "bound").limit(RULES + 1).collect()  # at most so many rules come here
    wanted = _wanted(rules) if len(rules) <= RULES else Wanted()
    ranked = docs.withColumn("_rank", F.array(*[x.cast("long") for x in rank]))
    type_ = docs.schema[doc].dataType
    if isinstance(type_, T.StructType | T.ArrayType) and len(rules) <= COLUMN_RULES:
        typed, subject_ = _Typed(rules), F.col(subject).alias("subject")
        faults = typed.faults(F.col("_typed"), type_, F.lit(""), "")
        others = typed.others(F.col(doc), type_, F.lit(""), "")
        parts = []
        if faults is not None:
            parts.append(computed(ranked.select(subject_, "_rank", F.col(doc).alias("_typed")), _typed=F.col("_typed")).select("subject", "_rank", F.inline(faults)))
        if others is not None or not parts:
            left = ranked.select(subject_, "_rank", F.inline(others)) if others is not None else ranked.where("false").select(subject_, "_rank", *[F.lit("").alias(c) for c in ("_at", "_as", "_doc")])
            parts.append(_judged(_walked(left, wanted), table, len(rules)))
        spread = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    else:
        if not isinstance(type_, T.VariantType):
            ranked = ranked.withColumn(doc, F.parse_json(F.to_json(doc)))
        spread = _judged(walked(ranked, subject, doc, "_rank", wanted=wanted), table, len(rules))
    at = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    return found(spread, F.col("subject"), F.lit(True), [*[F.get("_rank", F.lit(k)) for k in range(len(rank))], F.col("nth")], "schema", F.col("path"), F.concat(at, F.lit(": "), F.col("problem")))


def _judged(places: DataFrame, table: DataFrame, rules: int) -> DataFrame:
    """subject, _rank, nth, path and problem of all rules that walked places break."""
    one = lambda check, give: F.array_compact(F.collect_list(F.when(F.col("check") == check, give)))
    of_shape = table.groupBy("shape").agg(F.min(F.when(F.col("check") == "tag", F.col("bound"))).alias("_tag_field"), one("variant", F.col("tag")).alias("_tags"), one("property", F.struct("tag", "bound")).alias("_known"))
    checks = table.where(~F.col("check").isin("variant", "property")).join(of_shape, "shape").drop("kind")
    fields = of_shape.where("_tag_field is not null").select("shape", F.col("_tag_field").alias("_field"))
    if rules <= RULES:
        checks, fields = F.broadcast(checks), F.broadcast(fields)
    places = places.join(fields, "shape", "left")
    number = F.when(~F.col("kind").isin("object", "array", "string", "boolean", "null"), F.try_variant_get(F.try_parse_json("json"), "$", "double"))
    tag = F.when((F.col("kind") == "object") & F.col("_field").isNotNull(), F.try_variant_get(F.try_element_at(F.try_variant_get(F.try_parse_json("json"), "$", _OBJECT), F.col("_field")), "$", "string"))
    places = computed(places, _number=number, _tag=tag)
    # a row a place and rule: what fails stays, in one generated loop
    met = places.join(checks, "shape").where(F.col("tag").isNull() | (F.col("tag") == F.col("_tag")))
    known = F.transform(F.filter("_known", lambda k: k["tag"].isNull() | (k["tag"] == F.col("_tag"))), lambda k: k["bound"])
    unknown = F.when((F.col("check") == "closed") & (F.col("kind") == "object"), F.array_except("keys", known))
    under = lambda name: F.concat("path", F.lit("/"), name)
    fails = met.withColumns({"problem": _problem(F.col("check"), F.col("bound")), "unknown": unknown}).where("problem is not null or size(unknown) > 0")
    named = F.transform("unknown", lambda x: F.struct(under(x).alias("path"), F.lit(_ADDED).alias("problem")))
    alone = F.array(F.struct(F.when(F.col("check") == "required", under(F.col("bound"))).otherwise(F.col("path")).alias("path"), "problem"))
    return fails.select("subject", "_rank", F.col("nth").cast("int").alias("nth"), F.inline(F.when(F.col("check") == "closed", named).otherwise(alone)))
