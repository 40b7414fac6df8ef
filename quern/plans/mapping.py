"""Typed, additive mappings and the columns that their fields are analysed into."""

from __future__ import annotations

from dataclasses import dataclass, field as _field

from pyspark.sql import types as T

KEYWORD, TEXT, LIST, NUMBER, BOOL, DATE, POINT, NESTED = "keyword", "text", "keyword_list", "number", "bool", "date", "point", "nested"
SCALARS = (KEYWORD, TEXT, LIST, NUMBER, BOOL, DATE)
MAX_NAME, MAX_MEMBERS, MAX_POINTS, MAX_ID = 128, 10_000, 10_000, 512
_XY = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
#: Parts of an analysed field by type: suffix and column type, besides "p" (present).
PARTS = {
    KEYWORD: {"t": T.StringType()},
    TEXT: {"t": T.StringType(), "w": T.StringType()},
    LIST: {"e": T.ArrayType(T.StringType())},
    NUMBER: {"n": T.DoubleType()},
    DATE: {"n": T.DoubleType()},
    BOOL: {"b": T.BooleanType()},
    POINT: {"xy": _XY},
}


class Refused(Exception):
    """A request that is not answered, with the place and the reason of every problem."""

    def __init__(self, *problems: tuple[str, str], status: int = 400):
        self.status = status
        self.problems = [{"loc": loc, "message": message} for loc, message in problems]
        super().__init__("; ".join(f"{loc}: {message}" for loc, message in problems))

    def body(self) -> dict:
        return {"type": "about:blank", "title": "refused", "status": self.status, "code": "invalid", "detail": str(self), "problems": self.problems}


@dataclass(frozen=True)
class Field:
    type: str
    x: str = NUMBER
    y: str = NUMBER
    fields: dict = _field(default_factory=dict)

    def as_json(self):
        if self.type == POINT:
            return {"type": POINT, "x": self.x, "y": self.y}
        if self.type == NESTED:
            return {"type": NESTED, "fields": {k: f.as_json() for k, f in self.fields.items()}}
        return self.type

    @staticmethod
    def of(spec, loc: str) -> Field:
        kind = spec.get("type") if isinstance(spec, dict) else spec
        if kind in SCALARS and (isinstance(spec, str) or set(spec) == {"type"}):
            return Field(kind)
        if kind == POINT and isinstance(spec, dict) and {spec.get("x"), spec.get("y")} <= {NUMBER, DATE} and set(spec) == {"type", "x", "y"}:
            return Field(POINT, spec["x"], spec["y"])
        if kind == NESTED and isinstance(spec, dict) and isinstance(spec.get("fields"), dict) and set(spec) == {"type", "fields"}:
            subs = {}
            for name, sub in spec["fields"].items():
                check_name(name, f"{loc}.fields.{name}")
                subs[name] = Field.of(sub, f"{loc}.fields.{name}")
                if subs[name].type in (POINT, NESTED):
                    raise Refused((f"{loc}.fields.{name}", f"a {subs[name].type} can't be inside a nested field"))
            return Field(NESTED, fields=subs)
        raise Refused((loc, f"unknown field type {spec!r}"))


def check_name(name: str, loc: str) -> None:
    if not name or len(name) > MAX_NAME or name == "_id" or "\x00" in name:
        raise Refused((loc, "a field name has 1 to 128 characters and is not _id"))


class Mapping:
    """Field names and types, and what happens to names that are not in it: true (infer), false (ignore), strict."""

    def __init__(self, fields: dict | None = None, dynamic="true"):
        self.dynamic = {True: "true", False: "false"}.get(dynamic, dynamic)
        if self.dynamic not in ("true", "false", "strict"):
            raise Refused(("dynamic", "dynamic is true, false or strict"))
        self.fields: dict[str, Field] = {}
        for name, spec in (fields or {}).items():
            check_name(name, f"fields.{name}")
            self.fields[name] = spec if isinstance(spec, Field) else Field.of(spec, f"fields.{name}")

    @staticmethod
    def of(spec: dict) -> Mapping:
        return Mapping(spec.get("fields", {}), spec.get("dynamic", "true"))

    def as_json(self) -> dict:
        return {"dynamic": self.dynamic, "fields": {k: f.as_json() for k, f in sorted(self.fields.items())}}

    def merge(self, more: dict) -> Mapping:
        """This mapping with more fields; a field that changes its type is refused, nested fields gain sub-fields."""
        out = dict(self.fields)
        for name, spec in more.items():
            new = spec if isinstance(spec, Field) else Field.of(spec, f"fields.{name}")
            old = out.get(name)
            if old and old.type == new.type == NESTED:
                for sub, f in new.fields.items():
                    if sub in old.fields and old.fields[sub] != f:
                        raise Refused((f"fields.{name}.fields.{sub}", f"is {old.fields[sub].type} already"))
                new = Field(NESTED, fields={**old.fields, **new.fields})
            elif old and old != new:
                raise Refused((f"fields.{name}", f"is {old.type} already"))
            check_name(name, f"fields.{name}")
            out[name] = new
        return Mapping(out, self.dynamic)

    def find(self, name: str) -> tuple[str | None, Field | None]:
        """The nested path (None at the top) and the field of a name; "path.sub" is a sub-field of a nested path."""
        if name in self.fields:
            return None, self.fields[name]
        path, dot, sub = name.partition(".")
        while dot:
            if path in self.fields and self.fields[path].type == NESTED and sub in self.fields[path].fields:
                return path, self.fields[path].fields[sub]
            more, dot, sub = sub.partition(".")
            path = f"{path}.{more}"
        return None, None

    def schema(self) -> T.StructType:
        """Columns of analysed documents."""
        base = [("id", T.StringType()), ("_id__t", T.StringType()), ("body", T.StringType()), ("seq", T.LongType()), ("version", T.LongType())]
        out = [T.StructField(n, t) for n, t in base]
        for name, f in sorted(self.fields.items()):
            out.append(T.StructField(f"{name}__p", T.BooleanType()))
            if f.type == NESTED:
                out.append(T.StructField(f"{name}__o", T.ArrayType(object_type(f))))
            else:
                out += [T.StructField(f"{name}__{k}", t) for k, t in PARTS[f.type].items()]
        return T.StructType(out)


def object_type(f: Field) -> T.StructType:
    out = []
    for sub, g in sorted(f.fields.items()):
        out.append(T.StructField(f"{sub}__p", T.BooleanType()))
        out += [T.StructField(f"{sub}__{k}", t) for k, t in PARTS[g.type].items()]
    return T.StructType([T.StructField("__json", T.StringType()), *out])
