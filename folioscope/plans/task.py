"""Declared tasks: the fields of a result, how it is asked for, and how an answer is read."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

KIND_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "enum": T.StringType(), "list": T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "str"
    vocabulary: tuple[str, ...] = ()
    required: bool = True
    default: object = None


@dataclass(frozen=True)
class TaskSpec:
    """A task: its fields (one record, or a list of records), prompt text and call settings."""

    name: str
    fields: tuple[Field, ...]
    is_list: bool = False
    system: str = ""
    examples: tuple[tuple[str, object], ...] = ()
    version: int = 1
    temperature: float = 0.2
    max_tokens: int = 4096
    retries: int = 2
    ordinals: Mapping[str, Mapping[str, int]] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KIND_TYPES[f.kind]) for f in self.fields])

    def schema(self) -> T.DataType:
        return T.ArrayType(self.struct()) if self.is_list else self.struct()

    def json_spec(self) -> dict:
        kinds = {"bool": "boolean", "int": "integer", "float": "number", "str": "string", "enum": "string", "list": "array"}
        properties = {f.name: {"type": kinds[f.kind]} | ({"enum": list(f.vocabulary)} if f.vocabulary and f.kind == "enum" else {"items": list(f.vocabulary)} if f.kind == "list" and f.vocabulary else {}) for f in self.fields}
        one = {"type": "object", "properties": properties, "required": [f.name for f in self.fields if f.required]}
        return {"type": "array", "items": one} if self.is_list else one

    def prompt(self) -> str:
        """Instructions, the form of the answer and examples: one constant for a batch."""
        parts = [self.system, "Answer with JSON of this form only:\n" + json.dumps(self.json_spec(), sort_keys=True)]
        parts += [f"Example input:\n{a}\nExample output:\n{json.dumps(b, sort_keys=True)}" for a, b in self.examples]
        return "\n\n".join(p for p in parts if p)


#: Tasks by name; prefix_of gives the feature prefix of a task.
TASKS: dict[str, TaskSpec] = {}


def register_task(spec: TaskSpec) -> TaskSpec:
    TASKS[spec.name] = spec
    return spec


def resolve_task(name: str) -> TaskSpec:
    if name not in TASKS:
        raise KeyError(f"unknown task {name!r}; known: {', '.join(sorted(TASKS))}")
    return TASKS[name]


def prefix_of(name: str) -> str:
    """'passage-x-y' -> 'x_y.'"""
    return name.removeprefix("passage-").replace("-", "_") + "."


# ---- answers ---------------------------------------------------------------------------------


def parse_json(text: str) -> object:
    """JSON from an answer: without a fence, else the widest bracketed part, else after small repairs; ValueError if none."""
    body = text.strip()
    fence = re.search(r"```[a-zA-Z]*\s*(.*?)```", body, re.S)
    if fence:
        body = fence.group(1).strip()
    tries = [body]
    for left, right in ("[]", "{}"):
        a, b = body.find(left), body.rfind(right)
        if 0 <= a < b:
            tries.append(body[a : b + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    for t in reversed(tries):
        mended = _mend(t)
        if mended is not None:
            return mended
    raise ValueError(f"no JSON in answer: {text[:80]!r}")


def _mend(text: str) -> object | None:
    """Trailing commas, single quotes, bare keys, Python words and unclosed brackets; None if that isn't enough."""
    if not re.search(r"[\[{]", text):
        return None
    t = text[re.search(r"[\[{]", text).start() :]
    t = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", t)))
    t = re.sub(r"(?<=[\[{,:\s])'((?:[^'\\]|\\.)*)'(?=\s*[,:\]}])", lambda m: json.dumps(m.group(1)), t)
    t = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', t)
    t = re.sub(r'(:\s*)([A-Za-z][^",{}\[\]]*)"(?=\s*[,}\]])', r'\1"\2"', t)
    stack, quoted, escaped = [], False, False
    for c in t:
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
    t = t + ('"' if quoted else "") + "".join(reversed(stack))
    t = re.sub(r",\s*(?=[\]}])", "", t)
    try:
        return json.loads(t)
    except ValueError:
        return None


def unwrap(data: object, names: Sequence[str]) -> object:
    """Takes off an echoed schema ({"properties": ...}) and per-field envelopes ({"type": ..., "value": ...})."""
    if isinstance(data, dict) and isinstance(data.get("properties"), dict):
        inner = data["properties"]
        if len(set(inner) & set(names)) > len(set(data) & set(names)):
            data = inner
    if isinstance(data, dict) and data and all(isinstance(v, dict) and "type" in v and "value" in v for v in data.values()):
        data = {k: v["value"] for k, v in data.items()}
    return data


def validate(data: object, spec: TaskSpec) -> object:
    """A record, or a list of records, with the declared kinds; a lone record becomes a list; ValueError names what is wrong."""
    names = [f.name for f in spec.fields]
    data = unwrap(data, names)
    if spec.is_list:
        return [_record(unwrap(x, names), spec) for x in (data if isinstance(data, list) else [data])]
    return _record(data, spec)


def _record(data: object, spec: TaskSpec) -> dict:
    if not isinstance(data, dict):
        raise ValueError("not an object")
    out = {}
    for f in spec.fields:
        if f.name not in data or data[f.name] is None:
            if f.required and f.default is None and f.name not in data:
                raise ValueError(f"{f.name}: missing")
            out[f.name] = f.default
            continue
        out[f.name] = _value(data[f.name], f)
    return out


def _value(v: object, f: Field) -> object:
    if f.kind == "bool":
        if isinstance(v, bool):
            return v
        if str(v).strip().lower() in ("true", "yes", "1"):
            return True
        if str(v).strip().lower() in ("false", "no", "0"):
            return False
    elif f.kind in ("int", "float"):
        try:
            x = float(v)  # type: ignore[arg-type]
            if f.kind == "float" and not isinstance(v, bool):
                return x
            if x == int(x) and not isinstance(v, bool):
                return int(x)
        except (TypeError, ValueError, OverflowError):
            pass
    elif f.kind == "list":
        if isinstance(v, list) and all(isinstance(x, str) and (not f.vocabulary or x in f.vocabulary) for x in v):
            return v
    elif f.kind == "enum":
        if isinstance(v, str) and v in f.vocabulary:
            return v
    elif isinstance(v, str):
        return v
    raise ValueError(f"{f.name}: {v!r} is no {f.kind}")
