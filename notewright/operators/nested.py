"""Problem 2: related flat tables out of deeply nested records, by structural variants.

A bottom-up tree automaton reads each JSON value. Its transitions are a table (`RULES`): an object's state follows
from the classes of its keys and the states of its children, children first, so a node's state is decided
when all below it are. The state of the root is the record's variant, the state of an item its subtype. Rows are
routed by subtype to typed tables (`SUBTYPES`): spans by offsets and labels, concepts by position, concepts
inside a note's section. All keep the supertype keys (table, record key, span number), which link assertions
and candidates to their item and items to their record; records have a table of their own.

Columns that are typed already (`unified.spans`, `out_docs.concepts`) need no parsing: their variant is known
from the schema and they are flattened in the JVM by `posexplode`.

Defined results: a null or empty container gives no rows; null or empty elements give no rows but keep their
number; a scalar stands for a list of one; values that are not strings (numbers, booleans) are taken as their
JSON text; a payload that is not JSON, even after undoing a second encoding, gives no rows but a record of variant
'unreadable'. Trees of any depth are read. Rows delivered twice (same key, same content) count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- the tree automaton -----------------------------------------------------------------------------------

#: Keys that hold an item's assertions, its codes, and a record's items, whatever the origin calls them.
ASSERTION_KEYS = ("assertions", "assertion", "assert")
CODE_KEYS = ("candidates", "codes", "candidate", "code")
LINK_KEYS = ("links",)
ITEM_KEYS = ("spans", "entities", "concepts")

NULL, SCALAR, LIST, LINK, SPAN, CONCEPT, NESTED, SECTION, NOTE, RECORD, TEXTUAL, OBJECT = (
    "null", "scalar", "list", "link", "span", "concept", "nested_concept", "section", "note", "record", "text", "object",
)

#: The class of a key; other keys say nothing about a node's state.
CLASSES = {
    **dict.fromkeys(ITEM_KEYS, "items"), **dict.fromkeys(ASSERTION_KEYS, "assertion"), **dict.fromkeys(CODE_KEYS, "code"),
    "sections": "sections", "note": "note", "title": "title", "text": "text", "start": "start", "end": "offset", "label": "offset",
    "position": "position", "type": "type", "context": "inner", "span": "inner", "links": "inner", "kb": "kb", "score": "kb",
}

#: Transitions, the first that fits: the state, (class, states of the child) one of which is needed, classes that must
#: not be there, classes that must. No states: any.
RULES = (
    (NOTE, (("sections", ()), ("note", (NOTE, OBJECT))), (), ()),
    (SECTION, (("items", ()),), ("start", "position"), ("title",)),
    (RECORD, (("items", ()),), ("start", "position"), ()),
    (SECTION, (("title", ()),), ("text",), ()),
    (SPAN, (("start", ()), ("offset", ())), (), ()),
    (NESTED, (("inner", ()),), (), ()),
    (LINK, (("position", ()), ("type", ()), ("assertion", ()), ("code", ())), (), ("kb",)),
    (CONCEPT, (("position", ()), ("type", ()), ("assertion", ()), ("code", ())), (), ()),
    (TEXTUAL, (("text", ()),), (), ()),
    (OBJECT, (), (), ()),
)
#: Text alone is a record at the root and a concept inside.
AT_ROOT, INSIDE = {TEXTUAL: RECORD}, {TEXTUAL: CONCEPT}

_made: dict[frozenset, str] = {}  # transitions met so far


def _transition(signs: frozenset) -> str:
    """The state of an object by its (class, child's state) pairs."""
    got = _made.get(signs)
    if got is None:
        classes = {c for c, _ in signs}
        for state, one, lacks, needs in RULES:
            if (not one or any(c == k and (not states or st in states) for c, st in signs for k, states in one)) and not classes & set(lacks) and classes >= set(needs):
                got = state
                break
        if len(_made) < 10_000:
            _made[signs] = got
    return got


def states(root) -> dict[int, str]:
    """The state of every list and object of a tree, by id, children first, with a stack."""
    out: dict[int, str] = {}

    def of(node) -> str:
        return NULL if node is None else out[id(node)] if isinstance(node, (dict, list)) else SCALAR

    stack = [(root, False)]
    while stack:
        node, below_done = stack.pop()
        if isinstance(node, list):
            out[id(node)] = LIST
            stack += [(x, False) for x in node if isinstance(x, (dict, list))]
        elif isinstance(node, dict):
            if below_done:
                out[id(node)] = _transition(frozenset((CLASSES[k], of(v)) for k, v in node.items() if k in CLASSES))
            else:
                stack.append((node, True))
                stack += [(x, False) for x in node.values() if isinstance(x, (dict, list))]
    return out


def variant(root, known: dict[int, str]) -> str:
    """The record's variant: the state of the root, for a list the states of its elements."""
    if isinstance(root, list):
        of = lambda x: NULL if x is None else SCALAR if not isinstance(x, (dict, list)) else known[id(x)]
        return "list<" + "|".join(sorted({INSIDE.get(s, s) for s in map(of, root)})) + ">"
    return AT_ROOT.get(known[id(root)], known[id(root)])


def _listed(value) -> list:
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _text(value) -> str | None:
    if value is None or value == "":
        return None
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return _text(value.get("code", value.get("value", value.get("name", value.get("label")))))
    return json.dumps(value, ensure_ascii=False)


def items(root, known: dict[int, str] | None = None) -> list[tuple]:
    """(item, section title) of the spans or concepts of a record in order of appearance, null ones kept for their
    number. The tree is walked with a stack, to any depth."""
    known = states(root) if known is None else known
    out: list = []
    stack = [(root, False, None)]  # node, whether it is an item, the section's title
    while stack:
        node, item, title = stack.pop()
        if item:
            out.append((node if isinstance(node, dict) and node else None, title))
        elif isinstance(node, list):
            stack += [(x, not (isinstance(x, dict) and known[id(x)] in (SECTION, RECORD, NOTE)), title) for x in reversed(node)]
        elif isinstance(node, dict):
            own = _text(node.get("title")) or title
            inner = [(value if key == "note" else _listed(value), False, own) for key, value in node.items() if key in ITEM_KEYS or key in ("sections", "note")]
            stack += reversed(inner)
    return out


def leaves(item: dict) -> Iterator[tuple[str, int, str, str | None, float | None]]:
    """(leaf, leaf_no, value, kb, score) of an item, by its subtype."""
    where = item
    if isinstance(item.get("context"), dict):
        where = item["context"] | {k: v for k, v in item.items() if k in ASSERTION_KEYS}
    for key in ASSERTION_KEYS:
        if key in where:
            for i, v in enumerate(_listed(where[key])):
                if (t := _text(v)) is not None:
                    yield "assertion", i, t, None, None
            break
    for key in CODE_KEYS + LINK_KEYS:
        if key in item:
            for i, v in enumerate(_listed(item[key])):
                if (t := _text(v)) is not None:
                    link = v if isinstance(v, dict) else {}
                    score = link.get("score")
                    yield "candidate", i, t, _text(link.get("kb")), float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None
            break


def _int(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 2**31 else None


def _offsets(value) -> tuple[int | None, int | None]:
    two = (value + [None, None])[:2] if isinstance(value, list) else (value.get("from"), value.get("to")) if isinstance(value, dict) else (None, None)
    return _int(two[0]), _int(two[1])


#: The typed table of each subtype: how its (start, end, fine, coarse, type) are read from an item.
SUBTYPES = {
    SPAN: lambda x: (_int(x.get("start")), _int(x.get("end")), _text(x.get("fine", x.get("label"))), _text(x.get("coarse")), None),
    CONCEPT: lambda x: (*_offsets(x.get("position")), None, None, _text(x.get("type"))),
    NESTED: lambda x: (*_offsets(x.get("span")), None, None, _text(x.get("type"))),
}


_SCALAR = json.JSONDecoder()


def _loads_deep(text: str):
    """A JSON value of any depth, read with a stack; ValueError if it is none."""
    n, at, stack, key = len(text), 0, [], None
    done, value, want = False, None, "value"  # what may come next: value, key, more

    def blanks(i: int) -> int:
        while i < n and text[i] in " \t\n\r":
            i += 1
        return i

    while True:
        at = blanks(at)
        if done:
            if at < n:
                raise ValueError("text after the value")
            return value
        if at >= n:
            raise ValueError("the value is cut off")
        c = text[at]
        closed = False
        if want in ("value", "first") and c in "{[":
            stack.append(({} if c == "{" else [], key))
            at, want = at + 1, "first key" if c == "{" else "first"
            continue
        if want in ("key", "first key") and c == '"':
            key, at = _SCALAR.raw_decode(text, at)
            at = blanks(at)
            if at >= n or text[at] != ":":
                raise ValueError("a colon is missing")
            at, want = at + 1, "value"
            continue
        if c in "}]" and want in ("first", "first key", "more") and stack and isinstance(stack[-1][0], dict) == (c == "}"):
            (value, key), at, closed = stack.pop(), at + 1, True
        elif want in ("value", "first"):
            value, at = _SCALAR.raw_decode(text, at)
            closed = True
        elif want == "more" and c == ",":
            at, want = at + 1, "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if not closed:
            raise ValueError(f"unexpected sign at {at}")
        if not stack:
            done = True
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
            want = "more"
        else:
            stack[-1][0].append(value)
            want = "more"


def parse(payload: str | None):
    """The JSON value of a payload, a second encoding undone; None if it cannot be read."""
    value = payload
    for _ in range(4):
        if not isinstance(value, str) or not value.strip():
            return None
        try:
            value = json.loads(value.lstrip("﻿"))
        except RecursionError:
            try:
                value = _loads_deep(value.lstrip("﻿"))
            except ValueError:
                return None
        except ValueError:
            return None
        if not isinstance(value, str):
            return value
    return None


_FIELDS = (
    ("rec_key", pa.int64()), ("span_no", pa.int32()), ("variant", pa.string()), ("subtype", pa.string()), ("leaf", pa.string()), ("leaf_no", pa.int32()), ("leaf_value", pa.string()),
    ("kb", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("fine", pa.string()), ("coarse", pa.string()), ("type", pa.string()), ("section", pa.string()),
)
_OUT = pa.schema(_FIELDS)
_SQL_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
_OUT_DDL = ", ".join(f"`{n}` {_SQL_TYPES[t]}" for n, t in _FIELDS)
_ATTRIBUTES = ("kb", "score", "start", "end", "text", "fine", "coarse", "type", "section")


def routed(key: int, payload: str | None) -> Iterator[tuple]:
    """All rows of one payload: its record, its items with the attributes of their subtype, and their leaves."""
    root = parse(payload)
    if not isinstance(root, (list, dict)):
        yield (key, None, "unreadable", RECORD, "record", 0, "", *[None] * 9)
        return
    known = states(root)
    shape = variant(root, known)
    text = _text(root.get("text")) if isinstance(root, dict) else None
    yield (key, None, shape, RECORD, "record", 0, "", None, None, None, None, text, None, None, None, None)
    for no, (item, title) in enumerate(items(root, known)):
        if item is None:
            continue
        kind = INSIDE.get(known[id(item)], known[id(item)])
        start, end, fine, coarse, type_ = SUBTYPES.get(kind, SUBTYPES[CONCEPT])(item)
        yield (key, no, shape, kind, "span", 0, "", None, None, start, end, _text(item.get("text")), fine, coarse, type_, title)
        for leaf, i, value, kb, score in leaves(item):
            yield (key, no, shape, kind, leaf, i, value, kb, score, *[None] * 7)


def _flatten_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [r for key, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in routed(key, payload)]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _OUT]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


def flatten_json(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Rows (rec_key, span_no, variant, subtype, leaf, leaf_no, leaf_value and attributes) of JSON payloads. Rows that
    are repeated as a whole in (key, payload) are read once."""
    once = df.select(F.col(key).alias("rec_key"), F.col(payload).alias("payload"))
    # the digest, not the payload, is what the shuffle compares
    once = once.groupBy("rec_key", F.xxhash64("payload").alias("h1"), F.crc32(F.col("payload").cast("binary")).alias("h2")).agg(F.first("payload").alias("payload"))
    return once.select("rec_key", "payload").mapInArrow(_flatten_json, _OUT_DDL)


def flatten_typed(df: DataFrame, key: str, spans: str, subtype: str, attributes: bool = False) -> DataFrame:
    """The same rows out of a typed array of structs with `assertions` and `candidates`; with `attributes` also the
    records and the items' own columns, else only what links and leaves need.

    Each record is cut down to what is asked for before rows that came twice are dropped, and the explodes come
    after, so the shuffle carries a record once.
    """
    fields = df.schema[spans].dataType.elementType.names
    none = F.lit(None)

    def own(s):
        at = (s["position"][0], s["position"][1]) if "position" in fields else (s["start"], s["end"])
        have = lambda c: s[c] if c in fields else none
        return [at[0].cast("int").alias("start"), at[1].cast("int").alias("end"), have("text").cast("string").alias("text"), *(have(c).cast("string").alias(c) for c in ("fine", "coarse", "type"))]

    slim = F.transform(F.col(spans), lambda s: F.when(s.isNotNull(), F.struct(s["assertions"].alias("a"), s["candidates"].alias("c"), *(own(s) if attributes else []))))
    shape = F.lit(f"record<{subtype}>")
    base = df if attributes else df.where(F.size(spans) > 0)
    text = F.col("text") if attributes and "text" in df.columns else none.cast("string")
    rows = base.select(F.col(key).alias("rec_key"), slim.alias("items"), text.alias("rtext")).dropDuplicates()
    exploded = rows.select("rec_key", F.posexplode("items").alias("span_no", "item")).where(F.col("item").isNotNull())

    def leaf(kind: str, arr):
        return F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(kind).alias("leaf"), i.alias("leaf_no"), x.alias("leaf_value")))

    every = F.concat(
        F.array(F.struct(F.lit("span").alias("leaf"), F.lit(0).alias("leaf_no"), F.lit("").alias("leaf_value"))),
        F.filter(F.concat(leaf("assertion", F.col("item.a")), leaf("candidate", F.col("item.c"))), lambda x: x["leaf_value"].isNotNull() & (x["leaf_value"] != "")),
    )
    if not attributes:
        return exploded.select("rec_key", "span_no", shape.alias("variant"), F.lit(subtype).alias("subtype"), F.inline(every))
    flat = exploded.select("rec_key", "span_no", "item", F.inline(every))
    item = [F.when(F.col("leaf") == "span", F.col(f"item.{c}")).alias(c) for c in ("start", "end", "text", "fine", "coarse", "type")]
    out = flat.select("rec_key", "span_no", shape.alias("variant"), F.lit(subtype).alias("subtype"), "leaf", "leaf_no", "leaf_value", *item)
    records = rows.select("rec_key", shape.alias("variant"), F.lit(RECORD).alias("subtype"), F.lit("record").alias("leaf"), F.lit(0).alias("leaf_no"), F.lit("").alias("leaf_value"), F.col("rtext").alias("text"))
    return out.unionByName(records, allowMissingColumns=True)


def flat_rows(unified: DataFrame, out_docs: DataFrame, raw_annot: DataFrame, attributes: bool = False) -> DataFrame:
    """All rows of the three tables under one supertype, `tbl` first."""
    cols = ["tbl", "rec_key", "span_no", "variant", "subtype", "leaf", "leaf_no", "leaf_value"]
    parts = [
        flatten_typed(unified, "rec_id", "spans", SPAN, attributes).withColumn("tbl", F.lit("unified")),
        flatten_typed(out_docs, "out_id", "concepts", CONCEPT, attributes).withColumn("tbl", F.lit("out_docs")),
        flatten_json(raw_annot).withColumn("tbl", F.lit("raw_annot")),
    ]
    if not attributes:
        parts[2] = parts[2].where("leaf <> 'record'").select(*cols)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*cols, *(_ATTRIBUTES if attributes else ()))


#: The related tables: which rows they hold and their own columns beside the keys.
TABLES = {
    "records": ("leaf = 'record'", ("variant", "text")),
    "items": ("leaf = 'span'", ("variant", "subtype")),
    SPAN: (f"leaf = 'span' AND subtype = '{SPAN}'", ("start", "end", "text", "fine", "coarse")),
    CONCEPT: (f"leaf = 'span' AND subtype NOT IN ('{SPAN}', '{NESTED}')", ("start", "end", "text", "type")),
    NESTED: (f"leaf = 'span' AND subtype = '{NESTED}'", ("start", "end", "text", "type", "section")),
    "assertions": ("leaf = 'assertion'", ("leaf_no", "leaf_value")),
    "candidates": ("leaf = 'candidate'", ("leaf_no", "leaf_value", "kb", "score")),
}


def related(rows: DataFrame, name: str) -> DataFrame:
    """One related table of the rows: (tbl, rec_key, span_no) link it to its parents, but for 'records', whose keys
    are (tbl, rec_key)."""
    where, cols = TABLES[name]
    return rows.where(where).select("tbl", "rec_key", *(() if name == "records" else ("span_no",)), *cols)
