"""Front matter of documents as rows: leaves, tags, JSON and rejects.

The block is split into an array of lines inside its row, the lines into sections of one top-level key each, and every section is folded
with ``aggregate``. A section's state is small, so the cost grows with the lines; parsing needs no shuffle and no Python.
A block that is not understood yields a reject with line and reason (fixed wording); it never loses data silently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.functions.text import BLANK_CLASS, normalize_tags, trim_blanks

# Patterns of the accepted grammar ---------------------------------
HEAD = r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*\r?\n?"
QUOTED = r"""(?s:"(?:\\.|[^"\\])*+(?:"|\\?\z)|'[^']*+(?:'|\z))"""
BEFORE_COMMENT = rf"""\A((?:{QUOTED}|[^"'#]|(?<![{BLANK_CLASS}]|\A)#)*+)"""
# A key that has no bracket before its colon; other keys are read piece by piece.
KEY = rf"""\A(?:{QUOTED}|[^"'\[\]{{}}:]|:(?![ \t]|\z))*+:(?=[ \t]|\z)"""
PIECE = rf"""{QUOTED}|[\[\]{{}},:]|[^"'\[\]{{}},:]++"""
NUMBER = r"\A-?[0-9]+(\.[0-9]+)?\z"
BLOCK_HEADER = r"\A[|>][+-]?\z"
NULLS = ("", "null", "Null", "~")
TRUES = ("true", "True")
FALSES = ("false", "False")
ESCAPES = (("n", "\n"), ("r", "\r"), ("t", "\t"))
# --------------------------------------------------------------------------------

_LEAF = "struct<path:array<string>,value:string,value_type:string,line:int>"
_LINES = "array<struct<line:int,indent:int,tab:boolean,raw:string,content:string>>"
_STATE = (
    "struct<stack:array<struct<kind:string,indent:int,path:array<string>,items:int>>,"
    "open:struct<path:array<string>,kind:string,indent:int,line:int>,"
    "block:struct<path:array<string>,parent:int,indent:int,literal:boolean,lines:array<string>,line:int>,"
    f"leaves:array<{_LEAF}>,"
    "error:struct<line:int,reason:string>>"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _text(value: str) -> Column:
    return F.lit(value).cast("string")


# --- document split and lines ------------------------------------------------------


def split_document(text: Column) -> Column:
    """Struct ``(block, body)``; ``block`` is null for a document without front matter."""
    head = F.when(F.startswith(text, F.lit("---")), F.regexp_extract(text, HEAD, 0)).otherwise("")
    return _let(
        head,
        lambda h: F.struct(
            F.when(h != "", F.regexp_extract(h, HEAD, 1)).alias("block"),
            trim_blanks(
                F.when(h == "", text).otherwise(F.substring(text, F.length(h) + 1, F.length(text)))
            ).alias("body"),
        ),
    )


def block_lines(block: Column) -> Column:
    """Array of ``(line, indent, tab, raw, content)``; ``content`` has no comment and no margins."""

    def line(raw: Column, index: Column) -> Column:
        margin = F.regexp_extract(raw, r"\A[ \t]*", 0)
        return F.struct(
            (index + 1).cast("int").alias("line"),
            F.length(margin).alias("indent"),
            F.contains(margin, F.lit("\t")).alias("tab"),
            raw.alias("raw"),
            trim_blanks(
                F.when(F.contains(raw, F.lit("#")), F.regexp_extract(raw, BEFORE_COMMENT, 1)).otherwise(raw)
            ).alias("content"),
        )

    return F.transform(F.split(block, r"\r?\n"), line)


# --- scalars ---------------------------------------------------------------------


def _is_quoted(text: Column) -> Column:
    first = F.left(text, F.lit(1))
    return (F.length(text) >= 2) & first.isin('"', "'") & (F.right(text, F.lit(1)) == first)


def _unquote(text: Column) -> Column:
    inner = F.substring(text, F.lit(2), F.length(text) - 2)

    def piece(token: Column) -> Column:
        known = F.lit(None).cast("string")
        for char, value in ESCAPES:
            known = F.when(token == "\\" + char, value).otherwise(known)
        escaped = F.startswith(token, F.lit("\\")) & (F.length(token) == 2)
        return F.coalesce(
            known, F.when(escaped, F.right(token, F.lit(1))).otherwise(token)
        )

    tokens = F.regexp_extract_all(inner, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    double = F.when(
        F.contains(inner, F.lit("\\")), F.array_join(F.transform(tokens, piece), "")
    ).otherwise(inner)
    return F.when(F.startswith(text, F.lit("'")), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(double)


def _unquoted(text: Column) -> Column:
    return F.when(_is_quoted(text), _unquote(text)).otherwise(text)


def _leaf(path: Column, value: Column, kind: str, line: Column) -> Column:
    return F.array(
        F.struct(
            path.alias("path"), value.alias("value"), _text(kind).alias("value_type"), line.alias("line")
        )
    )


def _number_text(text: Column) -> Column:
    """Number as JSON prints it: plain from 1e-6 to below 1e21, else with an exponent; no needless zeros."""
    number = text.cast("double")
    shortest = number.cast("string")
    size = F.abs(number)

    def plain(kind: str) -> Column:
        return F.regexp_replace(shortest.try_cast(kind).cast("string"), r"\.?0+$", "")

    exponent = F.regexp_replace(F.regexp_replace(shortest, r"\.0E|E", "e"), "e(?=[0-9])", "e+")
    return (
        F.when(size == 0, "0")
        .when((size >= 1) & (size < 1e21), plain("decimal(38,17)"))
        .when((size >= 1e-6) & (size < 1), plain("decimal(38,30)"))
        .otherwise(exponent)
    )


def _nested(depth: Column, piece: Column) -> Column:
    """Bracket depth after a piece. Both kinds of brackets count alike; an entry decides by its ends what it is."""
    return depth + F.when(piece.isin("[", "{"), 1).when(piece.isin("]", "}"), -1).otherwise(0)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _key_head(text: Column) -> Column:
    """The text up to and with the colon that ends its key, empty where there is none."""

    def step(state: Column, piece: Column) -> Column:
        end = piece == ":"
        head = F.concat(state["head"], piece)
        # Whether the colon ends a key shows in what follows it.
        after = F.substring(text, F.length(head) + 1, F.lit(1))
        found = state["found"] | (end & (state["depth"] == 0) & after.isin("", " ", "\t"))
        return F.when(state["found"], state).otherwise(
            F.struct(
                head.alias("head"), _nested(state["depth"], piece).cast("int").alias("depth"), found.alias("found")
            )
        )

    start = F.struct(_text("").alias("head"), F.lit(0).alias("depth"), F.lit(False).alias("found"))
    bracketed = F.aggregate(
        _pieces(text), start, step, lambda state: F.when(state["found"], state["head"]).otherwise("")
    )
    flat = F.regexp_extract(text, KEY, 0)
    return F.when((flat == "") & F.rlike(text, F.lit(r"[\[\]{}]")), bracketed).otherwise(flat)


def _flow_items(inner: Column) -> Column:
    """The trimmed entries between commas outside quotes and brackets; empty ones are dropped."""

    def step(state: Column, piece: Column) -> Column:
        ends = (piece == ",") & (state["depth"] == 0)
        return F.struct(
            F.when(ends, F.concat(state["items"], F.array(state["item"]))).otherwise(state["items"]).alias("items"),
            F.when(ends, "").otherwise(F.concat(state["item"], piece)).alias("item"),
            _nested(state["depth"], piece).cast("int").alias("depth"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("items"), _text("").alias("item"), F.lit(0).alias("depth")
    )
    items = F.aggregate(
        _pieces(inner), start, step, lambda state: F.concat(state["items"], F.array(state["item"]))
    )
    return F.filter(F.transform(items, trim_blanks), lambda item: item != "")


def _deepest(text: Column) -> Column:
    """How deep brackets outside quotes go."""
    marks = F.filter(_pieces(text), lambda piece: piece.isin("[", "{", "]", "}"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(state: Column, piece: Column) -> Column:
        depth = _nested(state["depth"], piece).cast("int")
        return F.struct(depth.alias("depth"), F.greatest(state["deepest"], depth).alias("deepest"))

    return F.aggregate(marks, start, step, lambda state: state["deepest"])


def _sequence_entries(inner: Column, path: Column) -> Column:
    """Entries ``(path, text, problem)`` of the inside of ``[...]``."""
    return F.transform(
        _flow_items(inner),
        lambda item, i: F.struct(
            F.concat(path, F.array(F.concat(F.lit("#"), i.cast("string")))).alias("path"),
            item.alias("text"),
            _null("string").alias("problem"),
        ),
    )


def _mapping_entries(inner: Column, path: Column) -> Column:
    """Entries of the inside of ``{...}``; of equal keys the last one counts."""

    def entry(item: Column) -> Column:
        return _let(
            _key_head(item),
            lambda head: F.struct(
                F.concat(
                    path,
                    F.array(F.concat(F.lit("."), _unquoted(trim_blanks(F.left(head, F.length(head) - 1))))),
                ).alias("path"),
                trim_blanks(F.substring(item, F.length(head) + 1, F.length(item))).alias("text"),
                F.when(
                    head == "",
                    F.concat(F.lit('inline mapping entry "'), item, F.lit('" is missing a value')),
                ).alias("problem"),
            ),
        )

    return _let(
        F.transform(_flow_items(inner), entry),
        lambda entries: F.filter(
            entries,
            lambda e, i: e["problem"].isNotNull()
            | ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["path"] == e["path"]),
        ),
    )


def _plain_leaf(text: Column, path: Column, line: Column) -> Column:
    """Leaf of one value; a flow collection stays as it is, with type ``flow``. Failures have type ``error``."""
    kind = (
        F.when(text.isin(*NULLS), "null")
        .when(F.rlike(text, F.lit(r"\A[&*]")), "error")
        .when(F.rlike(text, F.lit(r"\A[\[{]")), "flow")
        .when(_is_quoted(text), "quoted")
        .when(text.isin(*TRUES, *FALSES), "boolean")
        .when(F.rlike(text, F.lit(NUMBER)), "number")
        .otherwise("string")
    )

    def leaf(k: Column) -> Column:
        value = (
            F.when(k == "error", "YAML anchors and aliases are not supported")
            .when(k == "quoted", _unquote(text))
            .when(k == "boolean", F.lower(text))
            .when(k == "number", _number_text(text))
            .when(k != "null", text)
        )
        return F.struct(
            path.alias("path"),
            value.alias("value"),
            F.when(k == "quoted", "string").otherwise(k).alias("value_type"),
            line.alias("line"),
        )

    return _let(kind, leaf)


def _opened(flow: Column) -> Column:
    """Leaves of the entries of a leaf of type ``flow``, one level down."""
    text, path, line = flow["value"], flow["path"], flow["line"]
    is_sequence = F.startswith(text, F.lit("["))
    closed = (F.length(text) > 1) & F.endswith(text, F.when(is_sequence, "]").otherwise("}"))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)

    def leaf(value: Column, kind: Column) -> Column:
        return F.array(
            F.struct(path.alias("path"), value.alias("value"), kind.alias("value_type"), line.alias("line"))
        )

    def leaves(entries: Column) -> Column:
        each = F.transform(
            entries,
            lambda e: F.when(
                e["problem"].isNotNull(),
                F.struct(
                    e["path"].alias("path"),
                    e["problem"].alias("value"),
                    _text("error").alias("value_type"),
                    line.alias("line"),
                ),
            ).otherwise(_plain_leaf(e["text"], e["path"], line)),
        )
        empty = leaf(
            F.when(is_sequence, "[]").otherwise("{}"), F.when(is_sequence, "array").otherwise("object")
        )
        return F.when(F.size(entries) > 0, each).otherwise(empty)

    unterminated = F.when(is_sequence, "unterminated inline sequence").otherwise("unterminated inline mapping")
    entries = F.when(is_sequence, _sequence_entries(inner, path)).otherwise(_mapping_entries(inner, path))
    return F.when(closed, _let(entries, leaves)).otherwise(leaf(unterminated, F.lit("error")))


def _scalar_leaves(text: Column, path: Column, line: Column) -> Column:
    """Leaves of one value. Flow collections are opened level by level, as deep as they go."""

    def open_level(leaves: Column, _: Column) -> Column:
        return F.flatten(
            F.transform(
                leaves, lambda leaf: F.when(leaf["value_type"] == "flow", _opened(leaf)).otherwise(F.array(leaf))
            )
        )

    def opened(first: Column) -> Column:
        start = F.array(first).cast(f"array<{_LEAF}>")
        levels = F.sequence(F.lit(1), _deepest(text))
        return F.when(first["value_type"] == "flow", F.aggregate(levels, start, open_level)).otherwise(start)

    return _let(_plain_leaf(text, path, line), opened)


# --- the fold over lines -----------------------------------------------------------


def _with(state: Column, **changes: Column) -> Column:
    names = ("stack", "open", "block", "leaves", "error")
    return F.struct(*[changes.get(name, state[name]).alias(name) for name in names])


def _fail(state: Column, line: Column, reason: Column | str) -> Column:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return _with(state, error=F.struct(line.alias("line"), reason.alias("reason")))


def _nothing(state: Column, name: str) -> Column:
    kinds = {
        "open": "struct<path:array<string>,kind:string,indent:int,line:int>",
        "block": "struct<path:array<string>,parent:int,indent:int,literal:boolean,lines:array<string>,line:int>",
    }
    return _with(state, **{name: _null(kinds[name])})


def _frame(kind: str, indent: Column, path: Column) -> Column:
    return F.struct(
        _text(kind).alias("kind"), indent.cast("int").alias("indent"), path.alias("path"), F.lit(0).alias("items")
    )


def _block_text(block: Column) -> Column:
    literal = F.regexp_replace(F.array_join(block["lines"], "\n"), r"\n+\z", "")
    joined = F.array_join(F.transform(block["lines"], trim_blanks), "\n")
    paragraphs = F.regexp_replace(F.regexp_replace(joined, r"\A\n+|\n+\z", ""), r"\n{2,}", "\x00")
    folded = F.translate(paragraphs, "\n\x00", " \n")
    return F.when(block["literal"], literal).otherwise(folded)


def _close_block(state: Column) -> Column:
    block = state["block"]
    closed = _with(
        state,
        leaves=F.concat(state["leaves"], _leaf(block["path"], _block_text(block), "string", block["line"])),
        block=_null("struct<path:array<string>,parent:int,indent:int,literal:boolean,lines:array<string>,line:int>"),
    )
    return F.when(block.isNull(), state).otherwise(closed)


def _close_open(state: Column) -> Column:
    """The key or dash that was waiting for a nested value gets none."""
    opened = state["open"]
    closed = _with(
        state,
        leaves=F.concat(
            state["leaves"], _leaf(opened["path"], _null("string"), "null", opened["line"])
        ),
        open=_null("struct<path:array<string>,kind:string,indent:int,line:int>"),
    )
    return F.when(opened.isNull(), state).otherwise(closed)


def _block_step(state: Column, line: Column) -> Column:
    """A line that belongs to the open block scalar."""
    block = state["block"]
    spaces = F.length(F.regexp_extract(line["raw"], r"\A *", 0))
    blank = trim_blanks(line["raw"]) == ""
    indent = F.when(blank, block["indent"]).otherwise(F.coalesce(block["indent"], spaces))
    kept = F.when(blank, F.lit("")).otherwise(
        F.substring(line["raw"], indent + 1, F.length(line["raw"]))
    )
    return _with(
        state,
        block=F.struct(
            block["path"].alias("path"),
            block["parent"].alias("parent"),
            indent.cast("int").alias("indent"),
            block["literal"].alias("literal"),
            F.concat(block["lines"], F.array(kept)).alias("lines"),
            block["line"].alias("line"),
        ),
    )


def _in_block(state: Column, line: Column) -> Column:
    spaces = F.length(F.regexp_extract(line["raw"], r"\A *", 0))
    return state["block"].isNotNull() & (
        (trim_blanks(line["raw"]) == "") | (spaces > state["block"]["parent"])
    )


def _dash(text: Column) -> Column:
    return F.startswith(text, F.lit("-"))


def _enter(state: Column, line: Column) -> Column:
    """Open the nested collection that the waiting key or dash announced, or give it null."""
    opened = state["open"]
    nested = (line["indent"] > opened["indent"]) | (
        (opened["kind"] == "m") & (line["indent"] == opened["indent"]) & _dash(line["content"])
    )
    frame = F.when(_dash(line["content"]), _frame("s", line["indent"], opened["path"])).otherwise(
        _frame("m", line["indent"], opened["path"])
    )
    entered = _nothing(_with(state, stack=F.concat(state["stack"], F.array(frame))), "open")
    return F.when(opened.isNull(), state).when(nested, entered).otherwise(_close_open(state))


def _leave(state: Column, line: Column) -> Column:
    """Close collections that end before this line and check its indentation."""

    def check(stack: Column) -> Column:
        top = F.element_at(stack, -1)
        return (
            F.when(F.size(stack) == 0, _fail(state, line["line"], "unexpected content after the mapping"))
            .when(top["indent"] < line["indent"], _fail(state, line["line"], "unexpected indentation"))
            .otherwise(_with(state, stack=stack))
        )

    def drop_sequence(stack: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        ends = (top["kind"] == "s") & (top["indent"] == line["indent"]) & ~_dash(line["content"])
        return F.when(
            F.coalesce(ends, F.lit(False)), F.slice(stack, F.lit(1), F.size(stack) - 1)
        ).otherwise(stack)

    shallow = F.filter(state["stack"], lambda frame: frame["indent"] <= line["indent"])
    return _let(shallow, lambda stack: _let(drop_sequence(stack), check))


def _under(path: Column, prefix: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(prefix)) == prefix


def _add_value(state: Column, text: Column, path: Column, line: Column) -> Column:
    def add(found: Column) -> Column:
        failed = F.get(F.filter(found, lambda leaf: leaf["value_type"] == "error"), F.lit(0))
        return F.when(failed.isNotNull(), _fail(state, line["line"], failed["value"])).otherwise(
            _with(state, leaves=F.concat(state["leaves"], found))
        )

    return _let(_scalar_leaves(text, path, line["line"]), add)


def _unsupported(content: Column) -> Column:
    return (
        F.when(content.isin("---", "..."), "multiple YAML documents are not supported")
        .when(F.startswith(content, F.lit("<<:")), "YAML merge keys are not supported")
        .when(F.startswith(content, F.lit("? ")), "complex mapping keys are not supported")
    )


def _read(state: Column, line: Column) -> Column:
    """Read one line as an item of the innermost collection.

    A step is first described as ``(state, action, path, text, indent)`` and then applied, so
    the value grammar appears once in the plan.
    """

    def describe_key(base: Column, text: Column, head: Column, frame_path: Column, indent: Column) -> Column:
        key = _unquoted(trim_blanks(F.left(head, F.length(head) - 1)))
        rest = trim_blanks(F.substring(text, F.length(head) + 1, F.length(text)))

        def with_key(k: Column) -> Column:
            path = F.concat(frame_path, F.array(F.concat(F.lit("."), k)))
            reason = (
                F.when(_unsupported(text).isNotNull(), _unsupported(text))
                .when(
                    head == "",
                    F.concat(F.lit('expected "key: value", found "'), text, F.lit('"')),
                )
                .when(k == "", "empty mapping key")
            )
            return F.struct(
                base.alias("state"),
                F.when(reason.isNotNull(), "fail")
                .when(F.rlike(rest, F.lit(BLOCK_HEADER)), "block")
                .when(rest == "", "wait")
                .otherwise("value")
                .alias("action"),
                path.alias("path"),
                F.coalesce(reason, rest).alias("text"),
                indent.alias("indent"),
                _text("m").alias("kind"),
                F.lit(True).alias("keyed"),
            )

        return _let(key, with_key)

    def in_mapping(top: Column) -> Column:
        return _let(
            _key_head(line["content"]),
            lambda head: describe_key(state, line["content"], head, top["path"], top["indent"]),
        )

    def in_sequence(top: Column) -> Column:
        path = F.concat(top["path"], F.array(F.concat(F.lit("#"), top["items"].cast("string"))))
        counted = F.struct(
            top["kind"].alias("kind"),
            top["indent"].alias("indent"),
            top["path"].alias("path"),
            (top["items"] + 1).alias("items"),
        )
        base = _with(
            state,
            stack=F.concat(F.slice(state["stack"], F.lit(1), F.size(state["stack"]) - 1), F.array(counted)),
        )
        rest = trim_blanks(F.substring(line["content"], F.lit(2), F.length(line["content"])))

        def item(text: Column) -> Column:
            plain = F.struct(
                base.alias("state"),
                F.when(_unsupported(line["content"]).isNotNull(), "fail")
                .when(text == "", "wait")
                .otherwise("value")
                .alias("action"),
                path.alias("path"),
                F.coalesce(_unsupported(line["content"]), text).alias("text"),
                top["indent"].alias("indent"),
                _text("s").alias("kind"),
                F.lit(False).alias("keyed"),
            )

            def keyed(head: Column) -> Column:
                indent = top["indent"] + 2
                deeper = _with(
                    base, stack=F.concat(base["stack"], F.array(_frame("m", indent, path)))
                )
                opens = (head != "") & ~F.rlike(text, F.lit(r"\A[\[{]")) & _unsupported(line["content"]).isNull()
                return F.when(opens, describe_key(deeper, text, head, path, indent)).otherwise(plain)

            return _let(_key_head(text), keyed)

        return _let(rest, item)

    def apply(step: Column) -> Column:
        path = step["path"]
        # A repeated key replaces everything it held before.
        kept = F.when(
            step["keyed"], F.filter(step["state"]["leaves"], lambda leaf: ~_under(leaf["path"], path))
        ).otherwise(step["state"]["leaves"])
        return _let(
            _with(step["state"], leaves=kept),
            lambda base: F.when(step["action"] == "fail", _fail(base, line["line"], step["text"]))
            .when(
                step["action"] == "block",
                _with(
                    base,
                    block=F.struct(
                        path.alias("path"),
                        step["indent"].cast("int").alias("parent"),
                        _null("int").alias("indent"),
                        F.startswith(step["text"], F.lit("|")).alias("literal"),
                        F.array().cast("array<string>").alias("lines"),
                        line["line"].alias("line"),
                    ),
                ),
            )
            .when(
                step["action"] == "wait",
                _with(
                    base,
                    open=F.struct(
                        path.alias("path"),
                        step["kind"].alias("kind"),
                        step["indent"].cast("int").alias("indent"),
                        line["line"].alias("line"),
                    ),
                ),
            )
            .otherwise(_add_value(base, step["text"], path, line)),
        )

    return _let(
        _let(
            F.element_at(state["stack"], -1),
            lambda top: F.when(top["kind"] == "s", in_sequence(top)).otherwise(in_mapping(top)),
        ),
        apply,
    )


def _step(state: Column, line: Column) -> Column:
    def structural(closed: Column) -> Column:
        return _let(
            _enter(closed, line),
            lambda entered: _let(
                _leave(entered, line),
                lambda left: F.when(left["error"].isNotNull(), left).otherwise(_read(left, line)),
            ),
        )

    return (
        F.when(state["error"].isNotNull(), state)
        .when(_in_block(state, line), _block_step(state, line))
        .otherwise(
            _let(
                _close_block(state),
                lambda closed: F.when(line["content"] == "", closed).otherwise(structural(closed)),
            )
        )
    )


def _start(first: Column) -> Column:
    return F.struct(
        F.array(_frame("m", first["indent"], F.array().cast("array<string>"))).alias("stack"),
        _null("struct<path:array<string>,kind:string,indent:int,line:int>").alias("open"),
        _null(
            "struct<path:array<string>,parent:int,indent:int,literal:boolean,lines:array<string>,line:int>"
        ).alias("block"),
        F.array().cast(f"array<{_LEAF}>").alias("leaves"),
        _null("struct<line:int,reason:string>").alias("error"),
    ).cast(_STATE)


def _sections(lines: Column, indent: Column) -> Column:
    """The lines of each top-level key. Items of a list may stand below their key without being indented further."""
    begins = F.filter(
        F.transform(
            lines,
            lambda line, i: F.when((line["content"] != "") & (line["indent"] == indent) & ~_dash(line["content"]), i),
        ),
        lambda i: i.isNotNull(),
    )
    return _let(
        begins,
        lambda starts: F.transform(
            starts,
            lambda start, i: F.slice(lines, start + 1, F.coalesce(F.get(starts, i + 1), F.size(lines)) - start),
        ),
    )


def _parse_lines(lines: Column) -> Column:
    """Struct ``(leaves, error)`` of an array of lines."""
    done = "struct<leaves:array<" + _LEAF + ">,error:struct<line:int,reason:string>>"

    def result(leaves: Column, error: Column) -> Column:
        return F.struct(leaves.alias("leaves"), error.alias("error")).cast(done)

    nothing = F.array().cast(f"array<{_LEAF}>")
    no_error = _null("struct<line:int,reason:string>")

    def problem(line: Column, reason: str) -> Column:
        return F.struct(line["line"].alias("line"), F.lit(reason).alias("reason"))

    end = lambda state: _let(
        _close_open(state),
        lambda closed: _let(
            _close_block(closed),
            lambda last: F.when(last["error"].isNotNull(), result(nothing, last["error"])).otherwise(
                result(last["leaves"], no_error)
            ),
        ),
    )

    def joined(parts: Column) -> Column:
        """The first error, or the leaves of all sections; of a top-level key that comes again, only the last section's."""
        broken = F.get(F.filter(parts, lambda part: part["error"].isNotNull()), F.lit(0))
        # Every section has a leaf, as empty values and collections are leaves too.
        names = F.transform(
            parts, lambda part: F.coalesce(F.get(F.get(part["leaves"], F.lit(0))["path"], F.lit(0)), F.lit(""))
        )

        def kept(names: Column) -> Column:
            last = lambda part, i: ~F.array_contains(
                F.slice(names, i + 2, F.size(names)), F.get(names, i)
            )
            return F.flatten(F.transform(F.filter(parts, last), lambda part: part["leaves"]))

        return _let(broken, lambda bad: F.when(bad.isNotNull(), result(nothing, bad["error"])).otherwise(result(_let(names, kept), no_error)))

    def fold(first: Column) -> Column:
        return (
            F.when(first.isNull(), result(nothing, no_error))
            .when(
                _dash(first["content"]),
                result(nothing, problem(first, "the document must be a mapping, not a sequence")),
            )
            .otherwise(
                _let(
                    F.transform(_sections(lines, first["indent"]), lambda part: F.aggregate(part, _start(first), _step, end)),
                    joined,
                )
            )
        )

    tabbed = F.get(F.filter(lines, lambda line: line["tab"]), F.lit(0))
    first = F.get(F.filter(lines, lambda line: line["content"] != ""), F.lit(0))
    return _let(
        tabbed,
        lambda tab: F.when(
            tab.isNotNull(), result(nothing, problem(tab, "tab indentation is not supported, use spaces"))
        ).otherwise(_let(first, fold)),
    )


# --- table operators -----------------------------------------------------------------


@lru_cache(maxsize=4)
def _parsed_lines(application_id: str) -> Column:
    """The fold over the column ``_lines``; its many nodes are built once per application."""
    lines = F.coalesce(F.col("_lines"), F.array().cast(_LINES))
    return _let(lines, _parse_lines)


def parse_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``body``, ``leaves`` and ``error`` (null when the block was read)."""
    split = docs.withColumn("_doc", split_document(F.col(text)))
    lines = split.select(
        *docs.columns, F.col("_doc.body").alias("body"), block_lines(F.col("_doc.block")).alias("_lines")
    )
    parsed = _parsed_lines(docs.sparkSession.sparkContext.applicationId)
    # A generator and not a projection: filters above must not copy the fold below themselves.
    return lines.select(*docs.columns, "body", F.inline(F.array(parsed)))


def key_path(path: Column) -> Column:
    """``authors[0].name`` from the segments of a leaf."""
    return F.array_join(
        F.transform(
            path,
            lambda part, i: F.when(
                F.startswith(part, F.lit("#")), F.concat(F.lit("["), F.substring(part, 2, 12), F.lit("]"))
            ).otherwise(F.when(i == 0, F.substring(part, F.lit(2), F.length(part))).otherwise(part)),
        ),
        "",
    )


def frontmatter_leaves(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(doc_id, key_path, ordinal, value, value_type, line)`` of all readable blocks."""
    parsed = parse_documents(docs.select(doc_id, text), text)
    return parsed.select(doc_id, F.posexplode("leaves").alias("ordinal", "leaf")).select(
        doc_id,
        key_path(F.col("leaf.path")).alias("key_path"),
        "ordinal",
        F.col("leaf.value").alias("value"),
        F.col("leaf.value_type").alias("value_type"),
        F.col("leaf.line").alias("line"),
    )


def frontmatter_rejects(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(doc_id, line, reason)`` of blocks outside the accepted grammar."""
    parsed = parse_documents(docs.select(doc_id, text), text)
    return parsed.where(F.col("error").isNotNull()).select(doc_id, "error.line", "error.reason")


def top_value(leaves: Column, key: str) -> Column:
    """Text of a top-level string value, else null."""
    hit = F.get(
        F.filter(
            leaves,
            lambda leaf: (leaf["path"] == F.array(F.lit("." + key))) & (leaf["value_type"] == "string"),
        ),
        F.lit(0),
    )
    return hit["value"]


def document_tags(leaves: Column) -> Column:
    """Tags of ``tag`` and then ``tags``; each may be one string or a list, other types are dropped."""

    def of(key: str) -> Column:
        hits = F.filter(
            leaves,
            lambda leaf: (leaf["value_type"] == "string")
            & (F.get(leaf["path"], F.lit(0)) == "." + key)
            & (
                (F.size(leaf["path"]) == 1)
                | ((F.size(leaf["path"]) == 2) & F.startswith(F.get(leaf["path"], F.lit(1)), F.lit("#")))
            ),
        )
        return F.transform(hits, lambda leaf: leaf["value"])

    return normalize_tags(F.concat(of("tag"), of("tags")))


def _json_string(text: Column) -> Column:
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def leaves_json(leaves: Column) -> Column:
    """Nested JSON object of the leaves.

    Leaves stand in document order with siblings together, so every leaf only has to close
    what its predecessor left open and open what is new.
    """

    def opening(part: Column) -> Column:
        return F.when(F.startswith(part, F.lit("#")), "[").otherwise("{")

    def closing(part: Column) -> Column:
        return F.when(F.startswith(part, F.lit("#")), "]").otherwise("}")

    def label(part: Column) -> Column:
        return F.when(F.startswith(part, F.lit("#")), "").otherwise(
            F.concat(_json_string(F.substring(part, F.lit(2), F.length(part))), F.lit(":"))
        )

    def value(leaf: Column) -> Column:
        return F.when(leaf["value_type"] == "string", _json_string(leaf["value"])).otherwise(
            F.coalesce(leaf["value"], F.lit("null"))
        )

    def shared(path: Column, previous: Column) -> Column:
        """Number of leading segments two neighbours have in common."""
        same = F.transform(F.arrays_zip(path.alias("a"), previous.alias("b")), lambda z: z["a"].eqNullSafe(z["b"]))
        first = F.array_position(same, F.lit(False))
        return F.when(first == 0, F.size(path)).otherwise(first - 1).cast("int")

    def emit(leaf: Column, i: Column) -> Column:
        previous = F.when(i > 0, F.get(leaves, i - 1)["path"]).otherwise(F.array().cast("array<string>"))

        def text(prior: Column) -> Column:
            def with_common(common: Column) -> Column:
                ends = F.transform(
                    F.reverse(F.slice(prior, common + 2, F.size(prior))), closing
                )
                parts = F.transform(
                    F.slice(leaf["path"], common + 1, F.size(leaf["path"])),
                    lambda part, j: F.concat(F.when(j > 0, opening(part)).otherwise(""), label(part)),
                )
                return F.concat(
                    F.array_join(ends, ""),
                    F.when(i > 0, ",").otherwise(""),
                    F.array_join(parts, ""),
                    value(leaf),
                )

            return _let(shared(leaf["path"], prior), with_common)

        return _let(previous, text)

    last = F.element_at(leaves, -1)["path"]
    tail = F.array_join(F.transform(F.reverse(F.slice(last, F.lit(2), F.size(last))), closing), "")
    return F.when(F.size(leaves) == 0, F.lit("{}")).otherwise(
        F.concat(F.lit("{"), F.array_join(F.transform(leaves, emit), ""), tail, F.lit("}"))
    )
