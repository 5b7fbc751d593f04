"""Documents to containers, nodes and statements.

A document is walked level by level inside its own row: ``containers`` is one
expression that keeps a frontier of open containers and repeats one step until
the frontier is empty.  Nothing is shuffled, nothing is exploded, the metadata of
a variant is not copied per node, and the same plan works on a stream.  A
container is an object or array after *singleton flattening* (an array of exactly
one element stands for that element).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import UNDEFINED, ZERO, computed_once, count_token, joined, let, lettered, pick, string_token, token_text

_ENTRIES = (
    "array<struct<key:string,pos:int,type:string,text:string,kept:boolean,"
    "size:int,kids:int,only:string>>"
)
_HEAD = "name:string,base:string,path:array<string>,type:string"
_CONTAINERS = f"array<struct<{_HEAD},entries:{_ENTRIES}>>"
_MEMBERS = "array<struct<key:string,value:variant>>"
_STATEMENTS = "array<struct<kind:string,name:string,key:string,cargo:string,base:string>>"


# Levels walked in each round before the depth of a document is looked at; a round goes on
# for all its levels, however early a document ends in it.
LEVELS = (3,)


@dataclass(frozen=True)
class Shape:
    """How documents are read as trees."""

    dialect: str = "v2"
    skip_nulls: bool = True
    arrays_are_sets: bool = False
    exclude_keys: tuple[str, ...] = ()
    flatten_singletons: bool = True
    open_arrays: bool = True  # row mode keeps arrays shut
    truthy_only: bool = False  # keep only non-empty, non-zero entries
    index_names: bool = True  # array items are named by their index
    root: str = "root"


def _unwrap(v: Column) -> Column:
    """Element of an array of one, repeated for arrays nested that way."""
    layers = F.length(F.regexp_extract(v.try_cast("string"), r"^\[+", 0))

    def inner(x, _):
        return let(
            x.try_cast("array<variant>"),
            lambda items: pick(F.size(items) == 1, F.get(items, F.lit(0)), x),
        )

    return F.aggregate(F.sequence(F.lit(1), layers), v, inner)


def _type_letter(schema: Column) -> Column:
    """Type letter by the schema text of a scalar variant."""
    # whole numbers of 19 digits and more are decimals without a scale
    whole = schema.endswith(",0)") & schema.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    number = schema.startswith("DECIMAL") | schema.startswith("DOUBLE") | schema.startswith("FLOAT")
    odd = pick(whole, F.lit("i"), pick(number, F.lit("f"), F.lit("s")))
    other = pick(schema.isNull() | (schema == "VOID"), F.lit("u"), pick(schema == "BOOLEAN", F.lit("b"), odd))
    return pick(schema == "STRING", F.lit("s"), pick(schema == "BIGINT", F.lit("i"), other))


def _object_members(v: Column, shape: Shape) -> Column:
    entries = F.map_entries(v.try_cast("map<string,variant>"))
    if shape.exclude_keys:
        entries = F.filter(entries, lambda e: ~e["key"].isin(*shape.exclude_keys))
    return entries


def _array_members(items: Column) -> Column:
    return F.transform(
        items, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))
    )


def _kept_container(size: Column, shape: Shape) -> Column:
    """Is an object or set entry that holds so many members a statement?"""
    empty_too = not shape.truthy_only and (not shape.skip_nulls or shape.dialect != "v1")
    return F.lit(True) if empty_too else size > 0


def _kept_scalar(kind: Column, text: Column, shape: Shape) -> Column:
    """Is an object or set entry with this scalar a statement?"""
    nonzero = F.coalesce(text.try_cast("double") != 0, F.lit(True))
    if shape.truthy_only:
        found = pick(kind == "b", text == "true", nonzero)
        return pick(kind == "s", text != "", pick(kind == "u", F.lit(False), found))
    if not shape.skip_nulls:
        return F.lit(True)
    if shape.dialect == "v1":
        found = pick(kind == "f", nonzero, F.lit(True))
        return pick(kind == "s", text != "", pick(kind == "u", F.lit(False), found))
    found = pick((kind == "i") | (kind == "f"), nonzero, kind != "u")
    return pick(kind == "s", (text != "") & (text != "0"), found)


def _entries(members: Column, parent_type: Column, shape: Shape, make) -> Column:
    """What ``make(key, pos, kind, letter, text, kept, size, members)`` makes of each member.

    ``kind`` is 'o', 'a', 'l' (a list that stays shut) or 's' (a scalar, with its type
    letter).  A walk is interpreted, and what each list holds is copied into it: so
    values are bound one by one, and a struct has only what the next step needs.
    """
    # every item of an ordered array takes part in its chain
    chained = not (shape.arrays_are_sets or shape.truthy_only)

    def opened(m, i):
        pos = pick(parent_type == "a", i, F.lit(None).cast("int"))

        def entry(kind, letter, text, kept, size, own):
            if chained:
                kept = (parent_type == "a") | kept
            return make(m["key"], pos, kind, letter, text, kept, size, own)

        def container(kind, found, own, wrapped):
            kept = F.lit(True) if wrapped else _kept_container(F.size(found), shape)
            return entry(kind, F.lit(kind), F.lit(None).cast("string"), kept, F.size(found), own)

        def scalar(v, wrapped):
            def described(letter, text):
                kept = F.lit(True) if wrapped else _kept_scalar(letter, text, shape)
                return entry("s", letter, text, kept, F.lit(0), F.lit(None).cast(_MEMBERS))

            return let(
                let(F.schema_of_variant(v), _type_letter),
                lambda letter: let(v.try_cast("string"), lambda text: described(letter, text)),
            )

        def array(items, wrapped):
            if shape.open_arrays:
                return let(_array_members(items), lambda a: container("a", a, a, wrapped))
            return container("l", items, F.lit(None).cast(_MEMBERS), wrapped)

        def other(v, wrapped):
            return let(
                _object_members(v, shape),
                lambda o: pick(o.isNull(), scalar(v, wrapped), container("o", o, o, wrapped)),
            )

        def of(v, items, wrapped):
            return pick(items.isNull(), other(v, wrapped), array(items, wrapped))

        def flattened(items):
            if not shape.flatten_singletons:
                return of(m["value"], items, False)
            alone = let(
                _unwrap(m["value"]),
                lambda v: let(v.try_cast("array<variant>"), lambda inner: of(v, inner, True)),
            )
            listed = pick(F.size(items) == 1, alone, array(items, False))
            return pick(items.isNull(), other(m["value"], False), listed)

        return let(m["value"].try_cast("array<variant>"), flattened)

    return F.transform(members, opened)


def _kept_number(kind: str, members: Column, shape: Shape) -> Column:
    """How many entries of such a container are kept."""
    chained = kind == "a" and not (shape.arrays_are_sets or shape.truthy_only)
    if chained or not (shape.skip_nulls or shape.truthy_only):
        return F.size(members)

    def judged(m):
        return F.get(_entries(F.array(m), F.lit(kind), shape, lambda *e: e[5]), F.lit(0))

    def kept(m):
        # a text from "1" on is that of no zero, and but for {} and [] of nothing empty
        def told(text):
            plain = (text >= "1") & (text != "{}") & (text != "[]")
            return pick(plain, F.lit(True), judged(m))

        return let(m["value"].try_cast("string"), told)

    return F.size(F.filter(members, judged if shape.truthy_only else kept))


def _walked(shape: Shape, make, done, flat: bool, result: str, paths: bool) -> Column:
    """Of column ``body``: ARRAY of what becomes of its containers, outermost first.

    ``make`` is that of ``_entries``, a struct with ``key``, ``pos``, ``type``, ``kept``
    and ``members``; ``done(container, entries)`` is a value, or if ``flat`` an array of
    values, and ``result`` is the type of an array of them.
    """
    body = F.col("body")

    def below(c, entries):
        is_object = c["type"] == "o"

        def child(x):
            index = count_token(x["pos"])
            name = pick(is_object, string_token(x["key"]), index if shape.index_names else c["name"])
            base = pick(is_object, string_token(x["key"]), F.lit(ZERO) if shape.arrays_are_sets else index)
            step = F.coalesce(x["key"], x["pos"].cast("string"))
            path = [F.concat(c["path"], F.array(step)).alias("path")] if paths else []
            return F.struct(
                name.alias("name"), base.alias("base"), *path, x["type"].alias("type"), x["members"].alias("members")
            )

        return F.transform(F.filter(entries, lambda x: x["kept"] & (F.size(x["members"]) > 0)), child)

    def split(c):
        def parted(entries):
            return F.struct(below(c, entries).alias("open"), done(c, entries).alias("done"))

        return let(_entries(c["members"], c["type"], shape, make), parted)

    def step(state, _):
        def parts(p):
            here = F.flatten(p["done"]) if flat else p["done"]
            return F.struct(
                F.flatten(p["open"]).alias("open"), joined(state["done"], here).alias("done")
            )

        return pick(F.size(state["open"]) > 0, let(F.transform(state["open"], split), parts), state)

    def rounds(state, number):
        return F.aggregate(F.sequence(F.lit(1), number), state, step)

    def walked(state, levels):
        if levels:
            more = let(rounds(state, F.lit(levels[0])), lambda s: walked(s, levels[1:]))
        else:
            # a document is nowhere deeper than it has opening brackets
            text = body.try_cast("string")
            more = rounds(state, F.length(text) - F.length(F.translate(text, "[{", "")))["done"]
        return pick(F.size(state["open"]) > 0, more, state["done"])

    # the document as the only member of nothing
    root = F.struct(F.lit(None).cast("string").alias("key"), body.alias("value"))
    path = [F.array().cast("array<string>").alias("path")] if paths else []
    start = _entries(
        F.array(root),
        F.lit("o"),
        shape,
        lambda key, pos, kind, letter, text, kept, size, members: F.struct(
            F.lit("s" + shape.root).alias("name"),
            F.lit(ZERO).alias("base"),
            *path,
            letter.alias("type"),
            members.alias("members"),
        ),
    )
    start = F.filter(start, lambda c: F.size(c["members"]) > 0)
    zero = F.struct(start.alias("open"), F.array().cast(result).alias("done"))
    return let(zero, lambda state: walked(state, LEVELS))


@lru_cache(maxsize=64)
def containers(shape: Shape = Shape()) -> Column:
    """Of column ``body``: ARRAY of the containers of one document, outermost first.

    Each has ``name``, ``base`` (the token of the key it sits under), ``path``,
    ``type`` ('o' or 'a') and ``entries`` (key, pos, type, text, kept, size =
    number of members, kids = number of kept members, only = token of the item of
    an array of one).
    """
    listed = ("key", "pos", "type", "text", "kept", "size", "kids", "only")

    def make(key, pos, kind, letter, text, kept, size, members):
        kids, only = F.lit(0), F.lit(None).cast("string")
        if kind in ("o", "a"):
            kids = _kept_number(kind, members, shape)
        if kind == "a":
            items = _entries(members, F.lit("a"), shape, lambda *e: size_or_text(*e[2:5], e[6]))
            only = pick(size == 1, F.get(items, F.lit(0)), only)
        values = (key, pos, letter, text, kept, size, kids, only)
        return F.struct(*[v.alias(n) for n, v in zip(listed, values)], members.alias("members"))

    def done(c, entries):
        finished = F.transform(entries, lambda x: F.struct(*[x[n].alias(n) for n in listed]))
        return F.struct(*[c[n].alias(n) for n in ("name", "base", "path", "type")], finished.alias("entries"))

    return _walked(shape, make, done, False, _CONTAINERS, True)


def size_or_text(kind: str, letter: Column, text: Column, size: Column) -> Column:
    """Token of a scalar, or the number of members of a container."""
    if kind in ("o", "a"):
        return count_token(size)
    if kind == "l":
        return letter
    return pick(letter == "u", letter, lettered(letter, text))


def listed_size_or_text(entry: Column) -> Column:
    """``size_or_text`` of an entry of ``containers``."""
    kind = entry["type"]
    bare = (kind == "u") | (kind == "l")
    scalar = pick(bare, kind, lettered(kind, entry["text"]))
    return pick((kind == "o") | (kind == "a"), count_token(entry["size"]), scalar)


def cargo_token(kind: str, letter: Column, text: Column, size: Column, members: Column, shape: Shape) -> Column:
    """Token of an entry's value; a container counts as its number of entries."""

    def counted(number):
        if shape.dialect == "v1":
            return count_token(number)
        return pick(number > 0, count_token(number), F.lit(UNDEFINED))

    if kind == "a" and not shape.arrays_are_sets:
        return pick(size > 0, count_token(size), F.lit(UNDEFINED))
    if kind in ("o", "a"):
        return let(_kept_number(kind, members, shape), counted)
    return size_or_text(kind, letter, text, size)


def _statement(kind, name, key, cargo, base) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        name.alias("name"),
        key.alias("key"),
        cargo.alias("cargo"),
        base.alias("base"),
    )


def object_statements(c: Column, entries: Column) -> Column:
    return F.transform(
        F.filter(entries, lambda e: e["kept"]),
        lambda e: _statement("object", c["name"], string_token(e["key"]), e["cargo"], c["base"]),
    )


def set_statements(c: Column, entries: Column) -> Column:
    return F.transform(
        F.filter(entries, lambda e: e["kept"]),
        lambda e: _statement("set", c["name"], count_token(e["pos"]), e["cargo"], c["base"]),
    )


def array_statements(c: Column, entries: Column) -> Column:
    """Chain of an ordered array: 0 to first, each to the next, last to length."""

    def chain(cargo):
        def link(x, i):
            before = pick(i == 0, F.lit(ZERO), F.get(cargo, i - 1))
            return _statement("array", c["name"], before, x, c["base"])

        end = _statement(
            "array",
            c["name"],
            F.get(cargo, F.size(cargo) - 1),
            count_token(F.size(cargo)),
            c["base"],
        )
        return joined(F.transform(cargo, link), F.array(end))

    return let(entries["cargo"], chain)


@lru_cache(maxsize=64)
def statements(shape: Shape = Shape(), kind: str | None = None) -> Column:
    """Of column ``body``: ARRAY of its statements (kind, name, key, cargo, base).

    With ``kind``, only the statements of that kind are made.
    """
    listed = ("set", set_statements) if shape.arrays_are_sets else ("array", array_statements)
    made = (("object", object_statements), listed)

    def make(key, pos, sort, letter, text, kept, size, members):
        cargo = cargo_token(sort, letter, text, size, members, shape)
        if kind is not None:
            # members of objects have no position
            wanted = pos.isNull() if kind == "object" else pos.isNotNull()
            cargo = pick(wanted, cargo, F.lit(None).cast("string"))
        values = dict(key=key, pos=pos, type=letter, kept=kept, cargo=cargo, members=members)
        return F.struct(*[v.alias(n) for n, v in values.items()])

    def done(c, entries):
        none = F.array().cast(_STATEMENTS)
        found = [of(c, entries) if kind in (None, name) else none for name, of in made]
        return pick(c["type"] == "o", *found)

    return _walked(shape, make, done, True, _STATEMENTS, False)


def vector_parts(found: Column) -> Column:
    """The three tokens per statement that are vectorised: base, key, cargo.

    All items of a set share the key 0.
    """
    return F.transform(
        found,
        lambda s: F.struct(
            s["base"].alias("base"),
            F.when(s["kind"] == "set", F.lit(ZERO)).otherwise(s["key"]).alias("key"),
            s["cargo"].alias("cargo"),
        ),
    )


def preorder_statements(found: Column) -> Column:
    """Statements of the second extractor, of the containers ``triples_preorder`` opens.

    Entries without content are left out; objects count their entries with
    content, arrays their items; an array chains each item (a container by its
    size) to the one before; an array of one item adds nothing of its own.
    """

    def cargo(e):
        counted = (e["type"] == "o") & (e["size"] > 1)
        return F.coalesce(
            e["only"], F.when(counted, count_token(e["kids"])), listed_size_or_text(e)
        )

    def of_object(c):
        return F.transform(
            F.filter(c["entries"], lambda e: e["kept"]),
            lambda e: _statement("object", c["name"], string_token(e["key"]), cargo(e), c["base"]),
        )

    def of_array(c):
        def chain(items):
            links = F.transform(
                items,
                lambda x, i: _statement(
                    "array",
                    c["name"],
                    F.when(i == 0, F.lit(ZERO)).otherwise(F.get(items, i - 1)),
                    x,
                    c["base"],
                ),
            )
            last = F.get(items, F.size(items) - 1)
            end = _statement("array", c["name"], last, count_token(F.size(items)), c["base"])
            return joined(links, F.array(end))

        return let(F.transform(c["entries"], listed_size_or_text), chain)

    return F.flatten(
        F.transform(
            F.filter(found, lambda c: (c["type"] == "o") | (F.size(c["entries"]) > 1)),
            lambda c: F.when(c["type"] == "o", of_object(c)).otherwise(of_array(c)),
        )
    )


# --- tables -------------------------------------------------------------------


def with_statements(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``docs`` with ``statements`` in place of ``body``."""
    return docs.select(
        *[c for c in docs.columns if c != "body"], statements(shape).alias("statements")
    )


def walked_once(docs: DataFrame, found: Column, name: str) -> DataFrame:
    """``doc_id`` and an array out of a walk.

    Exploding the walk itself would walk three times: the optimizer puts filters on the
    array (not null, not empty) below the generator.
    """
    return computed_once(docs, ["doc_id"], F.struct(found.alias(name)))


def triples(docs: DataFrame, shape: Shape = Shape(), kind: str | None = None) -> DataFrame:
    """One row per statement: doc_id, kind and the tokens name, key, cargo, base.

    With ``kind``, those of one kind, and the walk makes no others.
    """
    found = statements(shape, kind)
    return walked_once(docs, found, "statements").select("doc_id", F.inline("statements"))


def triple_text(rows: DataFrame) -> DataFrame:
    """Tokens of a triple table as plain text (NULL for null and undefined)."""
    tokens = [c for c in ("name", "key", "cargo", "base") if c in rows.columns]
    return rows.select(
        *[token_text(F.col(c)).alias(c) if c in tokens else F.col(c) for c in rows.columns]
    )


def triples_preorder(docs: DataFrame, exclude_keys=()) -> DataFrame:
    shape = Shape(
        dialect="v1",
        flatten_singletons=False,
        truthy_only=True,
        index_names=False,
        exclude_keys=tuple(exclude_keys),
    )
    found = preorder_statements(containers(shape))
    return walked_once(docs, found, "statements").select("doc_id", F.inline("statements")).drop("base")


def statement_count(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    counted = with_statements(docs, shape)
    return counted.select("doc_id", F.size("statements").cast("long").alias("statements"))


def nodes(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """One row per node below the root, with its container and value.

    ``kind`` is the value's type letter ('o', 'a' or a scalar), ``value`` its text.
    """
    opened = walked_once(docs, containers(shape), "found").select("doc_id", F.explode("found").alias("c"))
    entries = opened.select("doc_id", F.col("c.path").alias("parent"), F.inline("c.entries"))
    step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
    return entries.select(
        "doc_id",
        F.concat("parent", F.array(step)).alias("path"),
        "parent",
        (F.size("parent") + 1).alias("depth"),
        "key",
        "pos",
        F.col("type").alias("kind"),
        F.col("text").alias("value"),
        "kept",
    )


def child_counts(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Per container the number that stands for it as a value."""
    opened = walked_once(docs, containers(shape), "found").select("doc_id", F.explode("found").alias("c"))
    kept = F.size(F.filter("c.entries", lambda e: e["kept"]))
    return opened.select("doc_id", "c.path", F.col("c.type").alias("kind"), kept.alias("children"))
