"""Uses of symbols in markup: XAML object trees, Razor components and calls from scripts, as marks.

XAML is parsed as nested elements with their namespaces; what cannot be parsed fails the run. Names
are then joined to symbols: one match is protected, several or none leave what may be meant uncertain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ship
from .protection import _marks
from .references import among, meeting, owner_by_longest_prefix

# What a use looks like.
CLR = "clr-namespace:"
STATIC = re.compile(r"\{x:Static\s+(\w+):(\w+)\.(\w+)\}")
BINDING = re.compile(r"\{Binding\s+(?:Path=)?([\w.]+)")
PAGE = r"(?U)@page\s+"
HANDLER = r"""(?U)@(?:on\w+)\s*=\s*["']([^"']+)["']"""
TAG = r"(?U)<([A-Z][\w.]*)\b([^>]*)>"
SETS = r"(?U)(?:@bind-)?([\w-]+)\s*="
PLAIN = r"(?U)^@?(\w+)\s*$"
SCRIPT = r"""DotNet\.invokeMethod(?:Async)?\(\s*['"]([^'"]+)['"]\s*,\s*['"]([^'"]+)['"]"""
INVOKABLE, INVOKABLE_ASSEMBLY = "Microsoft.JSInterop.JSInvokableAttribute", "Microsoft.JSInterop"

XAML_USE = "file_path string, kind string, type string, name string, member string, project string"


def _clr(namespace: str | None, name: str) -> str | None:
    """The full name of a type in a namespace of the runtime, null in any other."""
    if namespace is None or not namespace.startswith(CLR):
        return None
    own = namespace[len(CLR) :].split(";", 1)[0]
    return f"{own}.{name}" if own else name


def xaml_uses(path: str, text: str) -> list[tuple]:
    """(file_path, kind, type, name, member) of one file, in document order.

    class: the code behind; type: an element's type; event: type, attribute and value of what may be
    an event; static: type (null if its prefix isn't known there), its simple name and the member;
    binding: the type of the first data context (null without) and a dotted path.
    """
    parser = ElementTree.XMLPullParser(("start", "end", "start-ns", "end-ns"))
    prefixes: dict[str, list[str]] = {}
    opened: list[str] = []
    out, stack, elements, contexts = [], [], [], []
    try:
        parser.feed(text)
        parser.close()
        for event, x in parser.read_events():
            if event == "start-ns":
                opened.append(x[0])
                prefixes.setdefault(x[0], []).append(x[1])
            elif event == "end-ns":
                prefixes[opened.pop()].pop()
            elif event == "start":
                space, _, local = x.tag.rpartition("}")
                kind = _clr(space[1:] or None, local)
                if stack and stack[-1]["context"] is not None and stack[-1]["first"]:
                    contexts.append((*stack[-1]["context"], kind))
                if stack:
                    stack[-1]["first"] = False
                    stack[-1]["n"] += 1
                context = (stack[-1]["at"], stack[-1]["n"]) if stack and local.endswith(".DataContext") else None
                stack.append({"at": len(elements), "n": 0, "first": True, "context": context})
                # The prefixes as they are here, where the element's own declarations hold already.
                elements.append((kind, dict(x.attrib), {p: u[-1] for p, u in prefixes.items() if u}))
            elif event == "end":
                if stack[-1]["context"] is not None and stack[-1]["first"]:
                    contexts.append((*stack[-1]["context"], None))
                stack.pop()
    except ElementTree.ParseError as e:
        raise ValueError(f"XAML markup could not be evaluated: {path}: {e}") from None
    behind = next((v for k, v in elements[0][1].items() if k.rpartition("}")[2] == "Class"), None)
    if behind is not None:
        out.append((path, "class", behind, behind.rpartition(".")[2], None))
    around = min(contexts, key=lambda c: c[:2])[2] if contexts else None
    for kind, attributes, known in elements:
        if kind is not None:
            out.append((path, "type", kind, None, None))
        for name, value in attributes.items():
            out += [(path, "static", _clr(known.get(m[1]), m[2]), m[2], m[3]) for m in STATIC.finditer(value)]
            out += [(path, "binding", around, m[1], None) for m in BINDING.finditer(value)]
            if behind is not None and kind is not None:
                out.append((path, "event", kind, name.rpartition("}")[2], value))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(*u, at) for p, t, at in zip(b["file_path"].to_pylist(), b["text"].to_pylist(), b["project"].to_pylist(), strict=True) for u in xaml_uses(p, t or "")]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["file_path", "kind", "type", "name", "member", "project"])


def counted(found: DataFrame, use: list[str]) -> DataFrame:
    """marks of found (use columns, symbol): protected where the use has one symbol, uncertain where it has several."""
    f = found.select(*use, "symbol").distinct()
    n = f.groupBy(*use).agg(F.count(F.lit(1)).alias("_n"), F.min("symbol").alias("_one"))
    one = n.where("_n = 1").select(F.col("_one").alias("symbol"))
    more = f.alias("f").join(n.where("_n > 1").alias("n"), reduce(Column.__and__, [F.col(f"f.{c}").eqNullSafe(F.col(f"n.{c}")) for c in use]), "left_semi")
    return _marks(one, "symbol", True, False).unionByName(_marks(more, "symbol", False, True))


def _without(uses: DataFrame, found: DataFrame, use: list[str]) -> DataFrame:
    return uses.join(found.select(*use).distinct(), use, "left_anti")


def xaml_marks(files: DataFrame, symbols: DataFrame, areas: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """marks of files (file_path, text, project). symbols has full_name of types and value_type of properties too.

    A type is looked up by its full name in the file's project, else in what that refers to (areas:
    origin, project), where it must be the only one. Symbols are filtered by what is looked for
    before they are dealt, and names that may mean any member of a project are met in one pass.
    """
    ship(files.sparkSession)
    uses = cut(files.select("file_path", "text", "project").mapInArrow(_parsed, XAML_USE))
    types = symbols.where("symbol_kind = 'type' and full_name is not null").select("full_name", F.col("symbol").alias("owner"), F.col("project").alias("home"))
    named = uses.where("type is not null").select("project", F.col("type").alias("full_name")).distinct()
    near = named.join(areas.select(F.col("origin").alias("project"), F.col("project").alias("home")), "project").join(types, ["full_name", "home"])
    own = F.col("home") == F.col("project")
    picked = near.groupBy("project", "full_name").agg(F.min(F.when(own, F.col("owner"))).alias("own"), F.min("owner").alias("any"), F.max("owner").alias("last"))
    picked = picked.select("project", F.col("full_name").alias("type"), F.coalesce("own", F.when(F.col("any") == F.col("last"), F.col("any"))).alias("owner"))
    u = cut(uses.join(picked, ["project", "type"], "left").select("file_path", "project", "kind", "owner", "name", "member"))
    sources = symbols.where("is_source")
    inside = symbols.where("symbol_kind <> 'type'").select("symbol", "symbol_kind", "name", F.col("type").alias("owner"), "value_type")
    place = ["owner", "name"]

    def astray(wanted: DataFrame, *kinds: str) -> DataFrame:
        """What may be any of the project's own members of the kinds and the name (project, name)."""
        return wanted.select("project", "name", F.explode(F.array(*map(F.lit, kinds))).alias("symbol_kind"))

    members = ("method", "property", "field", "event")
    lost = u.where("kind in ('class', 'static') and owner is null").select("project", "name")
    marks = [_marks(u.where("kind in ('class', 'type') and owner is not null"), "owner", True, False), _marks(meeting(sources.where("symbol_kind = 'type'"), lost, ["project", "name"]), "symbol", False, True)]
    loose = []
    # Handlers: attributes that are events of their element's type name methods of the code behind.
    events = u.where("kind = 'event'")
    events = events.join(among(inside.where("symbol_kind = 'event'").select(*place), events, place).distinct(), place, "left_semi")
    behind = u.where("kind = 'class' and owner is not null").select("file_path", "project", F.col("owner").alias("behind"))
    handlers = cut(events.join(behind, ["file_path", "project"]).select("project", F.col("behind").alias("owner"), F.col("member").alias("name")).distinct())
    methods = cut(among(inside.where("symbol_kind = 'method'").select(*place, "symbol"), handlers, place).join(handlers, place))
    marks.append(counted(methods, place))
    loose.append(astray(_without(handlers, methods, place), "method"))
    statics = cut(u.where("kind = 'static' and owner is not null").select("project", "owner", F.col("member").alias("name")).distinct())
    fixed = cut(among(inside.select(*place, "symbol"), statics, place).join(statics, place))
    marks.append(_marks(fixed, "symbol", True, False))
    loose.append(astray(_without(statics, fixed, place), *members))
    # Paths go on from property to property, all at once, until each has ended.
    at = u.where("kind = 'binding'").select("project", "owner", F.split("name", r"\.").alias("rest")).distinct()
    properties = inside.where("symbol_kind = 'property'")
    for _ in range(max_rounds):
        at = at.withColumn("name", F.get("rest", F.lit(0)))
        firsts = among(properties, at, place).groupBy(*place).agg(F.min(F.struct("symbol", "value_type")).alias("p"))
        step = cut(at.join(firsts, place, "left"))
        marks.append(_marks(step.where("p is not null").select(F.col("p.symbol").alias("symbol")), "symbol", True, False))
        loose.append(astray(step.where("p is null"), *members))
        at = step.where("p is not null and size(rest) > 1").select("project", F.col("p.value_type").alias("owner"), F.slice("rest", F.lit(2), F.size("rest") - 1).alias("rest"))
        if at.isEmpty():
            break
    else:
        raise RuntimeError("binding paths didn't end")
    found = meeting(sources.where("symbol_kind <> 'type'"), reduce(DataFrame.unionByName, loose), ["project", "name", "symbol_kind"])
    return reduce(DataFrame.unionByName, marks).unionByName(_marks(found, "symbol", False, True))


def _razor_members(bound: DataFrame, symbols: DataFrame) -> DataFrame:
    """marks of handlers (owner, expression): a plain name is a method or property of the owner, or else
    any method of that name in its assembly; anything else makes all methods of the owner uncertain."""
    b = bound.select("owner", F.nullif(F.regexp_extract("expression", PLAIN, 1), F.lit("")).alias("name")).distinct()
    inside = symbols.where("symbol_kind in ('method', 'property')").select("symbol", "symbol_kind", "name", F.col("type").alias("owner"))
    found = b.join(inside.select("owner", "name", "symbol"), ["owner", "name"])
    whole = inside.where("symbol_kind = 'method'").join(b.where("name is null").select("owner"), "owner", "left_semi")
    astray = _without(b.where("name is not null"), found, ["owner", "name"]).join(symbols.where("symbol_kind = 'type'").select(F.col("symbol").alias("owner"), "assembly"), "owner")
    far = symbols.where("symbol_kind = 'method' and is_source").join(astray.select("assembly", "name").distinct(), ["assembly", "name"], "left_semi")
    return counted(found, ["owner", "name"]).unionByName(_marks(whole, "symbol", False, True)).unionByName(_marks(far, "symbol", False, True))


def razor_marks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """marks of files (file_path, text, project): pages, handlers, component tags and what they set."""
    files = files.withColumn("name", F.regexp_extract("file_path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1))
    types = symbols.where("symbol_kind = 'type' and is_source")
    own = cut(files.join(types.select("project", "name", F.col("symbol").alias("owner")), ["project", "name"]).select("file_path", "owner", "text"))
    pages = own.where(F.col("text").rlike(PAGE)).select("file_path", F.col("owner").alias("symbol"))
    single = own.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("file_path")
    handlers = own.join(single, "file_path", "left_semi").select("owner", F.explode(F.regexp_extract_all("text", F.lit(HANDLER), F.lit(1))).alias("expression"))
    tags = files.select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(TAG), F.lit(1)).alias("tag"), F.regexp_extract_all("text", F.lit(TAG), F.lit(2)).alias("body"))).alias("t"))
    tags = cut(tags.select(F.element_at(F.split("t.tag", r"\."), -1).alias("name"), F.col("t.body").alias("body")).distinct())
    components = tags.join(types.select("name", F.col("symbol").alias("owner")), "name")
    named = tags.select("name").distinct().join(types.select("name", "symbol"), "name")
    several = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(named, "name").select(F.col("symbol").alias("type"))
    held = symbols.where("symbol_kind = 'method'").join(several, "type", "left_semi")
    sets = components.select("owner", F.explode(F.regexp_extract_all("body", F.lit(SETS), F.lit(1))).alias("name")).distinct()
    properties = sets.join(symbols.where("symbol_kind = 'property'").select(F.col("type").alias("owner"), "name", "symbol"), ["owner", "name"])
    inner = components.select("owner", F.explode(F.regexp_extract_all("body", F.lit(HANDLER), F.lit(1))).alias("expression"))
    marks = [counted(pages, ["file_path"]), counted(named, ["name"]), _marks(held, "symbol", False, True), counted(properties, ["owner", "name"]), _razor_members(handlers.unionByName(inner), symbols)]
    return reduce(DataFrame.unionByName, marks)


def script_marks(files: DataFrame, symbols: DataFrame, attributes: DataFrame) -> DataFrame:
    """marks of files (file_path, text): methods that scripts invoke by assembly and identifier.

    An assembly that several projects build makes all its methods of that name uncertain, as does
    an identifier that no invokable method has.
    """
    calls = files.select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(2)).alias("n"))).alias("c")).select(F.col("c.a").alias("assembly"), F.col("c.n").alias("name")).distinct()
    built = symbols.where("is_source").groupBy("assembly").agg(F.count_distinct("project").alias("projects"))
    calls = calls.join(built, "assembly")
    c = F.get("classes", F.lit(0))
    open_ = attributes.where((F.col("owner_kind") == "method") & (c["name"] == INVOKABLE) & c["assembly"].startswith(INVOKABLE_ASSEMBLY) & ~c["is_source"]).select(F.col("owner").alias("symbol"), "text").distinct()
    methods = symbols.where("symbol_kind = 'method' and is_source").select("symbol", "assembly", "name")
    invokable = methods.join(open_, "symbol").select("symbol", "assembly", F.coalesce("text", "name").alias("name"))
    single = calls.where("projects = 1")
    found = single.join(invokable, ["assembly", "name"])
    loose = calls.where("projects > 1").select("assembly", "name").unionByName(_without(single, found, ["assembly", "name"]).select("assembly", "name"))
    return counted(found, ["assembly", "name"]).unionByName(_marks(methods.join(loose, ["assembly", "name"], "left_semi"), "symbol", False, True))


def markup_marks(markup: DataFrame, projects: DataFrame, symbols: DataFrame, attributes: DataFrame, areas: DataFrame) -> DataFrame:
    """marks of all markup (file_path, text); a file that lies in no project (project, dir) is an error."""
    owned = owner_by_longest_prefix(markup.select(F.col("file_path").alias("path")).distinct(), projects.select("dir", F.col("project").alias("owner")))
    files = cut(markup.join(owned.select(F.col("path").alias("file_path"), F.col("owner").alias("project")), "file_path", "left"))
    if lost := files.where("project is null").orderBy("file_path").limit(1).collect():
        raise ValueError(f"markup lies in no project: {lost[0]['file_path']}")
    ending = lambda e: files.where(F.lower("file_path").endswith(e))
    return xaml_marks(ending(".xaml"), symbols, areas).unionByName(razor_marks(ending(".razor"), symbols)).unionByName(script_marks(ending(".js"), symbols, attributes))
