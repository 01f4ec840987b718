"""Uses that no reference shows: reflection, registrations, middleware, attributes, test frameworks, data providers.

Rules are rows joined to invocation and attribute facts. Each operator gives marks (symbol,
is_protected, is_uncertain); a protected symbol is used, an uncertain one may be, and a symbol may be
both. combined brings marks together and protects the types that protected symbols lie in.

Fact columns that the operators read:

symbols      symbol, symbol_kind (type, method, property, field, event), name, type (that contains it),
             assembly, project, is_source, is_static, accessibility, first_parameter, overrides,
             overrides_source (whether the overridden one has source), value_core, value_wraps
contracts    type, contract (full name), contract_source, member_source, implementation (of each member of
             each of the type's interfaces), arguments (array, of the interface); may have implementation_kind,
             for facts in which members of several kinds share a symbol
invocations  project, assembly, target_type, target_name, target_source, typeof_type, has_name_parameter,
             name (constant, else null), type_arguments, argument_types (arrays)
attributes   id, project, owner, owner_kind (type, method, parameter, member, assembly), owner_type,
             classes (array of struct name, assembly, is_source, version: the class and its bases),
             interfaces (array of the same), types (array), text (first constant string),
             named_types (map, null where unresolved), named_texts (map), is_error (the source type is unknown)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .graphs import ancestors
from .references import among

# Targets of invocations with what they bind.
REFLECTION = (("System.Type", "GetMethod", "method"), ("System.Type", "GetMethods", "method"), ("System.Type", "GetProperty", "property"), ("System.Type", "GetProperties", "property"))
ASSEMBLY_TYPES = (("System.Reflection.Assembly", "GetTypes"),)
SERVICES = "Microsoft.Extensions.DependencyInjection."
SERVICE_CLASSES = ("ServiceCollectionServiceExtensions", "ServiceCollectionHostedServiceExtensions", "OptionsServiceCollectionExtensions")
SERVICE_METHODS = ("AddSingleton", "AddScoped", "AddTransient", "AddHostedService", "ConfigureOptions")
MIDDLEWARE = (("Microsoft.AspNetCore.Builder.UseMiddlewareExtensions", "UseMiddleware"),)
MIDDLEWARE_METHODS, MIDDLEWARE_CONTEXT = ("Invoke", "InvokeAsync"), "Microsoft.AspNetCore.Http.HttpContext"
ENTRY_ATTRIBUTES = ("System.Runtime.CompilerServices.ModuleInitializerAttribute", "Microsoft.JSInterop.JSInvokableAttribute")
ROUTE_ASSEMBLY = "Microsoft.AspNetCore.Mvc"
ROUTE_ATTRIBUTES = ("HttpGetAttribute", "HttpPostAttribute", "HttpPutAttribute", "HttpDeleteAttribute", "AcceptVerbsAttribute", "RouteAttribute")
# Attributes and interfaces of test frameworks.
UNIT = "Microsoft.VisualStudio.TestTools.UnitTesting."
FACT_INTERFACE = "Xunit.v3.IFactAttribute"
TESTS = (
    "Xunit.FactAttribute", "Xunit.TheoryAttribute", "NUnit.Framework.TestAttribute", "NUnit.Framework.TestCaseAttribute", "NUnit.Framework.TestCaseSourceAttribute", "NUnit.Framework.TheoryAttribute",
    UNIT + "TestMethodAttribute", UNIT + "DataTestMethodAttribute",
)
LIFECYCLE = (
    "Xunit.BeforeAfterTestAttribute", "NUnit.Framework.SetUpAttribute", "NUnit.Framework.TearDownAttribute", "NUnit.Framework.OneTimeSetUpAttribute", "NUnit.Framework.OneTimeTearDownAttribute",
    "NUnit.Framework.TestFixtureSetUpAttribute", "NUnit.Framework.TestFixtureTearDownAttribute",
    UNIT + "AssemblyInitializeAttribute", UNIT + "AssemblyCleanupAttribute", UNIT + "ClassInitializeAttribute", UNIT + "ClassCleanupAttribute",
    UNIT + "TestInitializeAttribute", UNIT + "TestCleanupAttribute", UNIT + "GlobalTestInitializeAttribute", UNIT + "GlobalTestCleanupAttribute",
)
FIXTURES = (
    UNIT + "TestClassAttribute", "NUnit.Framework.TestFixtureAttribute", "NUnit.Framework.TestFixtureSourceAttribute", "NUnit.Framework.SetUpFixtureAttribute",
    "Xunit.CollectionAttribute", "Xunit.CollectionDefinitionAttribute", "Xunit.AssemblyFixtureAttribute", "Xunit.v3.AssemblyFixtureAttribute",
)
FIXTURE_INTERFACES = ("Xunit.IClassFixture`1", "Xunit.ICollectionFixture`1")
LIFETIME_INTERFACES = ("Xunit.IAsyncLifetime", "System.IDisposable", "System.IAsyncDisposable")
COLLECTION, DEFINITION = "Xunit.CollectionAttribute", "Xunit.CollectionDefinitionAttribute"
POINTS = ("NUnit.Framework.DatapointAttribute", "NUnit.Framework.DatapointSourceAttribute")
TYPE_DATA = ("Xunit.ClassDataAttribute", "Xunit.AssemblyFixtureAttribute", "Xunit.v3.AssemblyFixtureAttribute", UNIT + "AssemblyFixtureProviderAttribute")
#: Attribute, framework, owners, and the named argument that gives the source type.
MEMBER_DATA = (
    ("Xunit.MemberDataAttribute", "xunit", ("method",), "MemberType"),
    ("NUnit.Framework.TestCaseSourceAttribute", "nunit", ("method",), "SourceType"),
    ("NUnit.Framework.TestFixtureSourceAttribute", "nunit", ("method", "type"), "SourceType"),
    ("NUnit.Framework.ValueSourceAttribute", "nunit", ("method", "parameter"), "SourceType"),
    ("NUnit.Framework.DatapointAttribute", "nunit", ("method",), "SourceType"),
    ("NUnit.Framework.DatapointSourceAttribute", "nunit", ("method",), "SourceType"),
    (UNIT + "DynamicDataAttribute", "mstest", ("method",), "DynamicDataSourceType"),
)
DISPLAY_NAMES, DISPLAY_TYPE = ("DynamicDataDisplayName", "DynamicDataDisplayNameMethodName"), "DynamicDataDisplayNameDeclaringType"
NO_SOURCE_TYPE = "Recognized framework data attribute has no statically resolvable source type."
NO_PROVIDER_TYPE = "Recognized framework data attribute has no statically resolvable provider type."
NO_COLLECTION_NAME = "xUnit collection binding has no static collection name."
PROVIDER_KINDS = ("method", "property", "field")


def _in(column: str, values: tuple[str, ...]) -> Column:
    return F.col(column).isin(*values)


def _marks(df: DataFrame, symbol: str, protected: Column | bool, uncertain: Column | bool) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(F.col(symbol).alias("symbol"), lit(protected).alias("is_protected"), lit(uncertain).alias("is_uncertain"))


def combined(marks: list[DataFrame], symbols: DataFrame) -> DataFrame:
    """marks of each symbol once; the type that contains a protected symbol is protected too, the types around that one aren't."""
    every = reduce(DataFrame.unionByName, marks).where("symbol is not null")
    held = every.where("is_protected").select("symbol").distinct()
    around = among(symbols.select("symbol", "type").where("type is not null"), held, ["symbol"]).join(held, "symbol").select("type").distinct()
    return every.unionByName(_marks(around, "type", True, False)).groupBy("symbol").agg(F.bool_or("is_protected").alias("is_protected"), F.bool_or("is_uncertain").alias("is_uncertain"))


def reflected(invocations: DataFrame, symbols: DataFrame) -> DataFrame:
    """marks of members looked up by reflection on typeof(T), and of types listed by assembly.

    A constant name protects the members of that name and kind, a call that takes no name all of
    the kind; a name that isn't constant makes all of the kind uncertain. Listing the types of an
    assembly makes every type of the caller's assembly uncertain. Calls of methods that have source
    are somebody's own. Calls are made distinct before they meet members.
    """
    foreign = invocations.where("not target_source")
    kind = reduce(lambda c, r: c.when((F.col("target_type") == r[0]) & (F.col("target_name") == r[1]), r[2]), REFLECTION, F.when(F.lit(False), F.lit("")))
    calls = foreign.withColumn("kind", kind).where("kind is not null and typeof_type is not null")
    calls = calls.select(F.col("typeof_type").alias("type"), F.col("kind").alias("symbol_kind"), F.when(F.col("has_name_parameter"), F.col("name")).alias("wanted"), (F.col("has_name_parameter") & F.col("name").isNull()).alias("unknown")).distinct()
    members = symbols.select("symbol", "type", "symbol_kind", "name").join(calls, ["type", "symbol_kind"]).where("wanted is null or wanted = name")
    listing = foreign.where(reduce(Column.__or__, [(F.col("target_type") == t) & (F.col("target_name") == n) for t, n in ASSEMBLY_TYPES])).select("assembly").distinct()
    types = symbols.where("symbol_kind = 'type'").join(listing, "assembly", "left_semi")
    return _marks(members, "symbol", ~F.col("unknown"), F.col("unknown")).unionByName(_marks(types, "symbol", False, True))


def framework_hooks(types: DataFrame, symbols: DataFrame, contracts: DataFrame) -> DataFrame:
    """marks of types (type) that a framework creates: itself, its overrides of methods without
    source, and its own methods that implement members of contracts without source."""
    own = symbols.where("symbol_kind = 'method' and overrides is not null and not coalesce(overrides_source, false)").join(types, "type", "left_semi")
    kept = contracts.where("not member_source and implementation is not null").join(types, "type", "left_semi")
    if "implementation_kind" in contracts.columns:
        kept = kept.where("implementation_kind = 'method'")
    kept = kept.select("type", F.col("implementation").alias("symbol"))
    kept = kept.join(symbols.where("symbol_kind = 'method'").select("symbol", "type"), ["symbol", "type"], "left_semi")
    return _marks(types, "type", True, False).unionByName(_marks(own, "symbol", True, False)).unionByName(_marks(kept, "symbol", True, False))


def registered(invocations: DataFrame, symbols: DataFrame, contracts: DataFrame) -> DataFrame:
    """marks from registrations of services, whose types are type arguments or types of arguments, and of
    middleware, whose Invoke and InvokeAsync on a request's context are called too."""
    foreign = invocations.where("not target_source")
    services = foreign.where(_in("target_type", tuple(SERVICES + c for c in SERVICE_CLASSES)) & _in("target_name", SERVICE_METHODS))
    middleware = foreign.where(reduce(Column.__or__, [(F.col("target_type") == t) & (F.col("target_name") == n) for t, n in MIDDLEWARE]))
    piped = middleware.select(F.explode("type_arguments").alias("type")).distinct()
    types = services.select(F.explode(F.concat("type_arguments", "argument_types")).alias("type")).unionByName(piped).distinct()
    called = symbols.where(_in("name", MIDDLEWARE_METHODS) & (F.col("symbol_kind") == "method") & ~F.coalesce("is_static", F.lit(False)) & (F.col("first_parameter") == MIDDLEWARE_CONTEXT)).join(piped, "type", "left_semi")
    return framework_hooks(types, symbols, contracts).unionByName(_marks(called, "symbol", True, False))


def by_attribute(attributes: DataFrame, configured: list[str]) -> DataFrame:
    """marks of types and methods with an entry-point attribute: fixed ones if they have no source,
    configured ones in any case, and routes of controllers on methods. Bases of the attribute's class don't count."""
    own = F.get(F.col("classes"), F.lit(0))
    fixed = own["name"].isin(*ENTRY_ATTRIBUTES) & ~own["is_source"]
    given = own["name"].isin(*configured) if configured else F.lit(False)
    route = (F.col("owner_kind") == "method") & own["assembly"].startswith(ROUTE_ASSEMBLY) & ~own["is_source"] & own["name"].isin(*[f"{ROUTE_ASSEMBLY}.{a}" for a in ROUTE_ATTRIBUTES])
    return _marks(attributes.where(_in("owner_kind", ("type", "method")) & (fixed | given | route)), "owner", True, False)


def genuine(c: Column) -> Column:
    """Whether a class or interface (struct name, assembly, is_source) is the test framework's own and no look-alike: without source, from the framework's assembly."""
    name, assembly = c["name"], F.lower(c["assembly"])
    xunit = name.startswith("Xunit.") & assembly.startswith("xunit.")
    nunit = name.startswith("NUnit.Framework.") & (assembly == "nunit.framework")
    unit = name.startswith(UNIT) & ((assembly == "mstest.testframework") | assembly.startswith("microsoft.visualstudio.testplatform.testframework"))
    return ~c["is_source"] & (xunit | nunit | unit | name.startswith("System."))


def recognized(attributes: DataFrame) -> DataFrame:
    """attributes with known, the names of the frameworks' own classes among the attribute's class and bases, and is_fact, whether it implements xUnit's fact."""
    names = lambda c: F.transform(F.filter(c, genuine), lambda x: x["name"])
    fact = F.exists("interfaces", lambda i: genuine(i) & (i["name"] == FACT_INTERFACE))
    return attributes.withColumn("known", names("classes")).withColumn("is_fact", F.coalesce(fact, F.lit(False)))


def _has(names: tuple[str, ...]) -> Column:
    return F.arrays_overlap("known", F.array(*map(F.lit, names)))


def _around(types: DataFrame, up: DataFrame) -> DataFrame:
    """marks that protect types (type) and every type around them; up is (node, ancestor, depth) of containment."""
    return _marks(up.join(types.select(F.col("type").alias("node")).distinct(), "node", "left_semi").select("ancestor").distinct(), "ancestor", True, False)


def providers(types: DataFrame, up: DataFrame, contracts: DataFrame) -> DataFrame:
    """marks of types (type) that a framework makes to provide data: the types around them, and all that implements a contract."""
    kept = contracts.where("implementation is not null").join(types.select("type").distinct(), "type", "left_semi")
    return _around(types, up).unionByName(_marks(kept, "implementation", True, False))


def test_members(attributes: DataFrame, symbols: DataFrame, bases: DataFrame, up: DataFrame, contracts: DataFrame) -> DataFrame:
    """marks of tests, fixtures, data points and lifecycle members, inherited ones and their overrides included.

    attributes is what recognized gives; bases is (node, ancestor, depth) of base types, up that of containment.
    """
    tests = attributes.where((F.col("owner_kind") == "method") & (_has(TESTS) | F.col("is_fact")))
    hooks = attributes.where((F.col("owner_kind") == "method") & (_has(TESTS + LIFECYCLE) | F.col("is_fact"))).select(F.col("owner").alias("hook"), F.col("owner_type").alias("ancestor")).distinct()
    # A type inherits the hooks of its bases; one that overrides a hook runs its own.
    heirs = bases.join(hooks, "ancestor").select(F.col("node").alias("type"), "hook")
    heirs = heirs.join(symbols.where("symbol_kind = 'type' and is_source").select(F.col("symbol").alias("type")), "type", "left_semi")
    again = symbols.where("overrides is not null").select("symbol", "type", F.col("overrides").alias("hook")).join(heirs, ["type", "hook"], "left_semi")
    fixtures = attributes.where((F.col("owner_kind") == "type") & _has(FIXTURES)).select(F.col("owner").alias("type"))
    made = contracts.where(_in("contract", FIXTURE_INTERFACES) & ~F.col("contract_source"))
    lifetime = contracts.where(_in("contract", LIFETIME_INTERFACES) & ~F.col("contract_source"))
    points = attributes.where((F.col("owner_kind") == "member") & _has(POINTS))
    marks = [_marks(df, c, True, False) for df, c in ((tests, "owner"), (heirs, "hook"), (again, "symbol"), (lifetime.where("implementation is not null"), "implementation"), (points, "owner"))]
    within = [tests.select(F.col("owner_type").alias("type")), heirs.select("type"), fixtures, made.select("type"), lifetime.select("type"), points.where(_has(POINTS[1:])).select(F.col("owner_type").alias("type"))]
    marks += [_around(reduce(DataFrame.unionByName, within), up), providers(made.select(F.explode("arguments").alias("type")), up, contracts)]
    return reduce(DataFrame.unionByName, marks)


def plausible_provider(framework: Column, allows_task: Column, allows_async: Column) -> Column:
    """Whether a member (is_static, accessibility, symbol_kind, value_core, value_wraps) may provide data.

    value_core is array, enumerable, async_enumerable, void or other, inside value_wraps tasks.
    """
    open_ = F.coalesce("is_static", F.lit(False)) & ((framework == "nunit") | (F.col("accessibility") == "Public"))
    core = F.col("value_core").isin("array", "enumerable") | ((F.col("value_core") == "async_enumerable") & allows_async)
    return F.coalesce(open_ & core & ((F.col("value_wraps") == 0) | allows_task), F.lit(False))


def data_bindings(attributes: DataFrame) -> DataFrame:
    """(project, framework, source_type, name, allows_task, allows_async, is_open) of recognized attributes
    that name a member as a test's data, each once; is_open is whether the source type can't be known.

    The type is the named argument's, else the first type among the arguments, else the owner's. xUnit
    of version 3 takes tasks and asynchronous lists, NUnit tasks from 3.14 and such lists from 4.0.
    """

    def of_framework(attribute: str) -> Column:
        return F.get(F.filter("classes", lambda c: genuine(c) & (c["name"] == attribute)), F.lit(0))

    rows = []
    for attribute, framework, owners, argument in MEMBER_DATA:
        own = attributes.where(_in("owner_kind", owners) & F.array_contains("known", attribute))
        given = F.element_at("named_types", F.lit(argument))
        first = of_framework(attribute)
        version = F.split(first["version"], r"\.")
        number = F.coalesce(F.get(version, F.lit(0)).try_cast("int"), F.lit(0)) * 1000 + F.coalesce(F.get(version, F.lit(1)).try_cast("int"), F.lit(0))
        v3 = F.lower(first["assembly"]).startswith("xunit.v3.")
        task, async_ = {"xunit": (v3, v3), "nunit": (number >= 3014, number >= 4000), "mstest": (F.lit(False), F.lit(False))}[framework]
        unknown = (F.map_contains_key("named_types", argument) & given.isNull()) | F.col("is_error")
        source = F.coalesce(given, F.get("types", F.lit(0)), F.col("owner_type"))
        rows.append(own.select("project", F.lit(framework).alias("framework"), source.alias("source_type"), F.col("text").alias("name"), task.alias("allows_task"), async_.alias("allows_async"), F.coalesce(unknown, F.lit(False)).alias("is_open")))
    return reduce(DataFrame.unionByName, rows).distinct()


def bound_data(bindings: DataFrame, symbols: DataFrame, bases: DataFrame, up: DataFrame, contracts: DataFrame) -> DataFrame:
    """marks from bindings (data_bindings) that know their type, by the members of that name in it and its bases.

    One match is protected. Several are protected and uncertain, and so is every plausible provider
    of the type uncertain. Without a match or without a name these are uncertain and the type is
    protected with all that it implements.
    """
    b = bindings.where("not is_open").withColumnRenamed("name", "wanted")
    keys = [c for c in b.columns if c != "project"]
    b = b.select(*keys).distinct()
    members = symbols.where(_in("symbol_kind", PROVIDER_KINDS)).select("symbol", F.col("type").alias("ancestor"), "name", "symbol_kind", "is_static", "accessibility", "value_core", "value_wraps")
    # Bindings go up to the bases and meet members there: members aren't handed down to all types.
    above = bases.select(F.col("node").alias("source_type"), "ancestor")
    equal = lambda k: F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    wanted = b.where("wanted is not null").select("source_type", "wanted").distinct()
    met = wanted.join(above, "source_type").join(members.select("ancestor", F.col("name").alias("wanted"), "symbol").distinct(), ["ancestor", "wanted"])
    met = cut(met.select("source_type", "wanted", "symbol").distinct())
    counts = met.groupBy("source_type", "wanted").agg(F.count(F.lit(1)).alias("n"))
    names = ["source_type", "wanted"]
    b = cut(b.alias("l").join(counts.alias("r"), reduce(Column.__and__, map(equal, names)), "left").select(*[F.col(f"l.{k}").alias(k) for k in keys], F.coalesce("r.n", F.lit(0)).alias("n")))
    found = met.join(counts, names).groupBy("symbol").agg(F.max(F.col("n") > 1).alias("several"))
    # What makes a provider plausible is seen before it meets the kinds of bindings that reach its type.
    likely = members.where(plausible_provider(F.lit("nunit"), F.lit(True), F.lit(True)))
    kinds = ["framework", "allows_task", "allows_async"]
    reaching = b.where("n <> 1").select("source_type", *kinds).distinct().join(above, "source_type").select("ancestor", *kinds).distinct()
    open_ = likely.join(reaching, "ancestor").where(plausible_provider(F.col("framework"), F.col("allows_task"), F.col("allows_async")))
    whole = providers(b.where("n = 0").select(F.col("source_type").alias("type")), up, contracts)
    return _marks(found, "symbol", True, F.col("several")).unionByName(_marks(open_, "symbol", False, True)).unionByName(whole)


def display_names(attributes: DataFrame, symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """marks of methods that name the rows of dynamic data: all of the name given, or, if the type
    and its bases have none, every public static method that returns text is uncertain."""
    own = attributes.where((F.col("owner_kind") == "method") & F.array_contains("known", UNIT + "DynamicDataAttribute"))
    named = F.coalesce(*[F.element_at("named_texts", F.lit(k)) for k in DISPLAY_NAMES])
    wanted = own.select(F.coalesce(F.element_at("named_types", F.lit(DISPLAY_TYPE)), F.col("owner_type")).alias("node"), named.alias("wanted")).where("wanted is not null").distinct()
    methods = symbols.where("symbol_kind = 'method'").select("symbol", F.col("type").alias("ancestor"), "name", (F.col("is_static") & (F.col("accessibility") == "Public") & (F.col("value_core") == "text") & (F.col("value_wraps") == 0)).alias("plausible"))
    inherited = bases.select("node", "ancestor").join(methods, "ancestor")
    found = wanted.join(inherited, "node").where("name = wanted")
    none = wanted.join(found.select("node", "wanted").distinct(), ["node", "wanted"], "left_anti").select("node").distinct()
    return _marks(found, "symbol", True, False).unionByName(_marks(inherited.where("plausible").join(none, "node", "left_semi"), "symbol", False, True))


def collections(attributes: DataFrame, up: DataFrame, contracts: DataFrame) -> DataFrame:
    """marks of fixture definitions that a collection names in the same project; definitions protect what they hold."""
    own = attributes.where("owner_kind = 'type'")
    named = own.where(F.array_contains("known", COLLECTION) & F.col("text").isNotNull()).select("project", "text").distinct()
    defined = own.where(F.array_contains("known", DEFINITION)).select("project", "text", F.col("owner").alias("type"))
    return providers(defined.join(named, ["project", "text"], "left_semi").select("type"), up, contracts)


def given_types(attributes: DataFrame, up: DataFrame, contracts: DataFrame) -> DataFrame:
    """marks of the types that attributes of TYPE_DATA name."""
    own = attributes.where(_has(TYPE_DATA)).select(F.explode(F.concat("types", F.filter(F.map_values("named_types"), lambda t: t.isNotNull()))).alias("type"))
    return providers(own, up, contracts)


def open_projects(attributes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(project, reason), each once: projects with a binding whose type or collection name can't be known.

    All their types and members are uncertain, and what they refer to is left out of the analysis.
    """
    no_types = F.size(F.concat("types", F.filter(F.map_values("named_types"), lambda t: t.isNotNull()))) == 0
    rows = [
        bindings.where("is_open").select("project", F.lit(NO_SOURCE_TYPE).alias("reason")),
        attributes.where(_has(TYPE_DATA) & no_types).select("project", F.lit(NO_PROVIDER_TYPE).alias("reason")),
        attributes.where((F.col("owner_kind") == "type") & F.array_contains("known", COLLECTION) & F.col("text").isNull()).select("project", F.lit(NO_COLLECTION_NAME).alias("reason")),
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


def excluded_area(open_: DataFrame, areas: DataFrame) -> DataFrame:
    """(project, reason) of everything that open projects lead to; areas is (origin, project)."""
    return areas.join(open_.withColumnRenamed("project", "origin"), "origin").select("project", "reason").distinct()


def indirect_uses(invocations: DataFrame, attributes: DataFrame, symbols: DataFrame, contracts: DataFrame, base_types: DataFrame, configured: list[str]) -> tuple[DataFrame, DataFrame]:
    """(marks, open projects) of all rules here. base_types is (type, base), the nearest base of each type."""
    known = recognized(attributes)
    bases = ancestors(symbols.where("symbol_kind = 'type'").select(F.col("symbol").alias("node")).join(base_types.select(F.col("type").alias("node"), F.col("base").alias("parent")), "node", "left"))
    up = ancestors(symbols.where("symbol_kind = 'type'").select(F.col("symbol").alias("node"), F.col("type").alias("parent")))
    bindings = data_bindings(known)
    open_ = open_projects(known, bindings)
    everything = symbols.where("is_source").join(open_.select("project").distinct(), "project", "left_semi")
    marks = [
        reflected(invocations, symbols), registered(invocations, symbols, contracts), by_attribute(attributes, configured), test_members(known, symbols, bases, up, contracts),
        bound_data(bindings, symbols, bases, up, contracts), display_names(known, symbols, bases), collections(known, up, contracts), given_types(known, up, contracts), _marks(everything, "symbol", False, True),
    ]
    return combined(marks, symbols), open_
