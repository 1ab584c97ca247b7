"""Checks of whole trees: each is a query over facts that gives findings (severity, file, line, message)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import collate, paths, text
from ..functions.paths import LAYERS, Vocabulary
from ..operators import graph, trace
from ..operators.joins import first_per
from ..sources import tokens, tree
from . import facts as jsons
from . import policy

FINDING = "severity string, file string, line int, message string"


@dataclass(frozen=True)
class Limits:
    """Thresholds; a count must be above them."""

    lines_error: int = 600
    lines_warning: int = 500
    pairs: int = 4
    files_on_pair: int = 3
    targets: int = 2
    trace_depth: int = 6
    budget_slack: float = 1.05
    trampoline_layers: tuple[str, ...] = ("controllers", "service")
    #: Fixed values from here on, in the order of the rules' own configuration.
    server_packages: tuple[str, ...] = ("drizzle-orm", "pg", "postgres", "better-auth", "stripe")
    boundary_module: str = "@tanstack/react-start"
    boundary_calls: tuple[str, ...] = ("createServerFn", "createMiddleware")
    spacing_properties: tuple[str, ...] = ("gap", "p", "px", "py", "pt", "pr", "pb", "pl", "m", "mx", "my", "mt", "mr", "mb", "ml")
    spacing_keys: tuple[str, ...] = ("padding", "paddingTop", "paddingRight", "paddingBottom", "paddingLeft", "paddingInline", "paddingBlock", "margin", "marginTop", "marginRight", "marginBottom", "marginLeft", "marginInline", "marginBlock", "gap", "rowGap", "columnGap")
    radius_properties: tuple[str, ...] = ("radius",)
    radius_keys: tuple[str, ...] = ("borderRadius", "borderTopLeftRadius", "borderTopRightRadius", "borderBottomLeftRadius", "borderBottomRightRadius")

    def __post_init__(self):
        if self.lines_warning >= self.lines_error or min(self.pairs, self.files_on_pair, self.targets, self.trace_depth) < 0:
            raise ValueError("limits must not be negative, and the warning must come before the error")


@dataclass
class Facts:
    """The base tables of one run; derived ones are built when a check asks."""

    sources: DataFrame  # source_files() of the tree
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    limits: Limits = field(default_factory=Limits)
    files: DataFrame | None = None  # (file, text) of everything else: stylesheets, documents, grants
    visibility: DataFrame | None = None  # (file, feature, body)
    budgets: DataFrame | None = None  # (path, ceiling string as written)
    theme: DataFrame | None = None  # (name, value) of the spacing scale
    radii: DataFrame | None = None  # (name, value) of the radius scale

    @cached_property
    def live(self) -> DataFrame:
        return self.sources.where("not is_exempt")

    @cached_property
    def imports(self) -> DataFrame:
        return tokens.scan_imports(self.live.select("file", "text"))

    @cached_property
    def exports(self) -> DataFrame:
        """Scanned once per run and kept in the shared folder, as are the resolved imports."""
        return graph.cut(tokens.scan_exports(self.live.select("file", "text")))

    @cached_property
    def edges(self) -> DataFrame:
        """Resolved imports that stay in the tree, with both ends' feature, domain and layer."""
        v = self.vocabulary
        e = self.resolved.where("target_path is not null")
        name = lambda p, top: F.when((paths.segment(p, 1) == top) & (paths.depth(p) > 1), paths.segment(paths.stem(p), 2))
        s, t = F.col("source_path"), F.col("target_path")
        return e.withColumns({"from_feature": name(s, v.features), "to_feature": name(t, v.features), "from_domain": name(s, v.domains), "to_domain": name(t, v.domains), "from_layer": paths.layer(s, v), "to_layer": paths.layer(t, v)})

    @cached_property
    def resolved(self) -> DataFrame:
        return graph.cut(tree.import_edges(self.live, self.imports, self.vocabulary))


Check = Callable[[Facts], DataFrame]
CHECKS: dict[str, Check] = {}


def check(name: str) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        CHECKS[name] = f
        return f

    return add


def finding(rows: DataFrame, message: Column, severity: str | Column = "error", file: str = "file", line: Column | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(level.alias("severity"), F.col(file).alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"), message.alias("message"))


def said(template: str, **values: Column | str) -> Column:
    return text.rendered(template, {k: F.col(v) if isinstance(v, str) else v for k, v in values.items()})


@check("health/file-size")
def file_size(f: Facts) -> DataFrame:
    rows = f.sources.withColumn("n", text.line_count(F.col("text"))).where(F.col("n") > f.limits.lines_warning)
    return finding(rows, said("{{n}} lines; split the file", n="n"), F.when(F.col("n") > f.limits.lines_error, "error").otherwise("warning"))


@check("health/doc-budgets")
def doc_budgets(f: Facts) -> DataFrame:
    """Ceilings of f.budgets (path, ceiling as written, and manifest if there are several): what can't be read is filed at the manifest."""
    budgets = f.budgets if "manifest" in f.budgets.columns else f.budgets.withColumn("manifest", F.lit(None).cast("string"))
    rows = budgets.join(f.files.select(F.col("file").alias("path"), text.word_count(F.col("text")).alias("words")), "path", "left").withColumn("limit", F.when(F.col("ceiling").rlike("^[0-9]+$"), F.col("ceiling").try_cast("long")))
    status = (
        F.when(F.col("path").isNull(), "the manifest isn't an object of ceilings").when(F.col("limit").isNull() | (F.col("limit") <= 0), said("the ceiling of {{p}} isn't a positive whole number", p="path")).when(F.col("words").isNull(), "the document is missing")
        .when(F.col("words") > F.col("limit"), said("{{w}} words, above the ceiling of {{c}}", w="words", c="limit")).when(F.col("limit") > text.ratchet(F.col("words"), f.limits.budget_slack), said("the ceiling of {{c}} is loose for {{w}} words", w="words", c="limit"))
    )
    at = F.when(F.col("limit").isNull() | (F.col("limit") <= 0), F.coalesce("manifest", "path")).otherwise(F.col("path"))
    return finding(rows.withColumn("status", status).withColumn("at", at).where("status is not null"), F.col("status"), file="at")


@check("placement/topology")
def topology(f: Facts) -> DataFrame:
    v, p = f.vocabulary, F.col("source_path")
    bare = paths.stem(p)
    top, n = paths.segment(p, 1), paths.depth(p)
    in_features = top == v.features
    problem = (
        F.when(n == 1, F.when(~bare.isin(*v.root_modules), "a file at the source root that is no declared position"))
        .when(~top.isin(*v.areas), said("{{t}}/ is not a layer of the tree", t=top))
        .when(~top.isin(v.features, v.domains), None)
        .when(n == 2, said("a file directly in {{t}}/ belongs to no boundary", t=top))
        .when(in_features & (n == 3) & ~paths.segment(bare, 3).isin(v.client_barrel, v.server_barrel, *v.feature_root_files), "a file at a feature's root is outside every layer")
        .when(in_features & (n > 3) & ~paths.segment(p, 3).isin(*[d for _, d in v.layers]), said("{{t}}/ is not a layer of a feature", t=paths.segment(p, 3)))
    )
    return finding(f.live.withColumn("problem", problem).where("problem is not null"), F.col("problem"))


@check("boundary/import-policy")
def import_policy(f: Facts) -> DataFrame:
    """Relative imports: denied by the matrix, or a legal crossing that should be spelled by the alias; an unclassified file once."""
    judged = policy.verdicts(f.edges.where("relative").withColumn("package", F.lit(None).cast("string")), f.vocabulary)
    lost = judged.where("verdict = 'unclassified-source'").select("file").distinct()
    denied = judged.where(~F.col("verdict").isin("internal", "unclassified-source"))
    message = F.when(F.col("verdict") == "allowed", said("spell this import {{a}}{{p}}", a=F.lit(f.vocabulary.alias), p=paths.stem(F.col("target_path")))).otherwise(said("{{v}}: {{p}} imports {{s}}", v="verdict", p="profile", s="specifier"))
    return finding(lost, F.lit("this file is in no area that the import policy knows")).unionByName(finding(denied, message, line=F.col("line")))


def _rank(layer: str) -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), F.col(layer))


@check("placement/layer-direction")
def layer_direction(f: Facts) -> DataFrame:
    v = f.vocabulary
    inside = f.edges.where("from_feature = to_feature and from_layer is not null")
    upward = inside.where("to_layer is not null").where(_rank("to_layer") < _rank("from_layer"))
    barrel = inside.where(paths.is_barrel(F.col("target_path"), v))
    return finding(upward, said("{{a}} imports {{b}}, which stands above it", a="from_layer", b="to_layer"), line=F.col("line")).unionByName(finding(barrel, F.lit("a feature reaches its own barrel from inside"), line=F.col("line")))


@check("boundary/layer-occupancy")
def layer_occupancy(f: Facts) -> DataFrame:
    v = f.vocabulary
    own = ["tree_root", "from_feature"]
    held = f.live.select("tree_root", paths.segment(F.col("source_path"), 2).alias("from_feature"), paths.layer(F.col("source_path"), v).alias("l")).where("l is not null").groupBy(*own).agg(F.collect_set("l").alias("occupied"))  # at most four
    between = F.slice(F.array(*map(F.lit, LAYERS)), (_rank("from_layer") + 1).cast("int"), F.greatest(_rank("to_layer") - _rank("from_layer") - 1, F.lit(0)).cast("int"))
    down = f.edges.where("from_feature = to_feature and from_layer is not null and to_layer is not null").where(_rank("to_layer") > _rank("from_layer") + 1).join(held, own).withColumn("skipped", F.array_intersect(between, "occupied")).where(F.size("skipped") > 0)
    schema = f.edges.where("from_layer is not null and from_layer <> 'repo'").where(paths.under(paths.stem(F.col("target_path")), f"{v.infrastructure}/{v.db}/{v.db_schema}")).join(held, own).where(F.array_contains("occupied", "repo"))
    return finding(down, said("{{a}} skips {{s}} on the way to {{b}}", a="from_layer", b="to_layer", s=F.array_join("skipped", ", ")), line=F.col("line")).unionByName(finding(schema, said("{{a}} reaches the database schema past the feature's repo", a="from_layer"), line=F.col("line")))


def _rings(f: Facts, kind: str, folder: str) -> DataFrame:
    """One graph per tree: a node is a tree and a name in it."""
    e = f.edges.where(f"from_{kind} is not null and to_{kind} is not null and from_{kind} <> to_{kind}")
    pairs = first_per(e, ["tree_root", f"from_{kind}", f"to_{kind}"], ["file", "offset"])
    node = lambda n: F.struct("tree_root", F.col(f"{n}_{kind}").alias("name"))
    ring = graph.cycles(pairs.select(node("from").alias("a"), node("to").alias("b")))
    mark = lambda n: ring.select(F.col("node.tree_root"), F.col("node.name").alias(f"{n}_{kind}"), F.col("component.name").alias(f"{n}_component"))
    trail = pairs.join(mark("from"), ["tree_root", f"from_{kind}"]).join(mark("to"), ["tree_root", f"to_{kind}"]).where("from_component = to_component")
    step = collate.ordered(F.concat_ws(" -> ", f"from_{kind}", f"to_{kind}"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(step)), collate.plain), "; ")
    rows = trail.groupBy("tree_root", "from_component").agg(lines.alias("trail"))
    rows = rows.withColumn("file", F.concat_ws("/", "tree_root", F.lit(folder), "from_component"))
    return finding(rows, said("these import each other in a ring: {{t}}", t="trail"))


@check("graph/domain-cycles")
def domain_cycles(f: Facts) -> DataFrame:
    return _rings(f, "domain", f.vocabulary.domains)


@check("graph/feature-deps")
def feature_deps(f: Facts) -> DataFrame:
    e = f.edges.where("from_feature is not null and to_feature is not null and from_feature <> to_feature")
    folder = lambda name: F.concat_ws("/", "tree_root", F.lit(f.vocabulary.features), name)
    wide = e.groupBy("tree_root", "from_feature", "to_feature").agg(F.count_distinct("file").alias("n")).where(F.col("n") > f.limits.files_on_pair).withColumn("file", folder("from_feature"))
    many = e.groupBy("tree_root", "from_feature").agg(F.count_distinct("to_feature").alias("n")).where(F.col("n") > f.limits.targets).withColumn("file", folder("from_feature"))
    total = e.select("tree_root", "from_feature", "to_feature").distinct().groupBy("tree_root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > f.limits.pairs).withColumn("file", F.concat_ws("/", "tree_root", F.lit(f.vocabulary.features)))
    out = _rings(f, "feature", f.vocabulary.features)
    out = out.unionByName(finding(wide, said("{{n}} files import {{t}}", n="n", t="to_feature"), "warning")).unionByName(finding(many, said("imports {{n}} other features", n="n"), "warning"))
    return out.unionByName(finding(total, said("{{n}} pairs of features depend on each other", n="n"), "warning"))


@check("api/feature-visibility")
def feature_visibility(f: Facts) -> DataFrame:
    pairs = f.edges.where("from_feature is not null and to_feature is not null and from_feature <> to_feature").select("tree_root", F.col("from_feature").alias("importer"), F.col("to_feature").alias("feature")).distinct()
    roots = f.sources.select("tree_root").distinct()
    inside = F.col("file").startswith(F.concat("tree_root", F.lit(f"/{f.vocabulary.features}/")))  # a file of the longest root that holds it
    state = f.visibility.select("file", "feature", jsons.grant_state(F.col("body")).alias("state"), jsons.grants(F.col("body")).alias("grants")).join(F.broadcast(roots), inside)
    granted = state.where("state = 'grants'").select("file", "tree_root", "feature", F.explode("grants").alias("importer", "reason"))
    place = F.concat_ws("/", "tree_root", F.lit(f.vocabulary.features), "feature", F.lit("visibility.json"))
    bare = pairs.join(granted, ["tree_root", "feature", "importer"], "left_anti").groupBy("tree_root", "feature").agg(F.array_join(F.array_sort(F.collect_set("importer")), ", ").alias("importers")).withColumn("file", place)
    stale = granted.join(pairs, ["tree_root", "feature", "importer"], "left_anti")
    out = finding(bare, said("imported without a grant by {{i}}", i="importers")).unionByName(finding(state.where("state = 'malformed'"), F.lit("the visibility file isn't an object of reasons")))
    return out.unionByName(finding(stale, said("{{i}} has a grant but imports nothing", i="importer"), "warning"))


def boundary_modules(f: Facts) -> DataFrame:
    """(file) of modules that cross the server boundary: they import one of its calls from its module at run time, under any name,
    and call that name; a name that the module declares again is no such call."""
    module = re.escape(f.limits.boundary_module)
    importing = f.resolved.where(~F.col("type_only") & (F.col("specifier") == f.limits.boundary_module)).select("file").distinct()
    texts = f.live.select("file", "text").join(importing, "file", "left_semi")
    clauses = F.regexp_extract_all("text", F.lit(f"import\\s[^;'\"]*?\\{{([^}}]*)\\}}\\s*from\\s*[\"']{module}[\"']"), F.lit(1))
    entry = texts.select("file", F.explode(clauses).alias("c")).select("file", F.explode(F.split("c", ",")).alias("entry"))
    named = f"^\\s*(?:{'|'.join(f.limits.boundary_calls)})(?:\\s+as\\s+([\\w$]+))?\\s*$"
    names = entry.where(F.col("entry").rlike(named)).select("file", F.coalesce(F.nullif(F.regexp_extract("entry", named, 1), F.lit("")), F.trim("entry")).alias("name"))
    code = tokens.code(tokens.tokens(texts)).where("kind = 'name'")
    called = code.where("n1 = '('").select("file", F.col("token").alias("name")).distinct()
    again = code.where(F.col("token").isin("const", "let", "var", "function", "class")).select("file", F.col("n1").alias("name")).distinct()
    return names.join(called, ["file", "name"], "left_semi").join(again, ["file", "name"], "left_anti").select("file").distinct()


@check("api/barrel-purity")
def barrel_purity(f: Facts) -> DataFrame:
    """Client barrels that reach server code by run-time imports, walked depth first with one visited set a barrel.

    Barrels of features aren't walked beyond modules that cross the server boundary, unless the barrel itself is one. A chain that
    is cut at the depth limit is a finding of its own: what lies below isn't known.
    """
    v = f.vocabulary
    run = f.resolved.where("not type_only")
    steps = run.where("target_path is not null").select(F.col("file").alias("a"), F.concat_ws("/", "tree_root", "target_path").alias("b"), F.col("offset").alias("place"))
    barrels = f.live.where((paths.depth(F.col("source_path")) == 3) & (paths.segment(paths.stem(F.col("source_path")), 3) == v.client_barrel))
    at = paths.segment(F.col("source_path"), 1)
    crossing = graph.cut(boundary_modules(f))
    server = run.where(F.col("specifier").startswith("node:") | F.col("package").isin(*f.limits.server_packages)).select(F.col("file").alias("module"), "specifier").distinct()
    out = None
    for folder in (v.features, v.domains):
        starts = barrels.where(at == folder).select("file")
        edges, stops = steps, crossing.limit(0)
        if folder == v.features:  # a barrel that crosses the boundary starts under a name of its own, so that others still stop at it
            own = steps.join(crossing.join(starts, "file", "left_semi").withColumnRenamed("file", "a"), "a", "left_semi").withColumn("a", F.concat(F.lit("^"), "a"))
            edges = steps.join(crossing.withColumnRenamed("file", "a"), "a", "left_anti").unionByName(own)
            stops = crossing
            starts = starts.join(crossing.select("file", F.lit("^").alias("mark")), "file", "left").select(F.concat(F.coalesce("mark", F.lit("")), "file").alias("file"))
        met = trace.depth_first(edges, starts.withColumnRenamed("file", "node"), f.limits.trace_depth).join(stops.withColumnRenamed("file", "node"), "node", "left_anti")
        met = met.withColumns({"file": F.regexp_replace("start", "^\\^", ""), "module": F.regexp_replace("node", "^\\^", ""), "way": F.regexp_replace(F.array_join("chain", " > "), "^\\^", "")})
        dirty = finding(met.join(server, "module"), said("reaches {{s}} through {{n}}: {{c}}", s="specifier", n="module", c="way"))
        deep = finding(met.where("truncated"), said("imports run deeper than {{d}}: {{c}}", d=F.lit(f.limits.trace_depth), c="way"))
        found = dirty.unionByName(deep)
        out = found if out is None else out.unionByName(found)
    return out


@check("naming/barrel-discoverability")
def barrel_discoverability(f: Facts) -> DataFrame:
    e = f.exports.join(f.live.select("file", "source_path"), "file").where(paths.is_barrel(F.col("source_path"), f.vocabulary))
    star = e.where("kind = 'wildcard'")
    renamed = e.where("kind = 'named' and exported_name <> local_name")
    return finding(star, F.lit("export * hides the names of a barrel"), line=F.col("line")).unionByName(finding(renamed, said("{{e}} is {{l}} elsewhere", e="exported_name", l="local_name"), line=F.col("line")))


@check("naming/test-file-mirror")
def test_file_mirror(f: Facts) -> DataFrame:
    tests = f.sources.where("is_test").where(paths.stem(F.col("source_path")).endswith(".test")).withColumn("module", F.regexp_replace(paths.stem(F.col("source_path")), "\\.test$", ""))
    modules = f.sources.where("not is_test").select(paths.stem(F.col("source_path")).alias("module"), "tree_root")
    alone = tests.join(modules, ["tree_root", "module"], "left_anti").withColumn("module", F.regexp_replace("module", "\\.[^./]*$", "")).join(modules, ["tree_root", "module"], "left_anti")
    odd = f.sources.where(paths.stem(F.col("source_path")).endswith(".spec") | F.col("source_path").rlike("(?:^|/)test_[^/]*$"))
    return finding(alone, F.lit("no module beside this test has its name"), "warning").unionByName(finding(odd, F.lit("spell test files name.test"), "warning"))


COLOR = "#[0-9a-fA-F]{3,8}\\b|\\b(?:rgb|rgba|hsl|hsla|oklch|oklab|lab|lch|color)\\("


@check("style/css-tokens")
def css_tokens(f: Facts) -> DataFrame:
    """Declarations, whatever lines they run over, with a raw color or font size."""
    sheets = f.files.where(F.col("file").endswith(".css") & ~F.col("file").endswith("/" + f.vocabulary.token_stylesheet))
    blank = F.regexp_replace("text", "/\\*[\\s\\S]*?\\*/", "")
    parts = sheets.select("file", F.explode(F.regexp_extract_all(blank, F.lit("([^;{}]*)([;}])"), F.lit(1))).alias("d")).withColumn("d", F.trim(F.regexp_replace("d", "\\s+", " "))).where(~F.col("d").startswith("--") & F.col("d").contains(":"))
    size = F.col("d").rlike("^font-size\\s*:\\s*[0-9.]+(?:px|rem|pt)\\b")
    bad = parts.where(size | F.col("d").rlike(COLOR))
    return finding(bad, said("{{k}} instead of a token: {{d}}", k=F.when(size, "a raw font size").otherwise("a raw color"), d="d"))


@check("style/shadow-source")
def shadow_source(f: Facts) -> DataFrame:
    css = f.files.where(F.col("file").endswith(".css") & ~F.col("file").rlike("(?:^|/)shadows\\.css$")).select("file", "text", F.lit("(?<![\\w-])box-shadow(?![\\w-])").alias("what"))
    script = f.live.select("file", "text", F.lit("\\bboxShadow\\b").alias("what"))
    lines = css.unionByName(script).select("file", "what", F.posexplode(F.split("text", "\n")).alias("line", "body")).where(F.expr("regexp_like(body, what)"))
    return finding(lines, F.lit("shadows come from the shadow sheet"), line=F.col("line") + 1)


@check("style/token-equality")
def token_equality(f: Facts) -> DataFrame:
    """Spacing and radius, each as a property ({16}, "16" or "16px") and as a key of a style object, that equal a token of their scale."""
    v, limits = f.vocabulary, f.limits
    pixels = F.coalesce(text.pixels(F.col("value")), F.round(F.regexp_extract("value", "^\\s*([0-9]*\\.?[0-9]+)\\s*$", 1).try_cast("double")).cast("int"))
    scale = lambda t: t.select("name", pixels.alias("px")).where("px > 0").groupBy("px").agg(F.min("name").alias("name"))
    styled = f.live.where(F.coalesce(paths.profile(F.col("source_path"), v) != "domain", F.lit(True)) & (paths.stem(F.col("source_path")) != f"{v.shared}/{v.shared_ui}/{v.theme_module}"))
    # Comments go, but their line breaks stay.
    comment = "/\\*[\\s\\S]*?\\*/|//[^\n]*"
    parts = F.arrays_zip(F.split("text", comment).alias("kept"), F.regexp_extract_all("text", F.lit(comment), F.lit(0)).alias("gone"))
    blank = F.array_join(F.transform(parts, lambda p: F.concat(p["kept"], F.coalesce(F.regexp_replace(p["gone"], "[^\n]", " "), F.lit("")))), "")
    lines = styled.select("file", F.posexplode(F.split(blank, "\n")).alias("place", "body"))
    out = None
    for kind, table, properties, keys in (("spacing", f.theme, limits.spacing_properties, limits.spacing_keys), ("radius", f.radii, limits.radius_properties, limits.radius_keys)):
        if table is None:
            continue
        for pattern in (f"\\b(?:{'|'.join(properties)})=(?:\\{{\\d+\\}}|\"\\d+(?:px)?\")", f"\\b(?:{'|'.join(keys)})\\s*:\\s*\\d+\\b"):
            found = lines.select("file", "place", F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("said")).withColumn("px", F.regexp_extract("said", "\\d+", 0).try_cast("int"))
            one = finding(found.join(scale(table), "px"), said("{{s}} is the " + kind + " token {{n}}", s="said", n="name"), line=F.col("place") + 1)
            out = one if out is None else out.unionByName(one)
    return f.live.sparkSession.createDataFrame([], FINDING) if out is None else out


#: Words that bind or branch.
BRANCHING = ("const", "let", "var", "if", "for", "while", "switch", "try", "throw", "catch")


@check("health/trampolines")
def trampolines(f: Facts) -> DataFrame:
    """Exported functions of the target layers, and methods of their exported object literals, whose bodies neither bind nor
    branch; spans come from the depth of brackets."""
    v = f.vocabulary
    layers = f.live.where(paths.layer(F.col("source_path"), v).isin(*f.limits.trampoline_layers)).select("file", "text")
    c = tokens.code(tokens.tokens(layers))
    level = F.when(F.col("token") == "{", F.col("depth")).otherwise(F.col("depth") - 1)
    pair = Window.partitionBy("file", "level").orderBy("start")  # at one level opening and closing braces take turns
    braces = c.where((F.col("kind") == "mark") & F.col("token").isin("{", "}")).withColumn("level", level)
    braces = braces.withColumns({"to": F.lead("start").over(pair), "after": F.lead("n1").over(pair)}).where("token = '{' and to is not null").select("file", "level", F.col("start").alias("from"), "to", "after")

    n1, n2, n3 = F.col("n1"), F.col("n2"), F.col("n3")
    exports = c.where((F.col("token") == "export") & (F.col("depth") == 0))
    name = (
        F.when(n1 == "function", n2).when((n1 == "async") & (n2 == "function"), n3)
        .when((n1 == "default") & (n2 == "function"), n3).when((n1 == "default") & (n2 == "async") & (n3 == "function"), F.col("n4"))
    )
    heads = exports.withColumn("name", name).where(F.col("name").rlike(r"^[\p{L}_$]")).select("file", F.col("start").alias("at"), "name", F.lit(0).alias("level"))
    assigned = exports.where(n1 == "const").select("file", F.col("start").alias("export")).join(c.where("token = '=' and depth = 0").select("file", "start", "n1"), "file").where("start > export").groupBy("file", "export").agg(F.min(F.struct("start", "n1")).alias("equals")).where("equals.n1 = '{'")
    objects = assigned.join(braces.where("level = 0"), "file").where(F.col("from") > F.col("equals.start")).groupBy("file", "export").agg(F.min(F.struct("from", "to")).alias("object"))
    first = F.col("p1").isin("{", ",") & (F.col("kind") == "name") & (F.col("depth") == 1)
    method = F.when(first & (n1 == "("), F.col("token")).when(first & (F.col("token") == "async") & (F.col("k1") == "name") & (n2 == "("), n1)
    methods = c.withColumn("name", method).where("name is not null").join(objects, "file").where("start > object.from and start < object.to").select("file", F.col("start").alias("at"), "name", F.lit(1).alias("level"))
    heads = heads.unionByName(methods)

    marks = heads.join(c.where(F.col("token").isin(";", ":")).select("file", F.col("depth").alias("level"), "token", "start"), ["file", "level"]).where("start > at")
    marks = marks.groupBy("file", "at").agg(F.min(F.when(F.col("token") == ";", F.col("start"))).alias("stop"), F.min(F.when(F.col("token") == ":", F.col("start"))).alias("colon"))
    opens = heads.join(braces, ["file", "level"]).where(F.col("from") > F.col("at")).join(marks, ["file", "at"], "left").where(F.col("stop").isNull() | (F.col("from") < F.col("stop")))
    in_type = F.coalesce((F.col("colon") < F.col("from")) & F.col("after").isin("{", "|", "&", ">", "["), F.lit(False))
    spans = opens.where(~in_type).groupBy("file", "at", "name").agg(F.min(F.struct("from", "to")).alias("body")).select("file", "at", "name", "body.from", "body.to")
    busy = spans.join(c.where((F.col("kind") == "name") & F.col("token").isin(*BRANCHING)).select("file", "start"), "file").where("start > from and start < to").select("file", "at")
    idle = spans.join(busy, ["file", "at"], "left_anti").join(c.select("file", F.col("start").alias("at"), "line"), ["file", "at"])
    return finding(idle, said("{{n}} only passes its call on", n="name"), "warning", line=F.col("line"))
