"""The vocabulary of a governed tree, and Column functions that classify paths by it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: extensions of source files.
SOURCE_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
#: Fixed value: the order of a feature's layers, from the top.
LAYERS = ("ui", "controllers", "service", "repo")


@dataclass(frozen=True)
class Vocabulary:
    """Names that a tree uses. The defaults are the recommended names, and the extensions of assets."""

    alias: str = "@/"
    routes: str = "routes"
    features: str = "features"
    domains: str = "domains"
    infrastructure: str = "infrastructure"
    shared: str = "shared"
    shared_ui: str = "ui"
    layers: tuple[tuple[str, str], ...] = tuple((x, x) for x in LAYERS)  # (role, directory), from the top
    feature_root_files: tuple[str, ...] = ("errors",)
    client_barrel: str = "index"
    server_barrel: str = "index.server"
    server_suffix: str = ".server"
    env_modules: tuple[tuple[str, str], ...] = (("env.server", "env-server"), ("env.client", "env-client"), ("env", "env-server"))
    generated: str = "gen"
    root_files: tuple[str, ...] = ("router", "client", "server", "routeTree.gen")
    token_stylesheet: str = "styles.css"
    asset_extensions: tuple[str, ...] = ("css", "scss", "svg", "png", "jpg", "jpeg", "gif", "webp", "avif", "woff", "woff2", "ttf", "otf")
    db: str = "db"
    db_schema: str = "schema"
    theme_module: str = "theme"
    root_route: str = "__root"

    def __post_init__(self):
        names = [self.routes, self.features, self.domains, self.infrastructure, self.shared]
        if len(set(names)) < len(names) or len({d for _, d in self.layers}) < len(self.layers):
            raise ValueError("a vocabulary's directories must differ from each other")
        for name in (*names, self.shared_ui, *(d for _, d in self.layers), self.generated, self.db, self.db_schema):
            if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", name):
                raise ValueError(f"{name!r} isn't one safe path segment")
        if not self.alias:
            raise ValueError("the alias prefix is empty")
        if tuple(r for r, _ in self.layers) != LAYERS:
            raise ValueError(f"layers must give a directory to each of {LAYERS}")

    @property
    def areas(self) -> tuple[str, ...]:
        return self.routes, self.features, self.domains, self.infrastructure, self.shared

    @property
    def root_modules(self) -> tuple[str, ...]:
        return (*self.root_files, *(name for name, _ in self.env_modules))


@dataclass(frozen=True)
class Tree:
    """A governed source root."""

    root: str
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    tsconfig: str = "tsconfig.json"

    def __post_init__(self):
        if not self.root or any(c in self.root for c in "*?[]{}") or self.root.startswith("/") or ".." in self.root.split("/"):
            raise ValueError(f"{self.root!r} must be a plain relative folder")


def stem(path: Column) -> Column:
    """The path without its source extension."""
    return F.regexp_replace(path, "\\.(?:[cm]?[jt]s|[jt]sx)$", "")


def under(path: Column, prefix: str | Column) -> Column:
    """The path is the prefix or below it, by whole segments."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def segment(path: Column, number: int) -> Column:
    """A segment, from 1; null beyond the last."""
    return F.try_element_at(F.split(path, "/"), F.lit(number))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def has_dots(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def is_test(path: Column) -> Column:
    """A .test file, the source root's folder test, or any folder __tests__."""
    return path.rlike("\\.test\\.(?:[cm]?[jt]s|[jt]sx)$") | path.rlike("^test/") | path.rlike("(?:^|/)__tests__/")


def is_unauthored(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    """Written by tools, or outside the product: .gen and .d files, folders scripts, the generated folder."""
    return stem(path).rlike("\\.(?:gen|d)$") | path.rlike("(?:^|/)scripts/") | path.rlike(f"(?:^|/){re.escape(v.generated)}/")


def is_exempt(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    return is_test(path) | is_unauthored(path, v)


def is_component(path: Column) -> Column:
    return path.rlike("\\.[jt]sx$")


def names_test(specifier: Column) -> Column:
    return stem(specifier).endswith(".test") | specifier.rlike("(?:^|/)__tests__/")


def is_asset(specifier: Column, v: Vocabulary = Vocabulary()) -> Column:
    return F.regexp_replace(specifier, "\\?.*$", "").rlike("\\.(?:" + "|".join(map(re.escape, v.asset_extensions)) + ")$")


def package_of(specifier: Column) -> Column:
    """The package that a bare specifier names: two segments if it is scoped."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def normalized(path: Column) -> Column:
    """The path without . and .. segments; null if it leaves the root."""
    step = lambda acc, s: (
        F.when(acc.isNull() | s.isin("", "."), acc).when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.lit(None).cast("array<string>"))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _layer_of(directory: Column, v: Vocabulary) -> Column:
    out = F.lit(None).cast("string")
    for role, name in v.layers:
        out = F.when(directory == name, F.lit(role)).otherwise(out)
    return out


def layer(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    """The layer role of a file inside a feature's layer, else null."""
    return F.when((segment(path, 1) == v.features) & (depth(path) > 3), _layer_of(segment(path, 3), v))


def profile(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    """What kind of source a file is to the import policy; null where no kind fits."""
    bare = stem(path)
    top, n = segment(bare, 1), depth(bare)
    return (
        F.when(has_dots(path), None)
        .when(n == 1, "source-root")
        .when(top == v.routes, "route")
        .when((top == v.features) & (n == 3), F.when(segment(bare, 3).isin(v.client_barrel, v.server_barrel), "feature-barrel").otherwise("feature-root"))
        .when((top == v.features) & (n > 3), F.concat(F.lit("feature-"), _layer_of(segment(bare, 3), v)))
        .when(top == v.features, None)
        .when(top == v.domains, "domain")
        .when(top == v.infrastructure, "infrastructure")
        .when((top == v.shared) & under(bare, f"{v.shared}/{v.shared_ui}"), "shared-ui")
        .when(top == v.shared, "shared")
    )


def area(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    """Where an import's target lies; null where no area fits."""
    bare = stem(path)
    top, n = segment(bare, 1), depth(bare)
    env = F.lit(None).cast("string")
    for name, kind in v.env_modules:
        env = F.when(bare == name, F.lit(kind)).otherwise(env)
    alone = F.coalesce(env, F.when(top == v.routes, "route").when(top == v.infrastructure, "infrastructure").when(top == v.shared, "shared").when(bare.isin(*v.root_files), "source-root"))
    return (
        F.when(has_dots(path), None)
        .when(n == 1, alone)
        .when(top == v.routes, "route")
        .when(top == v.features, "feature")
        .when(top == v.domains, "domain")
        .when(top == v.infrastructure, "infrastructure")
        .when((top == v.shared) & under(bare, f"{v.shared}/{v.shared_ui}"), "shared-ui")
        .when(top == v.shared, "shared")
    )


def unit(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    """The boundary that a file or target belongs to: imports inside one are its own affair."""
    bare = stem(path)
    top, n = segment(bare, 1), depth(bare)
    return (
        F.when(top.isin(v.features, v.domains) & (n > 1), F.concat_ws("/", top, segment(bare, 2)))
        .when((top == v.shared) & under(bare, f"{v.shared}/{v.shared_ui}"), f"{v.shared}/{v.shared_ui}")
        .when(top.isin(v.routes, v.infrastructure, v.shared), top)
        .when(n == 1, "<root>")
    )


def is_barrel(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    """A client or server barrel of a feature or domain."""
    bare = stem(path)
    return segment(bare, 1).isin(v.features, v.domains) & (depth(bare) == 3) & segment(bare, 3).isin(v.client_barrel, v.server_barrel)


def is_server_context(path: Column, v: Vocabulary = Vocabulary()) -> Column:
    return stem(path).endswith(v.server_suffix) | F.coalesce(profile(path, v).isin("infrastructure", "feature-controllers", "feature-repo", "feature-service"), F.lit(False))
