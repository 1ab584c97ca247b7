"""Tokens, imports and exports of script files: a lexer cuts each text into tokens with their places and lines, windows over each
file's tokens find the statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from . import lexer


def tokens(files: DataFrame) -> DataFrame:
    """(file, start, line, kind, token) of files (file, text), by the grammar that a file's ending says; for kinds see lexer.lex."""
    jsx = F.col("file").rlike(f"[.](?:{'|'.join(lexer.JSX_ENDINGS)})$")
    return scan.each_text(files, ["file"], "text", lexer.lex, "start int, line int, kind string, token string", [jsx])


def code(all_tokens: DataFrame) -> DataFrame:
    """Tokens without space and comments, with their neighbours (p1; n1 to n4), their kinds, and the depth of brackets before them."""
    w = Window.partitionBy("file").orderBy("start")
    step = F.when(F.col("token").isin("{", "(", "["), 1).when(F.col("token").isin("}", ")", "]"), -1).otherwise(0)
    out = all_tokens.where(~F.col("kind").isin("space", "comment")).withColumns({"p1": F.lag("token").over(w), "depth": F.coalesce(F.sum(F.when(F.col("kind") == "mark", step).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    for n in range(1, 5):
        out = out.withColumns({f"n{n}": F.lead("token", n).over(w), f"k{n}": F.lead("kind", n).over(w)})
    return out


def _literal(token: str, kind: str) -> Column:
    """A string or a template without parts, unquoted; null for others."""
    t = F.col(token)
    plain = (F.col(kind) == "string") | ((F.col(kind) == "template") & ~t.contains("${"))
    return F.when(plain & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2))


def scan_imports(files: DataFrame) -> DataFrame:
    """(file, specifier, offset, line, type_only), a row for each occurrence: imports, re-exports, import(), require and require.resolve.

    A re-export or import is type-only with the keyword type, or if all its names in braces carry it and it has no other name.
    import() counts as type-only after typeof. Computed specifiers have no row.
    """
    c = code(tokens(files))
    w = Window.partitionBy("file").orderBy("start")
    opens = F.col("token").isin("import", "export") & F.coalesce(F.col("p1") != ".", F.lit(True)) & ~F.col("n1").isin("(", ".")
    statement = F.last(F.when(opens, F.struct("start", "line", "token", "n1", "n2", "k3")), ignorenulls=True).over(w)
    c = c.withColumn("statement", statement)
    entry = F.col("p1").isin("{", ",") & (F.col("kind") == "name")
    typed = entry & (F.col("token") == "type") & (F.col("k1") == "name") & (F.col("n1") != "as")
    part = Window.partitionBy("file", "statement.start").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumns({"entries": F.count_if(entry & (F.col("depth") > 0)).over(part), "typed": F.count_if(typed).over(part), "others": F.count_if((F.col("token") == "*") | (F.col("start") != F.col("statement.start")) & (F.col("p1") == F.col("statement.token")) & (F.col("kind") == "name") & (F.col("token") != "type")).over(part)})
    word = (F.col("statement.n1") == "type") & ~((F.col("statement.n2") == "from") & (F.col("statement.k3") == "string"))
    static_type = word | ((F.col("entries") > 0) & (F.col("entries") == F.col("typed")) & (F.col("others") == 0))
    free = F.coalesce(F.col("p1") != ".", F.lit(True))
    token, n1, n2, n3 = (F.col(x) for x in ("token", "n1", "n2", "n3"))
    hit = (
        F.when((token == "import") & free & (F.col("k1") == "string"), F.struct(_literal("n1", "k1").alias("s"), F.lit(False).alias("t")))
        .when((token == "from") & (F.col("k1") == "string") & (F.col("p1").isin("}", "*") | F.col("p1").rlike(r"^[\p{L}_$]")) & F.col("statement").isNotNull(), F.struct(_literal("n1", "k1").alias("s"), static_type.alias("t")))
        .when((token == "import") & free & (n1 == "(") & n3.isin(")", ","), F.struct(_literal("n2", "k2").alias("s"), F.coalesce(F.col("p1") == "typeof", F.lit(False)).alias("t")))
        .when((token == "require") & free & (n1 == "(") & n3.isin(")", ","), F.struct(_literal("n2", "k2").alias("s"), F.lit(False).alias("t")))
        .when((token == "require") & free & (n1 == ".") & (n2 == "resolve") & (n3 == "("), F.struct(_literal("n4", "k4").alias("s"), F.lit(False).alias("t")))
    )
    begun = lambda name: F.when(F.col("token") == "from", F.col(f"statement.{name}")).otherwise(F.col(name))
    return c.withColumn("hit", hit).where("hit.s is not null").select("file", F.col("hit.s").alias("specifier"), begun("start").alias("offset"), begun("line").alias("line"), F.coalesce("hit.t", F.lit(False)).alias("type_only"))


DECLARING = ("const", "let", "var", "function", "class", "type", "interface", "enum", "namespace")


def scan_exports(files: DataFrame) -> DataFrame:
    """(file, offset, line, kind, exported_name, local_name, namespace, specifier, type_only), a row for each name; kinds wildcard, named, default."""
    c = code(tokens(files))
    w = Window.partitionBy("file").orderBy("start")
    opens = (F.col("token") == "export") & F.coalesce(F.col("p1") != ".", F.lit(True)) & (F.col("depth") == 0)
    c = c.withColumn("at", F.last(F.when(opens, F.col("start")), ignorenulls=True).over(w)).where("at is not null")
    part = Window.partitionBy("file", "at").orderBy("start")
    c = c.withColumns({"place": F.row_number().over(part) - 1, "closed": F.count_if(F.col("token") == "}").over(part.rowsBetween(Window.unboundedPreceding, -1)), "comma": F.count_if((F.col("token") == ",") & (F.col("depth") == 1)).over(part)})
    head = c.where("place = 0").select("file", "at", F.col("n1").alias("h1"), F.col("n2").alias("h2"), F.col("n3").alias("h3"), F.col("n4").alias("h4"), F.col("k2").alias("hk2"), F.col("k3").alias("hk3"), F.col("k4").alias("hk4"))
    none = F.lit(None).cast("string")
    type_word = (F.col("h1") == "type") & F.col("h2").isin("{", "*")
    star = head.where((F.col("h1") == "*") | ((F.col("h1") == "type") & (F.col("h2") == "*")))
    unquoted = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    plain_star = F.when((F.col("h1") == "*") & (F.col("h2") == "from"), unquoted(F.col("h3"))).when((F.col("h1") == "type") & (F.col("h3") == "from"), unquoted(F.col("h4")))
    wildcard = star.select("file", "at", F.lit("wildcard").alias("kind"), none.alias("exported_name"), none.alias("local_name"), F.when((F.col("h1") == "*") & (F.col("h2") == "as"), F.col("h3")).when((F.col("h1") == "type") & (F.col("h3") == "as"), F.col("h4")).alias("namespace"), plain_star.alias("specifier"), type_word.alias("type_only"))
    default = head.where(F.col("h1") == "default").select("file", "at", F.lit("default").alias("kind"), F.lit("default").alias("exported_name"), none.alias("local_name"), none.alias("namespace"), none.alias("specifier"), F.lit(False).alias("type_only"))
    skip = F.col("h1").isin("async", "abstract", "declare") | ((F.col("h1") == "const") & (F.col("h2") == "enum"))
    name = F.when(skip & (F.col("h3") != "*"), F.col("h3")).when(F.col("h1").isin(*DECLARING), F.when(F.col("h2") == "*", F.col("h3")).otherwise(F.col("h2")))
    declared = head.where(F.col("h1").isin(*DECLARING, "async", "abstract", "declare") & ~type_word).withColumn("name", name).where(F.col("name").rlike(r"^[\p{L}_$]"))
    declared = declared.select("file", "at", F.lit("named").alias("kind"), F.col("name").alias("exported_name"), F.col("name").alias("local_name"), none.alias("namespace"), none.alias("specifier"), F.col("h1").isin("type", "interface").alias("type_only"))
    braced = c.join(head.where((F.col("h1") == "{") | ((F.col("h1") == "type") & (F.col("h2") == "{"))).select("file", "at", type_word.alias("word")), ["file", "at"])
    origin = braced.where((F.col("closed") == 1) & (F.col("token") == "from") & (F.col("p1") == "}")).select("file", "at", unquoted(F.col("n1")).alias("specifier"))
    names = braced.where((F.col("closed") == 0) & (F.col("depth") == 1) & (F.col("kind") == "name")).groupBy("file", "at", "comma", "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "token"))), lambda x: x["token"]).alias("names"))
    own = (F.col("names")[0] == "type") & (F.size("names") > 1) & (F.try_element_at("names", F.lit(2)) != "as")
    names = names.withColumn("own", own).withColumn("names", F.when(own, F.slice("names", F.lit(2), F.size("names"))).otherwise(F.col("names")))
    named = names.join(origin, ["file", "at"], "left").select("file", "at", F.lit("named").alias("kind"), F.element_at("names", -1).alias("exported_name"), F.col("names")[0].alias("local_name"), none.alias("namespace"), "specifier", (F.col("word") | F.col("own")).alias("type_only"))
    found = wildcard.unionByName(default).unionByName(declared).unionByName(named)
    lines = c.where("place = 0").select("file", "at", "line")
    return found.join(lines, ["file", "at"]).select("file", F.col("at").alias("offset"), "line", "kind", "exported_name", "local_name", "namespace", "specifier", "type_only")
