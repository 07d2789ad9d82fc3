"""Files of scanned projects: classification, sizes, modules, folders and how they refer to each other.

A file row delivered twice counts once (it may differ in ``loaded_at`` only); a null size or line count is 0; extensions are compared in
lower case. Rankings carry explicit tie keys. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions.text import basename, normal_path, snake

# The kind of file by extension.
FILE_TYPES = {
    ".c": "c_source", ".cpp": "c_source", ".cc": "c_source", ".cxx": "c_source", ".h": "header", ".hpp": "header", ".hh": "header", ".hxx": "header", ".asm": "assembly", ".s": "assembly",
    ".nasm": "assembly", ".inf": "module_inf", ".dec": "package_dec", ".dsc": "platform_dsc", ".fdf": "flash_desc", ".sdl": "common_file", ".sd": "common_file", ".cif": "common_file",
    ".mak": "common_file", ".hfr": "common_file", ".vfr": "hii_vfr", ".uni": "hii_string", ".asl": "acpi_asl", ".py": "py_source", ".js": "js_source", ".mjs": "js_source", ".cjs": "js_source",
    ".jsx": "jsx_source", ".ts": "ts_source", ".tsx": "tsx_source", ".go": "go_source", ".java": "java_source", ".kt": "kotlin_source", ".kts": "kotlin_source", ".scala": "scala_source",
    ".groovy": "groovy_source", ".dart": "dart_source", ".swift": "swift_source", ".m": "objc_source", ".mm": "objc_source", ".cs": "csharp_source", ".vb": "vb_source", ".fs": "fsharp_source",
    ".fsx": "fsharp_source", ".rb": "ruby_source", ".php": "php_source", ".pl": "perl_source", ".pm": "perl_source", ".lua": "lua_source", ".sh": "shell_source", ".bash": "shell_source",
    ".zsh": "shell_source", ".r": "r_source", ".jl": "julia_source", ".rs": "rust_source", ".zig": "zig_source", ".d": "d_source", ".nim": "nim_source", ".cr": "crystal_source",
    ".ex": "elixir_source", ".exs": "elixir_source", ".erl": "erlang_source", ".hrl": "erlang_source", ".clj": "clojure_source", ".cljs": "clojure_source", ".hs": "haskell_source",
    ".ml": "ocaml_source", ".mli": "ocaml_source", ".elm": "elm_source", ".sql": "sql_source", ".graphql": "graphql_source", ".gql": "graphql_source", ".proto": "proto_source", ".css": "css_source",
    ".scss": "scss_source", ".sass": "sass_source", ".less": "less_source", ".styl": "stylus_source", ".html": "html_source", ".htm": "html_source", ".xhtml": "html_source", ".json": "json_config",
    ".yaml": "yaml_source", ".yml": "yaml_source", ".toml": "toml_source", ".md": "markdown_doc", ".markdown": "markdown_doc", ".mdown": "markdown_doc", ".mkd": "markdown_doc", ".rst": "rst_doc",
    ".txt": "text_doc", ".ps1": "powershell_source", ".psm1": "powershell_source", ".psd1": "powershell_source",
}
NON_CODE = ("json_config", "yaml_source", "toml_source", "markdown_doc", "rst_doc", "text_doc")
BINARY_EXT = (".veb", ".lib", ".obj", ".efi", ".rom", ".bin", ".log", ".map")
SKIP_DIRS = ("Build", "build", ".git", "__pycache__", "Conf", "DEBUG", "RELEASE", "node_modules", ".next", ".nuxt", "dist", "out", ".output", ".cache", "coverage",
             ".nyc_output", "storybook-static", "vendor", ".venv", "venv", "env", ".env", ".tox", ".pytest_cache", ".mypy_cache", "site-packages", "__pypackages__", ".idea", ".vscode", ".DS_Store")
BUILD_DIRS = ("Build", "build", "DEBUG", "RELEASE")
FAMILY_ORDER = ("go", "typescript", "react", "javascript", "python", "c_cpp", "java", "kotlin", "scala", "dart", "swift", "groovy", "objc", "csharp", "rust", "ruby", "php", "lua", "elixir", "haskell", "html", "yaml", "powershell", "toml")
FAMILIES = {
    ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".c": "c_cpp", ".cpp": "c_cpp", ".cc": "c_cpp", ".h": "c_cpp", ".hpp": "c_cpp",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".dart": "dart", ".swift": "swift", ".groovy": "groovy", ".m": "objc", ".mm": "objc", ".cs": "csharp", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".lua": "lua", ".ex": "elixir", ".exs": "elixir", ".hs": "haskell", ".html": "html", ".htm": "html", ".xhtml": "html", ".yaml": "yaml", ".yml": "yaml", ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell", ".toml": "toml",
}
REACT_EXT = (".jsx", ".tsx")
FIRMWARE_EXT = (".inf", ".sdl", ".cif", ".dec", ".dsc", ".fdf")
MIXED_SHARE = 0.35
PALETTE_SIZE = 15


def _lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), otherwise)


def module_of(path: Column) -> Column:
    """The first segment of a path, or '_root'."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("_root")


def file_type_of(ext: Column) -> Column:
    low = F.lower(ext)
    return F.when(low.isin(*BINARY_EXT), "binary").otherwise(_lookup(low, FILE_TYPES, F.lit("other")))


def is_skipped(path: Column, include_build: bool = False, include: tuple[str, ...] = ()) -> Column:
    """Whether a folder of the path is one that scans leave out; those named in ``include`` are kept."""
    skip = [x for x in SKIP_DIRS if not (include_build and x in BUILD_DIRS) and x not in include]
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, skip)))


TEST_PATH = (r"(^|/)(tests?|__tests__|specs?)/|(^|/)(test(\.[^./]*)?|test[_-][^/]*|[^/]*(_test|_spec|\.test|\.spec)(\.[^./]*)?|[^/]*\.(test|spec)\.[^/]*|conftest\.py)$")


def is_test_for_dead_code(path: Column) -> Column:
    """A file in a folder of tests or specs, or named like one, in any case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(TEST_PATH)


def is_test_for_security(path: Column) -> Column:
    """The broader predicate of the security scan."""
    from codestrata.operators.security import is_test

    return is_test(path)


def known_files(files: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return files.where("file_id IS NOT NULL AND project IS NOT NULL AND path IS NOT NULL").select(
        "file_id", "project", "path", "label", F.lower("ext").alias("ext"), F.coalesce("size", zero).alias("size"), F.coalesce("loc.code", zero).alias("code"),
        F.coalesce("loc.comment", zero).alias("comment"), F.coalesce("loc.blank", zero).alias("blank"), F.coalesce("func_count", zero).alias("func_count")).distinct()


def file_nodes(files: DataFrame) -> DataFrame:
    """The file record with module, kind, total lines and predicates derived from path and extension."""
    path = F.col("path")
    return known_files(files).select(
        "file_id", "project", "path", "ext", "size", (F.col("code") + F.col("comment") + F.col("blank")).alias("lines"), module_of(path).alias("module"), file_type_of(F.col("ext")).alias("kind"),
        is_skipped(path).alias("skipped"), is_test_for_dead_code(path).alias("test_dead"), is_test_for_security(path).alias("test_security"),
        (~file_type_of(F.col("ext")).isin(*NON_CODE)).alias("is_code"))


def loc_totals(files: DataFrame) -> DataFrame:
    rows = known_files(files).groupBy("project").agg(*(F.sum(c).alias(c) for c in ("code", "comment", "blank")))
    return rows.withColumn("total", F.col("code") + F.col("comment") + F.col("blank"))


def type_counts(files: DataFrame) -> DataFrame:
    return known_files(files).groupBy("project", file_type_of(F.col("ext")).alias("kind")).agg(F.count("*").alias("files"))


def top_languages(files: DataFrame, top: int = 4) -> DataFrame:
    """The ``top`` extensions of each project by files and all others in one row."""
    n = known_files(files).groupBy("project", F.coalesce("ext", F.lit("")).alias("ext")).agg(F.count("*").alias("files"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("files"), "ext"))
    return n.withColumn("name", F.when(rank <= top, F.col("ext")).otherwise("others")).groupBy("project", "name").agg(F.sum("files").alias("files"))


def module_summary(files: DataFrame) -> DataFrame:
    """Source files, functions and other files of each module, and its colour: modules in order cycle a palette."""
    source = ~file_type_of(F.col("ext")).isin("binary", "other")
    rows = known_files(files).groupBy("project", module_of(F.col("path")).alias("module")).agg(
        F.count(F.when(source, 1)).alias("file_count"), F.sum(F.when(source, F.col("func_count")).otherwise(0)).alias("func_count"), F.count(F.when(~source, 1)).alias("other_count"))
    nth = F.row_number().over(Window.partitionBy("project").orderBy("module"))
    return rows.withColumn("colour", F.pmod(nth - 1, F.lit(PALETTE_SIZE)))


def project_types(files: DataFrame) -> DataFrame:
    """(project, family, files, second, project_type): the leading language family of each project; 'mixed' where the second has more than 35 % of the first's files.

    Any firmware description makes a project firmware. Pages of components count as a family of their own where they are more than half of the typed ones. Ties go by a fixed order; a
    project of no family is C.
    """
    held = known_files(files).groupBy("project", F.coalesce("ext", F.lit("")).alias("ext")).agg(F.count("*").alias("files"))
    some = lambda exts: F.coalesce(F.sum(F.when(F.col("ext").isin(*exts), F.col("files"))), F.lit(0))
    whole = held.groupBy("project").agg(some(FIRMWARE_EXT).alias("firmware"), some(REACT_EXT).alias("react"), some([e for e, f in FAMILIES.items() if f == "typescript"]).alias("typed"))
    react = whole.where((F.col("react") > 0) & (F.col("react") > F.col("typed") * 0.5)).select("project", F.lit("react").alias("family"), F.col("react").alias("files"))
    n = held.withColumn("family", _lookup(F.col("ext"), FAMILIES, F.lit(None).cast("string"))).where("family IS NOT NULL").groupBy("project", "family").agg(F.sum("files").alias("files")).unionByName(react)
    place = F.array_position(F.array(*map(F.lit, FAMILY_ORDER)), F.col("family"))
    order = Window.partitionBy("project").orderBy(F.desc("files"), place)
    first = n.withColumns({"rank": F.row_number().over(order), "second": F.lead("files", 1, 0).over(order)}).where("rank = 1").select("project", "family", "files", "second")
    rows = whole.select("project", "firmware").join(first, "project", "left")
    mixed = F.col("second") / F.col("files") > MIXED_SHARE
    kind = F.when(F.col("firmware") > 0, "firmware").when(F.col("family").isNull(), "c_cpp").when(mixed, "mixed").otherwise(F.col("family"))
    return rows.select("project", F.when(F.col("firmware") > 0, "firmware").otherwise(F.coalesce("family", F.lit("c_cpp"))).alias("family"), F.when(F.col("firmware") > 0, F.col("firmware")).otherwise(F.coalesce("files", F.lit(0))).alias("files"),
                       F.coalesce("second", F.lit(0)).alias("second"), kind.alias("project_type"))


def treemap(files: DataFrame, depth: int = 2) -> DataFrame:
    """The area a file takes in a tree map, by lines or else by size, and the group it falls in: up to ``depth`` folders, else its extension."""
    parts = F.split("path", "/")
    lines = F.col("code") + F.col("comment") + F.col("blank")
    scaled = F.log2(F.col("size") + 1) * F.when(F.col("ext").isin(*BINARY_EXT), 2.2).otherwise(5.0)
    group = F.when(F.size(parts) > 1, F.concat_ws("/", F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))))).otherwise(F.coalesce("ext", F.lit("")))
    return known_files(files).select("file_id", "project", F.round(F.when(lines > 0, lines.cast("double")).otherwise(scaled), 4).alias("metric"), group.alias("group_key"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """Files and functions in and below every folder, with an estimate of the nodes needed to show it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    rows = known_files(files).select("project", "func_count", F.explode(above).alias("folder")).groupBy("project", "folder").agg(F.count("*").alias("files"), F.sum("func_count").alias("symbols"))
    return rows.withColumn("nodes", F.col("files") + F.col("symbols") + F.ceil(F.col("files") * 0.25))


def fingerprint(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """A key of each project's size that changes when a cached view of it must: files:functions:edges:modules."""
    f = known_files(files).groupBy("project").agg(F.count("*").alias("files"), F.countDistinct(module_of(F.col("path"))).alias("modules"))
    s = symbols.groupBy("project").agg(F.countDistinct("sid").alias("symbols"))
    e = edges.groupBy("project").agg(F.countDistinct("edge_id").alias("edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return f.join(s, "project", "left").join(e, "project", "left").select("project", F.concat_ws(":", zero("files"), zero("symbols"), zero("edges"), zero("modules")).alias("fingerprint"))


# --- imports and their resolution ------------------------------------------------------------------------------------------------

# How languages write imports; one group holds the reference.
IMPORTS = {
    ".py": r"(?m)^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import|import[ \t]+([.\w]+))",
    ".js": r"(?:require\(\s*['\"]([^'\"]+)['\"]|(?:from|import)\s+['\"]([^'\"]+)['\"])",
    ".c": r"(?m)^[ \t]*#[ \t]*include[ \t]*(?:[\"<])([^\">]+)[\">]()",
    ".java": r"(?m)^[ \t]*(?:import|using)[ \t]+(?:static[ \t]+)?([\w.]+)()",
    ".rs": r"(?m)^[ \t]*use[ \t]+([\w:]+)()",
    ".rb": r"(?m)^[ \t]*(?:require|require_relative)[ \t]+['\"]([^'\"]+)['\"]()",
    ".go": r"(?m)^[ \t]*(?:import[ \t]+)?(?:\w+[ \t]+)?\"([\w./-]+)\"()",
}
SAME_IMPORTS = {".ts": ".js", ".tsx": ".js", ".jsx": ".js", ".mjs": ".js", ".cjs": ".js", ".cpp": ".c", ".cc": ".c", ".h": ".c", ".hpp": ".c", ".cs": ".java", ".kt": ".java", ".scala": ".java"}


def imports(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(project, path, ref): the distinct references each file imports, by the pattern of its language, in the JVM."""
    src = known_files(files).select("file_id", "project", "path", "ext").join(texts.where("text IS NOT NULL").select("file_id", "text"), "file_id")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in SAME_IMPORTS.items() for x in p)), F.coalesce("ext", F.lit(""))), F.col("ext"))
    found = F.array().cast("array<string>")
    for ext, pattern in IMPORTS.items():
        both = F.concat(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)))
        found = F.when(kind == ext, both).otherwise(found)
    return src.select("project", "path", F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("ref"))


def _no_ext(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(project, path, ref, rule, target): the files a reference leads to, by the first rule that finds any; all its matches come out.

    Rules in order: 0 the path as seen from the file's folder, with '.' and '..' resolved; 1 the base name; 2 the stem in lower case; 3 the stem of the path of rule 0; 4 the stem's
    camel case in snake case; 5 a dotted or ``::`` name as a path without extension, in lower case, and then 6 the same as the end of a path. 0 and 3 take references with a slash or dot, of files in a folder. The
    last rule is an equality on every tail of a path, so each rule is a hash join. A file never refers to itself, even where a rule finds nothing else.
    """
    rule = lambda n, key: F.struct(F.lit(n).alias("rule"), key.alias("key"))
    ref = F.replace("ref", F.lit("\\"), F.lit("/"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    seen = F.when((folder != "") & ref.rlike(r"[/.]"), normal_path(F.concat(folder, ref)))
    stem = _no_ext(basename(F.regexp_replace(ref, r"::", "/")))
    dotted = F.lower(F.regexp_replace(F.regexp_replace("ref", r"^(?:crate|self|super)::|^\.+", ""), r"::|\.", "/"))
    dotted = F.when(~ref.contains("/"), dotted)
    wanted = [rule(0, seen), rule(1, basename(ref)), rule(2, F.lower(stem)), rule(3, F.lower(_no_ext(basename(seen)))), rule(4, F.when(~stem.contains("_") & (stem != F.lower(stem)), snake(stem))), rule(5, dotted), rule(6, dotted)]
    keys = refs.select("project", "path", "ref", F.explode(F.array(*wanted)).alias("k")).select("project", "path", "ref", "k.rule", "k.key").where("key <> ''")
    bare = _no_ext(F.col("path"))
    parts = F.split(F.lower(bare), "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))
    low = F.lower(basename(bare))
    fixed = [rule(0, F.col("path")), rule(1, basename(F.col("path"))), rule(2, low), rule(3, low), rule(4, low), rule(5, F.lower(bare))]
    ends = F.when(F.size(parts) > 1, F.transform(tails, lambda t: rule(6, t))).otherwise(F.array().cast("array<struct<rule:int,key:string>>"))
    index = known_files(files).select("project", F.col("path").alias("target")).distinct().withColumn("path", F.col("target")).select("project", "target", F.explode(F.concat(F.array(*fixed), ends)).alias("k")).select("project", "target", "k.rule", "k.key")
    hits = keys.join(index, ["project", "rule", "key"]).drop("key")
    best = F.min("rule").over(Window.partitionBy("project", "path", "ref"))
    return hits.withColumn("best", best).where("rule = best AND path <> target").drop("best").distinct()


def import_edges(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(project, s, t): files and the files they import, each pair once."""
    return resolve(imports(files, texts), files).select("project", F.col("path").alias("s"), F.col("target").alias("t")).distinct()


def entry_points(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Code files that nothing imports: 'entry' if they import something themselves, else 'isolated'."""
    code = known_files(files).where(~file_type_of(F.col("ext")).isin(*NON_CODE)).select("project", "path")
    ends = lambda c: edges.select("project", F.col(c).alias("path")).distinct()
    outs = ends("s").withColumn("out", F.lit(True))
    return code.distinct().join(ends("t"), ["project", "path"], "left_anti").join(outs, ["project", "path"], "left").select(
        "project", "path", F.when(F.col("out"), "entry").otherwise("isolated").alias("role"))
