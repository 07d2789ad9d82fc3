"""Edges that follow from parsed files: hints, type usage, candidates nothing states outright, and what calls lead to.

Every function resolves names by hash joins; a name that several places bear resolves only where stated. Repeated rows count once; empty
inputs give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.operators.files import NON_CODE, file_type_of, known_files, resolve
from codestrata.operators.hierarchy import CALLABLE_KINDS, TYPE_KINDS, referenced_name
from codestrata.operators.symbols import NOT_CALLS, known_symbols
from codestrata.tables import materialize, spread

# The kind of each type of edge.
EDGE_KINDS = {
    "include": "import", "sources": "import", "package": "import", "library": "import", "elink": "import", "cif_own": "import", "component": "import", "depex": "import", "guid_ref": "import",
    "str_ref": "import", "asl_include": "import", "callback_ref": "import", "hii_pkg": "import", "import": "import", "asset_ref": "import", "config_ref": "import", "schema_ref": "import",
    "resource_hint": "import", "call": "call", "inherit": "inherit", "inferred": "inferred"}
NAME_PARTS = 16  # of the writers of one data file, each paired with all of its readers
# System functions by category, for calls that leave the project.
SYSTEM = {
    "open": "io", "read": "io", "write": "io", "close": "io", "print": "io", "printf": "io", "fprintf": "io", "puts": "io", "gets": "io", "fopen": "io", "fclose": "io", "readline": "io", "log": "io",
    "malloc": "memory", "free": "memory", "calloc": "memory", "realloc": "memory", "memcpy": "memory", "memset": "memory", "memmove": "memory", "alloc": "memory", "dealloc": "memory",
    "strlen": "string", "strcpy": "string", "strcat": "string", "strcmp": "string", "format": "string", "replace": "string", "split": "string", "join": "string", "trim": "string", "sleep": "time",
    "time": "time", "now": "time", "clock": "time", "delay": "time", "wait": "time", "exec": "process", "spawn": "process", "fork": "process", "system": "process", "exit": "process",
    "abort": "process", "run": "process", "connect": "network", "listen": "network", "bind": "network", "accept": "network", "send": "network", "recv": "network", "fetch": "network",
    "request": "network", "abs": "math", "sqrt": "math", "pow": "math", "floor": "math", "ceil": "math", "round": "math", "min": "math", "max": "math",
}


def edge_kind(edge_type: Column) -> Column:
    """The kind of an edge type; an unknown type is an import."""
    pairs = [F.lit(x) for pair in EDGE_KINDS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(edge_type, F.lit(""))), F.lit("import"))


def hint_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(project, s, t, type, kind, via, subtype, origin, confidence, line): what the hints of parsed files resolve to; the first by line of each (s, t, type, subtype). An unknown type is an import."""
    owner = known_files(files).select("file_id", "project").distinct()
    fields = ("type", "line", "via", "subtype", "origin", "confidence")
    hints = parsed.select("file_id", "path", F.explode("hints").alias("h")).join(owner, "file_id").select("project", "path", F.col("h.target").alias("ref"), *(F.col(f"h.{x}").alias(x) for x in fields))
    hints = hints.withColumn("type", F.when(F.col("type").isin(*EDGE_KINDS), F.col("type")).otherwise("import"))
    known = resolve(hints.select("project", "path", "ref").distinct(), files)
    first = F.min(F.struct("line", "via", "origin", "confidence")).alias("f")
    return (hints.join(known, ["project", "path", "ref"]).groupBy("project", F.col("path").alias("s"), F.col("target").alias("t"), "type", "subtype").agg(first)
            .select("project", "s", "t", "type", edge_kind(F.col("type")).alias("kind"), "f.via", "subtype", "f.origin", "f.confidence", "f.line"))


def trust_kind(origin: Column, edge_type: Column) -> Column:
    """What an edge is trusted by: its origin if stated, else 'inferred' or 'import' by its type."""
    return F.coalesce(origin, F.when(edge_type.contains("inferred"), "inferred").otherwise("import"))


def declared_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(project, s, t, type, via): files that refer to an identifier or string another declares, names in any case: manifests to packages (guid_ref), forms to their strings (str_ref). One file a name, the least by path."""
    owner = known_files(files).select("file_id", "project").distinct()
    rows = materialize(parsed.where("size(hints) + size(symbols) > 0").select("file_id", "path", "hints", "symbols").join(owner, "file_id"), "declared")
    refs = rows.where(~F.col("path").rlike(r"(?i)\.dec$")).select("project", "path", F.explode("hints").alias("h")).where("h.type IN ('guid_ref', 'str_ref')").select("project", F.col("path").alias("s"), "h.type", F.lower("h.target").alias("name"), F.col("h.target").alias("via")).distinct()
    kind = F.when(F.col("y.kind") == "guid", "guid_ref").when(F.col("y.kind") == "string", "str_ref")
    decl = rows.select("project", "path", F.explode("symbols").alias("y")).select("project", "path", kind.alias("type"), F.lower("y.name").alias("name")).where("type IS NOT NULL").groupBy("project", "type", "name").agg(F.min("path").alias("t"))
    return refs.join(decl, ["project", "type", "name"]).where("s <> t").groupBy("project", "s", "t", "type").agg(F.min("via").alias("via"))


def global_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(project, s, t, type, origin, via): script files without imports, and the only file that defines a global name they use; names of three letters or more. The least name of each pair is ``via``."""
    code = parsed.where(F.col("path").rlike(r"(?i)\.(js|jsx|mjs|cjs|ts|tsx)$")).join(known_files(files).select("file_id", "project").distinct(), "file_id").select("project", "path", "imports", "defines", "uses")
    only = code.select("project", F.col("path").alias("t"), F.explode("defines").alias("via")).distinct().groupBy("project", "via").agg(F.min("t").alias("t"), F.count("*").alias("n")).where("n = 1").drop("n")
    uses = code.where(F.size("imports") == 0).select("project", F.col("path").alias("s"), F.explode("uses").alias("via")).distinct().where((F.length("via") >= 3) & ~F.col("via").isin(*NOT_CALLS))
    return uses.join(only, ["project", "via"]).where("s <> t").groupBy("project", "s", "t").agg(F.min("via").alias("via")).select("project", "s", "t", F.lit("import").alias("type"), F.lit("inferred").alias("origin"), "via")


def central_definitions(calls: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, file_id, callee, target): which file defines what a file calls: the only one of the project, else the file itself, else the one that most files import, by edges(project, s, t); the least path on ties."""
    defs = known_symbols(symbols).where(F.col("kind").isin(*CALLABLE_KINDS) & F.col("file").isNotNull()).select("project", F.col("name").alias("callee"), F.col("file_id").alias("at"), F.col("file").alias("target")).distinct()
    indegree = edges.select("project", "s", F.col("t").alias("target")).distinct().groupBy("project", "target").agg(F.count("*").alias("links"))
    ranked = defs.join(indegree, ["project", "target"], "left").na.fill(0, ["links"])
    best = ranked.groupBy("project", "callee").agg(F.min(F.struct((-F.col("links")).alias("order"), "target")).alias("m")).select("project", "callee", F.col("m.target").alias("central"))
    here = defs.groupBy("project", F.col("at").alias("file_id"), "callee").agg(F.min("target").alias("own"))
    return calls.select("project", "file_id", "callee").distinct().join(best, ["project", "callee"]).join(here, ["project", "file_id", "callee"], "left").select("project", "file_id", "callee", F.coalesce("own", "central").alias("target"))


def stated_links(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, src, dst, type, line): what types state about others beside their bases, mixins, behaviours and protocols, between symbols(sid, project, file_id, name, kind).

    The source is the type of that name in the file. The target is a type or module of the file by the last part of its name, else the only one of the project. Each (src, dst, type) once, at its first line.
    """
    last = lambda c: F.regexp_extract(c, r"([^.:]+)$", 1)
    s = known_symbols(symbols).where(~F.col("kind").isin(*CALLABLE_KINDS)).select("project", "file_id", "sid", last("name").alias("name")).distinct()
    rows = parsed.select("file_id", F.explode("links").alias("l")).select("file_id", last("l.source").alias("source"), last("l.target").alias("target"), "l.type", "l.line")
    from_ = s.groupBy("project", "file_id", F.col("name").alias("source")).agg(F.min("sid").alias("src"))
    here = s.groupBy("file_id", F.col("name").alias("target")).agg(F.min("sid").alias("here"))
    only = s.groupBy("project", F.col("name").alias("target")).agg(F.min("sid").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    hit = rows.join(from_, ["file_id", "source"]).join(here, ["file_id", "target"], "left").join(only, ["project", "target"], "left").withColumn("dst", F.coalesce("here", "only"))
    return hit.where("dst IS NOT NULL AND dst <> src").groupBy("project", "src", "dst", "type").agg(F.min("line").alias("line"))


def link_symbols(pairs: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, s, t, link): what links two files of pairs(project, s, t): the first caller and callee of edges(src, dst), by line and name, that lead from one to the other, else 'import edge'."""
    at = known_symbols(symbols).groupBy("sid").agg(F.min(F.struct("file", "line", "name")).alias("a"))
    end = lambda c: at.select(F.col("sid").alias(c), F.col("a").alias(f"at_{c}"))
    crossing = edges.select("project", "src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst").select("project", F.col("at_src.file").alias("s"), F.col("at_dst.file").alias("t"), F.col("at_src.line").alias("line"), F.concat("at_src.name", F.lit(" -> "), "at_dst.name").alias("link"))
    first = crossing.where("s <> t").groupBy("project", "s", "t").agg(F.min(F.struct("line", "link")).alias("f"))
    return pairs.select("project", "s", "t").distinct().join(first, ["project", "s", "t"], "left").select("project", "s", "t", F.coalesce("f.link", F.lit("import edge")).alias("link"))


def type_usage(symbols: DataFrame) -> DataFrame:
    """(project, src, dst): callables whose signature names a type of the same file, else the only one of the project; each pair once."""
    s = known_symbols(symbols).select("project", "file_id", "sid", "name", "kind").distinct()
    sig = symbols.where("sid IS NOT NULL AND signature IS NOT NULL").select("sid", "signature").distinct()
    names = F.array_distinct(F.regexp_extract_all("signature", F.lit(r"\b([A-Z]\w{2,})\b"), F.lit(1)))
    refs = s.where(F.col("kind").isin(*CALLABLE_KINDS)).join(sig, "sid").select("project", "file_id", "sid", F.explode(names).alias("ref"))
    types = s.where(F.col("kind").isin(*TYPE_KINDS)).select("project", "file_id", F.col("sid").alias("type_sid"), F.col("name").alias("ref"))
    local = types.groupBy("file_id", "ref").agg(F.min("type_sid").alias("local"))
    only = types.groupBy("project", "ref").agg(F.min("type_sid").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    hit = refs.join(local, ["file_id", "ref"], "left").join(only, ["project", "ref"], "left").select("project", F.col("sid").alias("src"), F.coalesce("local", "only").alias("dst"))
    return hit.where("dst IS NOT NULL").distinct()


# How the candidates below are told. Words that start a process, files it may be given, files of data, and what is done with them near their name.
SPAWN = r"subprocess\.|Popen\b|os\.system\b|os\.exec\w*\b|os\.spawn\w*\b|check_call\b|check_output\b|\bspawn[vl]?p?e?\b|\bexec[vl]p?e?\b"
SPAWNED = r"[\"']([\w./\\-]+\.(?:py|js|mjs|cjs|ts|go|rb|sh|bash|bat|cmd|ps1|exe|jar|pl))[\"']"
DATA_EXT = ("json", "txt", "csv", "yaml", "yml", "toml", "ini", "db", "sqlite", "sqlite3", "cache", "pkl", "pickle", "log", "md", "ndjson", "jsonl")
LITERAL = r"[\"']([\w./\\-]+\.(\w+))[\"']"
WRITES = r"write_text|write_bytes|\.write\b|json\.dump|\.dump\b|to_json|\bsave\b|open\([^)]*[\"'][^'\")]*[\"']\s*,\s*[\"'][rwa+bt]*[wa][rwa+bt]*[\"']"
READS = r"read_text|read_bytes|\.read\b|json\.load|\.load\b|\bload\b|open\([^,)]*\)"
NEAR, LEAST_NAME = 200, 5
CONFIDENCE = {"subprocess": 0.80, "shared_file": 0.65, "interface": 0.85}


def _mentions(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(project, path, what, name, evidence): scripts named within NEAR characters behind a word that starts processes, and data files named as near to a verb of writing or reading."""
    spawn, spawned, literal, writes, reads = map(re.compile, (SPAWN, SPAWNED, LITERAL, WRITES, READS))
    base = lambda x: x.replace("\\", "/").rsplit("/", 1)[-1]
    for b in rows:
        out: dict[tuple, str] = {}
        for project, path, text in zip(b["project"], b["path"], b["text"]):
            for m in spawn.finditer(text):
                line = re.sub(r"\s+", " ", text[m.start() : m.start() + 120].split("\n", 1)[0]).strip()
                for name in spawned.findall(text[m.start() : m.start() + NEAR]):
                    out.setdefault((project, path, "starts", base(name)), line)
            for m in literal.finditer(text):
                name = base(m[1])
                if m[2].lower() in DATA_EXT and len(name) >= LEAST_NAME:
                    around = text[max(0, m.start() - NEAR) : m.end() + NEAR]
                    for what, verb in (("writes", writes), ("reads", reads)):
                        if verb.search(around):
                            out.setdefault((project, path, what, name), f"writes/reads {name}")
        yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["project", "path", "what", "name", "evidence"])


def mentions(files: DataFrame, texts: DataFrame) -> DataFrame:
    """What :func:`_mentions` finds in all texts that name a file at all, which is tested before any leaves the JVM."""
    src = known_files(files).select("file_id", "project", "path").distinct().join(texts.where(F.col("text").rlike(LITERAL)).select("file_id", "text"), "file_id")
    return spread(src.select("project", "path", "text")).mapInPandas(_mentions, "project string, path string, what string, name string, evidence string").distinct()


def _told(pairs: DataFrame, signal: str, stated: DataFrame | None) -> DataFrame:
    """Candidates (project, source, target, evidence) with signal and confidence, without those that an edge(project, s, t) states; the least evidence of each."""
    out = pairs.where("source <> target").groupBy("project", "source", "target").agg(F.min("evidence").alias("evidence"))
    if stated is not None:
        out = out.join(stated.select("project", F.col("s").alias("source"), F.col("t").alias("target")).distinct(), ["project", "source", "target"], "left_anti")
    return out.select("project", "source", "target", F.lit(signal).alias("signal"), F.lit(CONFIDENCE[signal]).alias("confidence"), "evidence")


def interface_candidates(symbols: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """Types whose base theirs does not define, with each file that does and that theirs does not import."""
    s = known_symbols(symbols).where(F.col("kind").isin(*TYPE_KINDS))
    base = s.select("project", F.col("name").alias("base"), F.col("file").alias("target")).distinct()
    refs = s.select("project", F.col("file").alias("source"), "name", F.explode("bases").alias("ref")).select("project", "source", "name", referenced_name(F.col("ref")).alias("base")).distinct()
    refs = refs.join(base.withColumnRenamed("target", "source"), ["project", "base", "source"], "left_anti")
    return _told(refs.join(base, ["project", "base"]).withColumn("evidence", F.concat(F.lit("class "), "name", F.lit("("), "base", F.lit(")"))), "interface", stated)


def shared_file_candidates(found: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """Files that write a data file another reads, by its name, of :func:`mentions`.

    Every writer meets every reader by an equality join on the data file's name. A name's writers are in parts, so that no single task pairs all files
    of a name that many touch.
    """
    side = lambda what, c: found.where(F.col("what") == what).select("project", "name", "evidence", F.col("path").alias(c)).distinct()
    w = side("writes", "source").withColumn("part", F.pmod(F.xxhash64("source"), F.lit(NAME_PARTS)))
    r = side("reads", "target").drop("evidence").withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(NAME_PARTS)])))
    return _told(w.join(r, ["project", "name", "part"]), "shared_file", stated)


def process_candidates(found: DataFrame, files: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """Files that start another, of :func:`mentions`, where only one file of the project bears the name."""
    only = known_files(files).select("project", "path").distinct().groupBy("project", F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).agg(F.min("path").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    return _told(found.where("what = 'starts'").withColumnRenamed("path", "source").join(only, ["project", "name"]), "subprocess", stated)


def candidates(files: DataFrame, texts: DataFrame, symbols: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """(project, source, target, signal, confidence, evidence): all candidate edges that nothing states outright, each (source, target, signal) once."""
    found = materialize(mentions(files, texts), "mentions")
    return process_candidates(found, files, stated).unionByName(shared_file_candidates(found, stated)).unionByName(interface_candidates(symbols, stated))


def classify_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of each caller by where they lead: 'internal' to the file, 'external' to another one, 'ambiguous' to several, a system category, or 'unknown'."""
    target = known_symbols(symbols).where(F.col("kind").isin(*CALLABLE_KINDS)).select("project", "file_id", F.col("name").alias("callee")).distinct()
    here = target.select("file_id", "callee").distinct().withColumn("here", F.lit(True))
    places = target.groupBy("project", "callee").agg(F.countDistinct("file_id").alias("places"))
    pairs = [F.lit(x) for pair in SYSTEM.items() for x in pair]
    system = F.element_at(F.create_map(*pairs), F.lower("callee"))
    rows = calls.join(here, ["file_id", "callee"], "left").join(places, ["project", "callee"], "left")
    kind = (F.when(F.col("here"), "internal").when(F.col("places") == 1, "external").when(F.col("places") > 1, "ambiguous").when(system.isNotNull(), F.concat(F.lit("system:"), system)).otherwise("unknown"))
    return rows.select("project", "file_id", "sid", "callee", kind.alias("leads_to"))


def call_flows(classified: DataFrame) -> DataFrame:
    """How many calls of each project lead where."""
    return classified.groupBy("project", "leads_to").agg(F.count("*").alias("calls"), F.countDistinct("callee").alias("callees"))


def unreached(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, path, role) of code files that neither an import nor a convention of their language reaches.

    Files of a package folder reach each other in languages whose packages are folders; a C file is reached through an imported header of
    its name in the same folder. Unreached files are 'entry' if they import something, else 'isolated'; every one is exactly one of the two.
    """
    code = known_files(files).where(~file_type_of(F.col("ext")).isin(*NON_CODE)).select("project", "path", "ext").distinct().withColumns(
        {"folder": F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "stem": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)})
    imported = edges.select("project", F.col("t").alias("path")).distinct()
    package = code.where(F.col("ext").isin(".go", ".java", ".kt", ".swift")).groupBy("project", "folder", "ext").agg(F.count("*").alias("n")).where("n > 1").select("project", "folder", "ext")
    headers = code.where(F.col("ext").isin(".h", ".hpp", ".hh", ".hxx")).join(imported, ["project", "path"], "left_semi").select("project", "folder", "stem").distinct()
    impl = code.where(F.col("ext").isin(".c", ".cpp", ".cc", ".cxx")).join(headers, ["project", "folder", "stem"], "left_semi").select("project", "path")
    rest = code.join(imported, ["project", "path"], "left_anti").join(package, ["project", "folder", "ext"], "left_anti").join(impl, ["project", "path"], "left_anti")
    outs = edges.select("project", F.col("s").alias("path")).distinct().withColumn("out", F.lit(True))
    return rest.join(outs, ["project", "path"], "left").select("project", "path", F.when(F.col("out"), "entry").otherwise("isolated").alias("role"))


def file_symbol_graph(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Of edges(src, dst): how many stay within each file, come in and go out."""
    at = known_symbols(symbols).groupBy("sid").agg(F.min("file_id").alias("file_id"))
    e = (edges.select("src", "dst").distinct().join(at.select(F.col("sid").alias("src"), F.col("file_id").alias("sf")), "src").join(at.select(F.col("sid").alias("dst"), F.col("file_id").alias("df")), "dst"))
    ends = F.explode(F.array_distinct(F.array(F.struct(F.col("sf").alias("file_id")), F.struct(F.col("df").alias("file_id"))))).alias("f")
    inside, out = F.col("sf") == F.col("df"), F.col("file_id") == F.col("sf")
    return (e.select("sf", "df", ends).select("sf", "df", "f.file_id").groupBy("file_id")
            .agg(F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(~inside & ~out, 1)).alias("incoming"), F.count(F.when(~inside & out, 1)).alias("outgoing")))


def neighbours(edges: DataFrame, top: int = 80) -> DataFrame:
    """(sid, direction, other, edges, rank) of each symbol in edges(src, dst, type): its neighbours bundled with counts, ``top`` each way (a bounded view)."""
    n = edges.groupBy("src", "dst").agg(F.count("*").alias("edges"))
    both = n.select(F.col("src").alias("sid"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "edges").unionByName(n.select(F.col("dst").alias("sid"), F.lit("in").alias("direction"), F.col("src").alias("other"), "edges"))
    rank = F.row_number().over(Window.partitionBy("sid", "direction").orderBy(F.desc("edges"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top)
