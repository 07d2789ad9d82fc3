"""Search: full text, files, symbols, keywords, and bounded context for a question.

Search terms come in as parameters. Results are ordered by explicit keys; where a page or a top list is asked for, that is the feature.
Null and empty texts match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions import text as t
from codestrata.operators.files import BINARY_EXT, is_skipped, known_files
from codestrata.operators.hierarchy import CALLABLE_KINDS
from codestrata.operators.symbols import known_symbols

LINES_A_FILE, CLIP, PAGE = 500, 300, 100


def _pattern(term: str, regex: bool, case: bool, word: bool) -> str:
    p = term if regex else re.escape(term).replace("\\ ", " ")
    return ("" if case else "(?i)") + (rf"\b(?:{p})\b" if word else p)


def grep(texts: DataFrame, key: str, term: str, *, regex: bool = False, case: bool = False, word: bool = False) -> DataFrame:
    """(key, line, text) of each line that holds the term, clipped around it.

    Whole texts are tested before they are split into lines.
    """
    p = _pattern(term, regex, case, word)
    lines = texts.where(F.col("text").rlike(p)).select(key, F.posexplode(F.split("text", "\n")).alias("at", "raw")).where(F.col("raw").rlike(p))
    start = F.greatest(F.regexp_instr("raw", F.lit(p)) - 60, F.lit(1))
    return lines.select(key, (F.col("at") + 1).alias("line"), F.substring(F.col("raw"), start, F.lit(CLIP)).alias("text"))


def grep_groups(hits: DataFrame, key: str, shown: int = LINES_A_FILE) -> DataFrame:
    """Hits by file: their number, the first line, and whether more lie beyond those shown."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return hits.withColumn("nth", nth).groupBy(key).agg(F.count("*").alias("hits"), F.min("line").alias("first_line"), F.count(F.when(F.col("nth") <= shown, 1)).alias("shown"))


def page(rows: DataFrame, order: list[Column], offset: int = 0, size: int = PAGE) -> DataFrame:
    """One page of ordered rows, with whether another follows."""
    got = rows.orderBy(*order).offset(offset).limit(size + 1).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of one page only
    more = F.max("place").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > size
    return got.withColumn("has_more", more).where(F.col("place") <= size)


def file_rank(path: Column, label: Column, term: str) -> Column:
    """How well a file fits: exact name, prefix, inside the name, inside the path, letters in order; null if not at all."""
    q, low, lp = term.lower(), F.lower(label), F.lower(path)
    return (F.when(low == q, 10000).when(low.startswith(q), 5000 + F.greatest(F.lit(0), 100 - F.length(label))).when(low.contains(q), 3000 + F.greatest(F.lit(0), 100 - F.instr(low, q)))
            .when(lp.contains(q), 1000 + F.greatest(F.lit(0), 100 - F.instr(lp, q))).when(t.fuzzy(label, q), 500).when(t.fuzzy(path, q), 100))


def text_score(text: Column, term: str) -> Column:
    """1000 for the term itself, 500 for a prefix, else 100 less the term's place, counted from 0; -1 where it isn't held."""
    low, q = F.lower(text), term.lower()
    return F.when(low == q, 1000).when(low.startswith(q), 500).when(low.contains(q), 100 - (F.instr(low, q) - 1)).otherwise(-1)


def call_sites(symbols: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(sid, line, code): the lines of each callable that hold the whole word ``name``. Texts without it are passed over before they are split."""
    p = rf"\b{re.escape(name)}\b"
    rows = known_symbols(symbols).where(F.col("kind").isin(*CALLABLE_KINDS) & (F.col("line") > 0) & (F.col("end_line") >= F.col("line"))).select("sid", "file_id", F.col("line").alias("first"), "end_line").distinct()
    hits = texts.where(F.col("text").rlike(p)).select("file_id", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("at", "raw")).where(F.col("raw").rlike(p)).select("file_id", (F.col("at") + 1).alias("line"), F.trim("raw").alias("code"))
    return rows.join(hits, "file_id").where(F.col("line").between(F.col("first"), F.col("end_line"))).select("sid", "line", "code")


def related_files(texts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, project, path): files whose name, or stem of three letters or more, stands as a word in a text, in any case. Words are joined by equality, one row a text and word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\w.-]*\w"), F.lit(0)))
    found = texts.where("text IS NOT NULL").select(key, F.explode(words).alias("word")).distinct()
    label = F.lower(t.basename(F.col("path")))
    names = files.where("project IS NOT NULL AND path IS NOT NULL").select("project", "path", F.explode(F.array_distinct(F.array(label, F.when(F.length(t.stem(label)) > 2, t.stem(label)).otherwise(label)))).alias("word")).distinct()
    return found.join(names, "word").select(key, "project", "path").distinct()


def file_seeds(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(question_id, project, token, path): the file each token of a question names: one of exactly that stem, else of a stem that starts with it (four letters or more); the least path."""
    tokens = questions.select("question_id", "project", F.explode(t.query_tokens(F.col("question"))).alias("token")).distinct()
    stems = files.where("project IS NOT NULL AND path IS NOT NULL").select("project", "path", F.lower(t.stem(F.col("path"))).alias("stem")).distinct()
    exact = tokens.join(stems.withColumnRenamed("stem", "token"), ["project", "token"]).select("question_id", "project", "token", "path", F.lit(0).alias("tier"))
    heads = stems.where(F.length("stem") > 4).select("project", "path", F.explode(F.transform(F.sequence(F.lit(4), F.length("stem") - 1), lambda n: F.substring(F.col("stem"), F.lit(1), n))).alias("token"))
    partly = tokens.where(F.length("token") >= 4).join(heads, ["project", "token"]).select("question_id", "project", "token", "path", F.lit(1).alias("tier"))
    return exact.unionByName(partly).groupBy("question_id", "project", "token").agg(F.min(F.struct("tier", "path")).alias("m")).select("question_id", "project", "token", "m.path")


def search_index(files: DataFrame, texts: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """(file_id, project, path, text) of the files a search looks at: no binary ones, none in folders that scans leave out, none above ``most_bytes``, where that is the feature's bound."""
    rows = known_files(files).where(~F.coalesce(F.col("ext").isin(*BINARY_EXT), F.lit(False)) & ~is_skipped(F.col("path"))).select("file_id", "project", "path").distinct()
    return rows.join(texts.where(F.octet_length("text") <= most_bytes).select("file_id", "text"), "file_id")


def search_stream(index: DataFrame, term: str, **options) -> Iterator[dict]:
    """The hits of a search file by file in order of project and path, as they come; the driver holds one partition at a time."""
    hits = grep(index, "path", term, **options) if "project" not in index.columns else grep(index.withColumn("place", F.struct("project", "path")), "place", term, **options).select("place.project", "place.path", "line", "text")
    keys = [c for c in ("project", "path") if c in hits.columns]
    for r in hits.orderBy(*keys, "line").toLocalIterator():
        yield r.asDict()


def related_kinds(kind: Column, wanted: list[str]) -> Column:
    """Whether a kind of relation is wanted, singular or plural, in any case; nothing named wants all."""
    bare = lambda x: x.lower().rstrip("s")
    return F.regexp_replace(F.lower(kind), "s+$", "").isin(*map(bare, wanted)) if wanted else F.lit(True)


def explain(edges: DataFrame, nodes: DataFrame, term: str, shown: int = 10) -> DataFrame:
    """(scope, node, role, imports, imported_by, uses, used_by): the nodes(scope, node) whose name holds the term, what they link to and from, ``shown`` names of each (a bounded view).

    The role is 'isolated' without links, 'entry' without incoming ones, 'leaf' without outgoing ones, 'hub' where four times as many come in as go out, else 'link'.
    """
    wanted = nodes.where(F.lower("node").contains(term.lower())).select("scope", "node").distinct()
    e = edges.where("s <> t").select("scope", "s", "t").distinct()

    def side(mine: str, other: str, name: str) -> DataFrame:
        rows = e.select("scope", F.col(mine).alias("node"), F.col(other).alias("other")).join(wanted, ["scope", "node"], "left_semi")
        nth = F.row_number().over(Window.partitionBy("scope", "node").orderBy("other"))
        return rows.withColumn("nth", nth).groupBy("scope", "node").agg(F.count("*").alias(f"n_{name}"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.col("other")))), ", ").alias(name))

    rows = wanted.join(side("s", "t", "uses"), ["scope", "node"], "left").join(side("t", "s", "used_by"), ["scope", "node"], "left").na.fill(0, ["n_uses", "n_used_by"]).na.fill("", ["uses", "used_by"])
    out, into = F.col("n_uses"), F.col("n_used_by")
    role = F.when((out == 0) & (into == 0), "isolated").when(into == 0, "entry").when(out == 0, "leaf").when(into >= 4 * out, "hub").otherwise("link")
    return rows.select("scope", "node", role.alias("role"), out.alias("imports"), into.alias("imported_by"), "uses", "used_by")


def find_files(files: DataFrame, term: str) -> DataFrame:
    """All files that fit, with their score; ordering and paging are left to :func:`page`."""
    return files.select("project", "path", "label").distinct().withColumn("score", file_rank(F.col("path"), F.col("label"), term)).where("score IS NOT NULL")


def find_symbols(symbols: DataFrame, term: str) -> DataFrame:
    """Symbols whose name holds the term: tier 0 the exact ones, 1 prefixes, 2 others."""
    q, low = term.lower(), F.lower("name")
    return symbols.select("project", "sid", "name").distinct().where(low.contains(q)).withColumn("tier", F.when(low == q, 0).when(low.startswith(q), 1).otherwise(2))


def references(texts: DataFrame, key: str, name: str, around: int = 3) -> DataFrame:
    """Lines with the whole word ``name`` and the lines around each."""
    p = rf"\b{re.escape(name)}\b"
    rows = texts.where(F.col("text").rlike(p)).select(key, F.split("text", "\n").alias("lines")).select(key, "lines", F.posexplode("lines").alias("at", "raw")).where(F.col("raw").rlike(p))
    first = F.greatest(F.col("at") + 1 - around, F.lit(1))
    return rows.select(key, (F.col("at") + 1).alias("line"), F.array_join(F.slice("lines", first, F.col("at") + 1 + around - first + 1), "\n").alias("context"))


def keyword_scores(modules: DataFrame, terms: list[str], top: int = 8) -> DataFrame:
    """Modules by how many of the terms their id holds, the larger first on ties (a top-k report)."""
    wanted = [x.lower() for x in terms if len(x) > 2]
    hit = sum((F.when(F.lower("id").contains(x), 1).otherwise(0) for x in wanted), F.lit(0))
    rows = modules.where("id IS NOT NULL AND project IS NOT NULL").groupBy("project", "id").agg(F.max(F.coalesce("file_count", F.lit(0))).alias("files")).withColumn("score", hit).where("score > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), F.desc("files"), "id"))).where(F.col("rank") <= top)


def seeds(questions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(question_id, project, sid, strength) for questions(question_id, project, question): symbols named by a token, strong tokens exactly or as a prefix, weak ones exactly."""
    tokens = questions.select("question_id", "project", F.explode(t.query_tokens(F.col("question"))).alias("token"))
    names = symbols.where("name IS NOT NULL").select("project", "sid", F.lower("name").alias("token"), "name").distinct()
    exact = tokens.join(names, ["project", "token"]).select("question_id", "project", "sid", F.when(t.is_strong(F.col("name")), 2).otherwise(1).alias("strength"))
    parts = names.select("project", "sid", F.explode(F.array_distinct(F.split(t.snake(F.col("name")), "_"))).alias("token")).where(F.length("token") >= 4)
    partly = tokens.join(parts, ["project", "token"]).select("question_id", "project", "sid", F.lit(0).alias("strength"))
    return exact.unionByName(partly).groupBy("question_id", "project", "sid").agg(F.max("strength").alias("strength"))


def context(questions: DataFrame, symbols: DataFrame, edges: DataFrame, cap: int = 12) -> DataFrame:
    """The symbols that answer each question in each project it is put to: its seeds and their neighbours in ``edges(src, dst)``, ``cap`` of them by strength and links (a bounded context)."""
    s = seeds(questions, symbols)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = s.join(both, s["sid"] == both["src"]).select("question_id", "project", F.col("dst").alias("sid"), (F.col("strength") - 1).alias("strength"))
    degree = both.groupBy(F.col("src").alias("sid")).agg(F.count("*").alias("links"))
    rows = s.unionByName(near).groupBy("question_id", "project", "sid").agg(F.max("strength").alias("strength")).join(degree, "sid", "left").na.fill(0, ["links"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "project").orderBy(F.desc("strength"), F.desc("links"), "sid"))).where(F.col("rank") <= cap)


def trim_history(messages: DataFrame, newest: int = 8, chars: int = 12000) -> DataFrame:
    """Of messages(conversation, turn, text) the latest that fit the budget; the last one always stays."""
    order = Window.partitionBy("conversation").orderBy(F.desc("turn"))
    rows = messages.withColumns({"nth": F.row_number().over(order), "upto": F.sum(F.coalesce(F.length("text"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("nth") == 1) | ((F.col("nth") <= newest) & (F.col("upto") <= chars))).drop("nth", "upto")
