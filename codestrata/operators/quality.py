"""Quality of scanned projects: duplicated blocks, technical debt, health scores.

Weights and limits are those of the fixed scoring model below. Empty inputs give empty results; unknown parts of a score count as perfect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.operators import symbols as sym
from codestrata.operators.files import known_files
from codestrata.tables import materialize

# Minutes of work for each issue, and the weights of the health score.
DEBT_MINUTES = {"cycles": 60, "dead": 5, "god": 90, "complex": 30, "duplicates": 20}
HEALTH_WEIGHTS = {"complexity": 0.30, "coupling": 0.20, "dead_code": 0.20, "duplication": 0.15, "cohesion": 0.15}
COMMENT_STARTS = ("#", "//", "--", "/*", "*", ";")


def code_lines(texts: DataFrame, least: int = 8) -> DataFrame:
    """(file_id, line, code): the lines that count for duplication, white space collapsed; short ones and comments don't."""
    lines = F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("at", "raw")
    stripped = F.trim(F.regexp_replace("raw", r"[\t\f\x0B]", " "))
    rows = texts.where("text IS NOT NULL").select("file_id", lines).select("file_id", (F.col("at") + 1).alias("line"), stripped.alias("stripped")).where(F.length("stripped") >= least)
    comment = F.lit(False)
    for c in COMMENT_STARTS:
        comment = comment | F.startswith("stripped", F.lit(c))
    return rows.where(~comment).select("file_id", "line", F.regexp_replace("stripped", r"\s+", " ").alias("code"))


def line_windows(texts: DataFrame, window: int = 6) -> DataFrame:
    """(file_id, line, low, high) of the counted lines, with a 128-bit hash of the stretch of ``window`` of them that starts there; null where fewer follow.

    Only hashes of lines are sorted and combined, never the lines.
    """
    hashed = code_lines(texts).select("file_id", "line", F.xxhash64("code").alias("a"), F.xxhash64("code", F.lit(1)).alias("b"))
    order = Window.partitionBy("file_id").orderBy("line")
    stretch = lambda c: F.xxhash64(*(F.lead(c, k).over(order) for k in range(window)))
    full = F.lead("a", window - 1).over(order).isNotNull()
    return hashed.select("file_id", "line", F.when(full, stretch("a")).alias("low"), F.when(full, stretch("b")).alias("high"))


def _repeated(windows: DataFrame) -> DataFrame:
    """Occurrences of a hash are counted with partial sums and joined back, so a block repeated in a third of all files is never gathered in one place."""
    full = windows.where("low IS NOT NULL")
    return full.join(full.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").select("low", "high"), ["low", "high"], "left_semi")


def duplicate_windows(texts: DataFrame, window: int = 6) -> DataFrame:
    """(block, file_id, line): every stretch of ``window`` counted lines that occurs at least twice anywhere. ``block`` names its content: the first place it has, by file and line."""
    hits = _repeated(materialize(line_windows(texts, window), "line-windows"))
    first = hits.groupBy("low", "high").agg(F.min(F.struct("file_id", "line")).alias("first"))
    return hits.join(first, ["low", "high"]).select(F.concat_ws(":", "first.file_id", "first.line").alias("block"), "file_id", "line")


def duplication(texts: DataFrame, files: DataFrame, window: int = 6) -> DataFrame:
    """Share of each project's counted lines that lie in repeated stretches, and the number of such stretches. Texts are split and hashed once."""
    owner = known_files(files).select("file_id", "project").distinct()
    windows = materialize(line_windows(texts, window), "line-windows")
    total = windows.groupBy("file_id").agg(F.count("*").alias("lines")).join(owner, "file_id").groupBy("project").agg(F.sum("lines").alias("lines"))
    w = materialize(_repeated(windows).join(owner, "file_id"), "repeated")
    # The stretches of a file that overlap or touch cover one run of lines; what is covered is the sum of the steps from each start to the next, a stretch at most.
    step = F.lead("line").over(Window.partitionBy("project", "file_id").orderBy("line")) - F.col("line")
    covered = w.select("project", "file_id", "line").distinct().select("project", F.least(F.coalesce(step, F.lit(window)), F.lit(window)).alias("n")).groupBy("project").agg(F.sum("n").alias("duplicated"))
    blocks = w.select("project", "low", "high").distinct().groupBy("project").agg(F.count("*").alias("blocks"))
    return (total.join(covered, "project", "left").join(blocks, "project", "left").na.fill(0, ["duplicated", "blocks"])
            .withColumn("percent", F.round(F.col("duplicated") / F.col("lines"), 6)))


def debt_minutes(cycles: Column, dead: Column, god: Column, complex_: Column, duplicates: Column) -> Column:
    w = DEBT_MINUTES
    return cycles * w["cycles"] + dead * w["dead"] + god * w["god"] + complex_ * w["complex"] + duplicates * w["duplicates"]


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def health_scores(rows: DataFrame) -> DataFrame:
    """A score of 0 to 10 with its five parts, a colour band and the technical debt, for rows with mean_complexity, cycles, god, files, dead, functions, percent,
    modularity, complex and blocks.

    Complexity loses a tenth of its mean; cycles and half of the god files are measured against a tenth of the files, 10 at least; dead code loses its share of
    all functions, duplication its share of all lines; cohesion is the modularity, 0 where that is negative.
    """
    c = F.col
    parts = {
        "complexity": 10 - clamp(c("mean_complexity") / 10, 0.0, 10.0),
        "coupling": F.when(c("files") <= 0, 10.0).otherwise(10 - clamp((c("cycles") + 0.5 * c("god")) / F.greatest(0.1 * c("files"), F.lit(10.0)) * 10, 0.0, 10.0)),
        "dead_code": 10 * (1 - c("dead") / F.greatest(c("functions"), F.lit(1))),
        "duplication": 10 * (1 - clamp(c("percent"), 0.0, 1.0)),
        "cohesion": 10 * clamp(c("modularity"), 0.0, 1.0),
    }
    rows = rows.withColumns({f"{k}_score": F.round(v, 4) for k, v in parts.items()})
    score = F.round(sum((F.col(f"{k}_score") * w for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0)), 2)
    minutes = debt_minutes(c("cycles"), c("dead"), c("god"), c("complex"), c("blocks"))
    return (rows.withColumn("score", score).withColumn("band", F.when(F.col("score") < 4, "red").when(F.col("score") < 7, "amber").otherwise("green"))
            .withColumn("debt_minutes", minutes).withColumn("debt_hours", F.round(minutes / 60, 1)))


def health_inputs(files: DataFrame, symbols: DataFrame, texts: DataFrame, components: DataFrame, modularity: DataFrame) -> DataFrame:
    """The rows of :func:`health_scores`, one a project; ``components`` and ``modularity`` are those of its graph, by scope. What is unknown is 0."""
    n_files = known_files(files).groupBy("project").agg(F.countDistinct("file_id").alias("files"))
    cx = sym.complexity_histogram(symbols).groupBy("project").agg(F.max("high").alias("complex"), F.sum("functions").alias("functions"), F.max("mean").alias("mean_complexity"))
    called = materialize(sym.calls(symbols, texts), "calls")
    dead = sym.dead_code(symbols, texts, called).groupBy("project").agg(F.count("*").alias("dead"))
    god = sym.top_callers(symbols, texts, calls_of=called).where("god_file").groupBy("project").agg(F.count("*").alias("god"))
    dup = duplication(texts, files).select("project", "percent", "blocks")
    cycles = components.groupBy(F.col("scope").alias("project")).agg(F.countDistinct("component").alias("cycles"))
    rows = n_files
    for part in (cx, dead, god, dup, cycles, modularity.select(F.col("scope").alias("project"), "modularity")):
        rows = rows.join(part, "project", "left")
    return rows.na.fill(0)


def health(files: DataFrame, symbols: DataFrame, texts: DataFrame, components: DataFrame, modularity: DataFrame) -> DataFrame:
    return health_scores(health_inputs(files, symbols, texts, components, modularity)).drop("mean_complexity", "functions")


def backfill(commits: DataFrame, inputs: DataFrame, existing: DataFrame | None = None, bucket: str = "week", keep: int = 500) -> DataFrame:
    """Health of past commits: the newest of each project and week, or day, by commits(sha, project, date, author), scored from inputs(project, sha, ...) as :func:`health_scores` takes, and
    merged with snapshots that exist already, which win. Nothing is checked out: the inputs are tables keyed by commit.
    """
    from codestrata.operators.history import merge_history, newest_per_bucket

    picked = newest_per_bucket(commits, bucket).select("project", "bucket", "sha", "date")
    new = health_scores(picked.join(inputs, ["project", "sha"])).select("project", "bucket", "sha", "date", "score", "band", "debt_minutes")
    return merge_history(existing if existing is not None else new.limit(0), new, ["project", "bucket"], "bucket", keep)
