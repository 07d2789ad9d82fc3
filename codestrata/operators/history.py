"""Version-history analytics over commits and the files they change.

Conventions for all functions here: a row delivered twice counts once; a null or blank author is 'Unknown'; null counts are 0;
null and empty paths are no files; commits without files count as commits. Every ranking has an explicit tie key, so results don't
depend on order of arrival. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_BASKET, MAX_BASKET = 2, 20
FALLBACK_DAYS = (180, 365, 730, 1460, 3650)


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def known_commits(commits: DataFrame) -> DataFrame:
    author = F.trim("author")
    return (commits.where("sha IS NOT NULL AND project IS NOT NULL")
            .select("sha", "project", F.col("date").cast("date").alias("date"), F.when(F.length(author) > 0, author).otherwise("Unknown").alias("author")).distinct())


def known_changes(commit_files: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (commit_files.where("sha IS NOT NULL")
            .select("sha", clean_path(F.col("path")).alias("path"), F.coalesce("add", zero).alias("add"), F.coalesce("del", zero).alias("del"))
            .where("path <> ''").distinct())


def changes(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(project, date, author, sha, path, add, del): one row for each file of a known commit."""
    return known_changes(commit_files).join(known_commits(commits), "sha")


def commit_totals(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """One row a commit with its lines; commits without files have none."""
    per = known_changes(commit_files).groupBy("sha").agg(F.sum("add").alias("add"), F.sum("del").alias("del"), F.count("*").alias("files"))
    return known_commits(commits).join(per, "sha", "left").na.fill(0, ["add", "del", "files"])


def _activity(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("commits"), F.sum("add").alias("add"), F.sum("del").alias("del"))


def week_of(date: Column) -> Column:
    """The Monday of a date."""
    return F.date_trunc("week", date).cast("date")


def author_activity(commits: DataFrame, commit_files: DataFrame, top: int = 20) -> DataFrame:
    """Commits, lines and share of commits of the ``top`` authors of each project (a top-k report)."""
    rows = _activity(commit_totals(commits, commit_files), "project", "author")
    total = known_commits(commits).groupBy("project").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("commits"), "author"))
    return (rows.withColumn("rank", rank).where(F.col("rank") <= top).join(total, "project")
            .withColumn("share", F.round(F.col("commits") / F.col("total"), 3)).drop("total"))


def timeline(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Commits and lines of each project and week."""
    return _activity(commit_totals(commits, commit_files).where("date IS NOT NULL").withColumn("week", week_of(F.col("date"))), "project", "week")


def daily(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    return _activity(commit_totals(commits, commit_files).where("date IS NOT NULL"), "project", "date")


def file_churn(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Change rows (not distinct commits) and lines of each file. All files come out; to order them is left to whoever shows them."""
    return changes(commits, commit_files).groupBy("project", "path").agg(F.count("*").alias("changes"), F.sum("add").alias("add"), F.sum("del").alias("del"))


def file_timeline(commits: DataFrame, commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """Weekly commits and lines of each file that the current scan still holds; a commit counts once a file."""
    live = files.select("project", "path").distinct()
    return (changes(commits, commit_files).where("date IS NOT NULL").join(live, ["project", "path"], "left_semi")
            .groupBy("project", "path", week_of(F.col("date")).alias("week"))
            .agg(F.countDistinct("sha").alias("commits"), F.sum("add").alias("add"), F.sum("del").alias("del")))


def commits_by_day(commits: DataFrame, commit_files: DataFrame, shown: int = 60) -> DataFrame:
    """Each commit with its first ``shown`` files by path, and whether some are not shown. Files beyond are cut before they are gathered."""
    nth = F.row_number().over(Window.partitionBy("sha").orderBy("path", "add", "del"))
    lists = (known_changes(commit_files).withColumn("nth", nth).groupBy("sha")
             .agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "path")))).alias("files")))
    return (known_commits(commits).join(lists, "sha", "left")
            .select("project", "date", "sha", "author", F.coalesce("n_files", F.lit(0)).alias("n_files"),
                    F.coalesce(F.concat_ws("\n", F.col("files.path")), F.lit("")).alias("files"), (F.coalesce("n_files", F.lit(0)) > shown).alias("capped")))


def change_groups(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Changes and lines of each file by author, by week and by day: one pass with grouping sets."""
    rows = changes(commits, commit_files).withColumn("week", week_of(F.col("date")))
    out = rows.groupingSets([["project", "author", "path"], ["project", "week", "path"], ["project", "date", "path"]], "project", "author", "week", "date", "path").agg(
        F.grouping("author").alias("g_author"), F.grouping("week").alias("g_week"), F.count("*").alias("changes"), F.sum("add").alias("add"), F.sum("del").alias("del"))
    grain = F.when(F.col("g_author") == 0, "author").when(F.col("g_week") == 0, "week").otherwise("day")
    return out.select(grain.alias("grain"), "project", "author", "week", "date", "path", "changes", "add", "del")


def bus_factor(commits: DataFrame, commit_files: DataFrame, min_commits: int = 3) -> DataFrame:
    """How few authors together made more than half of a file's commits, and the first author's share with its risk."""
    per = changes(commits, commit_files).groupBy("project", "path", "author").agg(F.countDistinct("sha").alias("n"))
    file = Window.partitionBy("project", "path")
    order = file.orderBy(F.desc("n"), "author")
    ranked = (per.withColumns({"total": F.sum("n").over(file), "rank": F.row_number().over(order),
                               "upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
              .where(F.col("total") >= min_commits))
    share = F.round(F.max(F.when(F.col("rank") == 1, F.col("n") / F.col("total"))), 3)
    out = ranked.groupBy("project", "path").agg(
        F.max("total").alias("commits"), F.max("rank").alias("authors"), F.min(F.when(F.col("upto") * 2 > F.col("total"), F.col("rank"))).alias("bus_factor"),
        F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("primary_author"), share.alias("primary_share"))
    return out.withColumn("risk", F.when(F.col("primary_share") >= 0.8, "high").when(F.col("primary_share") >= 0.5, "medium").otherwise("low"))


def file_complexity(symbols: DataFrame) -> DataFrame:
    """Mean complexity of the functions and methods of each file; unknown complexities are skipped."""
    kind = F.lower(F.trim("kind"))
    return (symbols.where(kind.isin("function", "method") & F.col("complexity").isNotNull()).select("sid", "project", "file", "complexity").distinct()
            .groupBy("project", F.col("file").alias("path")).agg(F.avg("complexity").alias("complexity")))


def hotspots(commits: DataFrame, commit_files: DataFrame, symbols: DataFrame, top: int = 20) -> DataFrame:
    """Files ranked by churn times complexity, both scaled by the project's largest; unknown complexity counts half (a top-k report)."""
    project = Window.partitionBy("project")
    rows = file_churn(commits, commit_files).select("project", "path", "changes").join(file_complexity(symbols), ["project", "path"], "left")
    rows = rows.join(rows.groupBy("project").agg(F.max("changes").alias("top_changes"), F.max("complexity").alias("top_complexity")), "project")
    scaled = F.coalesce(F.col("complexity") / F.col("top_complexity"), F.lit(0.5))
    rows = rows.withColumn("score", F.round(100 * (F.col("changes") / F.col("top_changes")) * scaled, 4))
    rank = F.row_number().over(project.orderBy(F.desc("score"), F.desc("changes"), "path"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("project", "path", "changes", F.round("complexity", 4).alias("complexity"), "score", "rank")


def peak_week(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Totals of each project and its busiest week, the first on ties."""
    w = timeline(commits, commit_files)
    return w.groupBy("project").agg(F.sum("commits").alias("commits"), F.sum("add").alias("add"), F.sum("del").alias("del"), F.count("*").alias("weeks"),
                                    F.min_by("week", F.struct(-F.col("commits"), "week")).alias("peak_week"), F.max("commits").alias("peak_commits"))


def heatmap(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Every day of each project's life, from the Monday of its first week, with its commits (0 for quiet days) and the project's busiest."""
    d = daily(commits, commit_files).select("project", "date", "commits")
    span = d.groupBy("project").agg(week_of(F.min("date")).alias("first"), F.max("date").alias("last"), F.max("commits").alias("most"))
    days = span.select("project", "most", F.explode(F.sequence("first", "last")).alias("date"))
    return days.join(d, ["project", "date"], "left").select("project", "date", F.coalesce("commits", F.lit(0)).alias("commits"), "most")


def initial_range(commits: DataFrame) -> DataFrame:
    """How many days a project's heat map shows at first: 180 if it spans more, else all."""
    span = F.datediff(F.max("date"), F.min("date")) + 1
    return known_commits(commits).where("date IS NOT NULL").groupBy("project").agg(span.alias("span")).select("project", "span", F.when(F.col("span") > 180, 180).otherwise(F.col("span")).alias("days"))


def recent(commits: DataFrame, commit_files: DataFrame, days: int = 90) -> DataFrame:
    """Daily rows of the last ``days`` days before each project's latest activity."""
    d = daily(commits, commit_files)
    last = F.max("date").over(Window.partitionBy("project"))
    return d.withColumn("last", last).where(F.col("date") >= F.date_sub(F.col("last"), days)).drop("last")


def newest_per_bucket(commits: DataFrame, bucket: str = "week") -> DataFrame:
    """The newest commit of each project and ISO week, or day; the greatest sha on ties."""
    at = week_of(F.col("date")) if bucket == "week" else F.col("date")
    rows = known_commits(commits).where("date IS NOT NULL").withColumn("bucket", at)
    nth = F.row_number().over(Window.partitionBy("project", "bucket").orderBy(F.desc("date"), F.desc("sha")))
    return rows.withColumn("nth", nth).where("nth = 1").select("project", "bucket", "sha", "date", "author")


def window_fallback(commits: DataFrame, until: str, windows: tuple[int, ...] = FALLBACK_DAYS) -> DataFrame:
    """For each project the shortest window of days before ``until`` that holds a commit, with its commits; the longest if none does."""
    age = F.datediff(F.to_date(F.lit(until)), "date")
    rows = known_commits(commits).where("date IS NOT NULL").withColumn("age", age).where("age >= 0")
    pick = F.lit(windows[-1])
    for n in reversed(windows):
        pick = F.when(F.col("nearest") <= n, n).otherwise(pick)
    nearest = rows.groupBy("project").agg(F.min("age").alias("nearest")).withColumn("days", pick)
    return rows.join(nearest, "project").groupBy("project", "days").agg(F.count(F.when(F.col("age") <= F.col("days"), 1)).alias("commits"))


def top_coupling(commits: DataFrame, commit_files: DataFrame, min_together: int = 3, top: int = 30) -> DataFrame:
    """The ``top`` file pairs of each project by common commits, of commits with 2 to 20 files, and their share of all commits (a top-k report).

    Only baskets within the size bound are paired, so a commit gives at most 190 pairs.
    """
    rows = known_changes(commit_files).select("sha", "path").distinct()
    sizes = rows.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n").between(MIN_BASKET, MAX_BASKET)).select("sha")
    owners = known_commits(commits).select("sha", "project").distinct()
    baskets = rows.join(sizes.join(owners, "sha"), "sha").groupBy("project", "sha").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    pairs = (baskets.select("project", "paths", F.posexplode("paths").alias("i", "file_a"))
             .select("project", "file_a", F.explode(F.slice("paths", F.col("i") + 2, F.size("paths"))).alias("file_b"))
             .groupBy("project", "file_a", "file_b").agg(F.count("*").alias("together")).where(F.col("together") >= min_together))
    total = owners.groupBy("project").agg(F.count("*").alias("commits"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("together"), "file_a", "file_b"))
    return (pairs.join(total, "project").withColumn("support", F.round(F.col("together") / F.col("commits"), 3)).withColumn("rank", rank)
            .where(F.col("rank") <= top).drop("commits"))


def merge_history(existing: DataFrame, new: DataFrame, key: list[str], at: str, keep: int = 500) -> DataFrame:
    """Union by ``key`` where existing rows win over new ones, trimmed to the ``keep`` latest by ``at`` for each first key column."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("_new", F.desc(at)))
    latest = F.row_number().over(Window.partitionBy(key[0]).orderBy(F.desc(at), *key))
    return both.withColumn("_n", first).where("_n = 1").withColumn("_n", latest).where(F.col("_n") <= keep).drop("_n", "_new")


def daily_snapshots(commits: DataFrame, keep: int = 500) -> DataFrame:
    """One live entry a project and day, the latest commit's, trimmed to the ``keep`` latest days."""
    days = newest_per_bucket(commits, "day")
    return merge_history(days, days.limit(0), ["project", "bucket"], "bucket", keep)


def touched_complexity(touched: DataFrame, complexity: DataFrame, hotspots: DataFrame) -> DataFrame:
    """(branch, files, mean_complexity, hot_files) for touched(project, branch, path): files a branch touched, their mean of complexity(project, path, mean) where known, and how many are in hotspots(project, path)."""
    hot = hotspots.select("project", "path").distinct().withColumn("hot", F.lit(1))
    rows = touched.select("project", "branch", "path").distinct().join(complexity.select("project", "path", "mean"), ["project", "path"], "left").join(hot, ["project", "path"], "left")
    return rows.groupBy("project", "branch").agg(F.count("*").alias("files"), F.round(F.avg("mean"), 4).alias("mean_complexity"), F.count("hot").alias("hot_files"))
