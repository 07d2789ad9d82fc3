"""How well a project is set up for automated work, scored from the files it has and what some of them say.

Evidence is a table: a signal of a dimension, the files that give it by path, what their text must hold, its points, and how many files may give it. Only the texts of the few files whose
contents matter are joined. Each dimension is capped; the weighted sum gives a level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.operators.files import known_files


@dataclass(frozen=True)
class Signal:
    dimension: str
    name: str
    points: float
    path: str  # pattern of paths from the project's root
    text: str | None = None  # pattern that the file's text must hold
    times: int = 1  # files that count
    unless: str | None = None  # the text must not hold this


# The evidence, the weights of the dimensions, their cap and the levels.
_INSTRUCTIONS = r"^(CLAUDE\.md|AGENTS\.md|GEMINI\.md|\.github/copilot-instructions\.md)$"
_PERMISSIONS = r"(?s)^\s*\{.*\"(?:permissions|allow|deny)\"\s*:"
EVIDENCE = (
    Signal("instructions", "CLAUDE.md", 8.0, r"^CLAUDE\.md$"), Signal("instructions", "AGENTS.md", 6.0, r"^AGENTS\.md$"), Signal("instructions", "GEMINI.md", 3.0, r"^GEMINI\.md$"),
    Signal("instructions", "copilot-instructions.md", 3.0, r"^\.github/copilot-instructions\.md$"), Signal("instructions", "more than 50 lines of instructions", 2.0, _INSTRUCTIONS, r"(?:[^\n]*\n){50}[^\n]"),
    Signal("instructions", ".cursorrules", 2.0, r"^\.cursorrules(/|$)"), Signal("instructions", ".cursor/rules", 2.0, r"^\.cursor/rules(/|$)"), Signal("instructions", ".windsurf/rules", 2.0, r"^\.windsurf/rules(/|$)"),
    Signal("harness_config", ".claude/settings.json", 4.0, r"^\.claude/settings\.json$"), Signal("harness_config", ".claude/settings.local.json", 2.0, r"^\.claude/settings\.local\.json$"), Signal("harness_config", ".mcp.json", 4.0, r"^\.mcp\.json$"),
    Signal("harness_config", ".claude/hooks", 2.0, r"^\.claude/hooks/"), Signal("harness_config", ".claude/commands", 2.0, r"^\.claude/commands/"), Signal("harness_config", ".claude/skills", 2.0, r"^\.claude/skills/"),
    Signal("harness_config", ".claude/agents", 3.0, r"^\.claude/agents/"), Signal("harness_config", ".gemini", 2.0, r"^\.gemini/"), Signal("harness_config", ".cursor", 2.0, r"^\.cursor/"), Signal("harness_config", ".windsurf", 2.0, r"^\.windsurf/"),
    Signal("loop_engineering", "tests folder", 2.0, r"^tests/"), Signal("loop_engineering", "test files", 3.0, r"^tests/(test_[^/]*|[^/]*_test)\.py$"), Signal("loop_engineering", "workflow", 4.0, r"^\.github/workflows/[^/]*\.ya?ml$"),
    Signal("loop_engineering", "pyproject.toml", 1.5, r"^pyproject\.toml$"), Signal("loop_engineering", "ruff.toml", 1.0, r"^ruff\.toml$"), Signal("loop_engineering", ".eslintrc.json", 1.0, r"^\.eslintrc\.json$"),
    Signal("loop_engineering", ".eslintrc.js", 1.0, r"^\.eslintrc\.js$"), Signal("loop_engineering", "eslint.config.js", 1.0, r"^eslint\.config\.js$"), Signal("loop_engineering", "Makefile", 1.0, r"^Makefile$"),
    Signal("loop_engineering", "package.json", 0.5, r"^package\.json$"), Signal("loop_engineering", "stated test command", 2.0, _INSTRUCTIONS, r"(?i)pytest|npm\s+run\s+test|npm\s+test|go\s+test|cargo\s+test|jest\b|vitest\b"),
    Signal("memory_learning", "LESSONS.md", 5.0, r"^LESSONS\.md$"), Signal("memory_learning", "dated lessons", 4.0, r"^LESSONS\.md$", r"##\s+\S+-\S+\s+\(\d{4}-\d{2}-\d{2}\)"), Signal("memory_learning", "memory file", 2.0, r"^(memory|MEMORY)[^/]*\.md$"),
    Signal("memory_learning", "learning files", 2.0, r"^\.claude/memory/[^/]*\.md$"), Signal("memory_learning", "change log", 3.0, r"^CHANGELOG(\.md)?$"), Signal("memory_learning", "decisions", 2.0, r"^(docs/adr|docs/decisions|ADR|adr)/"),
    Signal("delegation", "agent definition", 3.0, r"^\.claude/agents/[^/]*\.md$", times=2), Signal("delegation", "workflow definitions", 3.0, r"^(workflow|workflows|agents)/[^/]*\.(md|ya?ml)$"),
    Signal("delegation", "dispatch file", 2.0, r"^(\.claude/)?([^/]*dispatch[^/]*|[^/]*subagent[^/]*)\.md$"), Signal("delegation", "delegation in instructions", 0.5, _INSTRUCTIONS, r"(?i)\b(subagent|dispatch|delegate|orchestrat)\w*\b", times=2),
    Signal("safety_governance", "permissions", 4.0, r"^\.claude/settings\.json$", _PERMISSIONS), Signal("safety_governance", "settings without permissions", 1.0, r"^\.claude/settings\.json$", unless=_PERMISSIONS),
    Signal("safety_governance", "ignored .env", 4.0, r"^\.gitignore$", r"(?m)^(\*)?\.env\b"), Signal("safety_governance", "limits in instructions", 2.0, _INSTRUCTIONS, r"(?i)\b(do\s+not\s+touch|never\s+touch|do\s+not\s+edit|prohibit|never\s+commit)\b"))
THIN, THIN_LINES, NO_ENV = ("instructions", "thin index", 2.0), 150, ("safety_governance", "no .env", 1.0)
WEIGHTS = {"instructions": 0.20, "harness_config": 0.15, "loop_engineering": 0.20, "memory_learning": 0.15, "delegation": 0.15, "safety_governance": 0.15}
CAP = 10.0
LEVELS = ((8.0, "self_improving"), (6.0, "engineered"), (4.0, "structured"), (2.0, "basic"), (0.0, "none_adhoc"))
MEMORY_NEEDED = 6.0  # of the dimension memory_learning, for the highest level


def _lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.size(F.split(F.regexp_replace(text, r"\r\n?|\n$", "\n"), "\n")) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)).otherwise(0)


def evidence(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(project, dimension, signal, points, example) for each signal a project gives; points are those of all files that count, the least path is the example."""
    known = known_files(files).select("project", "file_id", "path").distinct()
    wanted = "|".join(f"(?:{s.path})" for s in EVIDENCE if s.text or s.unless)
    read = known.where(F.col("path").rlike(wanted)).join(texts.select("file_id", "text"), "file_id", "left").select("project", "path", F.coalesce("text", F.lit("")).alias("text"))
    told = lambda s: F.col("text").rlike(s.text) if s.text else ~F.col("text").rlike(s.unless) if s.unless else F.lit(True)

    def hits(signals: list[Signal]) -> Column:
        return F.explode(F.filter(F.array(*(F.struct(F.lit(s.dimension).alias("dimension"), F.lit(s.name).alias("signal"), F.lit(s.points).alias("points"), F.lit(s.times).alias("times"), (F.col("path").rlike(s.path) & told(s)).alias("hit"))
                                            for s in signals)), lambda e: e["hit"])).alias("e")

    by_path = known.select("project", "path", hits([s for s in EVIDENCE if not s.text and not s.unless]))
    by_text = read.select("project", "path", hits([s for s in EVIDENCE if s.text or s.unless]))
    found = by_path.unionByName(by_text).groupBy("project", "e.dimension", "e.signal").agg((F.max("e.points") * F.least(F.count("*"), F.max("e.times"))).alias("points"), F.min("path").alias("example"))
    thin = (read.where(F.col("path").rlike(_INSTRUCTIONS)).groupBy("project").agg(F.count("*").alias("n"), F.min(F.when(_lines(F.col("text")).between(1, THIN_LINES), F.col("path"))).alias("example")).where("n >= 2 AND example IS NOT NULL")
            .select("project", F.lit(THIN[0]).alias("dimension"), F.lit(THIN[1]).alias("signal"), F.lit(THIN[2]).alias("points"), "example"))
    clean = (known.groupBy("project").agg(F.max((F.col("path") == ".env").cast("int")).alias("env")).where("env = 0")
             .select("project", F.lit(NO_ENV[0]).alias("dimension"), F.lit(NO_ENV[1]).alias("signal"), F.lit(NO_ENV[2]).alias("points"), F.lit(".").alias("example")))
    return found.unionByName(thin).unionByName(clean)


def maturity(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Capped points by dimension, the weighted score and its level for each project. The highest level needs memory as well."""
    e = evidence(files, texts)
    dims = [F.least(F.lit(CAP), F.coalesce(F.sum(F.when(F.col("dimension") == d, F.col("points"))), F.lit(0.0))).alias(d) for d in WEIGHTS]
    rows = known_files(files).select("project").distinct().join(e.groupBy("project").agg(*dims), "project", "left").na.fill(0.0)
    rows = rows.withColumn("score", F.round(sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0)), 1))
    level = F.lit(LEVELS[-1][1])
    for least, name in reversed(LEVELS):
        level = F.when((F.col("score") >= least) & (F.lit(name != LEVELS[0][1]) | (F.col("memory_learning") >= MEMORY_NEEDED)), name).otherwise(level)
    return rows.withColumn("level", level)
