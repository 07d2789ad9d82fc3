"""The library's questions as tools: each with a name, a description, a schema of its parameters, and a call that gives a DataFrame.

``call`` checks parameters against the schema, so that tools can be offered to callers that only know names and JSON.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.operators import files as fl, graph, history, search, symbols
from codestrata.tables import read

_TYPES = {"str": "string", "int": "integer", "bool": "boolean", "float": "number"}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[..., DataFrame]

    @property
    def schema(self) -> dict:
        """The parameters as JSON schema; those without a default are required."""
        given = [p for p in inspect.signature(self.run).parameters.values() if p.name not in ("spark", "folder")]
        kind = lambda p: _TYPES[p.annotation if isinstance(p.annotation, str) else p.annotation.__name__]
        return {"type": "object", "properties": {p.name: {"type": kind(p), **({} if p.default is p.empty else {"default": p.default})} for p in given},
                "required": [p.name for p in given if p.default is p.empty], "additionalProperties": False}


TOOLS: dict[str, Tool] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = Tool(f.__name__, inspect.getdoc(f) or "", f)
    return f


def call(spark: SparkSession, folder: str, name: str, /, **given) -> DataFrame:
    """Run a tool on a warehouse folder. Unknown tools, unknown or missing parameters and values of another type raise ValueError."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name}; there are {', '.join(sorted(TOOLS))}")
    schema = TOOLS[name].schema
    types = {"string": str, "integer": int, "boolean": bool, "number": (int, float)}
    wrong = [k for k, v in given.items() if k not in schema["properties"] or not isinstance(v, types[schema["properties"][k]["type"]])]
    if wrong or (missing := [k for k in schema["required"] if k not in given]):
        raise ValueError(f"{name}: {'wrong ' + ', '.join(wrong) if wrong else 'missing ' + ', '.join(missing)}")
    return TOOLS[name].run(spark, folder, **given)


@tool
def find_files(spark, folder, term: str, project: str = "") -> DataFrame:
    """Files whose name or path fits a term, best first."""
    rows = search.find_files(read(spark, folder, "files"), term)
    return (rows.where(F.col("project") == project) if project else rows).orderBy(F.desc("score"), "project", "path")


@tool
def find_symbols(spark, folder, term: str) -> DataFrame:
    """Symbols whose name holds a term, exact ones first."""
    return search.find_symbols(read(spark, folder, "symbols"), term).orderBy("tier", "name", "sid")


@tool
def search_text(spark, folder, term: str, case: bool = False, word: bool = False, regex: bool = False) -> DataFrame:
    """Lines of the source texts that hold a term."""
    return search.grep(read(spark, folder, "source_texts"), "file_id", term, case=case, word=word, regex=regex)


@tool
def call_sites(spark, folder, name: str) -> DataFrame:
    """The lines of callables that hold a name."""
    return search.call_sites(read(spark, folder, "symbols"), read(spark, folder, "source_texts"), name)


@tool
def explain(spark, folder, term: str) -> DataFrame:
    """Modules whose name holds a term: their role and what they link to and from."""
    return search.explain(graph.module_edges(read(spark, folder, "module_edges")), read(spark, folder, "modules").select(F.col("project").alias("scope"), F.col("id").alias("node")).where("scope IS NOT NULL AND node IS NOT NULL"), term)


@tool
def path_between(spark, folder, project: str, a: str, b: str, most: int = 8) -> DataFrame:
    """The shortest path between two modules of a project, whatever the direction of the links."""
    edges = graph.module_edges(read(spark, folder, "module_edges")).where(F.col("scope") == project)
    return graph.shortest_path(edges, spark.createDataFrame([(project, a, b)], "scope string, a string, b string"), most)


@tool
def impact(spark, folder, project: str, module: str, most: int = 6) -> DataFrame:
    """What depends on a module, directly or not, with the number of links."""
    edges = graph.module_edges(read(spark, folder, "module_edges")).where(F.col("scope") == project)
    return graph.distances(edges.select("scope", F.col("t").alias("s"), F.col("s").alias("t")), spark.createDataFrame([(project, module)], "scope string, start string"), most)


@tool
def dead_code(spark, folder, project: str = "") -> DataFrame:
    """Callables that nothing in their project calls."""
    rows = symbols.dead_code(read(spark, folder, "symbols"), read(spark, folder, "source_texts"))
    return rows.where(F.col("project") == project) if project else rows


@tool
def bus_factor(spark, folder) -> DataFrame:
    """How many authors hold half of each file's changes."""
    return history.bus_factor(read(spark, folder, "commits"), read(spark, folder, "commit_files"))


@tool
def project_types(spark, folder) -> DataFrame:
    """The leading language family of each project."""
    return fl.project_types(read(spark, folder, "files"))
