"""python -m codestrata tools | python -m codestrata TOOL FOLDER [name=value ...] [--out PATH]: run a tool on a warehouse folder and print its rows as JSON lines, or write them as Parquet."""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    from codestrata import tools

    if not args or args == ["tools"]:
        for t in tools.TOOLS.values():
            print(json.dumps({"name": t.name, "description": t.description, "parameters": t.schema}))
        return 0
    out = args[args.index("--out") + 1] if "--out" in args[:-1] else None
    plain = [a for n, a in enumerate(args) if a != "--out" and (n == 0 or args[n - 1] != "--out")]
    if len(plain) < 2 or plain[0] not in tools.TOOLS:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    name, folder, *pairs = plain
    kinds = tools.TOOLS[name].schema["properties"]
    given = {k: json.loads(v) if kinds.get(k, {}).get("type") in ("integer", "boolean", "number") else v for k, _, v in (p.partition("=") for p in pairs)}
    spark = SparkSession.builder.appName("codestrata").getOrCreate()
    rows = tools.call(spark, folder, name, **given)
    if out:
        rows.write.mode("overwrite").parquet(out)
        return 0
    for line in rows.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
