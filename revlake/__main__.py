"""python -m revlake [--json] STORE kv get|put|delete KEY [VALUE] | STORE cluster status|members"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from revlake.sources.store import Store


def main(args: list[str], spark: SparkSession | None = None) -> int:
    as_json = "--json" in args
    args = [a for a in args if a != "--json"]
    match args:
        case [root, "kv", "get", key]:
            act = lambda s: None if (found := s.get(key)) is None else {"value": found[0].decode(errors="replace"), "revision": found[1]}
        case [root, "kv", "put", key, value]:
            act = lambda s: {"revision": s.put(key, value)}
        case [root, "kv", "delete", key]:
            act = lambda s: {"revision": s.delete(key)}
        case [root, "cluster", "status" | "members" as what]:
            act = lambda s: [r.asDict() for r in getattr(s, what)().collect()]
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    with Store.open(spark, root, write=args[2] in ("put", "delete")) as store:
        found = act(store)
    if found is None:
        print("not found", file=sys.stderr)
        return 1
    for row in found if isinstance(found, list) else [found]:
        print(json.dumps(row) if as_json else "\n".join(f"{k}: {v}" for k, v in row.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
