"""python -m tidemark.cli [--json] [--root ROOT] get|put|delete|scan|status|metrics|config|version ..."""

import argparse
import json
import sys
from pathlib import Path

from tidemark import __version__
from tidemark.api import Engine, InvalidInput, NotFound, exit_code
from tidemark.operators.mutations import scan as scan_keys
from tidemark.sources.manifest import Generations


def render(kind: str, as_json: bool, **x) -> str:
    if as_json:
        return json.dumps(x)
    return {"get": "{value}", "put": "OK  {key} → {value}", "delete": 'Deleted "{key}"', "version": "{version}"}[kind].format(**x)


#: The settings that are kept, and what they are where nothing sets them.
SETTINGS = {"root": "tidemark-data", "output": "table"}
SETTINGS_FILE = Path.home() / ".tidemark.json"


def settings(path: Path = SETTINGS_FILE) -> dict:
    return SETTINGS | (json.loads(path.read_text()) if path.exists() else {})


def config(action: str, name: str | None, value: str | None, path: Path, out) -> None:
    """Shows all settings, or keeps one."""
    if action == "set":
        if name not in SETTINGS or value is None:
            raise InvalidInput(f"settings are {', '.join(SETTINGS)}, each set to one value")
        kept = json.loads(path.read_text()) if path.exists() else {}
        path.write_text(json.dumps(kept | {name: value}))
    for k, v in settings(path).items():
        print(f"{k}\t{v}", file=out)


def rows_out(rows, as_json: bool, out) -> None:
    for row in rows:
        print(json.dumps(row.asDict()) if as_json else "\t".join(map(str, row)), file=out)


def status_of(spark, roots: list[str]):
    """Every table in the order asked for; one that holds nothing that can be read is marked."""
    from tidemark.operators.metrics import status_all_nodes

    found = []
    for root in roots:
        if Generations(spark, root).live():
            s = Engine(spark, root).status(root).first()
            found.append((root, s.role, s.term, s.key_count))
    hosts = spark.createDataFrame(list(enumerate(roots)), "pos bigint, host string")
    return status_all_nodes(hosts, spark.createDataFrame(found, "host string, role string, term bigint, key_count bigint"))


def main(args: list[str] | None = None, spark=None, out=None, ask=input, kept: Path = SETTINGS_FILE) -> int:
    out = out or sys.stdout
    saved = settings(kept)
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--json", action="store_true", default=saved["output"] == "json")
    p.add_argument("--root", default=saved["root"])
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("get").add_argument("key")
    put = sub.add_parser("put")
    put.add_argument("key")
    put.add_argument("value", nargs="?")
    delete = sub.add_parser("delete")
    delete.add_argument("key")
    delete.add_argument("--force", action="store_true", help="do not ask first")
    scan = sub.add_parser("scan")
    for name in ("--start", "--end", "--prefix"):
        scan.add_argument(name)
    sub.add_parser("status").add_argument("--all", nargs="*", metavar="ROOT", help="of these tables, in this order")
    conf = sub.add_parser("config")
    conf.add_argument("action", choices=("show", "set"))
    conf.add_argument("name", nargs="?")
    conf.add_argument("value", nargs="?")
    for name in ("metrics", "version"):
        sub.add_parser(name)
    a = p.parse_args(args)
    if a.cmd == "version":
        print(render("version", a.json, version=__version__), file=out)
        return 0
    try:
        if a.cmd == "config":
            config(a.action, a.name, a.value, kept, out)
            return 0
        if a.cmd == "delete" and not a.force and ask(f'Delete "{a.key}"? [y/N] ').strip().lower() not in ("y", "yes"):
            print("Aborted", file=out)
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.getOrCreate()
        if a.cmd == "status" and a.all is not None:
            rows_out(status_of(spark, a.all).drop("pos").collect(), a.json, out)
            return 0
        engine = Engine(spark, a.root)
        if a.cmd == "get":
            print(render("get", a.json, key=a.key, value=engine.get(a.key)), file=out)
        elif a.cmd == "put":
            value = a.value if a.value is not None else sys.stdin.read().rstrip("\r\n")
            engine.put(spark.createDataFrame([(a.key, value)], "key string, value string"))
            print(render("put", a.json, key=a.key, value=value), file=out)
        elif a.cmd == "delete":
            if not engine.delete(spark.createDataFrame([(a.key,)], "key string")).isEmpty():
                raise NotFound(a.key)
            print(render("delete", a.json, key=a.key), file=out)
        elif a.cmd == "scan":
            rows_out(scan_keys(engine.log(), a.start, a.end, a.prefix).select("key", "value").toLocalIterator(), a.json, out)
        else:
            rows_out((engine.status() if a.cmd == "status" else engine.metrics()).collect(), a.json, out)
    except (NotFound, InvalidInput) as e:
        print(f"error: {e}", file=sys.stderr)
        return exit_code(e)
    return 0


if __name__ == "__main__":
    sys.exit(main())
