"""Command line, line protocol and tool server over one catalog. The loops run on the driver; every search is a Spark query."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time
from collections.abc import Iterable
from dataclasses import replace
from typing import TextIO

from pyspark.sql import SparkSession

from metasearch.operators import search, view
from metasearch.plans.query import Query, absolute, parse, validate
from metasearch.render import check_size
from metasearch.sources import mounts, native
from metasearch.store import Reader, Store
from metasearch.streaming import changes

DEFAULT, MOST = 50, 1000


def clamped(limit: int | None) -> int:
    return min(MOST, max(1, DEFAULT if limit is None else limit))


def answer(reader: Reader, query: Query, metadata: bool) -> dict:
    """{paths, matched, returned, search_us, records?}"""
    began = time.perf_counter()
    hits, seen = search.search(reader.rows(query), query)
    rows = hits.collect()  # at most the query's limit
    matched = seen.get["matched"]
    found = {"paths": [r["path"] for r in rows], "matched": matched, "returned": len(rows), "search_us": int((time.perf_counter() - began) * 1e6)}
    if metadata:
        found["records"] = [{"path": r["path"], "kind": r["kind"].lower(), "size": r["size"], "mtime": r["mtime"], "fs": r["fs"]} for r in rows]
    return found


def request_query(text: str, limit: int | None, scopes: list[str], case_sensitive: bool = True) -> Query:
    if not all(map(absolute, scopes)):
        raise ValueError("scopes must be absolute")
    return validate(replace(parse(text), limit=clamped(limit)).within(scopes, case_sensitive))


def line_server(reader: Reader, lines: Iterable[str], out: TextIO) -> None:
    """One JSON request a line ({query, limit, scopes, metadata}), one answer a line. A failed query answers {"error"};
    a line that is no JSON ends the server."""
    for line in lines:
        if not line.strip():
            continue
        request = json.loads(line)
        try:
            found = answer(reader, request_query(request.get("query", ""), request.get("limit"), request.get("scopes", [])), request.get("metadata", False))
        except Exception as error:  # noqa: BLE001  the client gets it
            found = {"error": str(error).splitlines()[0]}
        out.write(check_size(json.dumps(found, ensure_ascii=False)) + "\n")
        out.flush()


def allowed_roots(setting: str | None) -> list[str]:
    """Roots between path separators; unset means no restriction."""
    roots = [r for r in (setting or "").split(os.pathsep) if r]
    if not all(absolute(r) and ".." not in re.split(r"[/\\]", r) for r in roots):
        raise ValueError("allowed roots must be absolute, without ..")
    return [os.path.realpath(r) for r in roots]


class Tools:
    """The JSON-RPC tool server: initialize, ping, tools/list, tools/call."""

    def __init__(self, reader: Reader, roots: list[str]) -> None:
        self.reader, self.roots = reader, roots

    def call(self, name: str, args: dict) -> dict:
        if name == "search":
            query = request_query(args.get("query", ""), args.get("limit"), self.roots)
            try:
                hits, seen = search.search(self.reader.rows(query), query)
                rows = hits.filter(view.allowed("path", self.roots)).collect()
            except Exception as error:  # noqa: BLE001
                return {"isError": True, "content": [{"type": "text", "text": f"search failed: {str(error).splitlines()[0]}"}]}
            head = f"# matched={seen.get['matched']} returned={len(rows)}"
            text = "\n".join([head, *("\t".join(map(str, (r["path"], r["kind"], r["size"], r["mtime"], r["fs"]))) if args.get("metadata") else r["path"] for r in rows)])
            return {"content": [{"type": "text", "text": text}], "structuredContent": {"paths": [r["path"] for r in rows], "matched": seen.get["matched"], "returned": len(rows)}}
        if name == "status":
            s = self.reader.store.status()
            return {"content": [{"type": "text", "text": f"{s['records']} indexed entries; {s['store']} store; {s['bytes']} bytes"}], "structuredContent": s}
        return {"isError": True, "content": [{"type": "text", "text": f"unknown tool {name}"}]}

    def handle(self, message: dict) -> dict | None:
        """The answer; None for a notification."""
        if "id" not in message:
            return None
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "metasearch", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            text = {"type": "string"}
            result = {"tools": [
                {"name": "search", "description": "Search file metadata", "inputSchema": {"type": "object", "properties": {"query": text, "limit": {"type": "integer"}, "metadata": {"type": "boolean"}}, "required": ["query"]}},
                {"name": "status", "description": "State of the catalog", "inputSchema": {"type": "object", "properties": {}}},
            ]}
        elif method == "tools/call":
            result = self.call(params.get("name", ""), params.get("arguments") or {})
        else:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"unknown method {method}"}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def main(argv: list[str] | None = None, out: TextIO = sys.stdout, lines: Iterable[str] = sys.stdin, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="metasearch")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, help_ in (("search", "search once"), ("serve", "answer requests, one a line"), ("tools", "answer JSON-RPC, one a line"), ("index", "build from a Parquet table of files"), ("status", "show the catalog's state"), ("compact", "merge changes into a new base"), ("scan", "build from the tables of a filesystem"), ("watch", "apply a folder of event files")):
        c = commands.add_parser(name, help=help_)
        c.add_argument("--store", required=True)
        if name == "search":
            c.add_argument("query", nargs="*")
            c.add_argument("--limit", type=int)
            c.add_argument("--scope", action="append", default=[])
            c.add_argument("--json", action="store_true")
            c.add_argument("--json-paths", action="store_true")
        if name == "index":
            c.add_argument("table")
        if name == "scan":
            c.add_argument("--fs", required=True)
            c.add_argument("--prefix", default="")
            c.add_argument("--root", action="append", default=[])
            c.add_argument("--table", action="append", default=[], metavar="NAME=PARQUET", help="items (btrfs), inodes and entries (ext4), records (ntfs)")
            c.add_argument("--image", help="a volume that all executors see (ntfs)")
        if name == "watch":
            c.add_argument("--events", required=True)
            c.add_argument("--progress", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("metasearch").getOrCreate()
    store = Store(spark, args.store)
    reader = Reader(store)
    if args.command == "search":
        found = answer(reader, request_query(" ".join(args.query), args.limit, args.scope), args.json)
        out.write((json.dumps(found, ensure_ascii=False) if args.json or args.json_paths else "\n".join(found["paths"])) + "\n")
    elif args.command == "serve":
        line_server(reader, lines, out)
    elif args.command == "tools":
        tools = Tools(reader, allowed_roots(os.environ.get("METASEARCH_ROOTS")))
        for line in lines:
            if line.strip() and (reply := tools.handle(json.loads(line))) is not None:
                out.write(check_size(json.dumps(reply, ensure_ascii=False)) + "\n")
                out.flush()
    elif args.command == "index":
        m = store.build(spark.read.parquet(args.table))
        out.write(f"generation {m.generation}: {m.records} records\n")
    elif args.command == "scan":
        tables = {name: spark.read.parquet(path) for name, path in (t.split("=", 1) for t in args.table)}
        if args.image:
            tables["records"] = native.image_records(spark, args.image)
        files = native.scan(args.fs, tables, args.prefix)
        mountpoint = args.prefix or "/"
        roots = mounts.validate_roots(args.root, [mountpoint]) if args.root else []
        m = store.build(mounts.scanned(files, mountpoint, roots) if roots else files.filter(~mounts.excluded("path", mountpoint)))
        out.write(f"generation {m.generation}: {m.records} records\n")
    elif args.command == "watch":
        query = changes.follow_events(changes.read_events(spark, args.events), store, args.progress)
        query.awaitTermination()
        out.write("".join(f"batch {p['batch']}: {p['rows']} events\n" for p in changes.progress(query)))
    elif args.command == "compact":
        m = store.compact()
        out.write(f"generation {m.generation}: {m.records} records\n")
    else:
        out.write(json.dumps(store.status()) + "\n")
    return 0
