"""A tool server: the six requests as tools, in JSON-RPC 2.0 messages of one line each over standard input and output.

``tools/list`` names the tools with a JSON schema of their arguments, made from the command line's own parser;
``tools/call`` runs one and answers with the text that the command line would print, or with its error.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from . import cli
from .errors import SearchError

PROTOCOL = "2024-11-05"
KINDS = {int: "integer", float: "number"}


def _verbs() -> dict[str, argparse.ArgumentParser]:
    return next(a for a in cli.parser()._actions if isinstance(a, argparse._SubParsersAction)).choices


def tools() -> list[dict]:
    helps = {a.dest: a.help for a in next(a for a in cli.parser()._actions if isinstance(a, argparse._SubParsersAction))._choices_actions}
    out = []
    for verb, parser in _verbs().items():
        own = [a for a in parser._actions if a.dest != "help"]
        properties = {a.dest: {"type": "boolean" if a.nargs == 0 else KINDS.get(a.type, "string")} | ({"description": a.help} if a.help else {}) for a in own}
        out.append({"name": verb, "description": helps[verb], "inputSchema": {"type": "object", "properties": properties, "required": [a.dest for a in own if not a.option_strings and a.nargs != "?"]}})
    return out


def arguments(verb: str, given: dict) -> list[str]:
    """A call's arguments as the command line takes them; ValueError for unknown or missing ones."""
    if verb not in _verbs():
        raise ValueError(f"no tool is called {verb}")
    own = {a.dest: a for a in _verbs()[verb]._actions if a.dest != "help"}
    if wrong := set(given) - set(own):
        raise ValueError(f"{verb} has no argument {sorted(wrong)[0]}")
    options, places = [], []
    for name, action in own.items():
        value = given.get(name)
        if not action.option_strings:
            if value is None and action.nargs != "?":
                raise ValueError(f"{verb} needs {name}")
            places += [] if value is None else [str(value)]
        elif action.nargs == 0:
            options += [action.option_strings[0]] if value else []
        elif value is not None:
            options.append(f"{action.option_strings[0]}={value}")
    return [verb, *options, "--", *places]


def call(spark: SparkSession, verb: str, given: dict, index: str | None = None) -> tuple[str, bool]:
    """(text, whether it is an error) of a tool."""
    try:
        args = cli.parser().parse_args([*([f"--index={index}"] if index else []), *arguments(verb, given)])
        return cli.run(spark, args), False
    except (SearchError, ValueError, OSError) as e:
        return f"error: {e}", True
    except SystemExit:  # the parser's way to refuse a value
        return f"error: arguments of {verb} that can't be read", True


def answer(message: dict, run: Callable[[str, dict], tuple[str, bool]]) -> dict | None:
    """The reply to a message; None for notifications."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    params = message.get("params") or {}
    match message.get("method"):
        case "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkloom", "version": "1"}}}
        case "ping":
            return reply | {"result": {}}
        case "tools/list":
            return reply | {"result": {"tools": tools()}}
        case "tools/call":
            text, failed = run(params.get("name", ""), params.get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
        case other:
            return reply | {"error": {"code": -32601, "message": f"no method {other}"}}


def serve(lines: Iterable[str], write: Callable[[str], None], run: Callable[[str, dict], tuple[str, bool]]) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(message, run) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"not JSON: {e}"}}
        if reply is not None:
            write(json.dumps(reply, ensure_ascii=False) + "\n")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom-server", description=__doc__)
    parser.add_argument("--index", help="index folder; else as on the command line")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sparkloom-server").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    def write(text: str) -> None:
        sys.stdout.write(text)
        sys.stdout.flush()

    serve(sys.stdin, write, lambda verb, args: call(spark, verb, args, given.index))
    return 0


if __name__ == "__main__":
    sys.exit(main())
