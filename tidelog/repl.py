"""A small shell over a table: put, get, delete, stats, help, exit."""

from __future__ import annotations

import argparse
import re
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from .model import KeyNotFound
from .table import KeyedTable, open_table

HELP = "put <key> <value>   get <key>   delete <key>   stats   help   exit"


def answer(table: KeyedTable, line: str) -> str | None:
    """What a line prints; None ends the session. The value of put keeps its spaces; white space around the key doesn't count."""
    word, _, rest = line.strip().partition(" ")
    rest = rest.strip()
    match word.lower():
        case "":
            return ""
        case "put":
            parts = re.split(r"\s+", rest, maxsplit=1)
            if len(parts) < 2:
                return "usage: put <key> <value>"
            table.put([(parts[0].encode(), parts[1].encode())])
            return "OK"
        case "get":
            if not rest:
                return "usage: get <key>"
            try:
                return table.get(rest.split()[0].encode()).decode("utf-8", "replace")
            except KeyNotFound:
                return "(nil)"
        case "delete":
            if not rest:
                return "usage: delete <key>"
            table.delete([rest.split()[0].encode()])
            return "OK"
        case "stats":
            stats = table.stats()
            return f"runs: {stats['runs']}\npending segments: {stats['pending_segments']}"
        case "help":
            return HELP
        case "exit" | "quit":
            return None
    return f"unknown command: {word}"


def session(table: KeyedTable, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        said = answer(table, line)
        if said is None:
            break
        if said:
            print(said, file=out, flush=True)
    table.close()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m tidelog")
    parser.add_argument("--dir", default="./data")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    try:
        table = open_table(spark, chosen.dir)
    except Exception as e:
        print(f"the table can't be opened: {e}", file=sys.stderr)
        return 1
    session(table, sys.stdin, sys.stdout)
    return 0
