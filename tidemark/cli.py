"""A command line for a store: ``python -m tidemark.cli PATH``."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from tidemark.model import NotFound, StoreError
from tidemark.operators.script import COMMANDS
from tidemark.store import Store

HELP = "PUT key value | GET key | DELETE key | FLUSH | COMPACT | STATS | HELP | EXIT"


def run(store: Store, lines: Iterable[str]) -> Iterator[str]:
    """The answer to each command line."""
    for line in lines:
        word, _, rest = line.strip(" \t\r\n").replace("\t", " ").partition(" ")
        command, rest = word.upper(), rest.strip(" ")
        if not command:
            continue
        if command in ("EXIT", "QUIT"):
            return
        try:
            yield _answer(store, command, rest)
        except StoreError as error:
            yield f"ERROR {error}"


def _answer(store: Store, command: str, rest: str) -> str:
    key, _, value = rest.partition(" ")
    if command not in COMMANDS:
        return f"unknown command {command}; try HELP"
    if command in ("PUT", "GET", "DELETE") and not key or command == "PUT" and not value.strip():
        return f"usage: {HELP}"
    if command == "PUT":
        store.put(key, value.strip())
    elif command == "DELETE":
        store.remove(key)
    elif command == "GET":
        try:
            return store.get(key)
        except NotFound:
            return "NOT_FOUND"
    elif command == "FLUSH":
        return "OK" if store.flush() else "nothing to flush"
    elif command == "COMPACT":
        return "OK" if store.compact() else "fewer than two segments"
    elif command == "STATS":
        return f"path {store.path}, segments {store.segment_count()}, memtable {store.memtable_size()} bytes"
    elif command == "HELP":
        return HELP
    return "OK"


def main() -> None:
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    with Store(spark).open(sys.argv[1]) as store:
        for answer in run(store, sys.stdin):
            print(answer, flush=True)


if __name__ == "__main__":
    main()
