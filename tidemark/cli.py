"""Command line: a prompt over a store, an HTTP server, or a load test."""

from __future__ import annotations

import argparse
import json
import logging
import os
import random
import signal
import sys
import threading
import time
from typing import TextIO

from tidemark import serve
from tidemark.functions.codec import quoted
from tidemark.model import NotFoundError, StoreError, StoreOptions
from tidemark.plans.store import Snapshot, Store

HELP = """PUT <key> <value>, GET <key>, DELETE <key>: one key
SCAN <start> <end> [limit]: keys from start up to, without, end; "" leaves a side open
SNAPSHOT, SNAPSHOT-END: stay at the present state, and leave it
STATS, EXIT"""


class Prompt:
    """Reads commands line by line; a name in any case."""

    def __init__(self, store: Store, out: TextIO):
        self.store, self.out, self.snapshot = store, out, None

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, lines: TextIO, name: str) -> None:
        self.say(f"store ready at {quoted(name.encode())}\n{HELP}")
        try:
            while True:
                print("(snapshot)> " if self.snapshot else "> ", end="", file=self.out, flush=True)
                line = lines.readline()
                if not line:
                    self.say("")
                    return
                if line.strip() and not self.obey(line.strip()):
                    return
        finally:
            if self.snapshot:
                self.snapshot.close()

    def obey(self, line: str) -> bool:
        """False to leave."""
        name, *rest = line.split(" ", 2)
        command = {"PUT": self.put, "GET": self.get, "DELETE": self.delete, "DEL": self.delete, "SCAN": self.scan, "SNAPSHOT": self.open, "SNAPSHOT-END": self.end, "STATS": self.stats}.get(name.upper())
        if name.upper() in ("EXIT", "QUIT"):
            return False
        if command is None:
            self.say(f"unknown command {quoted(name.encode())}")
            return True
        try:
            command(rest)
        except StoreError as error:
            self.say(f"error: {error}")
        return True

    @property
    def view(self) -> Store | Snapshot:
        return self.snapshot or self.store

    def put(self, args: list[str]) -> None:
        if len(args) < 2:
            self.say("usage: PUT <key> <value>")
            return
        self.store.put(args[0].encode(), args[1].encode())
        self.say("OK")

    def get(self, args: list[str]) -> None:
        self.say(quoted(self.view.get(args[0].encode())) if args else "usage: GET <key>")

    def delete(self, args: list[str]) -> None:
        if not args:
            self.say("usage: DELETE <key>")
            return
        self.store.delete(args[0].encode())
        self.say("OK")

    def scan(self, args: list[str]) -> None:
        words = " ".join(args).split()
        start, end = (w.strip('"').encode() if w and w != '""' else None for w in [*words, "", ""][:2])
        try:
            limit = int(words[2]) if len(words) > 2 else 0
        except ValueError:
            self.say(f"error: invalid limit: {words[2]}")
            return
        n = 0
        if limit >= 0:  # a negative limit gives no rows
            for row in self.view.scan(start, end, limit).toLocalIterator():
                self.say(f"{bytes(row['key']).decode('utf-8', 'replace')} = {quoted(bytes(row['value']))}")
                n += 1
        self.say(f"({n} entries)")

    def open(self, _: list[str]) -> None:
        if self.snapshot:
            self.say(f"reads are at seq {self.snapshot.seq} already")
            return
        self.snapshot = self.store.snapshot()
        self.say(f"reads stay at seq {self.snapshot.seq} until SNAPSHOT-END")

    def end(self, _: list[str]) -> None:
        if not self.snapshot:
            self.say("reads are at the newest state already")
            return
        self.snapshot.close()
        self.snapshot = None
        self.say("reads are at the newest state")

    def stats(self, _: list[str]) -> None:
        self.say(stats_line(self.store))


def stats_line(store: Store) -> str:
    s = store.stats()
    levels = ", ".join(f"{n} on level {i}" for i, n in enumerate(s["runs_per_level"]) if n) or "none"
    return f"{s['memtable_entries']} keys in memory; {s['runs']} runs: {levels}"


def load_test(store: Store, workers: int, ops: int, out: TextIO) -> None:
    """Each worker puts, seven times out of ten, or gets a random one of 1,000 keys of its own.

    The report is a line of JSON: counts, operations a second, and percentiles of their milliseconds by kind.
    """
    counts, spent, lock = {"puts": 0, "gets": 0, "errors": 0}, {"puts": [], "gets": [], "errors": []}, threading.Lock()

    def work(worker: int) -> None:
        rng = random.Random()
        for _ in range(ops):
            key = f"bench-worker-{worker}-key-{rng.randrange(1000)}".encode()
            kind, start = "puts" if rng.randrange(10) < 7 else "gets", time.perf_counter()
            try:
                if kind == "puts":
                    store.put(key, rng.randbytes(64))
                else:
                    store.get(key)
            except NotFoundError:
                pass
            except StoreError:
                kind = "errors"
            with lock:
                counts[kind] += 1
                spent[kind].append(1000 * (time.perf_counter() - start))

    began = time.perf_counter()
    threads = [threading.Thread(target=work, args=(i,)) for i in range(workers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    took = time.perf_counter() - began
    ms = {kind: {f"p{q}": round(sorted(x)[min(len(x) - 1, len(x) * q // 100)], 3) for q in (50, 95, 99)} for kind, x in spent.items() if x}
    report = {"workers": workers, **counts, "seconds": round(took, 3), "a_second": round((counts["puts"] + counts["gets"]) / took, 1), "ms": ms}
    print(f"{json.dumps(report)}\n{stats_line(store)}", file=out)


class _JsonLog(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "msg": record.getMessage()})


def parser() -> argparse.ArgumentParser:
    usual = StoreOptions()
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--dir", default="./tidemark-data", help="folder of the store")
    p.add_argument("--bench", action="store_true", help="run a load test instead of the prompt")
    p.add_argument("--bench-workers", type=int, default=8)
    p.add_argument("--bench-ops", type=int, default=50_000, help="operations of each worker")
    p.add_argument("--serve", action="store_true", help="run an HTTP server instead of the prompt")
    p.add_argument("--addr", default=":8080", help="where --serve listens")
    p.add_argument("--debug-addr", default=":6060", help="where metrics are served; empty for nowhere")
    p.add_argument("--flush-threshold", type=int, default=usual.flush_threshold)
    p.add_argument("--l0-compaction-trigger", type=int, default=usual.l0_trigger)
    p.add_argument("--base-level-size", type=int, default=usual.base_level_bytes)
    p.add_argument("--level-size-multiplier", type=int, default=usual.level_multiplier)
    p.add_argument("--compress", action="store_true", help="compress new runs")
    p.add_argument("--log-json", action="store_true", help="log lines as JSON")
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parser().parse_args(argv)
    handler = logging.StreamHandler()
    if a.log_json:
        handler.setFormatter(_JsonLog())
    logging.basicConfig(level=logging.INFO, handlers=[handler])
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    options = StoreOptions(a.flush_threshold, a.l0_compaction_trigger, a.base_level_size, a.level_size_multiplier, compress=a.compress)
    folder = a.dir if "://" in a.dir else os.path.abspath(a.dir)
    with Store(spark, folder, options) as store:
        if a.debug_addr:
            serve.start(store, a.debug_addr, metrics=True)
        if a.bench:
            load_test(store, a.bench_workers, a.bench_ops, sys.stdout)
        elif a.serve:
            done = threading.Event()
            for sig in (signal.SIGINT, signal.SIGTERM):
                signal.signal(sig, lambda *_: done.set())
            server = serve.start(store, a.addr)
            done.wait()
            server.shutdown()
        else:
            Prompt(store, sys.stdout).run(sys.stdin, a.dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
