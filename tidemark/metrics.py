"""Counters, gauges and latency histograms, rendered in the Prometheus text format."""

from __future__ import annotations

import threading
from bisect import bisect_left

from tidemark.operators.stats import LATENCY_BOUNDS


def number(x: float) -> str:
    """The shortest decimal form, with an exponent below 1e-4 and from 1e21."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" not in text and abs(x) < 1e-4:
        text = f"{x:e}"
        mantissa, exponent = text.split("e")
        text = f"{mantissa.rstrip('0').rstrip('.')}e{exponent}"
    return text


class _Metric:
    kind = ""

    def __init__(self, name: str, help_: str):
        self.name, self.help, self._lock = name, help_, threading.Lock()

    def head(self) -> str:
        return f"# HELP {self.name} {self.help}\n# TYPE {self.name} {self.kind}\n"


class Counter(_Metric):
    kind = "counter"

    def __init__(self, name: str, help_: str):
        super().__init__(name, help_)
        self.value = 0

    def inc(self, by: int = 1) -> None:
        with self._lock:
            self.value += by

    def render(self) -> str:
        return f"{self.head()}{self.name} {self.value}\n"


class Gauge(Counter):
    kind = "gauge"

    def set(self, value: int) -> None:
        with self._lock:
            self.value = value


class GaugeVec(_Metric):
    kind = "gauge"

    def __init__(self, name: str, help_: str, label: str):
        super().__init__(name, help_)
        self.label, self.values = label, {}

    def set(self, of: str, value: int) -> None:
        with self._lock:
            self.values[of] = value

    def render(self) -> str:
        with self._lock:
            rows = sorted(self.values.items())
        return self.head() + "".join(f'{self.name}{{{self.label}="{of}"}} {value}\n' for of, value in rows)


class Histogram(_Metric):
    kind = "histogram"

    def __init__(self, name: str, help_: str, bounds: tuple[float, ...] = LATENCY_BOUNDS):
        super().__init__(name, help_)
        self.bounds, self.counts, self.nanos, self.count = bounds, [0] * (len(bounds) + 1), 0, 0

    def observe(self, seconds: float) -> None:
        nanos = max(0, round(seconds * 1e9))
        with self._lock:
            self.counts[bisect_left([round(b * 1e9) for b in self.bounds], nanos)] += 1
            self.nanos += nanos
            self.count += 1

    def render(self) -> str:
        with self._lock:
            counts, nanos, count = list(self.counts), self.nanos, self.count
        out, total = [self.head()], 0
        for bound, n in zip(self.bounds, counts, strict=False):
            total += n
            out.append(f'{self.name}_bucket{{le="{number(bound)}"}} {total}\n')
        return "".join([*out, f'{self.name}_bucket{{le="+Inf"}} {count}\n{self.name}_sum {number(nanos / 1e9)}\n{self.name}_count {count}\n'])


class Registry:
    def __init__(self) -> None:
        self._metrics: list[_Metric] = []

    def add(self, metric):
        self._metrics.append(metric)
        return metric

    def render(self) -> str:
        return "".join(m.render() for m in list(self._metrics))


class StoreMetrics:
    """The metrics of one store."""

    def __init__(self, registry: Registry, prefix: str = "tidemark"):
        def counter(name: str, help_: str) -> Counter:
            return registry.add(Counter(f"{prefix}_{name}", help_))

        def gauge(name: str, help_: str) -> Gauge:
            return registry.add(Gauge(f"{prefix}_{name}", help_))

        def latency(name: str, help_: str) -> Histogram:
            return registry.add(Histogram(f"{prefix}_{name}_duration_seconds", help_))

        self.puts = counter("puts_total", "Puts, a row of a batch each.")
        self.deletes = counter("deletes_total", "Deletes, a row of a batch each.")
        self.gets = counter("gets_total", "Gets, those of snapshots too.")
        self.get_hits = counter("get_hits_total", "Gets that found a value.")
        self.get_misses = counter("get_misses_total", "Gets that found none.")
        self.scans = counter("scans_total", "Scans started, those of snapshots too.")
        self.flushes = counter("flushes_total", "Flushes attempted.")
        self.flush_failures = counter("flush_failures_total", "Flushes that failed.")
        self.compactions = counter("compactions_total", "Compactions attempted.")
        self.compaction_failures = counter("compaction_failures_total", "Compactions that failed.")
        self.snapshots_opened = counter("snapshots_opened_total", "Snapshots opened.")
        self.memory_entries = gauge("memtable_entries", "Keys in memory.")
        self.immutable_tables = gauge("immutable_memtables", "Memory tables that wait for their flush.")
        self.runs = gauge("runs_total", "Runs on all levels.")
        self.runs_per_level = registry.add(GaugeVec(f"{prefix}_runs_per_level", "Runs on each level.", "level"))
        self.active_snapshots = gauge("active_snapshots", "Open snapshots.")
        self.write_seconds = latency("write", "Seconds of a put or delete call.")
        self.get_seconds = latency("get", "Seconds of a get.")
        self.flush_seconds = latency("flush", "Seconds of a flush.")
        self.compaction_seconds = latency("compaction", "Seconds of a compaction.")
