"""Strategies by which an operator can run, their registry, and what the session can tell about itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from vecloom.plans.provenance import Stage

#: Operations that every strategy must offer.
REQUIRED = ("distance", "knn")


@dataclass(frozen=True)
class Strategy:
    """A named set of operations; `limit` is the most cells (rows x columns) it takes, None for any."""

    name: str
    device: str
    operations: dict[str, Callable] = field(default_factory=dict)
    limit: int | None = None

    def has(self, operation: str) -> bool:
        return operation in self.operations


_registry: dict[str, Strategy] = {}


def register(strategy: Strategy, replace: bool = False) -> Strategy:
    """Add a strategy after checking its contract."""
    if not strategy.name or strategy.device not in ("driver", "executors"):
        raise ValueError("A strategy needs a name and a device, driver or executors.")
    missing = [o for o in REQUIRED if not callable(strategy.operations.get(o))]
    if missing:
        raise ValueError(f"Strategy {strategy.name} lacks operations: {', '.join(missing)}.")
    if strategy.name in _registry and not replace:
        raise ValueError(f"Strategy {strategy.name} is registered already.")
    _registry[strategy.name] = strategy
    return strategy


def registered() -> dict[str, Strategy]:
    return dict(_registry)


def call(name: str, operation: str, *args, **kwargs):
    """Run an operation of a strategy; failures name both."""
    strategy = _registry.get(name)
    if strategy is None or not strategy.has(operation):
        raise ValueError(f"Strategy {name} has no operation {operation}.")
    try:
        return strategy.operations[operation](*args, **kwargs)
    except (ValueError, TypeError) as e:
        raise type(e)(f"{e} (strategy {name}, operation {operation})") from e


@dataclass(frozen=True)
class Selection:
    strategy: str
    stage: Stage


def select(requested: str, operation: str, cells: int) -> Selection:
    """The strategy for an operation on so many cells. A named strategy is taken or refused; "auto" takes the first that is eligible."""
    if requested != "auto":
        strategy = _registry.get(requested)
        if strategy is None or not strategy.has(operation):
            raise ValueError(f"The requested strategy {requested} is not available for {operation}.")
        if strategy.limit is not None and cells > strategy.limit:
            raise ValueError(f"The requested strategy {requested} takes at most {strategy.limit} cells.")
        return Selection(requested, Stage(strategy.device, strategy.device, requested, "explicit_request"))
    for name, strategy in _registry.items():
        if strategy.has(operation) and (strategy.limit is None or cells <= strategy.limit):
            return Selection(name, Stage("auto", strategy.device, name, "first_eligible", fallback=strategy.device == "driver"))
    raise ValueError(f"No strategy is available for {operation}.")


def available() -> bool:
    """Whether a session is active."""
    active = SparkSession.getActiveSession()
    return active is not None and not active.sparkContext._jsc.sc().isStopped()


@dataclass(frozen=True)
class Diagnostics:
    status: str
    summary: str
    next_steps: list[str]
    strategies: list[dict]

    def __repr__(self) -> str:
        return f"<diagnostics: {self.status}; {self.summary}>"


def diagnostics(spark: SparkSession | None = None) -> Diagnostics:
    """What can run, and what to do if something can't."""
    spark = spark or SparkSession.getActiveSession()
    listed = [{"name": s.name, "device": s.device, "operations": sorted(s.operations), "limit": s.limit} for s in _registry.values()]
    if spark is None or not available():
        return Diagnostics("unavailable", "no active session", ["Create a SparkSession first."], listed)
    steps = []
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        steps.append("Set spark.sql.adaptive.enabled to true.")
    if not listed:
        steps.append("Import vecloom.operators.neighbors to register the strategies.")
    slots = spark.sparkContext.defaultParallelism
    return Diagnostics("ready" if not steps else "degraded", f"Spark {spark.version}, {slots} task slots, {len(listed)} strategies", steps, listed)


@dataclass(frozen=True)
class MemoryInfo:
    """Storage memory of one executor, or why it isn't known."""

    executor: str
    available: bool
    total_bytes: int | None = None
    free_bytes: int | None = None
    used_bytes: int | None = None
    used_share: float | None = None
    unit: str = "bytes"
    source: str = "storage memory status"
    reason: str | None = None

    def __repr__(self) -> str:
        return f"<memory of {self.executor}: {self.used_bytes} of {self.total_bytes} bytes used>" if self.available else f"<memory of {self.executor}: unknown, {self.reason}>"


def memory_info(spark: SparkSession | None = None) -> list[MemoryInfo]:
    """One entry for each executor; a structured failure without a session."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return [MemoryInfo("none", False, reason="no active session")]
    status, out = spark.sparkContext._jsc.sc().getExecutorMemoryStatus(), []
    it = status.iterator()
    while it.hasNext():
        pair = it.next()
        total, free = int(pair._2()._1()), int(pair._2()._2())
        out.append(MemoryInfo(str(pair._1()), True, total, free, total - free, (total - free) / total if total else None))
    return out
