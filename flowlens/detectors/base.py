"""What a detector is: a key, the features it reads, and how a window is scored.

A detector returns columns, not objects. Its batch form is a DataFrame plan
over the packets (:meth:`Detector.score`); its stream form is a set of columns
over the packets of one closed window, held as an array
(:meth:`Detector.score_elements`). Both give the same result columns.
Windows without a result are simply not in the output.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any, ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import DEFAULT_POLICY, SlicePolicy
from ..operators.windows import EVENT_TIME, FlowWindow


@dataclass(frozen=True)
class Settings:
    """Detector settings: values are read as text and parsed, missing ones take the default."""

    values: Mapping[str, Any] = field(default_factory=dict)

    def get(self, key: str) -> Any:
        return self.values.get(key)

    def text(self, key: str, default: str) -> str:
        value = self.values.get(key)
        return default if value is None else str(value)

    def integer(self, key: str, default: int) -> int:
        return int(self.text(key, str(default)))

    def number(self, key: str, default: float) -> float:
        return float(self.text(key, str(default)))

    def flag(self, key: str, default: bool) -> bool:
        return self.text(key, str(default)).lower() == "true"


class Detector:
    """Base of the detectors. Subclasses set the class attributes and the two scoring methods."""

    name: ClassVar[str]
    key: ClassVar[str | Column] = "default"
    #: reads features only, so packets are projected before the shuffle
    feature_based: ClassVar[bool] = True
    #: detail columns in output order
    details: ClassVar[tuple[str, ...]]

    def __init__(self, settings: Settings | Mapping[str, Any] | None = None):
        self.settings = settings if isinstance(settings, Settings) else Settings(settings or {})
        self.execution_mode = self.settings.text("executionMode", "")
        self.window_type = self.settings.text("windowType", "")
        self.test_run = self.settings.text("testlauf", "unknown")

    def features(self) -> list[Column]:
        """Columns needed beside ``flow_key, ts_ms, seq``; none by default."""
        return []

    def score(
        self, packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        """Window columns, ``packets_in_window`` and the details of every window that has a result."""
        raise NotImplementedError

    def score_elements(self, windows: DataFrame, order: str = EVENT_TIME) -> DataFrame:
        """Same details from ``elements``, an array of the window's packets (any order)."""
        raise NotImplementedError

    def score_running(
        self, packets: DataFrame, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        """A result after every packet. Detectors that read features are never fed packets
        one by one, so by default nothing comes out."""
        empty = packets.select("flow_key", "ts_ms", "seq").where(F.lit(False))
        return empty.withColumns({c: F.lit(None).cast("double") for c in self.details})

    def echo(self) -> dict[str, Column]:
        """Settings repeated in every result."""
        return {
            "executionMode": F.lit(self.execution_mode),
            "windowType": F.lit(self.window_type),
            "testlauf": F.lit(self.test_run),
        }


class PythonDetector:
    """A user's own sequential detector, fed with the packets of one window after another.

    Every flow has a detector of its own: what is kept beyond ``reset`` is kept across
    the windows of that flow and never seen by another.

    ``process`` gets a window's packets in order, in one or more pandas batches, so
    a window is never held in memory as a whole. ``detect`` returns the details
    or ``None``. An exception sends that window to the dead letters and leaves
    the others alone; ``reset`` runs after every window.
    """

    name: ClassVar[str] = "python"
    key: ClassVar[str | Column] = "default"
    feature_based: ClassVar[bool] = True
    #: Spark type of the details, as DDL
    schema: ClassVar[str]

    def features(self) -> list[Column]:
        return []

    def initialize(self, settings: Settings) -> None:
        """Called once per flow, before its first packet."""

    def process(self, packets: pd.DataFrame) -> None:
        raise NotImplementedError

    def detect(self) -> dict[str, Any] | None:
        raise NotImplementedError

    def detect_each(self, packets: pd.DataFrame) -> list[dict[str, Any] | None]:
        """For results after every packet, optional: processes all packets given, with what ``detect``
        would say after each. Without it packets are processed one by one."""
        raise NotImplementedError

    def reset(self) -> None:
        """Called after each window; what is kept here is carried into the flow's next window."""

    def snapshot(self) -> bytes:
        """The detector's state between two micro-batches of a stream; its attributes by default."""
        return pickle.dumps(self.__dict__)

    def restore(self, state: bytes) -> None:
        """Takes up what ``snapshot`` gave."""
        self.__dict__.update(pickle.loads(state))

    def close(self) -> None:
        """Called once when a flow has ended, or with a micro-batch."""


@contextmanager
def shippable(kind: type[PythonDetector]) -> Iterator[None]:
    """Within it the class holds no columns: keys are for the driver, and workers cannot be sent them."""
    held = [(c, n, v) for c in kind.__mro__ for n, v in vars(c).items() if isinstance(v, Column)]
    for c, n, _ in held:
        setattr(c, n, None)
    try:
        yield
    finally:
        for c, n, v in held:
            setattr(c, n, v)


_REGISTRY: dict[str, Callable[..., Detector | PythonDetector]] = {}


def register(cls):
    """Class decorator: makes a detector available under its ``name``."""
    _REGISTRY[cls.name] = cls
    return cls


def registered() -> list[str]:
    return sorted(_REGISTRY)


def create(name: str, settings: Settings | Mapping[str, Any] | None = None) -> Detector | PythonDetector:
    """The detector registered under ``name``; a package prefix before the last dot is ignored."""
    try:
        cls = _REGISTRY[name.rsplit(".", 1)[-1]]
    except KeyError:
        raise ValueError(f"no detector named {name!r}; known: {', '.join(registered())}") from None
    return cls() if issubclass(cls, PythonDetector) else cls(settings)
