"""Metrics, index options and their validation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from enum import Enum


class Metric(str, Enum):
    """What orders neighbours: a distance, lower is nearer."""

    L2 = "l2"
    COSINE = "cosine"
    IP = "ip"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        if isinstance(name, Metric):
            return name
        key = str(name).lower()
        if key not in METRIC_NAMES:
            raise ValueError(f"Unknown metric {name!r}; one of {sorted(METRIC_NAMES)}")
        return METRIC_NAMES[key]


# fixed values: names by which a metric is known
METRIC_NAMES = {"l2": Metric.L2, "l2sq": Metric.L2, "euclidean": Metric.L2, "cosine": Metric.COSINE, "cos": Metric.COSINE, "ip": Metric.IP}

ELEMENT_TYPES = ("float32", "int8")
EDGE_TYPES = ("none", "ternary", "int8", "float16", "1bit")
BUILDS = ("batch", "doubling", "serial")
FORMAT_VERSION = 4


@dataclass(frozen=True)
class IndexConfig:
    """Options of a graph index. dimensions and element_type come from the column when the index is created."""

    metric: Metric = Metric.L2
    r: int = 64
    l_insert: int = 128
    alpha: float = 1.2
    l_search: int = 100
    edge_type: str = "none"
    dimensions: int = 0
    element_type: str = ""
    shard_rows: int = 20_000
    probes: int = 0  # 0: as many as the sample of the build needs
    build: str = "batch"

    def __post_init__(self) -> None:
        object.__setattr__(self, "metric", Metric.parse(self.metric))
        for name in ("r", "l_insert", "l_search", "shard_rows", "probes"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise ValueError(f"{name} must be an integer")
            if value < (name != "probes"):
                raise ValueError(f"{name} must be greater than 0")
        if self.alpha < 1:
            raise ValueError("alpha must be at least 1")
        if self.l_insert < self.r:
            raise ValueError("l_insert must be at least r")
        if self.edge_type not in EDGE_TYPES:
            raise ValueError(f"edge_type must be one of {EDGE_TYPES}")
        if self.build not in BUILDS:
            raise ValueError(f"build must be one of {BUILDS}")
        if self.edge_type == "ternary" and self.metric is Metric.L2:
            raise ValueError("ternary codes do not approximate L2; use cosine or ip")
        if self.edge_type == "1bit" and self.metric is not Metric.COSINE:
            raise ValueError("sign bits approximate cosine alone")
        if self.element_type and self.element_type not in ELEMENT_TYPES:
            raise ValueError(f"vectors must be one of {ELEMENT_TYPES}")
        if self.dimensions < 0:
            raise ValueError("dimensions must not be negative")

    @classmethod
    def from_options(cls, options: Mapping[str, object] | None = None) -> IndexConfig:
        """Reads options by case-insensitive name, in either spelling: R, L_INSERT, L_SEARCH, or M, M0, EF_CONSTRUCTION, EF_SEARCH."""
        found: dict[str, object] = {}
        own = {f.name for f in fields(cls)} - {"dimensions", "element_type"}
        for name, value in (options or {}).items():
            key = name.lower()
            if key in own:
                found[key] = str(value).lower() if key in ("edge_type", "build") else value
            elif key in ("ef_construction", "ef_search", "m", "m0"):
                if isinstance(value, bool) or not isinstance(value, int):
                    raise ValueError(f"{name} must be an integer")
                if value < (1 if key.startswith("ef") else 2):
                    raise ValueError(f"{name} must be at least {1 if key.startswith('ef') else 2}")
                found[key] = value
            else:
                raise ValueError(f"Unknown option {name!r}")
        m, m0 = found.pop("m", None), found.pop("m0", None)
        if m is not None or m0 is not None:
            found.setdefault("r", m0 if m0 is not None else 2 * m)  # the base layer's degree; twice M unless given
        if "ef_construction" in found:
            found.setdefault("l_insert", max(found.pop("ef_construction"), found.get("r", cls.r)))
        if "ef_search" in found:
            found.setdefault("l_search", found.pop("ef_search"))
        if "r" in found and "l_insert" not in found and isinstance(found["r"], int) and found["r"] > cls.l_insert:
            found["l_insert"] = found["r"]
        return cls(**found)

    def bound(self, dimensions: int, element_type: str) -> IndexConfig:
        """The same options for a column of this size and type."""
        if dimensions <= 0:
            raise ValueError("the vector column needs at least one dimension")
        return replace(self, dimensions=dimensions, element_type=element_type)

    def to_dict(self) -> dict:
        return asdict(self) | {"metric": self.metric.value, "format_version": FORMAT_VERSION}

    @classmethod
    def from_dict(cls, found: Mapping) -> IndexConfig:
        if found.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"index format {found.get('format_version')} is not {FORMAT_VERSION}")
        return cls(**{f.name: found[f.name] for f in fields(cls)})

    def node_bytes(self) -> int:
        """Bytes of one node: vector, neighbour ids and distances, and neighbour codes."""
        element = 4 if self.element_type == "float32" else 1
        return self.dimensions * element + self.r * (8 + 4 + self.edge_bytes())

    def edge_bytes(self) -> int:
        plane = 8 * ((self.dimensions + 63) // 64)
        return {"none": 0, "ternary": 2 * plane, "1bit": plane, "int8": self.dimensions, "float16": 2 * self.dimensions}[self.edge_type]
