"""Configurations: audit, benchmark and experiment, from YAML or plain mappings, checked strictly.

Fixed values: the names of sections and fields, their defaults and the names that they may hold."""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from decimal import Decimal


class ConfigError(ValueError):
    pass


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _typed(value, kind: str, name: str):
    if kind == "float" and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    wanted = {"int": int, "float": float, "bool": bool, "str": str, "tuple": tuple}[kind]
    if kind == "tuple" and isinstance(value, list):
        value = tuple(value)
    need(isinstance(value, wanted) and (kind == "bool" or not isinstance(value, bool)), f"{name} must be of type {kind}")
    need(kind != "float" or math.isfinite(value), f"{name} must be finite")
    return value


def build(cls, given, where: str = ""):
    """``cls`` (a dataclass of sections or values) from a mapping. Unknown keys, keys that are no
    strings and values of another type are refused; missing ones take their default."""
    need(isinstance(given, dict) and all(isinstance(k, str) for k in given), f"{where or 'the configuration'} must be a mapping with string keys")
    known = {f.name: f for f in fields(cls)}
    unknown = sorted(set(given) - set(known))
    need(not unknown, f"unknown keys: {', '.join(where + k for k in unknown)}")
    values = {}
    for name, value in given.items():
        section = known[name].metadata.get("section")
        values[name] = build(section, value, f"{where}{name}.") if section else _typed(value, known[name].type, where + name)
    return cls(**values)


def section(cls):
    return field(default_factory=cls, metadata={"section": cls})


def portable_path(path: str) -> bool:
    """Relative, with forward slashes, without ``..``, drive or NUL."""
    parts = path.split("/")
    return bool(path) and "\\" not in path and "\0" not in path and not re.match("[A-Za-z]:", path) and ".." not in parts and parts[0] != ""


@dataclass(frozen=True)
class Io:
    max_image_pixels: int = 50_000_000
    thumbnail_size: int = 256
    cache_dir: str = ".twinsieve-cache"

    def __post_init__(self):
        need(self.max_image_pixels > 0 and self.thumbnail_size > 0, "sizes must be positive")
        need(portable_path(self.cache_dir), "cache_dir must be a portable relative path")


@dataclass(frozen=True)
class Phash:
    enabled: bool = True
    hamming_threshold: int = 8

    def __post_init__(self):
        need(0 <= self.hamming_threshold <= 64, "hamming_threshold must lie in 0..64")


@dataclass(frozen=True)
class Embeddings:
    enabled: bool = True
    model: str = "fake:sha256-expand-v1"
    model_revision: str = ""
    preprocessing_version: str = "rgb-v1"
    device: str = "auto"
    batch_size: int = 32

    def __post_init__(self):
        need(self.device in ("auto", "cpu", "cuda"), "device must be auto, cpu or cuda")
        need(self.batch_size > 0 and bool(self.model) and bool(self.preprocessing_version), "embeddings are incomplete")


def _hnsw(c, neighbours: int) -> None:
    need(c.hnsw_m >= 2 and c.hnsw_ef_construction >= c.hnsw_m, "hnsw_ef_construction must be at least hnsw_m")
    need(c.hnsw_ef_search >= neighbours, "hnsw_ef_search must be at least k")


@dataclass(frozen=True)
class Neighbors:
    """``index`` hnsw stands for the approximate search here, flat for the exact one."""

    index: str = "hnsw"
    k: int = 20
    cosine_threshold: float = 0.95
    hnsw_m: int = 32
    hnsw_ef_construction: int = 200
    hnsw_ef_search: int = 64

    def __post_init__(self):
        need(self.index in ("flat", "hnsw"), "index must be flat or hnsw")
        need(self.k > 0 and 0 <= self.cosine_threshold <= 1, "k must be positive and cosine_threshold lie in 0..1")
        if self.index == "hnsw":
            _hnsw(self, self.k)


@dataclass(frozen=True)
class PolicyToggles:
    exact_is_duplicate: bool = True
    phash_is_duplicate: bool = True
    embedding_only_requires_review: bool = True


@dataclass(frozen=True)
class Repair:
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    split_size_weight: float = 1.0
    class_balance_weight: float = 1.0
    random_seed: int = 42
    local_improvement_iterations: int = 250
    local_improvement_patience: int = 25

    def __post_init__(self):
        ratios = self.train_ratio, self.val_ratio, self.test_ratio
        need(all(0 < r < 1 for r in ratios), "each ratio must lie between 0 and 1")
        need(abs(sum(Decimal(str(r)) for r in ratios) - 1) <= Decimal("1e-9"), "the ratios must sum to 1")
        need(self.split_size_weight >= 0 and self.class_balance_weight >= 0, "weights must not be negative")
        need(self.split_size_weight + self.class_balance_weight > 0, "one weight must be positive")
        need(0 <= self.random_seed < 1 << 32, "random_seed must be of 32 bits")
        need(0 < self.local_improvement_patience <= self.local_improvement_iterations, "patience cannot exceed the iterations")


@dataclass(frozen=True)
class Report:
    output_dir: str = "artifacts"

    def __post_init__(self):
        need(portable_path(self.output_dir), "output_dir must be a portable relative path")


@dataclass(frozen=True)
class AuditConfig:
    io: Io = section(Io)
    phash: Phash = section(Phash)
    embeddings: Embeddings = section(Embeddings)
    neighbors: Neighbors = section(Neighbors)
    policy: PolicyToggles = section(PolicyToggles)
    repair: Repair = section(Repair)
    report: Report = section(Report)


@dataclass(frozen=True)
class Detection:
    phash_thresholds: tuple = (0, 2, 4, 6, 8, 12)
    cosine_thresholds: tuple = (0.99, 0.97, 0.95, 0.90, 0.80)
    combined_phash_threshold: int = 8
    combined_cosine_threshold: float = 0.95
    embedding_only_is_duplicate: bool = False
    embedding_backend: str = "fake"
    embedding_model: str = "fake:sha256-expand-v1"
    embedding_revision: str = ""
    embedding_device: str = "auto"
    embedding_batch_size: int = 32
    source_count: int = 16

    def __post_init__(self):
        p, c = self.phash_thresholds, self.cosine_thresholds
        need(p and all(type(t) is int and 0 <= t <= 64 for t in p) and list(p) == sorted(set(p)), "phash_thresholds must be sorted integers in 0..64")
        need(c and all(isinstance(t, float) and -1 <= t <= 1 for t in c) and list(c) == sorted(set(c), reverse=True),
             "cosine_thresholds must be reverse-sorted numbers in [-1, 1]")
        need(0 <= self.combined_phash_threshold <= 64 and -1 <= self.combined_cosine_threshold <= 1, "combined thresholds are out of range")
        need(self.embedding_backend in ("fake", "dinov2"), "embedding_backend must be fake or dinov2")
        if self.embedding_backend == "fake":
            need(self.embedding_model == "fake:sha256-expand-v1", "the fake backend has one model")
        else:
            need(re.fullmatch("[0-9a-f]{40}", self.embedding_revision) is not None, "a model needs an immutable revision")
        need(self.source_count >= 2 and self.embedding_batch_size > 0, "source_count must be at least 2")


@dataclass(frozen=True)
class Scaling:
    dataset_sizes: tuple = (1_000, 5_000, 10_000)
    brute_force_max_size: int = 1_000
    phash_radius: int = 8
    embedding_source: str = "pixel_derived_fake_embeddings_not_dinov2"
    embedding_dimension: int = 64
    k: int = 10
    threads: int = 1
    hnsw_m: int = 32
    hnsw_ef_construction: int = 200
    hnsw_ef_search: int = 64

    def __post_init__(self):
        sizes = self.dataset_sizes
        need(sizes and all(type(n) is int and n > 0 for n in sizes) and list(sizes) == sorted(set(sizes)), "dataset_sizes must be sorted positive integers")
        need(self.embedding_source == "pixel_derived_fake_embeddings_not_dinov2", "embedding_source has one value")
        need(0 <= self.phash_radius <= 64 and self.brute_force_max_size > 0, "phash_radius must lie in 0..64")
        need(self.embedding_dimension > 0 and self.k > 0 and 0 < self.threads <= 1024, "sizes must be positive")
        _hnsw(self, self.k)


@dataclass(frozen=True)
class BenchmarkConfig:
    seed: int = 20260903
    detection: Detection = section(Detection)
    scaling: Scaling = section(Scaling)

    def __post_init__(self):
        need(0 <= self.seed < 1 << 32, "seed must be of 32 bits")


@dataclass(frozen=True)
class ExperimentData:
    data_dir: str = ".twinsieve-data"
    download: bool = False
    num_classes: int = 10
    train_per_class: int = 300
    validation_per_class: int = 50
    test_per_class: int = 100
    contamination_per_class: int = 20
    sampling_seed: int = 314159
    contamination: str = "resize"

    def __post_init__(self):
        need(self.contamination in ("resize", "jpeg"), "contamination must be resize or jpeg")
        need(min(self.train_per_class, self.validation_per_class, self.test_per_class, self.contamination_per_class) > 0, "counts must be positive")
        need(self.contamination_per_class <= self.train_per_class, "contamination cannot exceed the training rows")
        need(self.num_classes >= 2, "two classes are needed")


@dataclass(frozen=True)
class ExperimentRepair:
    split_size_weight: float = 1.0
    class_balance_weight: float = 1.0
    seed: int = 271828
    local_iterations: int = 250

    def __post_init__(self):
        need(self.split_size_weight >= 0 and self.class_balance_weight >= 0, "weights must not be negative")
        need(self.split_size_weight + self.class_balance_weight > 0 and self.local_iterations > 0, "one weight must be positive")


@dataclass(frozen=True)
class Training:
    seeds: tuple = (7, 42, 101)
    epochs: int = 3
    batch_size: int = 128
    learning_rate: float = 0.001
    weight_decay: float = 0.0001
    device: str = "auto"
    num_workers: int = 0
    augmentation: str = "none"

    def __post_init__(self):
        need(self.seeds and all(type(s) is int and s >= 0 for s in self.seeds) and len(set(self.seeds)) == len(self.seeds), "seeds must be distinct")
        need(self.epochs > 0 and self.batch_size > 0 and self.learning_rate > 0 and self.weight_decay >= 0, "training sizes must be positive")
        need(self.augmentation == "none", "augmentation has one value")


@dataclass(frozen=True)
class ExperimentConfig:
    data: ExperimentData = section(ExperimentData)
    repair: ExperimentRepair = section(ExperimentRepair)
    training: Training = section(Training)


def load_config(cls, path: str):
    """``cls`` from a YAML file; environment variables have no part in it."""
    try:
        import yaml
    except ImportError:  # the reader is optional
        raise ConfigError("no YAML reader is installed") from None

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        need(len(keys) == len({repr(k) for k in keys}), "a key stands twice")
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        with open(path, encoding="utf-8") as file:
            given = yaml.load(file, Strict)  # noqa: S506 (a safe loader)
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as problem:
        raise ConfigError(f"the configuration cannot be read: {type(problem).__name__}") from None
    return build(cls, {} if given is None else given)


def from_environment(cls, environment: dict[str, str], prefix: str = "TWINSIEVE_"):
    """``cls`` with values of variables such as ``TWINSIEVE_PHASH__HAMMING_THRESHOLD``."""
    given: dict = {}
    for name, text in environment.items():
        if name.startswith(prefix) and "__" in name:
            part, key = name.removeprefix(prefix).lower().split("__", 1)
            spec = next((f for f in fields(cls) if f.name == part and f.metadata.get("section")), None)
            kind = next((f.type for f in fields(spec.metadata["section"]) if f.name == key), "str") if spec else "str"
            try:
                value = {"int": int, "float": float, "bool": lambda t: {"true": True, "false": False}[t.lower()]}.get(kind, str)(text)
            except (ValueError, KeyError):
                raise ConfigError(f"{name} must be of type {kind}") from None
            given.setdefault(part, {})[key] = value
    return build(cls, given)


def plain(config) -> dict:
    """The configuration as plain values, for canonical JSON and hashes."""
    need(is_dataclass(config), "no configuration")
    return asdict(config)
