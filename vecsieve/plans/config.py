"""Typed run configurations, presets and sweeps."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from typing import ClassVar

# The two datasets are each other's held-out data.
HELD_OUT = {"roxford5k": "rparis6k", "rparis6k": "roxford5k"}
# Images and queries of each.
SIZES = {"roxford5k": (4993, 70), "rparis6k": (6322, 70)}
# The scales of multi-scale descriptors.
SCALES = (1.0, 2**-0.5, 0.5)
SOURCES = ("held_out", "sfm30k", "sfm120k", "learned")


@dataclass(frozen=True)
class HeldOutSplit:
    eval_dataset: str
    held_out_dataset: str

    def __post_init__(self):
        if self.eval_dataset not in HELD_OUT:
            raise ValueError(f"unknown dataset {self.eval_dataset}")
        if HELD_OUT[self.eval_dataset] != self.held_out_dataset:
            raise ValueError(f"{self.eval_dataset} is held out by {HELD_OUT[self.eval_dataset]}")

    @classmethod
    def of(cls, dataset: str) -> HeldOutSplit:
        return cls(dataset, HELD_OUT.get(dataset, ""))


@dataclass(frozen=True)
class Bow:
    k: int = 5000
    seed: int = 0
    technique: ClassVar[str] = "bow"
    axis: ClassVar[str | None] = "k"


@dataclass(frozen=True)
class Vlad:
    k: int = 64
    seed: int = 0
    intra_norm: bool = True
    power: float | None = None
    technique: ClassVar[str] = "vlad"
    axis: ClassVar[str | None] = "k"


@dataclass(frozen=True)
class Fisher:
    k: int = 64
    seed: int = 0
    power: float = 0.5
    sample: int = 1_000_000
    technique: ClassVar[str] = "fisher"
    axis: ClassVar[str | None] = "k"


@dataclass(frozen=True)
class NeuralCodes:
    backbone: str = "alexnet"
    dim: int | None = 256
    seed: int = 0
    technique: ClassVar[str] = "neural_codes"
    axis: ClassVar[str | None] = "dim"


# The defaults of the fields below.
@dataclass(frozen=True)
class Pooled:
    backbone: str = "alexnet"
    p: float | str | None = 3.0
    max_side: int = 1024
    scales: tuple[float, ...] = (1.0,)
    dim: int | None = None
    weights: str = "torchvision"
    last_pool: bool = True
    checkpoint: str | None = None
    whiten: bool = False
    whiten_source: str = "held_out"
    shrinkage: float = 0.0
    seed: int = 0
    technique: ClassVar[str] = "gem"
    axis: ClassVar[str | None] = "dim"

    def __post_init__(self):
        tuned, learned = self.weights == "sfm120k", self.whiten_source == "learned"
        rules = {
            "a learned exponent and fine-tuned weights go together": (self.p == "learned") == tuned,
            "a checkpoint needs fine-tuned weights": tuned or self.checkpoint is None,
            "learned whitening needs fine-tuned weights": tuned or not learned,
            "learned whitening needs whiten": self.whiten or not learned,
            "learned whitening takes no shrinkage": not (learned and self.shrinkage),
            "shrinkage is not negative": self.shrinkage >= 0,
            "there must be a scale": bool(self.scales),
            f"the source is one of {SOURCES}": self.whiten_source in SOURCES,
        }
        if broken := [rule for rule, holds in rules.items() if not holds]:
            raise ValueError("; ".join(broken))


@dataclass(frozen=True)
class Rmac:
    backbone: str = "alexnet"
    levels: int = 3
    max_side: int = 1024
    scales: tuple[float, ...] = (1.0,)
    dim: int | None = None
    weights: str = "torchvision"
    last_pool: bool = True
    whiten: bool = False
    whiten_source: str = "held_out"
    shrinkage: float = 0.0
    seed: int = 0
    technique: ClassVar[str] = "rmac"
    axis: ClassVar[str | None] = "dim"

    def __post_init__(self):
        if self.weights == "sfm120k" or self.whiten_source == "learned":
            raise ValueError("regional pooling has no fine-tuned weights")


@dataclass(frozen=True)
class Vit:
    model: str = "dinov2-vitl14"
    image_size: int = 224
    resize: str = "pad"
    interpolation: str = "bicubic"
    readout: str = "native"
    p: float | None = None
    dim: int | None = None
    whiten: bool = False
    whiten_source: str = "held_out"
    shrinkage: float = 0.0
    seed: int = 0
    checkpoint: str | None = None
    technique: ClassVar[str] = "vit"
    axis: ClassVar[str | None] = None

    def __post_init__(self):
        if self.readout not in ("native", "mean", "gem"):
            raise ValueError(f"no read-out {self.readout}")
        if self.whiten_source == "learned":
            raise ValueError("no learned whitening for transformers")


Descriptor = Bow | Vlad | Fisher | NeuralCodes | Pooled | Rmac | Vit


@dataclass(frozen=True)
class Run:
    descriptor: Descriptor
    dataset: str = "roxford5k"
    mp_at_k: int = 10

    @property
    def split(self) -> HeldOutSplit:
        return HeldOutSplit.of(self.dataset)


def params(descriptor: Descriptor) -> dict:
    return asdict(descriptor)


def descriptor_dim(descriptor: Descriptor) -> int:
    """Length of the encoded vector: that of the projection if set, else the descriptor's own."""
    from ..sources.runlog import CHANNELS, VIT_WIDTHS

    if isinstance(descriptor, Bow | Vlad | Fisher):
        return descriptor.k * {"bow": 1, "vlad": 128, "fisher": 256}[descriptor.technique]
    if descriptor.dim is not None:
        return descriptor.dim
    if isinstance(descriptor, NeuralCodes):
        return 4096
    return VIT_WIDTHS[descriptor.model] if isinstance(descriptor, Vit) else CHANNELS[descriptor.backbone]


def sweep(run: Run, values: tuple[int, ...]) -> list[Run]:
    """One run per value of the technique's axis; the run itself without values."""
    if not values:
        return [run]
    axis = run.descriptor.axis
    if axis is None:
        raise ValueError(f"{run.descriptor.technique} has no axis to sweep")
    return [replace(run, descriptor=replace(run.descriptor, **{axis: v})) for v in values]


# The named configurations.
_caffe = {"weights": "caffe", "scales": SCALES, "whiten": True}
_tuned = {"weights": "sfm120k", "scales": SCALES, "whiten": True, "whiten_source": "learned", "p": "learned"}
PRESETS: dict[str, Descriptor] = {
    "bow-best": Bow(k=50000),
    "vlad-best": Vlad(k=4096),
    "fisher-best": Fisher(k=256),
    "neural-codes-vgg16": NeuralCodes(backbone="vgg16", dim=None),
    "gem-r101": Pooled(backbone="resnet101", dim=2048, **_caffe),
    "gem-vgg16": Pooled(backbone="vgg16", dim=512, last_pool=False, **_caffe),
    "rmac-r101": Rmac(backbone="resnet101", dim=2048, **_caffe),
    "gem-ft-r101": Pooled(backbone="resnet101", **_tuned),
    "gem-ft-vgg16": Pooled(backbone="vgg16", last_pool=False, **_tuned),
}


@dataclass(frozen=True)
class Train:
    backbone: str = "resnet101"
    weights: str = "caffe"
    epochs: int = 30
    lr: float | None = None
    weight_decay: float = 1e-6
    gamma: float = 0.99005
    batch: int = 5
    p: float = 3.0
    pairs: int = 2000
    pool: int = 22000
    negatives: int = 5
    margin: float | None = None
    patience: int | None = 5
    min_delta: float = 0.001
    lora: int | None = None
    whiten_pairs: int = 20000
    seed: int = 0

    def resolved_margin(self) -> float:
        return self.margin if self.margin is not None else 0.7 if self.backbone == "vgg16" else 0.85

    def resolved_lr(self) -> float:
        if self.lora and self.lr is None:
            raise ValueError("low-rank adaptation needs a learning rate")
        return 5e-7 if self.lr is None else self.lr


def from_options(technique: str, options: dict[str, str]) -> Descriptor:
    """A descriptor of a technique or preset from text options."""
    kinds = {c.technique: c for c in (Bow, Vlad, Fisher, NeuralCodes, Pooled, Rmac, Vit)}
    base = PRESETS.get(technique) or kinds[technique]()
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    if unknown := set(options) - set(known):
        raise ValueError(f"unknown options {sorted(unknown)}")

    def read(name: str, text: str):
        old = known[name]
        if text.lower() in ("none", "true", "false"):
            return {"none": None, "true": True, "false": False}[text.lower()]
        if isinstance(old, tuple):
            return tuple(float(x) for x in text.split(","))
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
        return text

    return replace(base, **{k: read(k, v) for k, v in options.items()})
