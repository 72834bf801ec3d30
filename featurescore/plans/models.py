"""Configurations and models of the registered queries."""

from __future__ import annotations

import struct

import numpy as np

from ..config import VectorizationConfig
from ..operators.scoring import Mlp
from ..operators.transforms import Embedding, Identity, MinMax32, MinMax64, OneHot, Standardize32, Standardize64

TYPES = ("click", "error", "purchase", "view")
PRIORITIES = {"1-URGENT": (0.1, 0.2, 0.3), "2-HIGH": (0.4, 0.5, 0.6), "3-MEDIUM": (-1.0, 0.0, 1.0), "5-LOW": (7.5, -0.25, 0.125)}
ROLES = {"assistant": (0.1, 0.2), "user": (0.3, 0.4)}


def config(**features) -> VectorizationConfig:
    """A configuration of features in the order given."""
    return VectorizationConfig(dict(features), tuple(features))


EVENTS = config(
    etype=OneHot((0.0, 0.0, 0.0, 0.0), TYPES), etype_vec=Embedding((9.0, 9.0), {"click": (0.5, -0.5), "view": (0.25, 0.75)}), value=Standardize64((0.0,), 10.0, 12.5), user=MinMax64((-1.0,), 0.0, 150.0),
    k_int=MinMax32((-1.0,), 0.0, 99.0), k_float=Standardize32((0.0,), 50.0, 28.5), k_text=Identity((-1.0,)),
)
LINES = config(quantity=MinMax64((0.0,), 0.0, 50.0), price=Standardize64((0.0,), 38000.0, 23000.0), part=MinMax64((0.0,), 0.0, 20000.0))

# small network 64-8-4-2 with weights by rule
SHAPES = [(8, 64), (4, 8), (2, 4)]


def weight(layer: int, out: int, pos: int) -> float:
    return ((out * 7 + pos * 3 + layer) % 11 - 5) / 10


def mlp() -> Mlp:
    layers = [(np.array([[weight(k, o, p) for p in range(w)] for o in range(h)]), np.array([0.1 * (o + 1) for o in range(h)])) for k, (h, w) in enumerate(SHAPES)]
    norms = [(np.array([1 + 0.1 * o for o in range(h)]), np.array([0.05 * o for o in range(h)])) for h, _ in SHAPES[:-1]]
    return Mlp(layers, norms)


# the benchmark's shape: 22 features in a vector of 1,002 numbers, and layers for it
# Widths of the embeddings and one-hot features, and the layers of the full network.
EMBEDDED = {"text": 100, "category": 150, "sentiment": 200, "location": 34}
ENCODED = {"color": 50, "size": 100, "kind": 150, "status": 200}
FULL_LAYERS = [8192, 8192, 4096, 2048, 4096, 1024, 2048, 1024, 512, 5]
#: Layers of the registered query; the full network is a parameter away.
SMALL_LAYERS = [16, 8, 5]
#: Categories that no table has are looked up too, so that defaults occur.
KEYS = 4


def embedded(key: int, width: int) -> tuple[float, ...]:
    return tuple(((key * 7 + j) % 13 - 6) / 8 for j in range(width))


def benchmark_config() -> VectorizationConfig:
    """22 features: 4 embeddings, 4 one-hot, 2 identities (a pair and four), 3 of each scaling."""
    out = {f"embedding_{n}": Embedding((0.0,) * w, {f"k{k}": embedded(k, w) for k in range(KEYS)}) for n, w in EMBEDDED.items()}
    out |= {f"onehot_{n}": OneHot((0.0,) * w, tuple(f"c{k:03d}" for k in range(w))) for n, w in ENCODED.items()}
    out |= {"identity_pair": Identity((0.0, 0.0)), "identity_four": Identity((0.0,) * 4)}
    for k, (low, high) in enumerate([(-40.0, 120.0), (0.0, 10000.0), (0.0, 100.0)]):
        out |= {f"minmax32_{k}": MinMax32((0.0,), low, high), f"minmax64_{k}": MinMax64((0.0,), low, high * 100)}
    for k, (mean, std) in enumerate([(35.5, 12.75), (170.0, 30.0), (300.0, 150.0)]):
        out |= {f"standard32_{k}": Standardize32((0.0,), mean, std), f"standard64_{k}": Standardize64((0.0,), mean * 100, std * 100)}
    return VectorizationConfig(out, tuple(out))


def units(width: int, layers: list[int]) -> list[tuple]:
    """Rows (layer, out, weights, bias, scale, shift) of a network with weights by rule."""
    rows = []
    for k, (h, w) in enumerate(zip(layers, [width, *layers], strict=False)):
        last = k == len(layers) - 1
        rows += [(k, o, [weight(k, o, p) / 8 for p in range(w)], 0.1 * (o + 1), None if last else 1 + 0.1 * o, None if last else 0.05 * o) for o in range(h)]
    return rows


UNIT = "layer int, out int, weights array<double>, bias double, scale double, shift double"


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, data: bytes | int) -> bytes:
    return _varint(number << 3) + _varint(data) if isinstance(data, int) else _varint(number << 3 | 2) + _varint(len(data)) + data


def sigmoid_model(width: int, outputs: int = 2, w: float = 0.5, b: float = 0.1, free: bool = False, double: bool = False) -> bytes:
    """ONNX bytes of sigmoid(W x + b) with one weight and bias throughout; free leaves the input's width open.

    With double all numbers have 64 bits, and the sigmoid is spelled out as 1 / (1 + exp(-z)), so that scores close to 1 are
    rounded as in SQL.
    """
    kind, letter = (11, "d") if double else (1, "f")
    dim = lambda d: _field(1, _field(1, d) if isinstance(d, int) else _field(2, d))
    shaped = lambda name, *dims: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, b"".join(dim(d) for d in dims))))
    tensor = lambda name, dims, xs: b"".join(_field(1, d) for d in dims) + _field(2, kind) + _field(8, name) + _field(9, struct.pack(f"<{len(xs)}{letter}", *xs))
    node = lambda op, ins, outs, attrs=b"": b"".join(_field(1, i) for i in ins) + b"".join(_field(2, o) for o in outs) + _field(4, op) + attrs
    trans = _field(5, _field(1, b"transB") + _field(3, 1) + _field(20, 2))
    squash = [node(b"Neg", [b"z"], [b"n"]), node(b"Exp", [b"n"], [b"e"]), node(b"Add", [b"one", b"e"], [b"d"]), node(b"Div", [b"one", b"d"], [b"y"])] if double else [node(b"Sigmoid", [b"z"], [b"y"])]
    graph = b"".join(_field(1, n) for n in [node(b"Gemm", [b"x", b"w", b"b"], [b"z"], trans), *squash]) + _field(2, b"g")
    if double:
        graph += _field(5, tensor(b"one", (1,), [1.0]))
    graph += _field(5, tensor(b"w", (outputs, width), [w] * width * outputs)) + _field(5, tensor(b"b", (outputs,), [b] * outputs))
    graph += _field(11, shaped(b"x", b"batch_size", b"width" if free else width)) + _field(12, shaped(b"y", b"batch_size", outputs))
    return _field(1, 7) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 11))
