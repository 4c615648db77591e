"""The tagger's forward pass as a graph for onnxruntime, which runs it several times as fast as numpy.

The graph is written out in the public protobuf layout of the format: two look-ups, one bidirectional LSTM, one linear
layer. Where onnxruntime is missing, numpy runs instead; scores agree up to rounding.
"""

from __future__ import annotations

import numpy as np

from pairloom.llm.pii_model import K, Tagger

#: Element types and attribute types of the format.
FLOAT, INT32, INT64 = 1, 6, 7
AS_INT, AS_TEXT, AS_INTS = 2, 3, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n)


def _bytes(tag: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, values: np.ndarray) -> bytes:
    kind = INT64 if values.dtype == np.int64 else FLOAT
    return b"".join(_number(1, d) for d in values.shape) + _number(2, kind) + _bytes(8, name) + _bytes(9, np.ascontiguousarray(values).tobytes())


def _node(kind: str, inputs: list[str], output: str, **attributes: int | str | list[int]) -> bytes:
    out = b"".join(_bytes(1, x) for x in inputs) + _bytes(2, output) + _bytes(4, kind)
    for name, value in attributes.items():
        if isinstance(value, int):
            body = _number(3, value) + _number(20, AS_INT)
        elif isinstance(value, str):
            body = _bytes(4, value) + _number(20, AS_TEXT)
        else:
            body = b"".join(_number(8, x) for x in value) + _number(20, AS_INTS)
        out += _bytes(5, _bytes(1, name) + body)
    return out


def _value(name: str, kind: int, dims: list[str | int]) -> bytes:
    shape = b"".join(_bytes(1, _number(1, d) if isinstance(d, int) else _bytes(2, d)) for d in dims)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, shape)))


def graph(model: Tagger) -> bytes:
    """The model file of a tagger: symbols and classes [T, B] in, scores [T, B, K] out."""
    p, h = model.p, model.hidden
    order = np.concatenate([np.arange(h) + h * i for i in (0, 2, 1, 3)])  # input, output, forget, cell
    both = lambda f: np.stack([f(s) for s in "fb"]).astype(np.float32)
    weights = {
        "symbols_table": p["symbols"].astype(np.float32), "classes_table": p["classes"].astype(np.float32), "W": both(lambda s: p[f"x{s}"][:, order].T), "R": both(lambda s: p[f"h{s}"][:, order].T),
        "B": both(lambda s: np.concatenate((p[f"c{s}"][order], np.zeros(4 * h, np.float32)))), "out": p["out"].astype(np.float32), "bias": p["bias"].astype(np.float32), "flat": np.array([0, 0, 2 * h], np.int64),
    }
    nodes = [
        _node("Gather", ["symbols_table", "symbols"], "s"), _node("Gather", ["classes_table", "classes"], "c"), _node("Concat", ["s", "c"], "x", axis=2),
        _node("LSTM", ["x", "W", "R", "B"], "y", hidden_size=h, direction="bidirectional"), _node("Transpose", ["y"], "t", perm=[0, 2, 1, 3]), _node("Reshape", ["t", "flat"], "r"),
        _node("MatMul", ["r", "out"], "m"), _node("Add", ["m", "bias"], "scores"),
    ]
    body = b"".join(_bytes(1, n) for n in nodes) + _bytes(2, "tagger") + b"".join(_bytes(5, _tensor(k, v)) for k, v in weights.items())
    body += b"".join(_bytes(11, _value(x, INT32, ["T", "B"])) for x in ("symbols", "classes")) + _bytes(12, _value("scores", FLOAT, ["T", "B", K]))
    return _number(1, 8) + _bytes(7, body) + _bytes(8, _bytes(1, "") + _number(2, 14))


class GraphTagger(Tagger):
    """A tagger whose scores come from onnxruntime, on one thread."""

    def __init__(self, model: Tagger) -> None:
        import onnxruntime

        self.p, self.hidden = model.p, model.hidden
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        self.session = onnxruntime.InferenceSession(graph(model), options, providers=["CPUExecutionProvider"])

    def scores(self, symbols: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return self.session.run(["scores"], {"symbols": symbols.astype(np.int32), "classes": classes.astype(np.int32)})[0]


def fastest(model: Tagger) -> Tagger:
    """The tagger on onnxruntime where that is there."""
    try:
        return GraphTagger(model)
    except ImportError:
        return model
