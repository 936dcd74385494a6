"""Writes boosted trees as an ONNX file: a tree-ensemble node, doubled and squashed into two class probabilities.

The few messages that such a file needs are written in protobuf's wire format.
Field numbers, type codes and attribute names are those of the open format.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
FLOAT_TENSOR = 1
ATTRIBUTE_TYPE = {"f": 1, "i": 2, "s": 3, "floats": 6, "ints": 7, "strings": 8}
IR_VERSION, OPSET, ML_OPSET = 8, 13, 1


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _attribute(name: str, value) -> bytes:
    if isinstance(value, str):
        kind, data = "s", _bytes(4, value)
    elif isinstance(value, int):
        kind, data = "i", _number(3, value)
    elif isinstance(value[0], str):
        kind, data = "strings", b"".join(_bytes(9, v) for v in value)
    elif isinstance(value[0], float):
        kind, data = "floats", _bytes(7, struct.pack(f"<{len(value)}f", *value))
    else:
        kind, data = "ints", _bytes(8, b"".join(map(_varint, value)))
    return _bytes(1, name) + data + _number(20, ATTRIBUTE_TYPE[kind])


def _node(op: str, inputs: list[str], output: str, domain: str = "", **attributes) -> bytes:
    return b"".join(_bytes(1, i) for i in inputs) + _bytes(2, output) + _bytes(4, op) + b"".join(_bytes(5, _attribute(k, v)) for k, v in attributes.items()) + (_bytes(7, domain) if domain else b"")


def _tensor_info(name: str, width: int) -> bytes:
    rows, cols = _bytes(1, _bytes(2, "rows")), _bytes(1, _number(1, width))
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, FLOAT_TENSOR) + _bytes(2, rows + cols)))


def _constant(name: str, value: float) -> bytes:
    return _number(1, 1) + _number(2, FLOAT_TENSOR) + _bytes(8, name) + _bytes(9, struct.pack("<f", value))


def float_below(threshold: float) -> float:
    """The largest 32-bit number not above the threshold: a 32-bit feature is at most the one exactly if it is at most the other."""
    t = np.float32(threshold)
    return float(np.nextafter(t, np.float32(-np.inf)) if float(t) > threshold else t)


def encode(trees: list[tuple[float, list[dict]]], features: int) -> bytes:
    """trees: (weight, nodes) with feature, threshold, left and right, or value. Input `features` (rows, n) of 32-bit floats; output `probabilities` (rows, 2)."""
    ids, nodes, kinds, feature, value, yes, no = [], [], [], [], [], [], []
    leaf_tree, leaf_node, leaf_value = [], [], []
    for t, (weight, tree) in enumerate(trees):
        for k, n in enumerate(tree):
            branch = "feature" in n
            ids.append(t)
            nodes.append(k)
            kinds.append("BRANCH_LEQ" if branch else "LEAF")
            feature.append(n["feature"] if branch else 0)
            value.append(float_below(n["threshold"]) if branch else 0.0)
            yes.append(n["left"] if branch else 0)
            no.append(n["right"] if branch else 0)
            if not branch:
                leaf_tree.append(t)
                leaf_node.append(k)
                leaf_value.append(float(weight * n["value"]))
    ensemble = _node("TreeEnsembleRegressor", ["features"], "margin", "ai.onnx.ml", n_targets=1, post_transform="NONE", nodes_treeids=ids, nodes_nodeids=nodes, nodes_modes=kinds, nodes_featureids=feature, nodes_values=value,
                     nodes_truenodeids=yes, nodes_falsenodeids=no, target_treeids=leaf_tree, target_nodeids=leaf_node, target_ids=[0] * len(leaf_tree), target_weights=leaf_value)
    rest = [_node("Mul", ["margin", "two"], "doubled"), _node("Sigmoid", ["doubled"], "fraud"), _node("Sub", ["one", "fraud"], "legit"), _node("Concat", ["legit", "fraud"], "probabilities", axis=1)]
    graph = b"".join(_bytes(1, n) for n in (ensemble, *rest)) + _bytes(2, "trees") + _bytes(5, _constant("one", 1.0)) + _bytes(5, _constant("two", 2.0)) + _bytes(11, _tensor_info("features", features)) + _bytes(12, _tensor_info("probabilities", 2))
    opsets = _bytes(8, _bytes(1, "") + _number(2, OPSET)) + _bytes(8, _bytes(1, "ai.onnx.ml") + _number(2, ML_OPSET))
    return _number(1, IR_VERSION) + _bytes(2, "fraudloom") + _bytes(7, graph) + opsets
