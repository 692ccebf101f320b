"""Checked transforms as Spark Columns.

Scalars become built-in expressions: the control flow, which has no loops, folds into CASE
expressions whose untaken arms are not evaluated. Byte loops become one Arrow UDF each, in
which numpy evaluates the loop expression over all bytes at once, arm by arm on the bytes
that take it, so checked integer errors occur exactly where a byte runs into them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import buffers, scalars
from .checker import Block, Module, Transform, Value

SYMBOLS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "equal": "==", "not-equal": "!=", "less": "<", "less-equal": "<=", "greater": ">", "greater-equal": ">="}
SPARK_TYPES = {"bool": "boolean", "u8": "int", "i64": "bigint", "f32": "float", "String": "string", "StringView": "string", "Bytes": "binary", "BytesView": "binary", "Buffer": buffers.BUFFER, "BufferView": buffers.BUFFER}


def float_of(bits: int) -> float:
    return float(np.array([bits], np.uint32).view(np.float32)[0])


def boundary(value: Column, type_: str) -> Column:
    """An outer column as a parameter: ranges and layouts are checked, not converted."""
    if type_ == "u8":
        return scalars.u8_checked(value)
    if type_.startswith("Buffer"):
        return buffers.checked(value)
    return value.cast(SPARK_TYPES[type_])


def strategy(module: Module, name: str) -> tuple[str, list[str]]:
    """How a transform runs, and why: 'expression', 'arrow-udf' or 'driver' (reads the world)."""
    t = module.transforms[name]
    reasons = []
    for v in t.values():
        if v.kind.startswith("world."):
            reasons.append(f"{v.kind} observes the world")
        elif v.kind.startswith("buffer.byte-map"):
            reasons.append("byte loop")
        elif v.kind == "operation.call":
            mode, _ = strategy(module, v.data["callee"])
            if mode != "expression":
                reasons.append(f"calls {v.data['callee']} ({mode})")
    mode = "driver" if module.observes(name) else "arrow-udf" if reasons else "expression"
    return mode, reasons


class ColumnLowering:
    def __init__(self, module: Module, world: Mapping[tuple[str, str], bytes] | None = None) -> None:
        self.module, self.world = module, world

    def call(self, t: Transform, arguments: list) -> Column:
        env = dict(zip(map(id, t.arguments), arguments, strict=True))
        return self.block(t.entry, env)

    def block(self, b: Block, env: dict) -> Column:
        env = dict(env)
        for v in b.instructions:
            env[id(v)] = self.value(v, env)
        kind, *parts = b.end
        if kind == "return":
            return env[id(parts[0])]
        if kind == "jump":
            return self.block(parts[0], env)
        condition = env[id(parts[0])]
        return F.when(condition, self.block(parts[1], env)).otherwise(self.block(parts[2], env))

    def value(self, v: Value, env: dict):
        d = v.data
        get = lambda x: env[id(x)]
        if v.kind.startswith("constant."):
            return F.lit(float_of(d["value"])).cast("float") if v.type == "f32" else F.lit(d["value"]).cast(SPARK_TYPES[v.type])
        if v.kind.startswith("binary."):
            op, a, b = SYMBOLS[v.kind[7:]], get(d["left"]), get(d["right"])
            kind = d["left"].type
            return scalars.i64_binary(op, a, b) if kind == "i64" else scalars.f32_binary(op, a, b) if kind == "f32" else scalars.compare(op, a, b)
        if v.kind == "numeric.u8-scale":
            return scalars.u8_scale(get(d["value"]), get(d["factor"]))
        if v.kind == "operation.call":
            return self.call(self.module.transforms[d["callee"]], [get(x) for x in d["arguments"]])
        if v.kind == "struct.construct":
            return [get(x) for x in d["fields"]]  # fields are columns of their own; no row holds the struct
        if v.kind == "struct.field":
            return get(d["value"])[d["index"]]
        if v.kind == "buffer.zero":
            return buffers.zero(get(d["buffer"]))
        if v.kind == "buffer.fill":
            return buffers.fill(get(d["buffer"]), get(d["value"]))
        if v.kind.startswith("buffer.byte-map"):
            free = free_values(v, self.module)
            scalars_ = [get(x) for x in free]
            return buffers.byte_map(get(d["buffer"]), loop_function(v, free, self.module), *scalars_)
        raise EngineError(f"{v.kind} runs on the driver only")


def lower(module: Module, name: str, *arguments: Column) -> Column:
    """The result column of a transform over argument columns."""
    t = module.transforms[name]
    if len(arguments) != len(t.parameters):
        raise EngineError(f"`{name}` takes {len(t.parameters)} arguments")
    return ColumnLowering(module).call(t, [boundary(a, ty) for a, (_, ty) in zip(arguments, t.parameters, strict=True)])


# ---- byte loops in numpy ------------------------------------------------------------------


def free_values(loop: Value, module: Module) -> list[Value]:
    """Values from outside that the loop expression uses, each once; struct fields one by one."""
    inside = {id(v) for v in loop.data["instructions"]} | {id(loop.data["element"]), id(loop.data.get("index"))}
    out: list[Value] = []

    def use(v: Value) -> None:
        if id(v) not in inside and all(v is not x for x in out):
            out.append(v)

    for v in [*loop.data["instructions"]]:
        for x in v.data.values():
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Value):
                    use(y)
    use(loop.data["result"])
    return [v for v in out if v.type in SPARK_TYPES]


def loop_function(loop: Value, free: list[Value], module: Module) -> Callable[..., np.ndarray]:
    def run(data: np.ndarray, offsets: np.ndarray, *outside) -> np.ndarray:
        env = {id(loop.data["element"]): data}
        if "index" in loop.data:
            env[id(loop.data["index"])] = offsets
        for v, x in zip(free, outside, strict=True):
            env[id(v)] = np.broadcast_to(_array(x, v.type), data.shape)
        n = len(data)
        for v in loop.data["instructions"]:
            env[id(v)] = _numpy(v, env, n, module)
        return env[id(loop.data["result"])]

    return run


def _array(x, type_: str) -> np.ndarray:
    return np.asarray(x, {"bool": bool, "u8": np.uint8, "i64": np.int64, "f32": np.float32}[type_])


def _block(b: Block, env: dict, n: int, module: Module) -> np.ndarray:
    env = dict(env)
    while True:
        for v in b.instructions:
            env[id(v)] = _numpy(v, env, n, module)
        kind, *parts = b.end
        if kind == "return":
            return env[id(parts[0])]
        if kind == "jump":
            b = parts[0]
            continue
        take = np.broadcast_to(env[id(parts[0])], (n,))
        out = None
        for lanes, arm in ((np.flatnonzero(take), parts[1]), (np.flatnonzero(~take), parts[2])):
            if not len(lanes):
                continue
            part = {k: [y[lanes] for y in x] if isinstance(x, list) else x[lanes] for k, x in env.items()}
            got = _block(arm, part, len(lanes), module)
            out = np.zeros(n, got.dtype) if out is None else out
            out[lanes] = got
        return out


def _numpy(v: Value, env: dict, n: int, module: Module):
    d = v.data
    get = lambda x: env[id(x)]
    if v.kind.startswith("constant."):
        return np.full(n, _array(float_of(d["value"]) if v.type == "f32" else d["value"], v.type)) if v.type != "StringView" else np.full(n, d["value"], object)
    if v.kind.startswith("binary."):
        return arithmetic(SYMBOLS[v.kind[7:]], get(d["left"]), get(d["right"]), d["left"].type)
    if v.kind == "numeric.u8-scale":
        with np.errstate(all="ignore"):
            x = get(d["value"]).astype(np.float32) * get(d["factor"]).astype(np.float32)
            return np.where(np.isnan(x), np.float32(0), np.clip(x, 0, 255)).astype(np.uint8)
    if v.kind == "operation.call":
        t = module.transforms[d["callee"]]
        return _block(t.entry, dict(zip(map(id, t.arguments), map(get, d["arguments"]), strict=True)), n, module) if n else np.zeros(0, np.uint8)
    if v.kind == "struct.construct":
        return [get(x) for x in d["fields"]]
    if v.kind == "struct.field":
        return get(d["value"])[d["index"]]
    raise EngineError(f"{v.kind} cannot run inside a byte loop")


def arithmetic(op: str, a: np.ndarray, b: np.ndarray, type_: str) -> np.ndarray:
    """One operator over arrays: checked i64, binary32 floats, plain comparisons."""
    with np.errstate(all="ignore"):
        if op not in "+-*/":
            return {"==": np.equal, "!=": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[op](a, b)
        if type_ == "f32":
            return {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide}[op](a, b).astype(np.float32)
        if op == "/":
            if (b == 0).any():
                raise EngineError("integer division by zero")
            if ((a == scalars.I64_MIN) & (b == -1)).any():
                raise EngineError("integer overflow")
            q = a // b
            return q + ((a % b != 0) & ((a < 0) != (b < 0)))  # floor to truncation
        out = {"+": np.add, "-": np.subtract, "*": np.multiply}[op](a, b)
        if op == "+":
            bad = ((a ^ out) & (b ^ out)) < 0
        elif op == "-":
            bad = ((a ^ b) & (a ^ out)) < 0
        else:
            near = np.abs(a.astype(float) * b.astype(float)) > 2.0**62
            bad = np.zeros(len(out), bool)
            for i in np.flatnonzero(near):
                bad[i] = not scalars.I64_MIN <= int(a[i]) * int(b[i]) <= scalars.I64_MAX
        if bad.any():
            raise EngineError("integer overflow")
        return out
