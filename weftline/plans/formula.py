"""Formula series: small arithmetic expressions over t and earlier series, as Spark columns.

Python's own parser reads the text; only the node types below are accepted, and nothing is
ever evaluated in Python.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.blocks import running_sum
from weftline.panel import Panel

BLOCK = 16384


class UnsafeFormulaError(ValueError):
    pass


@dataclass(frozen=True)
class FormulaSpec:
    name: str
    expr: str


FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.ln, "sqrt": F.sqrt, "abs": F.abs,
    "minimum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "maximum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "clip": lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi)),
    "where": lambda c, a, b: F.when(c != 0, a).otherwise(b),
}
CONSTANTS = {"pi": math.pi, "e": math.e}
NOISE = {"randn": ("scale",), "randu": ("scale",), "rw": ("scale",), "ar1": ("phi", "scale")}
NOISE_DEFAULTS = {"scale": 1.0, "phi": 0.7}
BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / F.nullif(b, F.lit(0.0)),
    ast.Pow: lambda a, b: F.pow(a, b),
    ast.Mod: lambda a, b: a - b * F.floor(a / F.nullif(b, F.lit(0.0))),
    ast.FloorDiv: lambda a, b: F.floor(a / F.nullif(b, F.lit(0.0))).cast("double"),
}

PRESETS = {
    "linear_noise": (("X", "sin(2*pi*t/50)+0.2*randn()"), ("Y", "0.8*X+0.3*randn()"), ("Z", "rw(0.5)")),
    "random": (("X", "randn()"), ("Y", "randn()"), ("Z", "randn()")),
    "sin_cos": (("X", "sin(2*pi*t/50)"), ("Y", "cos(2*pi*t/50)"), ("Z", "0.5*X+0.5*Y")),
    "ar1": (("X", "ar1(0.7, 1.0)"), ("Y", "0.6*X+ar1(0.5, 0.5)"), ("Z", "ar1(0.9, 0.3)")),
}


class _Compiler:
    def __init__(self, frame: DataFrame, known: Sequence[str], seed: int):
        self.frame, self.known, self.seed = frame, set(known), seed
        self.made = 0

    def column(self, text: str) -> Column:
        try:
            tree = ast.parse(text, mode="eval")
        except SyntaxError as err:
            raise UnsafeFormulaError(f"cannot read {text!r}") from err
        return self.visit(tree.body)

    def visit(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id in CONSTANTS:
                return F.lit(CONSTANTS[node.id])
            if node.id == "t":
                return F.col("time")
            if node.id in self.known:
                return F.col(f"`{node.id}`")
            raise UnsafeFormulaError(f"unknown name {node.id!r}")
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            return BINARY[type(node.op)](self.visit(node.left), self.visit(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            inner = self.visit(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return self.call(node)
        raise UnsafeFormulaError(f"{type(node).__name__} is not allowed in a formula")

    def call(self, node: ast.Call) -> Column:
        name = node.func.id
        if name in NOISE:
            return self.noise(name, node)
        if name not in FUNCTIONS:
            raise UnsafeFormulaError(f"unknown function {name!r}")
        args = [self.visit(a) for a in node.args] + [self.visit(k.value) for k in node.keywords]
        try:
            return FUNCTIONS[name](*args)
        except TypeError as err:
            raise UnsafeFormulaError(f"wrong arguments for {name}") from err

    def number(self, node: ast.AST) -> float:
        try:
            return float(ast.literal_eval(node))
        except (ValueError, SyntaxError) as err:
            raise UnsafeFormulaError("noise parameters must be numbers") from err

    def noise(self, name: str, node: ast.Call) -> Column:
        names = NOISE[name]
        got = {n: NOISE_DEFAULTS[n] for n in names}
        got.update(zip(names, (self.number(a) for a in node.args)))
        got.update({k.arg: self.number(k.value) for k in node.keywords if k.arg in names})
        self.made += 1
        out, seed = f"_noise{self.made}_{len(self.known)}", self.seed + 7919 * (self.made + 31 * len(self.known))
        if name == "randu":
            self.frame = self.frame.withColumn(out, (F.rand(seed) * 2 - 1) * got["scale"])
        else:
            self.frame = self.frame.withColumn(out, F.randn(seed) * got["scale"])
            if name == "rw":
                self.frame = running_sum(self.frame.withColumnRenamed(out, out + "s"), [], "t", out + "s", out).drop(out + "s")
            if name == "ar1":
                self.frame = autoregress(self.frame, out, got["phi"])
        return F.col(out)


def autoregress(frame: DataFrame, column: str, phi: float, size: int = BLOCK) -> DataFrame:
    """Replace noise by x[t] = phi x[t-1] + noise[t] with x[0] = 0, block by block.

    Blocks start from zero; the end of earlier blocks enters damped by phi to the distance.
    """
    if abs(phi) >= 1:
        raise UnsafeFormulaError("ar1 needs |phi| < 1")
    marked = frame.withColumn("_b", F.floor(F.col("t") / size))
    marked = marked.withColumn(column, F.when(F.col("t") == 0, 0.0).otherwise(F.col(column)))
    part = marked.select("t", "_b", F.col(column).alias("e"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        e = pdf["e"].to_numpy()
        x = np.empty_like(e)
        last = 0.0
        for i, v in enumerate(e):
            last = phi * last + v
            x[i] = last
        return pd.DataFrame({"t": pdf["t"], "_b": pdf["_b"], "x": x})

    loc = part.groupBy("_b").applyInPandas(local, "t bigint, _b bigint, x double")
    back = max(1, math.ceil(math.log(1e-17) / (size * math.log(abs(phi))))) if phi else 1
    ends = loc.groupBy("_b").agg(F.max_by("x", "t").alias("end"))
    carry = ends.select(F.explode(F.sequence(F.lit(1), F.lit(back))).alias("k"), "_b", "end")
    carry = carry.groupBy((F.col("_b") + F.col("k")).alias("_b")).agg(F.sum(F.col("end") * F.pow(F.lit(float(phi)), (F.col("k") - 1) * size)).alias("c"))
    step = F.pow(F.lit(float(phi)), F.pmod("t", F.lit(size)) + 1)
    x = loc.join(carry, "_b", "left").select("t", (F.col("x") + F.coalesce("c", F.lit(0.0)) * step).alias("_x"))
    return marked.drop("_b", column).join(x, "t").withColumnRenamed("_x", column)


def evaluate(frame: DataFrame, specs: Sequence[FormulaSpec], dt: float = 1.0, seed: int = 42) -> Panel:
    """Series of ``specs`` at every ``t`` of the frame; later formulas may use earlier names."""
    cur = frame.select("t").withColumn("time", F.col("t") * F.lit(float(dt)))
    names: list[str] = []
    for s in specs:
        if not s.name.isidentifier() or s.name == "t" or s.name in names:
            raise UnsafeFormulaError(f"bad series name {s.name!r}")
        c = _Compiler(cur, names, seed)
        col = c.column(s.expr)
        cur = c.frame.withColumn(s.name, col.cast("double"))
        names.append(s.name)
    return Panel(cur.select("t", *[F.col(f"`{n}`") for n in names]), tuple(names))


def formula_dataset(spark: SparkSession, n_samples: int = 500, dt: float = 1.0, seed: int = 42, specs: Sequence[FormulaSpec] | None = None) -> Panel:
    specs = specs or [FormulaSpec(*p) for p in PRESETS["linear_noise"]]
    return evaluate(spark.range(max(5, n_samples)).select(F.col("id").alias("t")), specs, dt, seed)


def random_walks(spark: SparkSession, n_vars: int = 5, n_samples: int = 500, seed: int = 42) -> Panel:
    return formula_dataset(spark, n_samples, seed=seed, specs=[FormulaSpec(f"RW_{i + 1}", "rw(1.0)") for i in range(n_vars)])


def independent_ar1(spark: SparkSession, n_vars: int = 3, n_samples: int = 500, phi: float = 0.7, noise: float = 0.5, seed: int = 42) -> Panel:
    specs = [FormulaSpec(f"AR1_{i + 1}", f"ar1({phi}, {noise})") for i in range(n_vars)]
    return formula_dataset(spark, n_samples, seed=seed, specs=specs)


def _driven(frame: DataFrame, column: str, parts: dict[str, float], noise: float, phi: float, seed: int, extra: Column | None = None) -> DataFrame:
    """Add ``column`` = phi * itself one step back + weighted channels one step back + noise."""
    from weftline.functions.blocks import rolling

    back = rolling(frame, [], "t", lambda w: {f"_{c}": F.lag(F.col(f"`{c}`"), 1, 0.0).over(w) for c in parts}, before=1) if parts else frame
    push = F.randn(seed) * noise
    for c, weight in parts.items():
        push = push + F.col(f"_{c}") * weight
    if extra is not None:
        push = push + extra
    return autoregress(back.withColumn(column, push).drop(*[f"_{c}" for c in parts]), column, phi)


def _warmed(frame: DataFrame, names: dict[str, str], skip: int = 50) -> Panel:
    kept = frame.filter(F.col("t") >= skip)
    return Panel(kept.select((F.col("t") - skip).alias("t"), *[F.col(a).alias(b) for a, b in names.items()]), tuple(names.values()))


def coupled_system(spark: SparkSession, n_samples: int = 500, coupling: float = 0.8, noise: float = 0.2, seed: int = 42) -> Panel:
    """An autoregressive source driving a target, a random walk, and a season; 50 warm-up rows drop."""
    f = spark.range(n_samples).select(F.col("id").alias("t"))
    f = _driven(f, "x", {}, 1.0, 0.5, seed)
    f = _driven(f, "y", {"x": coupling}, noise, 0.5, seed + 1)
    f = running_sum(f.withColumn("zs", F.randn(seed + 2)), [], "t", "zs", "z")
    f = f.withColumn("s", F.sin(F.col("t") * (2 * math.pi / 50)) + F.randn(seed + 3) * 0.1)
    return _warmed(f, {"x": "Source (X)", "y": "Target (Y)", "z": "Noise (Z)", "s": "Season (S)"})


def chain_system(spark: SparkSession, n_samples: int = 500, coupling: float = 0.8, noise: float = 0.2, season: int = 50, seed: int = 42) -> Panel:
    """X1 drives X2 drives X3 drives X4, each one step later; X1 carries a season."""
    f = spark.range(n_samples).select(F.col("id").alias("t"))
    f = _driven(f, "X1", {}, noise, 0.6, seed, F.sin(F.col("t") * (2 * math.pi / season)))
    for i in (2, 3, 4):
        f = _driven(f, f"X{i}", {f"X{i - 1}": coupling}, noise, 0.6, seed + i)
    return _warmed(f, {f"X{i}": f"X{i}" for i in (1, 2, 3, 4)})
