"""The registry of degradation views: names, specs, fingerprints, chains, and the expansion of rows into views."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlab.functions import vectors as V

# Severities and chains that results are comparable by.
JPEG_QUALITIES = (90, 70, 50, 30)
BLUR_SIGMAS = (0.5, 1.0, 2.0)
RESIZE_SCALES = (0.5, 0.25)
NOISE_SIGMAS = (0.02, 0.05, 0.1)
JITTER_STRENGTH = 0.2
CROP_FRACTION = 0.8
CHAINS = {
    "chain_light": (("resize", 0.5), ("jpeg", 70)),
    "chain_medium": (("crop80", None), ("jitter", None), ("resize", 0.5), ("jpeg", 50)),
    "chain_heavy": (("blur", 1.0), ("resize", 0.25), ("noise", 0.05), ("jpeg", 30)),
}
TRAIN_CHAINS = {
    "trainchain_a": (("blur", 1.0), ("jpeg", 70)),
    "trainchain_b": (("noise", 0.05), ("jpeg", 70)),
    "trainchain_c": (("crop80", None), ("jitter", None), ("blur", 1.0)),
    "trainchain_d": (("jitter", None), ("resize", 0.5), ("noise", 0.05), ("jpeg", 70)),
}
CDN_VIEWS = ("clean", "jpeg_q70", "jpeg_q90", "resize_0.5x", "chain_light")

Steps = tuple[tuple[str, float | int | None], ...]


def single_views() -> dict[str, Steps]:
    out: dict[str, Steps] = {"clean": ()}
    out |= {f"jpeg_q{q}": (("jpeg", q),) for q in JPEG_QUALITIES}
    out |= {f"blur_sigma{s}": (("blur", s),) for s in BLUR_SIGMAS}
    out |= {f"resize_{s}x": (("resize", s),) for s in RESIZE_SCALES}
    out |= {f"noise_sigma{s}": (("noise", s),) for s in NOISE_SIGMAS}
    return out | {"color_jitter": (("jitter", None),), "center_crop_80": (("crop80", None),)}


def view_steps() -> dict[str, Steps]:
    return single_views() | CHAINS | TRAIN_CHAINS


def validate_chains() -> None:
    """No chain uses a family twice, and no training chain is a scored one."""
    for name, steps in (CHAINS | TRAIN_CHAINS).items():
        ops = [op for op, _ in steps]
        if len(set(ops)) != len(ops):
            raise ValueError(f"{name} applies a transform twice")
    if set(CHAINS.values()) & set(TRAIN_CHAINS.values()):
        raise ValueError("a chain is both trained on and scored")


validate_chains()


def _part(op: str, param, chained: bool) -> str:
    return {
        "jpeg": f"jpeg(q={param})",
        "blur": f"blur(sigma={param})",
        "resize": f"resize(scale={param})",
        "noise": f"{'pil_' * chained}noise(sigma={param})",
        "jitter": f"color_jitter(strength={JITTER_STRENGTH})",
        "crop80": f"center_crop(frac={CROP_FRACTION})",
    }[op]


def is_chain(name: str) -> bool:
    return name in CHAINS or name in TRAIN_CHAINS


def view_spec(name: str) -> str:
    """The canonical text of a view, with |stochastic where it draws numbers."""
    steps = view_steps()[name]
    parts = ">".join(_part(op, p, is_chain(name)) for op, p in steps) or name
    spec = f"chain[{parts}]" if is_chain(name) else parts
    return spec + "|stochastic" * any(op in ("noise", "jitter") for op, _ in steps)


def view_fingerprint(name: str) -> str:
    spec = view_spec(name)
    return hashlib.sha1((spec + "|seed=path-v1" * spec.endswith("|stochastic")).encode()).hexdigest()


def component_views(chain: str) -> list[str]:
    """The single views that a chain is made of."""
    by_step = {steps[0]: name for name, steps in single_views().items() if steps}
    return [by_step[s] for s in (CHAINS | TRAIN_CHAINS)[chain]]


def views_table(spark: SparkSession) -> DataFrame:
    """(view, ord, kind, spec, scored, fingerprint), one row a view."""
    rows = [(n, i, "chain" if is_chain(n) else "single", view_spec(n), n not in TRAIN_CHAINS, view_fingerprint(n)) for i, n in enumerate(view_steps())]
    return spark.createDataFrame(rows, "view string, ord int, kind string, spec string, scored boolean, fingerprint string")


def select_views(names, scored_only: bool = True) -> list[str]:
    """The named views in registry order; unknown names raise."""
    known = [n for n in view_steps() if not scored_only or n not in TRAIN_CHAINS]
    unknown = set(names) - set(view_steps()) if names else set()
    if unknown:
        raise ValueError(f"unknown views: {sorted(unknown)}")
    return [n for n in known if not names or n in names]


def apply_view(x: Column, name: str, path: Column) -> Column:
    seed = V.path_seed(path, F.lit(name))
    for op, p in view_steps()[name]:
        x = {
            "jpeg": lambda x, p: V.quantize(x, p),
            "blur": lambda x, p: V.blur(x, p),
            "resize": lambda x, p: V.decimate(x, p),
            "noise": lambda x, p: V.noise(x, p, seed),
            "jitter": lambda x, p: V.gain(x, JITTER_STRENGTH, seed),
            "crop80": lambda x, p: V.crop(x, CROP_FRACTION),
        }[op](x, p)
    return x


def expand_views(rows: DataFrame, names=None, vector: str = "x", path: str = "path", scored_only: bool = True) -> DataFrame:
    """rows times views: columns view, ord, kind and the view's vector in place of ``vector``. A projection; no shuffle."""
    order = {n: i for i, n in enumerate(view_steps())}
    made = [F.struct(F.lit(n).alias("view"), F.lit(order[n]).alias("ord"), F.lit("chain" if is_chain(n) else "single").alias("kind"), apply_view(F.col(vector), n, F.col(path)).alias(vector)) for n in select_views(names, scored_only)]
    rest = [c for c in rows.columns if c != vector]
    return rows.select(*rest, F.explode(F.array(*made)).alias("v")).select(*rest, "v.*")


def named_views(rows: DataFrame, names=None, vector: str = "x", path: str = "path", scored_only: bool = True) -> DataFrame:
    """rows times views: columns view and seed beside the vector as it is, for those who make the views where they need them (scoring.view_matrix)."""
    seed = lambda n: V.path_seed(F.col(path), F.lit(n)) if "stochastic" in view_spec(n) else F.lit(0).cast("long")
    made = [F.struct(F.lit(n).alias("view"), seed(n).alias("seed")) for n in select_views(names, scored_only)]
    return rows.select(*rows.columns, F.explode(F.array(*made)).alias("v")).select(*rows.columns, "v.*")
