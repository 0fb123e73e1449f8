"""Score formulas. Constants are part of what the scores mean; all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _flag(x: Column, weight: float) -> Column:
    return F.when(x, F.lit(weight)).otherwise(F.lit(0.0))


def clones(tokens: Column, n: Column, same_name: Column, same_dir: Column) -> Column:
    return F.least(F.lit(1.0), 0.25 + 0.20 * F.least(_d(tokens) / 40, F.lit(1.0)) + 0.175 * clip((_d(n) - 2) / 3) + _flag(same_name, 0.20) + _flag(same_dir, 0.05))


def near_clones(diffs: Column, max_diff: int, tokens: Column, same_name: Column, same_dir: Column, both_trait: Column) -> Column:
    return clip(0.30 + 0.25 * clip(1 - (_d(diffs) - 1) / max(max_diff, 1)) + 0.20 * F.least(_d(tokens) / 40, F.lit(1.0)) + _flag(same_name, 0.15) + _flag(same_dir, 0.05) - _flag(both_trait, 0.20))


def concepts(n: Column, public_share: Column, modules: Column, positional: Column, agreement: Column) -> Column:
    return clip(0.28 + 0.22 * clip((_d(n) - 2) / 3) + 0.14 * public_share + 0.16 * clip((_d(modules) - 1) / 2) + _flag(positional, 0.10) + 0.15 * agreement - _flag(n >= 6, 0.25))


def divergence(shared: Column, rich: Column, missing: Column, kin: Column, sealed: Column) -> Column:
    return _d(shared) / _d(rich) / _d(missing) * kin * F.when(sealed, 1.5).otherwise(1.0)


def config_drift(agreed: Column, differing: Column, configs: Column, modules: Column, sites: Column) -> Column:
    return (0.4 + 0.6 * _d(agreed) / (_d(agreed) + _d(differing))) / F.sqrt(_d(differing)) / F.greatest(_d(configs) - 1, F.lit(1.0)) * _d(modules) / _d(sites)


def builder_drift(shared: Column, differing: Column, near: Column) -> Column:
    return (0.4 + 0.6 * _d(shared) / (_d(shared) + _d(differing))) / F.sqrt(_d(differing)) * near


def ratio_drift(checked: Column, raw: Column) -> Column:
    return _d(checked) / (_d(checked) + _d(raw))


def validation_drift(checked: Column, unchecked: Column) -> Column:
    n = _d(checked) + _d(unchecked)
    return clip(0.25 + 0.45 * _d(checked) / n + 0.30 * clip((_d(checked) - 1) / 3) - _flag(n >= 6, 0.25))


def _ladder(x: Column, table: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


SWALLOW_KIND = {"let-_": 0.30, "match-err-wild": 0.30, ".ok": 0.20, ".err": 0.20, "if-let-ok": 0.20, "while-let-ok": 0.20, "unwrap_or": 0.15, "unwrap_or_default": 0.15, "unwrap_or_else": 0.15, "map_err": 0.05}
SWALLOW_EFFECT = {"mutation": 0.60, "io": 0.35, "unknown": 0.20, "decode": 0.05}
PANIC_KIND = {"todo": 0.60, "unimplemented": 0.60, "unwrap": 0.30, "panic": 0.25, "expect": 0.20, "unreachable": 0.15}
PANIC_EFFECT = {"decode": 0.35, "io": 0.30, "mutation": 0.25, "unknown": 0.15}
DOC_DRIFT = {"panics-doc-unbacked": 0.80, "panics-undocumented": 0.45, "errors-doc-unbacked": 0.85, "stale-name": 0.50}


def error_swallows(kind: Column, effect: Column, benign: Column, substitutes: Column) -> Column:
    return F.least(F.lit(1.0), F.when(benign, 0.0).otherwise(_ladder(effect, SWALLOW_EFFECT) + _flag(substitutes, 0.20)) + _ladder(kind, SWALLOW_KIND))


def panics(kind: Column, effect: Column, benign: Column, in_process: Column) -> Column:
    held = F.when(in_process, F.lit(PANIC_EFFECT["unknown"])).otherwise(_ladder(effect, PANIC_EFFECT))
    return F.least(F.lit(1.0), F.when(benign, 0.0).otherwise(held) + _ladder(kind, PANIC_KIND))


def doc_drift(kind: Column) -> Column:
    return _ladder(kind, DOC_DRIFT)


def contract_candidates(callers: Column, modules: Column, loc: Column, free: Column, fallible: Column, undocumented: Column) -> Column:
    t = F.when(free, 1.0).otherwise(0.5)
    one = F.lit(1.0)
    return F.least(_d(callers) / 12, one) * 0.35 * t + F.least((_d(modules) - 1) / 4, one) * 0.25 * t + F.least(_d(loc) / 80, one) * 0.20 + _flag(fallible, 0.12) + _flag(undocumented, 0.08)


def signature_rarity(population: Column) -> Column:
    return 1.0 / F.greatest(_d(population) - 1, F.lit(1.0))


#: Score from which a check's findings gate, and the least that it lists by default.
GATES = {"clones": 0.75, "near-clones": 0.75, "concepts": 0.70, "divergence": 0.45, "config-drift": 0.12, "builder-drift": 0.40, "arith-drift": 0.60, "validation-drift": 0.70, "error-swallows": 0.55, "panics": 0.55, "doc-drift": 0.70}
FLOORS = {"concepts": 0.35, "divergence": 0.25, "config-drift": 0.05, "builder-drift": 0.05, "arith-drift": 0.5, "validation-drift": 0.55}
