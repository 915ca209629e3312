"""Exact train and validation splits over strata, and balanced quotas.

Only the table of (domain, scenario, rows) is decided on the driver: its size is
the number of kinds, not of rows. Rows are then drawn by their rank in hash order
within a cell, so no cell is gathered and reruns agree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.batch import with_group_rank

Cells = dict[tuple[str, str], int]


def apportion(sizes: dict[Hashable, int], total: int, limits: dict[Hashable, int] | None = None, least: int = 0) -> dict[Hashable, int]:
    """`total` dealt out in proportion to sizes by largest remainders, each within `least` and its limit.

    Of equal remainders the larger size goes first, then the larger name. If the limits
    hold less than the total, all are filled.
    """
    limits, whole = limits or sizes, max(1, sum(sizes.values()))
    raw = {k: n * total / whole for k, n in sizes.items()}
    out = {k: min(limits[k], max(least, int(raw[k]))) for k in sizes}
    while (missing := min(total, sum(limits.values())) - sum(out.values())) > 0:
        room = sorted((k for k in out if out[k] < limits[k]), key=lambda k: (raw[k] - out[k], sizes[k], k), reverse=True)
        step = max(1, min((limits[k] - out[k] for k in room), default=1)) if missing > len(room) else 1
        for k in room[: max(1, missing // step)]:
            out[k] += min(step, limits[k] - out[k])
    while (over := sum(out.values()) - total) > 0:
        full = sorted((k for k in out if out[k] > least), key=lambda k: (raw[k] - out[k], sizes[k], k))
        if not full:
            break
        for k in full[:over]:
            out[k] -= 1
    return out


def _margins(cells: Cells) -> tuple[Counter, Counter]:
    domains, scenarios = Counter(), Counter()
    for (d, s), n in cells.items():
        domains[d] += n
        scenarios[s] += n
    return domains, scenarios


def splittable(cells: Cells) -> Cells:
    """Cells without the domains and scenarios of a single row, again and again until none is left."""
    while True:
        domains, scenarios = _margins(cells)
        kept = {(d, s): n for (d, s), n in cells.items() if domains[d] > 1 and scenarios[s] > 1}
        if len(kept) == len(cells):
            return cells
        cells = kept


def _covered(quotas: Cells, cells: Cells, axis: int) -> Cells:
    """Quotas moved, one a kind, so that every kind along an axis with rows has one; from the largest quota of the same kind on the other axis."""
    out = dict(quotas)
    have, rows = _margins(out)[axis], _margins(cells)[axis]
    for kind in sorted(k for k in rows if rows[k] and not have[k]):
        swaps = [(out[donor], cell, donor) for cell in cells if cell[axis] == kind and cells[cell] > out[cell] for donor in out
                 if donor[1 - axis] == cell[1 - axis] and out[donor] > 0 and _margins(out)[axis][donor[axis]] > 1]
        if swaps:
            _, cell, donor = max(swaps)
            out[cell], out[donor] = out[cell] + 1, out[donor] - 1
    return out


def split_quotas(cells: Cells, train: int, val: int) -> tuple[Cells, Cells]:
    """(train, validation) rows to draw of each (domain, scenario), of exactly these totals.

    Kinds of a single row are left out where enough rows stay; validation takes from
    scenarios in proportion, at least one of each and never the last, and then from
    their domains, each covered; train takes the rest in proportion with all of
    validation's kinds covered. Where kinds can't all be covered, both are exact and
    disjoint only, and train keeps a row of each kind as far as it can.
    """
    if sum(cells.values()) < train + val:
        raise ValueError(f"{sum(cells.values())} rows can't make {train} and {val}")
    pool = splittable(cells) if val else cells
    strict = sum(pool.values()) >= train + val
    pool = pool if strict else cells
    domains, scenarios = _margins(pool)
    none = dict.fromkeys(pool, 0)
    quotas = none
    if val and strict and val >= max(len(domains), len(scenarios)):
        targets = apportion(scenarios, val, {s: n - 1 for s, n in scenarios.items()}, least=1)
        quotas = none | {k: n for s, t in targets.items() for k, n in apportion({k: n for k, n in pool.items() if k[1] == s}, t).items()}
        quotas = _covered(quotas, pool, 0)
    if sum(quotas.values()) != val:
        spare = {k: max(0, min(n, domains[k[0]] - 1, scenarios[k[1]] - 1)) for k, n in pool.items()}
        quotas = apportion(pool, val, spare)
        rest = val - sum(quotas.values())
        if rest > 0:
            more = apportion({k: n - quotas[k] for k, n in pool.items()}, rest)
            quotas = {k: n + more[k] for k, n in quotas.items()}
    left = {k: n - quotas[k] for k, n in pool.items()}
    taken = apportion(left, train)
    for axis in (0, 1):
        taken = _covered(taken, left, axis)
    return taken, quotas


def exact_split(df: DataFrame, domain: str, scenario: str, key: str, train: int, val: int, seed: int = 42) -> DataFrame:
    """Rows with `split`, "train" or "val", of exactly these numbers, stratified over domain and scenario; other rows go.

    Rows are unique by `key`. Null kinds are kinds of the name "unknown".
    """
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in (domain, scenario)]
    keyed = df.withColumns({"_d": cell[0], "_s": cell[1]})
    cells = {(r[0], r[1]): r[2] for r in keyed.groupBy("_d", "_s").agg(F.count(F.lit(1))).collect()}  # a row a kind
    quotas = split_quotas(cells, train, val)
    bounds = df.sparkSession.createDataFrame([(d, s, quotas[1].get((d, s), 0), quotas[0].get((d, s), 0)) for d, s in cells] or [("", "", 0, 0)], "_d string, _s string, _v long, _t long")
    ranked = with_group_rank(keyed, ["_d", "_s"], F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key, rank="_k")
    out = ranked.join(F.broadcast(bounds), ["_d", "_s"])
    split = F.when(F.col("_k") <= F.col("_v"), "val").when(F.col("_k") <= F.col("_v") + F.col("_t"), "train")
    return out.withColumn("split", split).where("split is not null").drop("_d", "_s", "_v", "_t", "_k")


def even_targets(names: list[str], total: int) -> dict[str, int]:
    """`total` over names: equal shares, the first names take one more."""
    base, more = divmod(total, len(names))
    return {n: base + (i < more) for i, n in enumerate(names)}


def quota_rounds(df: DataFrame, domain: str, text: str, key: str, targets: dict[str, int]) -> DataFrame:
    """Of each domain its target of rows in the order of keys, after rows of a domain with an equal text but the first are dropped."""
    # rows of one domain and text are aggregated to their first key, so a text that many rows have is no burden
    firsts = df.groupBy(domain, F.sha2(F.lower(F.trim(text)), 256)).agg(F.min(key).alias("_first")).select("_first")
    unique = df.join(firsts, F.col(key) == F.col("_first"), "left_semi")
    goal = F.element_at(F.create_map(*[x for n, t in targets.items() for x in (F.lit(n), F.lit(t))]), F.col(domain))
    return with_group_rank(unique, [domain], key, rank="_k").where(F.col("_k") <= goal).drop("_k")
