"""The best record of each duplicate group, bundle by bundle.

Fields that belong together form a bundle, which is taken whole from one record.  Of a
bundle's real values the record with the highest trust wins, then the latest, then the
smallest id.  Dependencies between bundles restrict this: values chosen for two
dependent bundles must occur together in some record of the group.  Under them the sum
of trust is maximised by branch and bound over all groups at once, one bundle a level:

- start: the best single record of a group is a solution, so its sum is the floor;
- branch: each choice made so far goes on with every value of the next bundle that
  occurs with the chosen values it depends on, and with leaving that bundle out;
- bound: the sum so far and the highest trust of each bundle still to come; a branch
  whose bound is below the floor ends;
- dominance: of a group's choices that agree in the values on which later bundles
  depend, only the best goes on, ties going by trust, time and id of the bundles in order.

Every level is made of equi-joins and aggregates, so a group may be of any size.  What is
kept of a group are the values that later bundles depend on: one choice without
dependencies, one for each value of the first bundle if the others depend on it.

Trust is 0 or more; null trust is below all.  Null group keys are left out.  Bundles none
of whose records is real, and those that fit nowhere, get null ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycrest.llm.common import checkpoint
from quarrycrest.llm.truncation import bare

#: Subject letters, number and the letter that may follow it, in upper case.
COURSE = r"^[^A-Z0-9]*([A-Z]{2,5})[^A-Z0-9]*(\d{3,4})(?:([A-Z])(?![A-Z]))?"


#: What a known trust is above an unknown one: too little to outweigh a difference of trust.
KNOWN = 1e-9
#: What rounding may take from a bound: a branch as good as the floor must not end.
ROUNDING = 1e-12


def course_code(code: Column) -> Column:
    """A course code as ``ABCD 123`` or ``ABCD 123W``, without section; null if none."""
    up = F.upper(code)
    got = lambda g: F.regexp_extract(up, COURSE, g)
    return F.when(got(1) != "", F.concat(got(1), F.lit(" "), got(2), got(3)))


def _base(rows: DataFrame, group: str, bundles: dict[str, list[str]], real: dict[str, Column], trust: str, time: str, key: str) -> DataFrame:
    """(group, rec, trust, time, v0 ...): hashes of the real values; a few numbers a row."""
    text = lambda b: F.xxhash64(*(F.lower(bare(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in bundles[b]))
    return rows.where(F.col(group).isNotNull()).select(
        group, F.col(key).cast("bigint").alias("rec"), F.coalesce(F.col(trust).cast("double") + KNOWN, F.lit(0.0)).alias("trust"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62))).alias("time"),
        *(F.when(real[b], text(b)).alias(f"v{i}") for i, b in enumerate(bundles)),
    )


def _branched(base: DataFrame, states: DataFrame, group: str, k: int, linked: list[int]) -> DataFrame:
    """Every choice with every value of bundle k that fits it, and without bundle k.

    A choice meets its values over the first bundle that it holds a value of and that k
    depends on; the others are checked.  A choice that holds none is free."""
    order = F.struct("trust", "time", (-F.col("rec")).alias("m"))
    real = lambda i: F.col(f"v{i}").isNotNull()
    together = lambda i: base.where(real(i) & real(k)).select(group, f"v{i}", f"v{k}").distinct()
    found = base.where(real(k)).groupBy(group, f"v{k}").agg(F.max(order).alias(f"o{k}"))
    out = states.withColumn(f"v{k}", F.lit(None).cast("bigint")).withColumn(f"o{k}", F.lit(None).cast(found.schema[f"o{k}"].dataType))
    free = F.lit(True)
    for at, j in enumerate(linked):
        some = states.where(free & real(j)).join(together(j), [group, f"v{j}"]).join(found, [group, f"v{k}"])
        for i in linked[at + 1 :]:
            some = some.join(together(i).withColumn("fits", F.lit(True)), [group, f"v{i}", f"v{k}"], "left").where(~real(i) | F.col("fits")).drop("fits")
        out = out.unionByName(some)
        free = free & ~real(j)
    return out.unionByName(states.where(free).join(found, group))


def levels(base: DataFrame, group: str, n: int, pairs: list[tuple[int, int]]) -> list[tuple[DataFrame, DataFrame]]:
    """For each of n bundles (branches that the bound leaves, choices that go on).

    base is (group, rec, trust, time, v0 ...).  A row has the sum of trust (total), the
    records chosen (o0 ...) and the values that later bundles depend on; n_rows, floor and
    what later bundles may bring (rest0 ...) are the group's."""
    real = lambda i: F.col(f"v{i}").isNotNull()
    filled, rest = F.lit(0), [F.lit(0.0)]
    for i in range(n):
        filled = filled + real(i).cast("int")
    for i in range(n - 1, 0, -1):
        rest.append(rest[-1] + F.coalesce(F.max(F.when(real(i), F.col("trust"))), F.lit(0.0)))
    known = ["n_rows", "floor", *(f"rest{i}" for i in range(n))]
    states = base.groupBy(group).agg(F.count("*").alias("n_rows"), F.max(F.col("trust") * filled).alias("floor"), *(x.alias(f"rest{i}") for i, x in enumerate(reversed(rest))))
    states = states.withColumn("total", F.lit(0.0))
    out = []
    for k in range(n):
        chosen = [f"o{i}" for i in range(k + 1)]
        needed = [f"v{i}" for i in range(k + 1) if any(a == i and b > k for a, b in pairs)]
        branches = _branched(base, states, group, k, [a for a, b in pairs if b == k])
        branches = branches.withColumn("total", F.col("total") + F.coalesce(F.col(f"o{k}.trust"), F.lit(0.0)))
        branches = branches.where(F.col("total") + F.col(f"rest{k}") >= F.col("floor") * (1 - ROUNDING))
        best = branches.groupBy(group, *needed).agg(F.max(F.struct("total", *chosen)).alias("best"), *(F.max(c).alias(c) for c in known))
        states = best.select(group, *needed, *known, "best.*")
        if k + 1 < n:
            states = checkpoint(states)  # the next level reads it several times
        out.append((branches, states))
    return out


def consistent(rows: DataFrame, group: str, bundles: dict[str, list[str]], real: dict[str, Column], dependencies: list[tuple[str, str]], trust: str, time: str, key: str = "rec_id") -> DataFrame:
    """(group, n_rows, <bundle>_rec ...): for each bundle the record that supplies it, with
    the highest sum of trust such that the values of each dependent pair of bundles occur
    together in a record.  bundles maps a name to its fields, real to the condition under
    which a record's bundle is real; both are in that record for a pair."""
    names = list(bundles)
    number = {b: i for i, b in enumerate(names)}
    pairs = sorted({(min(number[a], number[b]), max(number[a], number[b])) for a, b in dependencies})
    base = _base(rows, group, bundles, real, trust, time, key)
    best = levels(checkpoint(base), group, len(names), pairs)[-1][1]
    return best.select(group, "n_rows", *((-F.col(f"o{i}.m")).alias(f"{b}_rec") for i, b in enumerate(names)))
