"""Ordered funnels over events, counted by one reverse sweep.

Every row of a funnel's first kind starts an attempt. The next step is the key's earliest row of its kind at a
later time; it is reached unless it comes over `within` after the step before, or a row of an excluded kind
lies after that step and not after the next one. The sweep takes the timestamp groups of a key from the last to the first.
For each funnel it keeps, for every step but the first, the ready-made chain that begins at the next row of that step,
and the next excluded time. A group reads only what later groups left: its step's row is put before the chain of
the following step if that is near enough and no exclusion comes between; a first step so has its whole attempt at once.

A key's rows are cut into cells of `cell` of time, each with the rows that an attempt begun in it can still reach
(`within` times the steps that follow), so a key that holds most rows is many tasks' work. Percentiles
are found digit by digit: at each level a key's values are counted in at most 1,024 bins and only those of the
bin that holds the rank go on, so no task gets a key's values.

Defined results: rows without a key, kind or time take no part; rows equal in all three are one; times of one value are
one group, whose rows never follow each other; keys without attempts give no row; an empty table gives an empty result;
other columns are not read. Times without a zone are taken as they are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .common import cut, stored

MINUTE = 60_000_000
#: Width of a cell in microseconds: an eighth is added by rows that the cell before also needs, if attempts span 45 minutes.
CELL = 360 * MINUTE
#: Bits of a digit.
DIGIT = 10


@dataclass(frozen=True)
class Funnel:
    """Steps in order, and the kinds that end an attempt."""

    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()


#: The contract's funnels and longest time between steps.
SHOP = (Funnel("A", ("view", "click", "view", "purchase"), ("error",)), Funnel("B", ("signup", "view", "click", "purchase"), ("error",)), Funnel("C", ("click", "click", "purchase", "view"), ("signup",)))
WITHIN = 15 * MINUTE


def micros(df: DataFrame, at: str) -> Column:
    """Microseconds since 1970; of a time without a zone as if it were in UTC."""
    if not isinstance(df.schema[at].dataType, TimestampNTZType):
        return F.unix_micros(F.col(at))
    minutes = (F.unix_date(F.col(at).cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * MINUTE + (F.extract(F.lit("SECOND"), F.col(at)) * 1_000_000).cast("long")


def attempts(events: DataFrame, funnels: tuple[Funnel, ...], within: int, key: str = "client_id", kind: str = "kind", at: str = "ts", cell: int = CELL) -> DataFrame:
    """funnel, key, started (microseconds) and gaps of each attempt: the microseconds from each reached step to the next one."""
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
    bit = {k: 1 << i for i, k in enumerate(kinds)}
    span = within * (max(len(f.steps) for f in funnels) - 1)
    of_kind = reduce(lambda rest, k: F.when(F.col(kind) == k, bit[k]).otherwise(rest), kinds, F.lit(0))
    rows = events.where(F.col(kind).isin(kinds) & F.col(key).isNotNull() & F.col(at).isNotNull())
    groups = rows.select(F.col(key).alias("key"), micros(rows, at).alias("t"), of_kind.alias("bit")).groupBy("key", "t").agg(F.bit_or("bit").alias("bits"))
    place = lambda t: F.expr(f"({t} - pmod({t}, {cell}L)) div {cell}L")
    dealt = groups.withColumn("own", place("t")).withColumn("cell", F.explode(F.sequence(place(f"(t - {span}L)"), F.col("own"))))
    dealt = dealt.select("key", "cell", "t", "bits", (F.col("cell") == F.col("own")).alias("own"))
    # What each set of kinds does: for each funnel the steps that it takes, in order, and whether it ends attempts.
    acts = []
    for bits in range(1 << len(kinds)):
        does = [(i, len(f.steps), [k for k, s in enumerate(f.steps) if bits & bit[s]], any(bits & bit[x] for x in f.excluded)) for i, f in enumerate(funnels)]
        acts.append([d for d in does if d[2] or d[3]])
    names, never = [f.name for f in funnels], 1 << 62

    def sweep(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chains, ends = None, [], []
        for table in tables:
            funnel, of, started, gaps = [], [], [], []
            for who, part, t, bits, own in zip(*(table.column(i).to_pylist() for i in range(5))):
                if (who, part) != now:
                    now, chains, ends = (who, part), [[()] * (len(f.steps) + 1) for f in funnels], [never] * len(funnels)
                for i, _, steps, excluded in acts[bits]:
                    chain, end = chains[i], ends[i]
                    for k in steps:  # ascending: a step reads its follower's chain before this group changes it
                        ahead = chain[k + 1]
                        reach = (t, *ahead) if ahead and ahead[0] - t <= within and ahead[0] < end else (t,)
                        if k:
                            chain[k] = reach
                        elif own:
                            funnel.append(names[i])
                            of.append(who)
                            started.append(t)
                            gaps.append([b - a for a, b in zip(reach, reach[1:])])
                    if excluded:
                        ends[i] = t
            yield pa.RecordBatch.from_arrays([pa.array(funnel, pa.string()), pa.array(of, table.schema.field(0).type), pa.array(started, pa.int64()), pa.array(gaps, pa.list_(pa.int64()))], ["funnel", key, "started", "gaps"])

    kind_of_key = groups.schema["key"].dataType.simpleString()
    ordered = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", F.desc("t"))
    return ordered.mapInArrow(sweep, f"funnel string, `{key}` {kind_of_key}, started bigint, gaps array<bigint>")


def ranked(values: DataFrame, keys: list[str], value: str, share: int, top: int) -> DataFrame:
    """keys and value: the ceil(share * n / 100)-th smallest of each key's n values, which are whole numbers from 0 to `top`."""
    left = cut(values.groupBy(*keys, value).agg(F.count("*").alias("n")))
    levels = max(1, -(-top.bit_length() // DIGIT))
    picked = None
    for level in range(levels):
        left = left.withColumn("bin", F.shiftright(value, DIGIT * (levels - 1 - level)))
        if picked is not None:
            left = cut(left.join(picked, [*keys, "above"]).drop("above"))
        bins = left.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), *([F.first("want").alias("want")] if level else []))
        whole, run = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        bins = bins.withColumn("upto", F.sum("n").over(run))
        if not level:
            bins = bins.withColumn("want", F.ceil(F.sum("n").over(whole) * share / 100))
        picked = bins.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).select(*keys, F.col("bin").alias("above"), (F.col("want") - F.col("upto") + F.col("n")).alias("want"))
        left = left.drop("want").withColumnRenamed("bin", "above") if level < levels - 1 else left
    return picked.select(*keys, F.col("above").alias(value))


def funnel_report(events: DataFrame, funnels: tuple[Funnel, ...], within: int, share: int = 50, key: str = "client_id", kind: str = "kind", at: str = "ts") -> DataFrame:
    """For each funnel and key with attempts: n1, n2, ... attempts that reach each step, deepest, t2, t3, ... (the given
    percentile of the times from the step before), and same_depth, the keys of equal funnel and deepest."""
    steps = max(len(f.steps) for f in funnels)
    made = stored(attempts(events, funnels, within, key, kind, at))
    counts = made.groupBy("funnel", key).agg(*[F.count_if(F.size("gaps") >= k).cast("long").alias(f"n{k + 1}") for k in range(steps)], (F.max(F.size("gaps")) + 1).cast("int").alias("deepest"))
    gaps = made.select("funnel", key, F.posexplode("gaps").alias("step", "gap"))
    times = ranked(gaps, ["funnel", key, "step"], "gap", share, within)
    times = times.groupBy("funnel", key).agg(*[F.max(F.when(F.col("step") == k, F.col("gap"))).alias(f"t{k + 2}") for k in range(steps - 1)])
    depth = counts.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    out = counts.join(times, ["funnel", key], "left").join(F.broadcast(depth), ["funnel", "deepest"])  # a row for each step of a funnel
    return out.select("funnel", key, *[f"n{k + 1}" for k in range(steps)], "deepest", *[f"t{k + 2}" for k in range(steps - 1)], "same_depth")


def funnel_digest(clicks: DataFrame) -> DataFrame:
    """The contract's funnels over clicks."""
    return funnel_report(clicks, SHOP, WITHIN)


def _oracle() -> str:
    kinds = sorted({k for f in SHOP for k in (*f.steps, *f.excluded)})
    following = ", ".join(f"min(CASE WHEN kinds LIKE '%{k};%' THEN t END) OVER w AS next_{k}" for k in kinds)
    parts = []
    for f in SHOP:
        sql = "SELECT client_id, t AS t1 FROM n WHERE kinds LIKE '%{};%'".format(f.steps[0])
        for i, k in enumerate(f.steps[1:], 2):
            have = ", ".join(f"a.t{j}" for j in range(1, i))
            sql = f"SELECT a.client_id, {have}, CASE WHEN next_{k} - t <= {WITHIN} AND (next_{f.excluded[0]} IS NULL OR next_{f.excluded[0]} > next_{k}) THEN next_{k} END AS t{i} FROM ({sql}) a LEFT JOIN n ON n.client_id = a.client_id AND n.t = a.t{i - 1}"
        parts.append(f"SELECT '{f.name}' AS funnel, * FROM ({sql})")
    ranks = ", ".join(f"row_number() OVER (PARTITION BY funnel, client_id ORDER BY t{i} - t{i - 1} NULLS LAST) AS r{i}" for i in (2, 3, 4))
    return f"""
WITH g AS (SELECT client_id, epoch_us(ts) AS t, string_agg(DISTINCT kind || ';', '') AS kinds FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL GROUP BY ALL
), n AS (SELECT *, {following} FROM g WINDOW w AS (PARTITION BY client_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), a AS ({" UNION ALL ".join(parts)}
), c AS (SELECT funnel, client_id, count(t1)::BIGINT AS n1, count(t2)::BIGINT AS n2, count(t3)::BIGINT AS n3, count(t4)::BIGINT AS n4 FROM a GROUP BY ALL
), r AS (SELECT *, {ranks} FROM a
), q AS (SELECT funnel, client_id, {", ".join(f"max(CASE WHEN r{i} = (n{i} + 1) // 2 THEN t{i} - t{i - 1} END) AS t{i}" for i in (2, 3, 4))} FROM r JOIN c USING (funnel, client_id) GROUP BY ALL
), d AS (SELECT *, (1 + (n2 > 0)::INT + (n3 > 0)::INT + (n4 > 0)::INT)::INTEGER AS deepest FROM c)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, q.t2, q.t3, q.t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM d JOIN q USING (funnel, client_id)
"""


ORACLE = _oracle()
