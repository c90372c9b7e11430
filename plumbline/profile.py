"""``Profile``: one table and the shared aggregates that its operators read.

Each shared aggregate runs at most once per profile and is kept as a relation with a few rows per column, so the
operators over it are cheap DataFrame expressions. The table itself is never cached or collected.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import (
    DATETIME,
    DIGEST_OVER,
    FLOAT,
    INT,
    STRING,
    ColumnInfo,
    columns_of,
    grouping_key,
    kind_of,
    quoted,
)
from plumbline.plans import moments as moments_plan
from plumbline.plans.blocks import aggregate_arrays
from plumbline.plans.coded import CODED, Values, few_values
from plumbline.plans.frequencies import distinct_by_column, frequencies, long_values
from plumbline.plans.quantiles import approx_quantiles, exact_quantiles
from plumbline.plans.small import local, pinned

# Largest set of keys that is broadcast to look long texts up again.
BROADCAST_KEYS = 10_000
# One in so many hash values is looked at for a value that comes twice.
SLICES = 64


class Profile:
    """A profiled table.

    ``order_by`` names the columns that give the row order, for the operators that need one (head, first outliers,
    kept duplicate, sequential identifiers). ``exact=False`` swaps the exact quantiles and distinct counts for
    one-pass sketches.
    """

    def __init__(self, df: DataFrame, order_by: list[str] | str | None = None, *, exact: bool = True):
        self.df = df
        self.spark = df.sparkSession
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by or [])
        self.exact = exact
        self.columns = columns_of(df)

    def column(self, name: str) -> ColumnInfo:
        return next(c for c in self.columns if c.name == name)

    @property
    def numeric(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.is_numeric]

    @property
    def categorical(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.is_categorical]

    @property
    def datetimes(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.family == DATETIME]

    @cached_property
    def counts(self) -> DataFrame:
        """Per column: rows, nulls, bytes, mean, extremes, lengths, and the column's ``kind``."""
        df = moments_plan.counts(self.df, self.columns)
        return pinned(df.withColumn("kind", kind_of(F.col("family"), F.col("null_count"))))

    @cached_property
    def count_rows(self) -> dict[str, dict]:
        """``counts`` on the driver, by column name."""
        return {r["column_name"]: r.asDict() for r in self.counts.collect()}

    @cached_property
    def n_rows(self) -> int:
        if not self.columns:
            return 0
        return next(iter(self.count_rows.values()))["n_rows"]

    @cached_property
    def moments(self) -> DataFrame:
        """``counts`` plus variance, standard deviation and population skewness and kurtosis."""
        return pinned(moments_plan.moments(self.df, self.columns, first=self.counts))

    @cached_property
    def category_frequencies(self) -> DataFrame:
        """``(ordinal, s, n)`` of the string and boolean columns."""
        return frequencies(self.df, self.categorical)

    @cached_property
    def distinct(self) -> DataFrame:
        """Per column: ``ndv``, the smallest most frequent value (text and number), its count, and two extremes."""
        if not self.exact:
            return self._distinct_by_sketch()
        found = distinct_by_column(self.df, self.columns)
        all_columns = self.counts.select("ordinal", "column_name", "family")
        stamp = F.timestamp_micros("mode_l").cast("string")  # with the part of a second, if there is one
        joined = (
            all_columns.join(found, "ordinal", "left")
            .withColumn("ndv", F.coalesce("ndv", F.lit(0)))
            .withColumn("mode_n", F.coalesce("mode_n", F.lit(0)))
            .withColumn("mode_number", F.coalesce("mode_d", F.when(F.col("family") == "int", F.col("mode_l"))))
            .withColumn(
                "mode_text",
                F.when(F.col("family") == DATETIME, stamp).otherwise(
                    F.coalesce("mode_s", F.col("mode_l").cast("string"), F.col("mode_d").cast("string"))
                ),
            )
            .select(
                "ordinal", "column_name", "ndv", "mode_n", "mode_ties", "mode_number", "mode_text",
                *[
                    F.coalesce(f"{end}_s", F.col(f"{end}_l").cast("string"), F.col(f"{end}_d").cast("string"))
                    .alias(f"{end}_text")
                    for end in ("min", "max")
                ],
            )
        )
        return self._with_long_modes(pinned(joined))

    def _with_long_modes(self, distinct: DataFrame) -> DataFrame:
        """Put the real text where the mode of a column with long texts is known only by digest."""
        texts = {}
        for r in distinct.collect():
            info = self.columns[r["ordinal"]]
            longest = self.count_rows[info.name]["max_len"]
            if info.family != STRING or not longest or longest <= DIGEST_OVER:
                continue
            keyed = self.df.select(info.value().alias("v"), grouping_key(info).alias("k")).where("v IS NOT NULL")
            if r["mode_n"] == 1:  # every value is tied
                wanted = keyed
            else:
                tied = (
                    keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") == r["mode_n"]).select("k")
                )
                if r["mode_ties"] <= BROADCAST_KEYS:
                    wanted = keyed.join(F.broadcast(tied), "k", "left_semi")
                else:
                    # one row per distinct text before the shuffled join, so no key is hot
                    wanted = keyed.groupBy("k").agg(F.min("v").alias("v")).join(tied, "k", "left_semi")
            texts[r["ordinal"]] = wanted.agg(F.min("v")).first()[0]
        if not texts:
            return distinct
        pairs = [F.lit(x) for kv in texts.items() for x in kv]
        long_mode = F.create_map(*pairs)[F.col("ordinal")]
        return distinct.withColumn("mode_text", F.coalesce(long_mode, F.col("mode_text")))

    def cardinalities(self, columns: list[ColumnInfo]) -> dict[int, int]:
        """About how many values each column has, by ordinal: the exact numbers where they are known, else a sketch's."""
        if "distinct" in self.__dict__:  # has run already
            found = {r["ordinal"]: r["ndv"] for r in self.distinct.select("ordinal", "ndv").collect()}
            return {c.ordinal: found[c.ordinal] for c in columns}
        sketched = self.__dict__.setdefault("sketched", {})
        missing = [c for c in columns if c.ordinal not in sketched]
        found = aggregate_arrays(self.df, [{c.ordinal: F.array(F.approx_count_distinct(grouping_key(c)))} for c in missing])
        sketched |= {k: int(v[0]) for k, v in found.items()}
        return {c.ordinal: sketched[c.ordinal] for c in columns}

    @cached_property
    def small_values(self) -> dict[int, Values]:
        """The values of each column that has few, by ordinal."""
        return few_values(self.df, self.columns, CODED)

    @cached_property
    def rule_counts(self) -> DataFrame:
        """Per column: ``ndv`` as far as rules ask for it, and the extremes of columns with few or all different values.

        Rules ask whether a column has few values, or a different one in every row. One scan finds the values of columns
        with ``CODED`` at most, and most columns in which one comes twice. In the others a value that comes twice
        is looked for where its hash falls into one of ``SLICES``. Only what may still be all different is counted whole.
        ``ndv`` is exact for those and for few values; for other columns it is ``CODED`` + 1, the least it can be.
        """
        if "distinct" in self.__dict__ or not self.exact:
            return self.distinct.select("ordinal", "column_name", "ndv", "min_text", "max_text")
        found = self.small_values
        open_ = [c for c in self.columns if found[c.ordinal].values is None and not found[c.ordinal].repeated]
        if open_:
            values = long_values(self.df, open_)
            slots = [s for s in values.columns if s != "ordinal"]
            part = values.where(F.pmod(F.xxhash64(*slots), F.lit(SLICES)) == 0)
            repeated = part.groupBy(*values.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ordinal").distinct()
            twice = {r["ordinal"] for r in repeated.collect()}
            open_ = [c for c in open_ if c.ordinal not in twice]
        whole = {}
        if open_:
            ends = [
                F.coalesce(f"{end}_s", F.col(f"{end}_l").cast("string"), F.col(f"{end}_d").cast("string")).alias(f"{end}_text")
                for end in ("min", "max")
            ]
            whole = {r["ordinal"]: tuple(r)[1:] for r in distinct_by_column(self.df, open_).select("ordinal", "ndv", *ends).collect()}
        rows = []
        for c in self.columns:
            values = found[c.ordinal].values
            if values is None:
                rows.append((c.ordinal, c.name, *whole.get(c.ordinal, (CODED + 1, None, None))))
            else:
                numbers = [float(v) for v in values] if c.family == FLOAT else values
                rows.append((c.ordinal, c.name, len(values), *(str(end(numbers)) if values else None for end in (min, max))))
        return local(self.spark, rows, "ordinal int, column_name string, ndv bigint, min_text string, max_text string")

    def _distinct_by_sketch(self) -> DataFrame:
        """``distinct`` with estimated counts and no modes, and the extremes of columns with two values."""
        about = self.cardinalities(self.columns)
        ends: dict[int, tuple] = {}
        two = [c for c in self.columns if about[c.ordinal] == 2]
        for c in two:
            facts = self.count_rows[c.name]
            if c.is_numeric and facts["min_num"] is not None:
                shown = (lambda x: str(int(x))) if c.family == INT else repr
                ends[c.ordinal] = (shown(facts["min_num"]), shown(facts["max_num"]))
        texts = [c for c in two if c.family == STRING]
        if texts:
            both = [F.array(F.min(grouping_key(c)), F.max(grouping_key(c))).alias(f"c{c.ordinal}") for c in texts]
            found = self.df.agg(*both).first()
            ends |= {c.ordinal: tuple(found[f"c{c.ordinal}"]) for c in texts}
        schema = (
            "ordinal int, column_name string, ndv bigint, mode_n bigint, mode_ties bigint, mode_number double,"
            " mode_text string, min_text string, max_text string"
        )
        rows = [(c.ordinal, c.name, about[c.ordinal], *[None] * 4, *ends.get(c.ordinal, (None, None))) for c in self.columns]
        return local(self.spark, rows, schema)

    @cached_property
    def quartiles(self) -> dict[str, list[float]]:
        """First quartile, median and third quartile of each numeric column with any value."""
        rows = self.count_rows
        if not self.exact:
            return approx_quantiles(self.df, self.numeric)
        infinite = {}
        with_inf = [c for c in self.numeric if rows[c.name]["infinite"]]
        if with_inf:
            ends = [
                {c.name: F.array(*[F.count_if(c.number() == e) for e in (float("-inf"), float("inf"))])}
                for c in with_inf
            ]
            infinite = {k: (int(v[0]), int(v[1])) for k, v in aggregate_arrays(self.df, ends).items()}
        non_null = {c.name: rows[c.name]["non_null"] for c in self.numeric}
        return exact_quantiles(self.df, self.numeric, counts=non_null, infinite=infinite)

    @cached_property
    def fences(self) -> DataFrame:
        """Per numeric column: quartiles, IQR fences, rows outside them, and the extremes inside them.

        Fences are null for a column with fewer than two distinct values.
        """
        rows, groups, base = self.count_rows, [], []
        for c in self.numeric:
            facts = rows[c.name]
            q = self.quartiles.get(c.name)
            if q is None:
                base.append((c.ordinal, c.name, 0, None, None, None, None, None, None))
                continue
            iqr = q[2] - q[0]
            lo = hi = None
            if facts["min_num"] < facts["max_num"]:
                lo, hi = q[0] - 1.5 * iqr, q[2] + 1.5 * iqr
                x = c.number()
                groups.append(
                    {
                        c.ordinal: F.array(
                            F.count_if((x < lo) | (x > hi)).cast("double"),
                            F.min(F.when(x >= lo, x)),
                            F.max(F.when(x <= hi, x)),
                        )
                    }
                )
            base.append((c.ordinal, c.name, facts["non_null"], *q, iqr, lo, hi))
        found = aggregate_arrays(self.df, groups)
        schema = (
            "ordinal int, column_name string, non_null bigint, q1 double, median double, q3 double, iqr double,"
            " lower double, upper double, outlier_count bigint, whisker_low double, whisker_high double"
        )
        data = []
        for b in base:
            inside = found.get(b[0])
            if inside:
                data.append((*b, int(inside[0]), inside[1], inside[2]))
            else:
                end = rows[b[1]]["min_num"]
                data.append((*b, 0, end, end))
        return local(self.spark, data, schema)

    @cached_property
    def distinct_rows(self) -> int:
        """Number of different rows; nulls equal each other."""
        if not self.columns:
            return 0
        return self.df.groupBy(*row_keys(self)).agg(F.count(F.lit(1)).alias("n")).count()

    def warm(self, *names: str) -> None:
        """Compute shared aggregates side by side: they are independent jobs, so the cluster need not wait between."""
        missing = [n for n in names if n not in self.__dict__]
        if len(missing) > 1:
            _ = self.count_rows  # all of them build on the counts
            with ThreadPoolExecutor(max_workers=len(missing)) as pool:
                list(pool.map(inheritable_thread_target(self.spark)(lambda n: getattr(self, n)), missing))

    def bounds(self) -> list[tuple[ColumnInfo, float, float]]:
        """Numeric columns that have fences, with those fences."""
        return [
            (self.columns[r["ordinal"]], r["lower"], r["upper"])
            for r in self.fences.where("lower IS NOT NULL").orderBy("ordinal").collect()
        ]

    def order(self):
        """The row order as sort columns; required by order-dependent operators."""
        if not self.order_by:
            raise ValueError("this operator depends on the row order: pass order_by to Profile")
        return [F.col(quoted(c)) for c in self.order_by]


def row_keys(p: Profile):
    """One bounded-size grouping key per column: long texts by digest, so that whole texts are not shuffled."""
    return [grouping_key(c).alias(f"k{c.ordinal}") for c in p.columns]


def as_profile(table: DataFrame | Profile, **options) -> Profile:
    return table if isinstance(table, Profile) else Profile(table, **options)
