"""The preparation steps that the findings call for, as transforms of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import STRING, quoted
from plumbline.operators.association import rank_pairs
from plumbline.operators.cardinality import constant_columns
from plumbline.operators.numeric import skewness_kurtosis
from plumbline.operators.semantics import ignored_columns
from plumbline.plans.lookup import lookup
from plumbline.plans.running import running_total
from plumbline.profile import Profile, as_profile

# Most indicator columns one column may turn into.
ONE_HOT_LIMIT = 200

# Upper limits (exclusive) of the named bands; the last band is open.
AGE_BANDS = ((13.0, "Child"), (30.0, "Young Adult"), (60.0, "Adult"), (None, "Senior"))
BMI_BANDS = ((18.5, "Underweight"), (25.0, "Normal"), (30.0, "Overweight"), (None, "Obese"))


def drop_identifiers(table: DataFrame | Profile) -> DataFrame:
    """The table without identifier columns."""
    p = as_profile(table)
    return p.df.drop(*ignored_columns(p))


def drop_constants(table: DataFrame | Profile) -> DataFrame:
    """The table without columns of at most one distinct value."""
    p = as_profile(table)
    return p.df.drop(*[r["column_name"] for r in constant_columns(p).collect()])


def impute_median(table: DataFrame | Profile, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers replaced by the column's exact median; columns with gaps become doubles."""
    p = as_profile(table)
    filled = {}
    for c in p.numeric:
        gaps = p.count_rows[c.name]["null_count"] > 0
        if gaps and (columns is None or c.name in columns) and c.name in p.quartiles:
            filled[c.name] = F.coalesce(c.number(), F.lit(p.quartiles[c.name][1]))
    return p.df.withColumns(filled)


def impute_mode(table: DataFrame | Profile, columns: list[str] | None = None) -> DataFrame:
    """Missing categories replaced by the column's mode."""
    p = as_profile(table)
    if not p.exact:  # sketches know no modes
        p = Profile(p.df)
    modes = {r["column_name"]: r["mode_text"] for r in p.distinct.select("column_name", "mode_text").collect()}
    filled = {}
    for c in p.categorical:
        if (columns is None or c.name in columns) and modes[c.name] is not None:
            filled[c.name] = F.coalesce(c.value(), F.lit(modes[c.name]).cast(c.data_type))
    return p.df.withColumns(filled)


def one_hot(table: DataFrame | Profile, column: str, limit: int = ONE_HOT_LIMIT) -> DataFrame:
    """The column replaced by one 0/1 column per value, named ``<column>_<value>`` in value order.

    Raises an error for more than ``limit`` values; ``one_hot_sparse`` takes any number of them.
    """
    p = as_profile(table)
    c = p.column(column)
    values = p.df.select(c.value().alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values; use one_hot_sparse instead")
    flags = {
        f"{column}_{v}": F.coalesce((c.value() == F.lit(v)).cast("int"), F.lit(0)) for v in sorted(r["v"] for r in values)
    }
    return p.df.withColumns(flags).drop(column)


def value_codes(table: DataFrame | Profile, column: str) -> DataFrame:
    """``(<column>, n, code)``: each value of the column, the rows that hold it, and its number from 0 in value order."""
    p = as_profile(table)
    value = p.column(column).value()
    counted = p.df.select(value.alias(column)).where(F.col(quoted(column)).isNotNull()).groupBy(quoted(column))
    counted = counted.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1).cast("bigint"))
    text = column if p.column(column).family == STRING else None
    numbered = running_total(counted, [F.asc(quoted(column))], "_one", "_number", text=text)
    return numbered.select(quoted(column), "n", (F.col("_number") - 1).alias("code"))


def one_hot_sparse(table: DataFrame | Profile, column: str) -> DataFrame:
    """The column replaced by ``<column>_one_hot``, a sparse vector: its size, the place of the 1 and the 1 itself.

    Places follow the values' order, as the columns of ``one_hot`` do. A missing value gives a vector of zeros. The values
    are numbered by range partitions and joined to the rows, so there may be any number of them.
    """
    p = as_profile(table)
    codes = value_codes(p, column)
    size = codes.agg(F.count(F.lit(1)).alias("c")).first()["c"]
    df, out = p.df, f"{column}_one_hot"
    joined = lookup(df.withColumn(column, p.column(column).value()), [column], codes.withColumnRenamed("code", out))
    place = F.col(quoted(out))
    ones = F.when(place.isNotNull(), F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    places = F.when(place.isNotNull(), F.array(place)).otherwise(F.array().cast("array<bigint>"))
    vector = F.struct(F.lit(size).cast("bigint").alias("size"), places.alias("indices"), ones.alias("values"))
    return joined.withColumn(out, vector).select(*[quoted(c) for c in df.columns if c != column], quoted(out))


def frequency_encode(table: DataFrame | Profile, column: str) -> DataFrame:
    """Add ``<column>_freq``: the share of the rows that hold the row's value; null for a missing value."""
    p = as_profile(table)
    counted = p.df.where(p.column(column).value().isNotNull()).groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("n"))
    facts = counted.withColumn(f"{column}_freq", F.col("n") / F.lit(float(p.n_rows)))
    return lookup(p.df, [column], facts)


def target_encode(table: DataFrame | Profile, column: str, target: str, fold: Column | None = None) -> DataFrame:
    """Add ``<column>_target``: the mean target of the row's value.

    With ``fold`` the mean is taken over the rows of the other folds only, so that no row sees its own target; where
    there are none it is the mean of the whole table.
    """
    p = as_profile(table)
    out, y = f"{column}_target", p.column(target).number()
    if fold is None:
        facts = p.df.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias(out))
        return lookup(p.df, [column], facts)
    df = p.df.withColumn("_fold", fold)
    by_fold = df.groupBy(quoted(column), "_fold").agg(
        F.count(F.lit(1)).alias("n"), F.count(y).alias("m"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s")
    )
    by_value = by_fold.groupBy(quoted(column)).agg(F.sum("m").alias("m_all"), F.sum("s").alias("s_all"))
    mean = p.count_rows[target]["mean"]
    others = F.try_divide(F.col("s_all") - F.col("s"), F.col("m_all") - F.col("m"))
    facts = by_fold.join(by_value, column).select(
        quoted(column), "_fold", "n", F.coalesce(others, F.lit(mean)).alias(out)
    )
    return lookup(df, [column, "_fold"], facts).drop("_fold")


def log1p_skewed(table: DataFrame | Profile) -> DataFrame:
    """``log1p`` of the columns with absolute skewness over 1; null for values of -1 and below."""
    p = as_profile(table)
    skewed = {r["column_name"] for r in skewness_kurtosis(p).where("abs(skewness) > 1.0").collect()}
    skewed -= ignored_columns(p)
    changed = {c.name: F.when(c.number() > -1.0, F.log1p(c.number())) for c in p.numeric if c.name in skewed}
    return p.df.withColumns(changed)


def standard_scale(table: DataFrame | Profile, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns less their mean, over their population standard deviation; constants become zero."""
    p = as_profile(table)
    ignored = ignored_columns(p) if columns is None else set()
    facts = {r["column_name"]: r for r in p.moments.select("column_name", "non_null", "mean", "variance").collect()}
    scaled = {}
    for c in p.numeric:
        if c.name in ignored or (columns is not None and c.name not in columns) or not facts[c.name]["non_null"]:
            continue
        n, variance = facts[c.name]["non_null"], facts[c.name]["variance"] or 0.0
        deviation = (variance * (n - 1) / n) ** 0.5
        scaled[c.name] = (c.number() - F.lit(facts[c.name]["mean"])) / F.lit(deviation or 1.0)
    return p.df.withColumns(scaled)


def date_parts(table: DataFrame | Profile, column: str) -> DataFrame:
    """Add year, month, weekday (1 is Sunday) and a weekend flag of a datetime column."""
    df = as_profile(table).df
    c = F.col(quoted(column))
    return df.withColumns(
        {
            f"{column}_year": F.year(c),
            f"{column}_month": F.month(c),
            f"{column}_dayofweek": F.dayofweek(c),
            f"{column}_is_weekend": F.dayofweek(c).isin(1, 7),
        }
    )


def pair_ratio(table: DataFrame | Profile, top: int = 3) -> DataFrame:
    """Add ``<a>_<b>_ratio`` for the strongest pairs, positive ones first; null where b is zero."""
    p = as_profile(table)
    strong = rank_pairs(p).where(F.col("bucket").startswith("strong"))
    pairs = strong.orderBy(F.desc("bucket"), "bucket_rank").limit(top).collect()
    ratios = {
        f"{r['column_a']}_{r['column_b']}_ratio": F.try_divide(
            p.column(r["column_a"]).number(), p.column(r["column_b"]).number()
        )
        for r in pairs
    }
    return p.df.withColumns(ratios)


def _bands(x: Column, bands) -> Column:
    """Name of the band a number falls in; null for a missing number."""
    out = F.when(x.isNull(), F.lit(None))
    for limit, name in bands:
        out = out.otherwise(name) if limit is None else out.when(x < limit, name)
    return out


def bin_age(table: DataFrame | Profile, column: str) -> DataFrame:
    """Add ``<column>_group`` with the age band. The limits are this library's own."""
    p = as_profile(table)
    return p.df.withColumn(f"{column}_group", _bands(p.column(column).number(), AGE_BANDS))


def bin_bmi(table: DataFrame | Profile, column: str) -> DataFrame:
    """Add ``<column>_category`` with the body-mass-index band."""
    p = as_profile(table)
    return p.df.withColumn(f"{column}_category", _bands(p.column(column).number(), BMI_BANDS))
