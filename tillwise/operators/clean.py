"""Cleaning rules and the per-table cleaners composed from them.

Global statistics (modes, newest dates, the conditional age check) enter the plan
as scalar subqueries: one small value and no join. Quantile bounds are two
numbers fetched by a job of their own, as with ``approxQuantile``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tillwise.functions import dates, text
from tillwise.operators.ordering import mode_value, quantiles
from tillwise.session import staged

# Accepted domains and imputation order of the cleaning rules.
CUSTOMER_DOMAINS = {
    "Prefix": ["MR.", "MS.", "MRS."],
    "MaritalStatus": ["M", "S"],
    "Gender": ["M", "F", "U"],
    "EducationLevel": [
        "Bachelors", "Partial College", "High School", "Partial High School", "Graduate Degree",
    ],
    "Occupation": ["Professional", "Management", "Skilled Manual", "Clerical", "Manual"],
    "HomeOwner": ["Y", "N"],
}
PRODUCT_COLORS = [
    "Silver/Black", "Red", "Black", "White", "Blue", "Multi", "Silver", "Yellow", "Grey",
]
PRODUCT_DOMAINS = {
    "ProductColor": PRODUCT_COLORS,
    "ProductSize": [
        "0", "M", "L", "S", "XL", "62", "44", "48", "52", "56", "58", "60", "42", "46", "38",
        "40", "70", "50", "54",
    ],
    "ProductStyle": ["0", "U", "W", "M"],
}
AGE_PROXY_DATE = "2017-06-01"
LAST_VALID_DATE = "2017-06-30"


# --- row rules -------------------------------------------------------------

def keep_filled_rows(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Keep rows with at least ``floor(share * columns)`` non-null cells."""
    return df.na.drop(thresh=int(len(df.columns) * share))


def drop_repeats(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def require_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns))


def require_any(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="all", subset=list(columns))


def strip_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip whitespace from the given (default: all) string columns."""
    chosen = set(columns) if columns is not None else None
    return df.select(
        *[
            text.strip(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) and (chosen is None or f.name in chosen)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def without_digits(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~text.has_digit(F.col(column)))


def valid_emails(df: DataFrame, column: str = "EmailAddress") -> DataFrame:
    return df.filter(text.is_email(F.col(column)))


def alphabetic_names(df: DataFrame, columns: Sequence[str] = ("FirstName", "LastName")) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & text.is_alphabetic_name(F.col(c))
    return df.filter(keep)


def plausible_age(
    df: DataFrame,
    birth: str = "BirthDate",
    at: str = AGE_PROXY_DATE,
    limit: float = 100,
    strict: bool = False,
) -> DataFrame:
    """Drop customers older than ``limit`` years.

    The rule only fires when someone exceeds the limit; then unknown birthdays
    go too. ``strict=True`` keeps unknown birthdays and always applies the limit.
    """
    age = F.datediff(F.lit(at).cast("date"), F.col(birth)) / F.lit(365.25)
    if strict:
        return df.filter(age.isNull() | (age <= limit))
    fires = df.agg(F.coalesce(F.bool_or(age > limit), F.lit(False))).scalar()
    return df.filter(~fires | F.coalesce(age <= limit, F.lit(False)))


def within_domains(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    keep = F.lit(True)
    for column, allowed in domains.items():
        keep = keep & F.col(column).cast("string").isin(*allowed)
    return df.filter(keep)


def at_most(df: DataFrame, column: str, bound: float) -> DataFrame:
    return df.filter(F.col(column) <= bound)


def until(df: DataFrame, column: str, last: str = LAST_VALID_DATE) -> DataFrame:
    """Guardrail: keep dates up to and including ``last`` (NULL dates drop)."""
    return df.filter(F.col(column) <= F.lit(last).cast("date"))


def since(df: DataFrame, column: str, first: str = "2016-08-01") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(first).cast("date"))


def trailing_days(df: DataFrame, column: str, days: int = 365) -> DataFrame:
    """Rows not older than ``days`` before the newest date."""
    newest = df.agg(F.max(column)).scalar()
    return df.filter(F.col(column) >= F.date_sub(newest, days))


def trim_tails(df: DataFrame, column: str, low: float | None = 0.005, high: float | None = 0.995) -> DataFrame:
    """Keep values between two exact quantiles (inclusive); ``None`` leaves a side open.

    The bounds are one scalar subquery over the same rows: no job runs while the plan is built.
    """
    probs = {name: p for name, p in (("low", low), ("high", high)) if p is not None}
    if not probs:
        return df
    bounds = quantiles(df, column, list(probs.values()), names=list(probs)).select(F.struct(*probs)).scalar()
    if low is not None:
        df = df.filter(F.col(column) >= bounds["low"])
    if high is not None:
        df = df.filter(F.col(column) <= bounds["high"])
    return df


def trim_top(df: DataFrame, column: str, high: float = 0.99) -> DataFrame:
    return trim_tails(df, column, None, high)


def currency_column(df: DataFrame, column: str) -> DataFrame:
    """Money text to double; rows that do not parse are dropped."""
    return df.withColumn(column, text.currency_or_null(F.col(column))).na.drop(subset=[column])


def numeric_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.number_or_null(F.col(column)))


def date_column(df: DataFrame, column: str, formats: Sequence[str] = dates.DAY_FIRST) -> DataFrame:
    return df.withColumn(column, dates.parse_date(F.col(column), formats))


# --- imputations -----------------------------------------------------------

def impute_gender(df: DataFrame, names: DataFrame) -> DataFrame:
    """Fill a missing Gender from a ``(first_name, gender)`` table; unknown is ``U``.

    The table may say ``male``/``mostly_male``/``female``/``mostly_female`` or M/F.
    """
    label = F.lower(F.col("gender"))
    guess = (
        F.when(label.contains("female") | (label == "f"), "F")
        .when(label.contains("male") | (label == "m"), "M")
    )
    lookup = names.groupBy(F.col("first_name").alias("_name")).agg(F.min(guess).alias("_guess"))
    return (
        df.join(lookup, F.col("FirstName") == F.col("_name"), "left")
        .withColumn("Gender", F.coalesce("Gender", "_guess"))
        .drop("_name", "_guess")
    )


def impute_prefix(df: DataFrame) -> DataFrame:
    """Fill Prefix from gender and marital status, then from the most common one."""
    implied = (
        F.when(F.col("Gender") == "M", "MR.")
        .when((F.col("Gender") == "F") & (F.col("MaritalStatus") == "M"), "MRS.")
        .when(F.col("Gender") == "F", "MS.")
    )
    filled = df.withColumn("Prefix", F.coalesce("Prefix", implied))
    return filled.withColumn("Prefix", F.coalesce("Prefix", mode_value(filled, "Prefix"))).withColumn(
        "Gender", F.coalesce("Gender", F.lit("U"))
    )


def impute_color(df: DataFrame, colors: Sequence[str] = tuple(PRODUCT_COLORS)) -> DataFrame:
    """Fill a missing colour from the product name, else with the most common colour."""
    present = F.when(F.lower("ProductColor") != "nan", F.col("ProductColor"))
    return df.withColumn(
        "ProductColor",
        F.coalesce(
            present,
            text.first_contained(F.col("ProductName"), colors),
            mode_value(df, "ProductColor"),
        ),
    )


def fill(df: DataFrame, fills: Mapping[str, Column | int | float | str]) -> DataFrame:
    """Replace NULLs by a constant, another expression or a scalar subquery."""
    for column, value in fills.items():
        value = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(column, F.coalesce(F.col(column), value))
    return df


# --- table cleaners --------------------------------------------------------

def customers(df: DataFrame, names: DataFrame, age_at: str = AGE_PROXY_DATE) -> DataFrame:
    df = require_any(drop_repeats(keep_filled_rows(df)), ["FirstName", "LastName"])
    df = strip_text(df)
    df = df.withColumn("BirthDate", F.col("BirthDate").cast("string").try_cast("date"))
    # The age test, the most frequent gender and the rows themselves read the parsed table: write it once.
    df = plausible_age(staged(df, "customers"), at=age_at)
    df = impute_prefix(impute_gender(df, names))
    df = currency_column(within_domains(df, CUSTOMER_DOMAINS), "AnnualIncome")
    df = alphabetic_names(valid_emails(df))
    return trim_tails(staged(at_most(df, "TotalChildren", 15), "customers"), "AnnualIncome")


def products(df: DataFrame) -> DataFrame:
    df = require_all(drop_repeats(keep_filled_rows(df)), ["ProductSubcategoryKey"])
    df = staged(impute_color(strip_text(df)), "products")
    for column in ("ProductPrice", "ProductCost"):
        df = trim_tails(require_all(numeric_column(df, column), [column]), column)
    return within_domains(df, PRODUCT_DOMAINS)


def calendar(
    df: DataFrame, last: str = LAST_VALID_DATE, formats: Sequence[str] = dates.DAY_FIRST
) -> DataFrame:
    return until(date_column(require_all(df, ["Date"]), "Date", formats), "Date", last)


def subcategories(df: DataFrame, name: str = "SubcategoryName") -> DataFrame:
    df = require_all(drop_repeats(df), [name])
    return without_digits(strip_text(df, [name]), name)


def categories(df: DataFrame) -> DataFrame:
    return subcategories(df, "CategoryName")


def territories(df: DataFrame) -> DataFrame:
    df = require_any(drop_repeats(df), ["Country", "Region"])
    return strip_text(df, ["Region", "Country", "Continent"])


SALES_KEY = ("OrderDate", "OrderNumber", "ProductKey", "CustomerKey", "TerritoryKey")


def merge_sale_lines(df: DataFrame) -> DataFrame:
    """Add up quantities of repeated sale lines.

    Rows with a missing key part are left out. Which stock date and line number
    survive is made repeatable by taking the smallest (stock date, line) pair.
    """
    first = F.min(F.struct("StockDate", "OrderLineItem"))
    return (
        require_all(df, SALES_KEY)
        .groupBy(*SALES_KEY)
        .agg(F.sum("OrderQuantity").alias("OrderQuantity"), first.alias("_first"))
        .select(
            *SALES_KEY,
            "OrderQuantity",
            F.col("_first.StockDate").alias("StockDate"),
            F.col("_first.OrderLineItem").alias("OrderLineItem"),
        )
    )


def sales(
    df: DataFrame, last: str = LAST_VALID_DATE, formats: Sequence[str] = dates.DAY_FIRST
) -> DataFrame:
    df = date_column(date_column(df, "OrderDate", formats), "StockDate", formats)
    df = until(df, "OrderDate", last)
    df = require_all(df, ["OrderDate", "OrderNumber", "ProductKey", "CustomerKey", "OrderQuantity"])
    # Both the quantile and the result read the merged lines: parse and shuffle them once.
    merged = staged(merge_sale_lines(strip_text(df, ["OrderNumber"])), "sales")
    return trim_top(merged, "OrderQuantity").withColumn(
        "OrderQuantity", F.col("OrderQuantity").cast("int")
    )


def returns(df: DataFrame, formats: Sequence[str] = dates.DAY_FIRST) -> DataFrame:
    df = require_all(drop_repeats(df), ["ReturnQuantity", "ReturnDate", "ProductKey"])
    df = trim_top(df.withColumn("ReturnQuantity", F.col("ReturnQuantity").cast("int")), "ReturnQuantity")
    return require_all(date_column(df, "ReturnDate", formats), ["ReturnDate"])


def price_events(df: DataFrame) -> DataFrame:
    df = numeric_column(numeric_column(drop_repeats(df.na.drop()), "ProductPrice"), "OrderQuantity")
    return strip_text(df.na.drop(), ["event"])


def as_csv_dates(df: DataFrame) -> DataFrame:
    """Render every date column as ``DD-MM-YYYY`` text for the CSV sink."""
    return df.select(
        *[
            dates.day_text(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.DateType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
