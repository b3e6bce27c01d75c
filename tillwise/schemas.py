"""Fixed schemas of the retail tables (nothing is inferred from data)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(),
        "i": T.IntegerType(),
        "l": T.LongType(),
        "d": T.DoubleType(),
        "t": T.DateType(),
    }
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


# Raw files: dates, money text and anything that can be malformed stay text.
RAW_CUSTOMERS = _struct(
    "CustomerKey:l Prefix:s FirstName:s LastName:s BirthDate:s MaritalStatus:s Gender:s "
    "EmailAddress:s AnnualIncome:s TotalChildren:i EducationLevel:s Occupation:s HomeOwner:s"
)
RAW_PRODUCTS = _struct(
    "ProductKey:l ProductSubcategoryKey:i ProductSKU:s ProductName:s ModelName:s "
    "ProductDescription:s ProductColor:s ProductSize:s ProductStyle:s ProductCost:s ProductPrice:s"
)
RAW_CALENDAR = _struct("Date:s")
RAW_SUBCATEGORIES = _struct("ProductSubcategoryKey:i SubcategoryName:s ProductCategoryKey:i")
RAW_CATEGORIES = _struct("ProductCategoryKey:i CategoryName:s")
RAW_TERRITORIES = _struct("SalesTerritoryKey:i Region:s Country:s Continent:s")
RAW_SALES = _struct(
    "OrderDate:s StockDate:s OrderNumber:s ProductKey:l CustomerKey:l TerritoryKey:i "
    "OrderLineItem:i OrderQuantity:i"
)
RAW_RETURNS = _struct("ReturnDate:s TerritoryKey:i ProductKey:l ReturnQuantity:i")
PRICE_EVENTS = _struct("CategoryName:s ProductPrice:s OrderQuantity:s profit:d event:s")
WEEKLY_CHANNELS = _struct(
    "date:t profit:d tv_s:d ooh_s:d print_s:d facebook_i:d facebook_s:d search_clicks_p:d "
    "search_s:d competitor_sales_b:d"
)

# Number of columns each raw file is expected to carry.
EXPECTED_WIDTH = {
    "customers": 13,
    "products": 11,
    "calendar": 1,
    "subcategories": 3,
    "categories": 2,
    "territories": 4,
    "returns": 4,
}

# Documents exchanged between the analyses.
FORECAST_DOCUMENT = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("model_source", T.StringType()),
            T.StructField("confidence_level", T.StringType()),
            T.StructField("daily_forecast", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("total_horizon_volume", T.DoubleType()),
        ]
    ),
)
STOCKING_DOCUMENT = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("item_id", T.StringType()),
            T.StructField("forecasted_sales_total", T.DoubleType()),
            T.StructField("safety_stock_estimate", T.DoubleType()),
            T.StructField("total_stock_recommendation", T.DoubleType()),
            T.StructField("model_used", T.StringType()),
            T.StructField("stock_logic", T.StringType()),
        ]
    ),
)
ENCODER_DOCUMENT = T.MapType(T.StringType(), T.IntegerType())
