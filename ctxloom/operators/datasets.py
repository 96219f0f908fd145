"""Raw tables of public retail and housing data into modelling tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import past_mean
from .prepare import by_state, fill_median, melt, star

# Columns of the public tables that the modelling tables keep.
ROSSMANN = "Date Store StoreType Assortment DayOfWeek Promo Promo2 StateHoliday SchoolHoliday CompetitionDistance Customers month day_of_month week_of_year Sales".split()
WALMART = "Date Store Dept Type IsHoliday Size Temperature Fuel_Price CPI Unemployment MarkDown1 MarkDown2 MarkDown3 MarkDown4 MarkDown5 month week_of_year year Weekly_Sales".split()
MELBOURNE = "Date Suburb Type Method Regionname CouncilArea Postcode Rooms Distance Bedroom2 Bathroom Car Landsize BuildingArea YearBuilt Propertycount month year Price".split()
M5_EVENTS = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")
M5 = ["date", "state_id", "store_id", "cat_id", "dept_id", *M5_EVENTS, "avg_sell_price", "wday", "month", "year", "day", "snap_state", "lag_7", "lag_28", "rolling_mean_7", "rolling_mean_28", "demand"]


def _text(*columns: str) -> dict[str, Column]:
    return {c: F.col(c).cast("string") for c in columns}


def rossmann(train: DataFrame, store: DataFrame) -> DataFrame:
    """Open days with sales, store facts, date parts; missing competition distance is the median of those days."""
    days = star(train, [(store, ["Store"], "left")]).where("Open = 1 AND Sales > 0").withColumn("Date", F.to_date("Date"))
    parts = {"month": F.month("Date"), "day_of_month": F.dayofmonth("Date"), "week_of_year": F.weekofyear("Date")}
    days = days.withColumns(parts | _text("DayOfWeek", "Promo", "Promo2", "SchoolHoliday", "StateHoliday", "Store"))
    return fill_median(days.withColumn("CompetitionDistance", F.col("CompetitionDistance").cast("double")), ["CompetitionDistance"]).select(*ROSSMANN)


def walmart(train: DataFrame, stores: DataFrame, features: DataFrame) -> DataFrame:
    """Weekly sales with store and week facts; no markdown is 0."""
    weeks = star(train, [(stores, ["Store"], "left"), (features, ["Store", "Date", "IsHoliday"], "left")]).withColumn("Date", F.to_date("Date"))
    parts = {"month": F.month("Date"), "week_of_year": F.weekofyear("Date"), "year": F.year("Date")}
    down = {f"MarkDown{k}": F.coalesce(F.col(f"MarkDown{k}").cast("double"), F.lit(0.0)) for k in range(1, 6)}
    return weeks.withColumns(parts | down | _text("Store", "Dept", "IsHoliday")).select(*WALMART)


def melbourne(raw: DataFrame) -> DataFrame:
    """Sold homes; numbers missing are medians of those, names missing are Unknown."""
    numbers = ["Distance", "Bedroom2", "Bathroom", "Car", "Landsize", "BuildingArea", "YearBuilt", "Propertycount"]
    sold = raw.where("Price IS NOT NULL").withColumn("Date", F.to_date("Date", "d/M/yyyy"))
    sold = sold.withColumns({"month": F.month("Date"), "year": F.year("Date")} | {c: F.col(c).try_cast("double") for c in numbers})
    named = {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("CouncilArea", "Regionname")}
    named["Postcode"] = F.coalesce(F.col("Postcode").cast("double"), F.lit(0.0)).cast("int").cast("string")
    return fill_median(sold.withColumns(named), numbers).select(*MELBOURNE)


def m5_panel(calendar: DataFrame, sales: DataFrame, prices: DataFrame, history_days: int = 0) -> DataFrame:
    """Daily demand of stores and departments with calendar, mean price, state flag, and past-only lags; rows without full lags go. history_days keeps that many last days only."""
    days = [c for c in sales.columns if c.startswith("d_")]
    days = days[-history_days:] if history_days > 0 else days
    ids = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
    long = melt(sales.select(*ids, *[F.col(d).cast("double").alias(d) for d in days]), ids, days, "d", "demand")
    demand = long.groupBy("state_id", "store_id", "cat_id", "dept_id", "d").agg(F.sum("demand").alias("demand"))
    items = sales.select("item_id", "dept_id", "store_id").distinct()
    dept_price = prices.join(items, ["item_id", "store_id"]).groupBy("store_id", "dept_id", "wm_yr_wk").agg(F.avg("sell_price").alias("avg_sell_price"))
    cal = calendar.withColumns({"date": F.to_date("date")} | {c: F.coalesce(F.col(c), F.lit("none")) for c in M5_EVENTS})
    panel = star(demand, [(cal, ["d"], "left"), (dept_price, ["store_id", "dept_id", "wm_yr_wk"], "left")])
    w = Window.partitionBy("store_id", "dept_id").orderBy("date")
    past = {f"lag_{n}": F.lag("demand", n).over(w) for n in (7, 28)} | {f"rolling_mean_{n}": past_mean(F.col("demand"), w, n) for n in (7, 28)}
    state = by_state("state_id", {s: f"snap_{s}" for s in ("CA", "TX", "WI")}).cast("int")
    panel = panel.withColumns({"day": F.dayofmonth("date"), "snap_state": state} | past)
    return fill_median(panel, ["avg_sell_price"]).na.drop(subset=list(past)).select(*M5)
