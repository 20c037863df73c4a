"""Dispatch of parsed calls to the demonstration tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLORS = ("red", "blue", "green", "yellow", "purple", "orange")


def dispatch(name: Column, args: Column) -> Column:
    """The result as JSON of a call with args map<string,string>."""
    ok = lambda m: F.to_json(F.struct(F.lit("success").alias("status"), m.alias("message")))
    bad = lambda *x: F.to_json(F.struct(*x))
    title, color = args["title"], F.lower(args["color"])
    return (
        F.when((name == "change_app_title") & (F.coalesce(title, F.lit("")) != ""), ok(F.concat(F.lit('App title changed to "'), title, F.lit('"'))))
        .when(name == "change_app_title", bad(F.lit("Title cannot be empty").alias("error")))
        .when((name == "change_background_color") & F.coalesce(color.isin(*COLORS), F.lit(False)), ok(F.concat(F.lit("Background color changed to "), color)))
        .when(name == "change_background_color", bad(F.lit("Color not supported").alias("error"), F.array(*map(F.lit, COLORS)).alias("available_colors")))
        .when(name == "show_alert", ok(F.concat(F.lit('Alert dialog shown with title "'), F.coalesce(title, F.lit("Alert")), F.lit('"'))))
        .otherwise(bad(F.lit("Tool not found").alias("error")))
    )
