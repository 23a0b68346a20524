"""Product offers of many retailers as Spark DataFrames: parsing, matching, price history, alerts."""
