"""Evidence graphs on Spark: typed entity pairs, panels, forecasts, links and their evaluation."""
