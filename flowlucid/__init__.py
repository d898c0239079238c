"""Spark-native analytics and explainability for labelled network flows.

Every operator takes and returns a DataFrame (or a Column); nothing here holds
rows on the driver beyond per-class, per-week or per-model summaries.
"""
