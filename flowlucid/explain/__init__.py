"""Model explanations as tables: Shapley values, local surrogates, dependence, importance."""
