"""Spark-native spatial analytics: joins, weights, autocorrelation, OLS, validation."""
