"""A Spark-native engine for panel time series: similarity forecasting, regimes and walk-forward evaluation."""
