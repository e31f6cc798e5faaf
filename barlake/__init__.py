"""barlake: a PySpark-native toolkit for market-data lakes."""
