"""lodestone: a PySpark-native engine for large-scale data mining, built from DataFrame-to-DataFrame operators."""
