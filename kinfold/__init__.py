"""kinfold: a PySpark-native engine that folds many records of one person into one profile."""
