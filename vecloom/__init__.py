"""PySpark-native nearest-neighbour search over large collections of embeddings."""
