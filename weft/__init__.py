"""weft: a Spark-native engine for weighted directed networks and the entity tables around them."""
