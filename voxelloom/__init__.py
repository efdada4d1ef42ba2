"""voxelloom: a Spark-native engine for 3D scene tables and corpus preparation."""
