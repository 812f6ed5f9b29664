"""inkwell: a Spark-native retrieval and data-preparation engine for note vaults."""
