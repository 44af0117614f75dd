"""News-text and exchange-rate analytics as composable Spark DataFrame operators."""
