"""mensura: quantity take-off analytics as Spark DataFrame operators."""
