"""Energy and process analytics for plant machines, as Spark DataFrame operators."""
