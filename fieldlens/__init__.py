"""fieldlens: field-sensor, weather and satellite analytics as Spark DataFrame operators."""
