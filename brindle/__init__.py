"""brindle: review analytics on Spark, expressed as DataFrame transformations."""
