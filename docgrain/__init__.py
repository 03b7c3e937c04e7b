"""docgrain: document evidence analytics expressed as Spark DataFrame transformations."""
