"""docgrain subpackage."""
