"""Finding and replacing personal data in Spark frames."""
