"""Column functions: identifiers, locations, channels and records."""
